"""The filter audit against plain loops over every order."""

import re
from collections import Counter
from itertools import permutations

import pytest

from changelens.llm import filter_audit

LONG = " ".join(f"word{i}" for i in range(260))
SCHEMA = "doc_id long, text string, lang string, mask int, digest string, part string, good long"


def rows():
    base = [
        (1, LONG, "en"), (2, LONG, "en"), (3, LONG, "de"), (None, LONG, "en"), (3, LONG, "de"), (4, None, None), (5, "", ""), (6, "A B C # D", "en"), (7, LONG.upper(), "en"), (8, "the the the | cat", "de"),
        (9, " ".join(["same"] * 400), "en"), (10, LONG + " $", "de"), (None, None, None), (11, "x" * 300_000, "fr"), (12, "Größe \x0b é É", "fr"), (9, "other", "en"),
    ]
    return [(*r, 7, "d", "p", 9) for r in base]


LABELS = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (6, 1, None), (6, 0, 1), (9, None, 1), (None, 1, 1), (99, 1, 1)]


def brute(documents, labels):
    first = {}
    for i, t, *_ in documents:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    found = []
    for i, t, lang, *_ in documents:
        text = t or ""
        words = re.findall("[^ \t\n\x0b\x0c\r]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and i > first[text],
        }
        said = [x for x in labels if x[0] == i and i is not None]
        found.append((lang or "", {k for k, v in fails.items() if v}, any(x[1] == 1 for x in said), any(x[2] == 1 for x in said)))
    out = []
    for part in {x[0] for x in found}:
        own, total, rows = [x for x in found if x[0] == part], Counter(), []
        for order in permutations("ABCDE"):
            alive = own
            for step, f in enumerate(order, 1):
                gone, stay = [x for x in alive if f in x[1]], [x for x in alive if f not in x[1]]
                total[f] += len(gone)
                rows.append((part, "".join(order), step, len(stay), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone), f))
                alive = stay
        out += [(*r[:-1], total[r[-1]]) for r in rows]
    return Counter(out)


def test_every_order_once_by_single_swaps():
    for n in (1, 2, 5):
        seen = list(filter_audit.transpositions(n))
        assert sorted(o for o, _ in seen) == sorted(permutations(range(n)))
        for (before, _), (after, at) in zip(seen, seen[1:], strict=False):
            assert [i for i in range(n) if before[i] != after[i]] == [at, at + 1]


def test_audit(spark):
    docs, labels = spark.createDataFrame(rows(), SCHEMA), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, labels)
    assert got.columns == ["part", "filter_order", "step", *filter_audit.COUNTS]
    assert Counter(map(tuple, got.collect())) == brute(rows(), LABELS)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    no_labels = filter_audit.audit(docs, labels.limit(0))
    assert no_labels.filter("good_lost + toxic_lost > 0").count() == 0 and no_labels.count() == got.count()


def test_hot_digests_give_the_same(spark, monkeypatch):
    docs, labels = spark.createDataFrame(rows(), SCHEMA), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    monkeypatch.setattr(filter_audit, "HOT_SHARE", 1.0)  # no digest is hot
    assert Counter(map(tuple, filter_audit.audit(docs, labels).collect())) == brute(rows(), LABELS)


def test_own_filters_and_text_ids(spark):
    docs = spark.createDataFrame([("a", "x", "en"), ("b", "x", "en"), ("c", "xy", "en")], "doc_id string, text string, lang string")
    long = filter_audit.Filter("L", lambda text, words, points: points > 1)
    got = filter_audit.audit(docs, spark.createDataFrame([("c", 1, 0)], "doc_id string, quality int, toxic int"), filters=(long,)).orderBy("filter_order", "step").collect()
    assert [(r.filter_order, r.step, r.kept, r.removed, r.good_lost) for r in got] == [("EL", 1, 2, 1, 0), ("EL", 2, 1, 1, 1), ("LE", 1, 2, 1, 1), ("LE", 2, 1, 1, 0)]
    with pytest.raises(ValueError):
        filter_audit.audit(docs, docs, filters=(long, long))
