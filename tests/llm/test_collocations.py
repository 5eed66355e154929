"""Collocations against plain counting, over shards, blocks and bitmaps of any size."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from changelens.llm import collocations as c

SCHEMA = "doc_id long, text string, lang string, phrase string, score string, f string, rank string"
TEXTS = [
    ("New York city, new york City; NEW YORK.\nin new\tyork city  now", "en"), ("new york new york new york", "en"), ("the cat\x0bthe cat the cat the cat", "en"), (None, "en"), ("", None), ("...!?", "en"),
    ("São Paulo são paulo SÃO Paulo, São Paulo", None), ("a a a a a a a a", "de"), ("new york city", "de"), ("one two three four five " * 4, "en"), ("one two three four five " * 4, "en"), ("x\x1cy z\x1cy x\x1cy z", "fr"),
    ("lang age é \U0001f600 \U0001f600 \U0001f600 \U0001f600 \U0001f600", "fr"), ("w" * 5000 + " tail " + "w" * 5000 + " tail", "fr"), ("the the cat", "en"),
]


def table(spark, texts=TEXTS):
    return spark.createDataFrame([(i % 7, t, lang, "p", "s", "f", "r") for i, (t, lang) in enumerate(texts)], SCHEMA)


def brute(texts, depth, least, cover, top):
    f, n = Counter(), Counter()
    for t, lang in texts:
        for piece in re.split("[.,;:!?\n-\r]", (t or "").translate({k: k + 32 for k in range(65, 91)})):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang or "und"] += len(words)
            for d in range(1, depth + 1):
                for i in range(len(words) - d + 1):
                    f[(lang or "und", *words[i : i + d])] += 1
    found = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    inside = lambda g, h: len(h) > len(g) and g[0] == h[0] and any(h[i : i + len(g) - 1] == g[1:] for i in range(1, len(h)))
    rows = defaultdict(list)
    for g, a in found.items():
        if any(inside(g, h) and 100 * b >= cover * a for h, b in found.items()):
            continue
        score, _, left, right = min((1_000_000 * a * a // (f[g[: k + 1]] * f[(g[0], *g[k + 1 :])]), k, f[g[: k + 1]], f[(g[0], *g[k + 1 :])]) for k in range(1, len(g) - 1))
        rows[g[0]].append((-score, -a, " ".join(g[1:]).encode(), left, right))
    return {(lang, k, p.decode(), -a, left, right, n[lang], -s) for lang, own in rows.items() for k, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1)}


@pytest.mark.parametrize(("depth", "least", "cover", "top", "shard", "block", "bits"), [(3, 2, 50, 2000, 2_000_000, 2 << 20, 28), (3, 3, 50, 4, 7, 64, 28), (2, 2, 50, 2000, 5, 16, 28), (4, 2, 90, 2000, 9, 33, 16), (5, 1, 100, 3, 2, 1, 16)])
def test_collocations(spark, depth, least, cover, top, shard, block, bits):
    limits = c.Limits(block_bytes=block, shard_words=shard, bitmap_bits=bits, merge_entries=3)
    got = c.collocations(table(spark).repartition(3), depth, least, cover, top, limits=limits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(TEXTS, depth, least, cover, top)


def test_empty_table_and_texts_without_words(spark):
    assert c.collocations(table(spark).limit(0)).count() == 0
    assert c.collocations(table(spark, [(None, "en"), (" ,;", None)]), min_count=1).count() == 0


def test_counts_above_a_byte_and_beyond_64_bits(spark):
    many = [("a b " * 4000, "en")] * 3
    got = c.collocations(table(spark, many), min_count=300)
    assert {tuple(r) for r in got.collect()} == brute(many, 3, 300, 50, 2000)
    big = spark.createDataFrame([(10**12, 10**13, 10**14)], "a long, l long, r long")
    assert big.selectExpr("cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * cast(1000000 as decimal(8,0)) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0))) AS s").first().s == 10**6 * 10**24 // 10**27


def test_automaton_counts_end_positions():
    words = c.Words.joined(list(c.words_of([b"a b a b c. b c"], np.zeros(1, np.int64))))
    made = c.Automaton(words, 3)
    assert [int(x.count.sum()) for x in made.levels] == [7, 5, 3]
    assert all((made.levels[d - 1].count[made.levels[d].link] >= made.levels[d].count).all() for d in (1, 2))
    assert [int(x.count.sum()) for x in c.Automaton(words, 3, seen=2).levels] == [5, 4, 3]
