"""Queries over whole, unaltered documents, which have no SQL, against plain Python."""

import hashlib
import json
import random
import re
import unicodedata
from difflib import SequenceMatcher

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from changelens.functions import patterns as P
from changelens.functions import text
from changelens.plans import queries

SF = "/root/testdata/sf0.001"
DOCUMENT = "doc_id long, text string, source string"


def redacted(value):
    for pattern, put, fold in P.SECRETS:
        value = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", put), value, flags=re.I if fold else 0)
    return value


def written(spark, folder, *rows):
    spark.createDataFrame(rows, DOCUMENT).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_redaction_of_whole_documents(spark, tmp_path):
    far, tails = "plain words – " * 40, queries._SECRET_TAILS
    rows = [(0, far + "sent bearer tok_9 and more\nhttps://me:pw@host/x " + far, "a"), (1, far + "key sk-ABCDEFGH99 end", "a"), (2, "short", "a"), (3, "", "a"), (4, None, "a"), (None, far + "api_key=abc1", "a"), (-5, "sk-ABCDEFGH99", "a")]
    got = {r.doc_id: r.out for r in entry.queries()["redact"](spark, written(spark, tmp_path, *rows)).collect()}
    tail = lambda i: tails[i % len(tails)] if i is not None and i >= 0 else ""
    assert got == {i: None if t is None else redacted(t + tail(i)) for i, t, _ in rows}
    assert "tok_9" not in got[0] and ":pw@" not in got[0] and got[0].endswith(far) and "sk-" not in got[1] and "abc1" not in got[None]


def test_redaction_of_the_documents_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r.out for r in entry.queries()["redact"](spark, SF).collect()}
    assert got == {r.doc_id: redacted(r.text + queries._SECRET_TAILS[r.doc_id % len(queries._SECRET_TAILS)]) for r in docs}


LINES = (
    ("Preis €49 – jetzt\nÜbersicht £1,499 per user\n“Zitat” – l’été", "b"), ("Preis €59 — jetzt\nÜbersicht £1,499 per user\n\"Zitat\" - l'été\n¥300 façade", "b"), ("nothing\nhere\nbut ₹999 a\u200bmonth and 5 projects\nnaïve Slack café", "b"),
    ("ein €5 Lauf\n• Größe ist größer\nplain line", "a"), ("ein €5 Lauf\n• GRÖSSE ist grösser\nplain line", "a"), ("été 12 users – $7\nß and ſ\nMünchen 10 GB", "a"),
)


def canonical(value):
    value = re.sub(r"\s+", " ", re.sub("[\u200b-\u200f\u202a-\u202e\ufeff]", "", value)).strip(" ")
    for pattern, put in P.DYNAMIC_TOKENS:
        value = re.sub(pattern, put, value, flags=re.I)
    folded = value.lower().replace("ß", "ss").replace("ς", "σ").translate(str.maketrans("’‘“”–—", "''\"\"--"))
    return re.sub(r"\s+", " ", folded).strip(" .,;:!•|-")


def changed():
    """{(doc_id, seq): (before, after, location)} of LINES, by plain loops."""
    out, last = {}, {}
    for i, (value, source) in enumerate(LINES):
        lines, old = unicodedata.normalize("NFKC", value).split("\n"), last.get(source, [])
        last[source] = lines
        for k, line in enumerate(lines):
            h = hashlib.md5(f"{i}:{k}".encode()).hexdigest()
            part = lambda a, n: int(h[a - 1 : a - 1 + n], 16)  # noqa: B023, E731
            planted = lambda x, a: f"{x} {queries.PHRASES[part(a, 4) % len(queries.PHRASES)]}".strip(" ")  # noqa: B023, E731
            then = line if part(9, 1) < 8 else old[k] if k < len(old) else ""
            out[i, k] = planted(then, 1), planted(line, 5), queries.LOCATIONS[part(10, 2) % len(queries.LOCATIONS)]
    return out


def price_list(value):
    return [float(re.search(P.AMOUNT, m[0])[0].replace(",", "")) for m in re.finditer(P.PRICE, value, re.I)]


def pricing_score(before, after, location):
    has = lambda pattern, x=before + " " + after: bool(re.search(pattern, x, re.I))
    b, a = price_list(before), price_list(after)
    step = 0.45 if a and b and abs(a[0] - b[0]) > 1e-9 else 0.2 if b and not a else 0.25 if a and not b else 0
    free = has(P.FREE_WORD, before) != has(P.FREE_WORD, after) and bool(a or b)
    return min(1.0, 0.35 * bool(a or b) + step + 0.12 * has(P.BILLING_PERIOD) + 0.1 * has(P.PLAN_NAME) + 0.3 * free + 0.15 * (location == "pricing"))


def size(before, after):
    b, a = canonical(before), canonical(after)
    if a == b:
        return 0.0
    return 1 - SequenceMatcher(None, b, a).ratio() if a and b else min(1.0, 0.35 + len(a + b) / 600)


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("lines"), *((i, t, s) for i, (t, s) in enumerate(LINES)))


def result(spark, name, folder):
    return {(r.doc_id, r.seq): r for r in entry.queries()[name](spark, folder).collect()}


def test_real_lines_reach_the_text_rules(spark, lines):
    rows = changed()
    assert any(not b.isascii() for b, _, _ in rows.values())
    assert {k: r.out for k, r in result(spark, "canonicalise", lines).items()} == {k: canonical(a) for k, (_, a, _) in rows.items()}
    tokens = lambda x: "|".join(sorted({re.sub(r"[\s,]", "", m[0]).lower() for m in re.finditer(P.PRICE_TOKEN, x, re.I)}))
    assert {k: r.prices for k, r in result(spark, "price_tokens", lines).items()} == {k: tokens(a) for k, (_, a, _) in rows.items()}
    assert {k: r.prices for k, r in result(spark, "price_amounts", lines).items()} == {k: "|".join(f"{x:.2f}" for x in price_list(a)) for k, (_, a, _) in rows.items()}
    limits = lambda x: "|".join(sorted({f"{m[2].lower()}={m[1].lower()}" for m in re.finditer(P.PLAN_LIMIT, x, re.I)}))
    assert {k: r.limits for k, r in result(spark, "plan_limits", lines).items()} == {k: limits(a) for k, (_, a, _) in rows.items()}
    partners = lambda x: {m[0].lower() for m in re.finditer(P.PARTNER, x, re.I)}
    assert {k: r.partners for k, r in result(spark, "partners_new", lines).items()} == {k: "|".join(sorted(partners(a) - partners(b))) for k, (b, a, _) in rows.items()}


def test_real_lines_reach_noise_and_classes(spark, lines):
    rows = changed()
    same = {k for k, (b, a, _) in rows.items() if canonical(b) == canonical(a)}
    assert {k for k, r in result(spark, "noise_reason", lines).items() if (r.noise_reason or "").startswith("canonically identical")} == same
    got = result(spark, "detector_scores", lines)
    assert {k: round(r.pricing, 6) for k, r in got.items()} == {k: round(pricing_score(*x), 6) for k, x in rows.items()}
    segments = {k: json.loads(r.segments) for k, r in result(spark, "word_diff", lines).items()}
    assert {k: ("".join(x["before"] for x in s), "".join(x["after"] for x in s)) for k, s in segments.items()} == {k: (b, a) for k, (b, a, _) in rows.items()}


def test_magnitude_is_of_the_texts(spark, lines):
    got = {k: r.magnitude for k, r in result(spark, "change_magnitude", lines).items()}
    assert got.keys() == changed().keys() and all(got[k] == pytest.approx(size(b, a), abs=6e-5) for k, (b, a, _) in changed().items())


def test_consecutive_documents_meet_by_id(spark, tmp_path):
    at = written(spark, tmp_path, (0, "x\ny", "a"), (1, "x\nz\nz", "a"), (2, None, "a"), (3, "q", "a"), (4, "alone", "b"), (5, "x\ny", None), (6, "y", None))
    got = {(r.doc_id, r.line, r.net) for r in entry.queries()["line_changes"](spark, at).collect()}
    assert got == {(1, "y", -1), (1, "z", 2), (2, "x", -1), (2, "z", -2), (6, "x", -1)}
    assert {r.pair_id for r in entry.queries()["diff_changes"](spark, at).collect()} == {1, 2, 6}


def test_compatibility_forms_do_not_change_a_text(spark, tmp_path):
    plain = "Prix 499 EUR - office fi e\u0301te\u0301 now 12 users"
    wide = "".join(chr(ord(c) + 0xFEE0) if c.isascii() and c.isalnum() else c for c in plain.replace("fi", "\ufb01")).replace(" ", "\u00a0")
    at = written(spark, tmp_path, (0, plain, "a"), (1, wide, "a"), (2, "ascii only", "b"), (3, None, "b"), (4, "한글 \u1112\u1161\u11ab ½ ﬀ", "c"))
    hashes = {r.doc_id: r.out for r in entry.queries()["content_hash"](spark, at).collect()}
    assert hashes[0] == hashes[1] != hashes[2]
    for name in ("collapse_ws", "normalize_lines"):
        got = {r.doc_id: r.out for r in entry.queries()[name](spark, at).collect()}
        assert got[1] == unicodedata.normalize("NFKC", plain) and got[4] == "한글 한 1⁄2 ff"
    assert not [r for r in entry.queries()["diff_changes"](spark, at).collect() if r.pair_id == 1]


def test_folding_leaves_no_text_out(spark):
    letters = [chr(i) for i in range(0x3100) if not 0xD800 <= i < 0xE000] + list("ﬁＡ①㎏ｱ가𝐀")
    rows = [(c, f"a{c}b e{c}") for c in letters]
    got = spark.createDataFrame(rows, "c string, t string").select("c", text.folded("t").alias("x")).collect()
    assert {r.c: r.x for r in got} == {c: unicodedata.normalize("NFKC", t) for c, t in rows}


def test_texts_of_the_tables_are_composed():
    """What the SQL of the text queries takes for granted."""
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["text"]).column(0).to_pylist()
    assert all(unicodedata.is_normalized("NFKC", t) for t in docs if t)


#: Texts that come near to the patterns or match them, from the patterns' own words.
SHREDS = sorted({w for many in P.NEEDS.values() for w in many} | set(
    "the for by a we are now new job machine data research full-stack front-end ai ml nlp mlops learning product launch google cloud power bi up to 10 5 #1 number all-in-one end-to-end "
    "ai-powered we're per month per user /mo /yr billed yearly coming soon general early native support connects with été größe _ai ai_ x-api partner open role team full-time plan tier".split()
))


def test_no_match_without_a_needed_word(spark):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice(SHREDS) + rng.choice((" ", " ", " ", "-", ", ", "\u00a0", "é", "_", "/", "  ", "")) for _ in range(rng.randint(1, 9)))) for i in range(6000)]
    rows += [(6000 + i, w.upper() + "s" * (i % 2)) for i, w in enumerate(SHREDS)]
    df = spark.createDataFrame(rows, "i int, t string").withColumn("w", text.words_of("t", tuple(P.NEEDS)))
    checks = [F.count_if(text.matches("t", getattr(P, n)) & ~text.if_words("w", n, F.lit(True), F.lit(False))).alias(n) for n in P.NEEDS]
    hits = [F.count_if(text.matches("t", getattr(P, n))).alias(n) for n in P.NEEDS]
    assert df.agg(*checks).first().asDict() == dict.fromkeys(P.NEEDS, 0)
    assert all(n > 0 for n in df.agg(*hits).first())
