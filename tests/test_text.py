import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from changelens.functions import patterns as P
from changelens.functions import payloads, text, urls


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("value", "expected"),
    [("  a \n\t b  ", "a b"), ("   ", ""), (None, ""), ("a\u200bb\u200e", "ab"), ("a\u00a0b", "a b")],
)
def test_collapse(spark, value, expected):
    assert one(spark, text.collapse_whitespace("v"), value) == expected


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("id 8f14e45f-ceea-467a-9a1e-4b2d3c9f0011", "id <UUID>"), ("at 2026-09-05T08:14:22Z", "at <DATE>"), ("on January 14, 2026", "on <DATE>"), ("3 hours ago", "<RELTIME>"), ("at 10:45 pm", "at <TIME>"),
        ("© 2025-2026 Acme", "<COPYRIGHT> Acme"), ("/p?utm_source=x&a=1", "/p?<TRACKING>&a=1"), ("app.3f2a9c1b.js", "app.<HASH>."), ("213 visitors", "<COUNTER>"), ("deadbeefdeadbeef00", "<HEX>"), ("ts 1700000000", "ts <EPOCH>"),
        ("Pro plan costs $49", "Pro plan costs $49"),
    ],
)
def test_masks(spark, value, expected):
    assert one(spark, text.strip_dynamic_tokens("v"), value) == expected


def test_canonical_equality(spark):
    same = [("Hello, World!", "hello, world"), ("It’s “new” – now", "it's \"new\" - now"), ("• Item", "item"), ("STRASSE", "straße")]
    for a, b in same:
        assert one(spark, text.canonicalise("v"), a) == one(spark, text.canonicalise("v"), b)
    assert one(spark, text.canonicalise("v"), "Rs 999") != one(spark, text.canonicalise("v"), "Rs 1499")
    assert re.fullmatch("[0-9a-f]{64}", one(spark, text.content_hash("v"), "x"))
    assert one(spark, text.nfkc(F.col("v")), "ﬁne") == "fine"


def test_truncate_words_lines(spark):
    long = one(spark, text.truncate("v", 10), "abcdefgh  klmnop")
    assert long == "abcdefgh…" and one(spark, text.truncate("v", 10), " short ") == "short"
    assert one(spark, text.word_count("v"), " a  b c\n") == 3 and one(spark, text.word_count("v"), None) == 0
    assert one(spark, text.normalize_text("v"), "a  b\n\n  \r\nc") == "a b\nc"


@pytest.mark.parametrize(
    ("value", "gone", "there"),
    [
        ("Authorization: Bearer abc.def", "abc.def", "Authorization: [redacted]"), ('{"api_key": "k-123"}', "k-123", '"api_key": "[redacted]"'), ("sent bearer tok_1", "tok_1", "Bearer [redacted]"),
        ("https://me:pw@host/x", ":pw@", "https://me:[redacted]@host/x"), ("sk-ABCDEFGH1234", "ABCDEFGH", "[redacted]"), ("nothing here", "[redacted]", "nothing here"),
    ],
)
def test_redaction(spark, value, gone, there):
    out = one(spark, text.redact_secrets("v", ("topsecretvalue",)), value)
    assert gone not in out and there in out
    assert one(spark, text.redact_secrets("v", ("topsecretvalue",)), "x topsecretvalue") == "x [redacted]"


def test_error_summary():
    assert text.summarise_error(ValueError("secret")) == "ValueError"


@pytest.mark.parametrize(
    ("url", "reason"),
    [
        ("https://example.com/x", None), ("example.com", None), ("http://93.184.216.34/", None), ("ftp://example.com", "unsupported scheme"), ("http://u:p@example.com", "embedded credentials"), ("http://localhost:8000", "private hostname"),
        ("http://db.internal/", "private hostname"), ("http://127.0.0.1", "private or reserved address"), ("http://10.0.0.5/", "private or reserved address"), ("http://172.16.3.4/", "private or reserved address"), ("http://172.32.3.4/", None),
        ("http://169.254.169.254/", "private or reserved address"), ("http://[::1]/", "private or reserved address"), ("http://[2606:4700::1111]/", None), ("  ", "empty url"), ("http:///x", "no hostname"),
    ],
)
def test_url_guard(spark, url, reason):
    assert one(spark, urls.unsafe_reason("v"), url) == reason


def test_urls(spark):
    for url, kind in (("https://a.com/pricing", "pricing"), ("https://a.com/Careers/x", "careers"), ("https://a.com/changelog", "blog"), ("https://a.com/partners", "integrations"), ("https://a.com/features", "product"), ("https://pricing.com/", "generic")):
        assert one(spark, urls.page_type("v"), url) == kind
    assert one(spark, urls.normalize_url("v"), " example.com/a#b ") == "https://example.com/a"
    assert one(spark, urls.origin("v"), "https://a.com:8443/x") == "https://a.com:8443"
    assert one(spark, urls.same_origin("v", F.lit("https://a.com/z")), "https://A.com/x") and not one(spark, urls.same_origin("v", F.lit("https://a.com:444/z")), "https://a.com/x")


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ('{"a": 1}', {"a": 1}), ('```json\n{"a": 1}\n```', {"a": 1}), ('Sure: {"a": {"b": "}"}} done', {"a": {"b": "}"}}), ('{"a": 1,}', {"a": 1}), ('[{"a": 1}]', {"a": 1}), ('{"title": "x", "summary": "cut of', {"title": "x"}),
        ('{"a": [1, 2', {"a": [1, 2]}), ('{"a": "x", "b":', {"a": "x"}), ("no json", None), ("", None), (None, None),
    ],
)
def test_json_repair(value, expected):
    assert payloads.find_object(value) == expected


def test_coercion(spark):
    for raw, score in (("91%", 91.0), ("high", 78.0), ("0.85", 85.0), ("140", 100.0), ("-5", 0.0), ("none", 50.0), (None, 50.0)):
        assert one(spark, payloads.coerce_score("v"), raw) == score
    for raw, c in (("85", 0.85), ("0.4", 0.4), (None, 0.5), ("maybe", 0.5)):
        assert one(spark, payloads.coerce_confidence("v"), raw) == c
    assert [one(spark, payloads.coerce_bool("v"), x) for x in ("Yes", "no", None, "1")] == [True, False, True, True]
    assert [one(spark, payloads.coerce_category("v"), x) for x in (" Jobs", "pricing", "zzz")] == ["hiring", "pricing", "other"]
    got = one(spark, payloads.read_payload("v"), 'x {"title": ["a", "b"], "category": "price", "relevance_score": "91%"}')
    assert (got.title, got.category, got.relevance_score, got.confidence) == ("a b", "pricing", 91.0, 0.5)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aB 1:-/?&=.,$’–\t©", max_size=40), min_size=1, max_size=20))
def test_masking_matches_a_plain_loop(spark, values):
    def mask(t):
        for pattern, put in P.DYNAMIC_TOKENS:
            t = re.sub(pattern, put, t, flags=re.IGNORECASE | re.ASCII)
        return t

    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", text.strip_dynamic_tokens("v").alias("x")).collect()
    assert all(r.x == mask(r.v) for r in rows)


def test_all_white_space_is_seen_before_it_is_replaced(spark):
    """Texts that hold nothing to collapse are passed over: what decides it must find all that the replacements would."""
    signs = [chr(i) for i in range(0x10000) if not 0xD800 <= i <= 0xDFFF and i not in (0, 32)]
    df = spark.createDataFrame([(c,) for c in signs], "c string")
    changed = F.col("c").rlike(r"(?U)\s") | F.col("c").rlike(text.ZERO_WIDTH)
    assert df.filter(changed).count() > 30 and df.filter(changed & ~F.col("c").rlike(text._UNEVEN)).isEmpty()
    odd = spark.createDataFrame([("a  b",), (" a b ",), ("a\u2003b",), ("a\u200bb",), ("\ta b",), ("a b",), (None,)], "c string")
    assert [r[0] for r in odd.select(text.collapse_whitespace("c")).collect()] == ["a b", "a b", "a b", "ab", "a b", "a b", ""]
    assert [r[0] for r in odd.select(text.shorten("c", 2)).collect()] == ["a…"] * 3 + ["a…"] * 3 + [""]
