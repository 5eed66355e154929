"""Blocks, alignment, noise rules, classes and scores."""

import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from changelens.arrow import with_python
from changelens.operators import classify, diff, html, narrate, noise, relevance
from changelens.plans import evaluate

CHANGE = "before string, after string, location string, change_type string, magnitude double"


def page(body, year="2025", extra=""):
    return f"""<html><head><title>Plans</title></head><body><nav><a href="/">Home</a>{extra}</nav><div class="cookie-banner">We use cookies to improve things. Accept all</div>
    <main>{body}</main><footer><p>Copyright {year} Firm. All rights reserved.</p><p>Session: 8f14e45f-ceea-467a-9a1e-4b2d3c9f00{year[-2:]}</p></footer></body></html>"""


V1 = page('<h1>Simple pricing</h1><section class="pricing-table"><div class="plan"><h3>Pro</h3><p class="price">Rs 999/month</p><ul><li>5 projects</li><li>Basic analytics</li></ul></div></section>')
V2 = page('<h1>Simple pricing</h1><section class="pricing-table"><div class="plan"><h3>Pro</h3><p class="price">Rs 1499/month</p><ul><li>10 projects</li><li>AI-powered analytics</li></ul></div></section>', "2026", '<a href="/blog">Blog</a>')


def changes(spark, *rows):
    return spark.createDataFrame([(b, a, loc, kind, float(m)) for b, a, loc, kind, m in rows], CHANGE).withColumn("seq", F.monotonically_increasing_id())


def test_blocks_and_locations():
    blocks = html.extract_blocks(V1)
    by_text = {b["text"]: b for b in blocks}
    assert by_text["Rs 999/month"]["location"] == "pricing" and by_text["Home"]["location"] == "navigation" and by_text["Simple pricing"]["tag"] == "h1"
    assert by_text["Copyright 2025 Firm. All rights reserved."]["location"] == "footer"
    assert [b["pos"] for b in blocks] == list(range(len(blocks)))
    assert html.extract_title(V1) == "Plans" and html.extract_title("<h1>Only</h1>") == "Only" and html.extract_title("") is None


@pytest.mark.parametrize(
    ("source", "texts"),
    [
        ("", []), ("<p>Hello <a>link</a> world</p>", ["link"]), ("<p>one<p>two", ["one", "two"]), ("<script>x=1</script><p hidden>no</p><p style='display:none'>no</p><p>yes!</p>", ["yes!"]), ("<p>•</p><p>a</p>", ["• a"]),
        ("<ul><li>first<li>second</ul>", ["first", "second"]), ("<td>cell</td></p></div><p>after", ["cell", "after"]), ("<div><ul><li>xy</li></ul></div>", ["xy", "xy"]),
    ],
)
def test_tolerant_extraction(source, texts):
    assert [b["text"] for b in html.extract_blocks(source)] == texts


def pairs(spark, *rows):
    return spark.createDataFrame([(i, b, a) for i, (b, a) in enumerate(rows)], "pair_id int, before_html string, after_html string")


def test_diff_kinds(spark):
    wrap = "<p>Always here, never changed.</p>{}".format
    got = diff.diff_html(
        pairs(spark, (V1, V1), (wrap(""), wrap("<p>A new paragraph appears.</p>")), (wrap("<p>An old one goes.</p>"), wrap("")), (wrap("<p>Our office is in Berlin</p>"), wrap("<p>Our office is in Hamburg</p>")), (wrap("<h1>Old headline here</h1>"), wrap("<h1>New headline here</h1>"))),
        ["pair_id"],
    ).collect()
    assert {(r.pair_id, r.change_type) for r in got} == {(1, "added"), (2, "removed"), (3, "text_change"), (4, "headline_change")}
    added = next(r for r in got if r.pair_id == 1)
    assert added.before == "" and added.magnitude == round(0.35 + len("a new paragraph appears") / 600, 4)


def test_cosmetic_differences_are_emitted_and_noise(spark):
    got = evaluate.evaluate_pairs(pairs(spark, ("<p>Hello World example</p>", "<p>hello world example!</p>"))).collect()
    assert [(r.change_type, r.magnitude, r.is_noise) for r in got] == [("modified", 0.0, True)]


def test_repeats_fold(spark):
    got = diff.diff_html(pairs(spark, ("<p>start of it all</p>", "<p>start of it all</p>" + "<p>the same new text</p>" * 3)), ["pair_id"]).collect()
    assert len(got) == 1


def plain_pairs(old, new, b0, a0):
    """Each old block with the best new one that is left, by comparing with all of them."""
    free, out = list(range(len(new))), []
    for i, x in enumerate(old):
        best, score = None, 0.40
        for j in free:
            found = diff.similarity(x["key"], new[j]["key"]) + 0.08 * (x["location"] == new[j]["location"]) + 0.04 * (x["tag"] == new[j]["tag"])
            if found > score:
                best, score = j, found
        if best is not None:
            free.remove(best)
        out.append((b0 + i, None if best is None else a0 + best))
    return out + [(None, a0 + j) for j in free]


def test_bounds_keep_the_pairs():
    rng, words = random.Random(1), "alpha beta gamma delta plan price ab ba abc größe été pro".split()
    some = lambda n: [{"key": " ".join(rng.choice(words) for _ in range(rng.choice((0, 1, 2, 3, 8, 40)))), "location": rng.choice("ab"), "tag": rng.choice("pq")} for _ in range(n)]
    for _ in range(150):
        old, new = some(rng.randint(0, 10)), some(rng.randint(0, 10))
        assert diff._pair(old, new, 3, 5) == plain_pairs(old, new, 3, 5)


def test_ratios_are_those_of_the_library(monkeypatch):
    rng = random.Random(2)
    some = lambda letters, most: "".join(rng.choice(letters) for _ in range(rng.randint(1, most)))
    texts = [some(letters, most) for letters in ("ab ", "abcdefghij 12", "eeeeettaoinzq7") for most in (30, 150, 500) for _ in range(8)]
    texts += [t[: k // 2] + "x1" + t[k:] for t in texts for k in (5, 60)]
    for old, new in zip(rng.choices(texts, k=400), rng.choices(texts, k=400), strict=True):
        pairs = [old[i : i + 2] for i in range(len(old) - 1)]
        expected, least = diff.SequenceMatcher(None, old, new).ratio(), rng.random()
        assert diff._Matcher(new).ratio(old, pairs, 0.0) == expected
        assert (found := diff._Matcher(new).ratio(old, pairs, least)) == expected or found < 0 and expected < least
    # Unrelated lines are told apart without the library's comparison, which takes a hundred times as long as the bounds.
    calls = []
    monkeypatch.setattr(diff.SequenceMatcher, "ratio", lambda self: calls.append(1) or 0.0)
    lines = [{"key": " ".join(some("abcdefghijklmnopqrst", 9) for _ in range(20)), "location": "body", "tag": "p"} for _ in range(12)]
    diff._pair(lines[:6], lines[6:], 0, 0)
    assert not calls


def test_long_lines_are_bounded_together(monkeypatch):
    rng = random.Random(3)
    letters, signs = "eeeeettttaaaooinshr ", "bvkjxqz0123456789-,;你好世界ñ"
    some = lambda n: "".join(rng.choice(letters) if rng.random() < 0.93 else rng.choice(signs) for _ in range(n))
    texts = [some(rng.choice((0, 3, 150, 199, 200, 201, 450, 900))) for _ in range(36)]
    texts += ["".join(rng.choice(texts)[k : k + 90] for k in (0, 100, 0)) for _ in range(12)] + [t[: len(t) // 2] + "-7-" + t[len(t) // 2 + 5 :] for t in texts[:12]] + [some(5) * 60, "q" * 250]
    old, new = ([{"key": t, "location": "body", "tag": "p"} for t in rng.sample(texts, len(texts))] for _ in range(2))
    for at_once in (1_000_000, 20_000):  # in one part, and in many
        monkeypatch.setattr(diff._Region, "AT_ONCE", at_once)
        region = diff._Region(old, new)
        for first in range(0, len(old), region.rows):
            bounds = region.bounds(first, min(first + region.rows, len(old)), 0.0)
            for i, row in enumerate(bounds):
                assert all(bound >= diff.similarity(old[first + i]["key"], x["key"]) for bound, x in zip(row, new, strict=True) if x["key"])
        assert diff._pair(old, new, 0, 0) == plain_pairs(old, new, 0, 0)
    # Unrelated long lines are not compared one by one at all.
    calls, ratio = [], diff._Matcher.ratio
    monkeypatch.setattr(diff._Matcher, "ratio", lambda *of: calls.append(1) or ratio(*of))
    lines = [{"key": some(rng.randint(250, 500)), "location": "body", "tag": "p"} for _ in range(40)]
    diff._pair(lines[:20], lines[20:], 0, 0)
    assert len(calls) < 20


def test_word_segments(spark):
    got = diff.with_word_diff(spark.createDataFrame([("Rs 999 per month", "Rs 1499 per month")], "before string, after string")).first().segments
    assert [(s.op, s.before, s.after) for s in got] == [("equal", "Rs ", "Rs "), ("delete", "999 ", ""), ("insert", "", "1499 "), ("equal", "per month", "per month")]


def test_word_segments_of_lines_with_a_common_start_need_no_search(monkeypatch):
    library, calls, some = diff.SequenceMatcher, [], random.Random(5)
    for _ in range(5000):
        start = [some.choice("abc"[: some.randint(1, 3)]) for _ in range(some.randint(0, 9))] * some.randint(1, 3)
        old, new = ([*start, *(some.choice("abcxy") for _ in range(some.randint(0, 6)))] for _ in range(2))
        assert diff._opcodes(old, new) == library(None, old, new, autojunk=False).get_opcodes()
    for text in ("", " ", "a", " a b", "a  b\u00a0c ", "a b c", "a\0b c", "\x1ca b\n", "é ü\u2003x"):
        assert diff._words(text) == re.findall(r"\S+\s*", text)
    monkeypatch.setattr(diff, "SequenceMatcher", lambda *a, **k: calls.append(len(a[1])) or library(*a, **k))
    line = " ".join(f"word{k % 40}" for k in range(300))
    assert [x["op"] for x in diff.word_segments(f"{line} 5 projects", f"{line} $79 per user")] == ["equal", "delete", "insert"]
    assert [x["op"] for x in diff.word_segments(line, "nothing of it")] == ["delete", "insert"] and not calls


@pytest.mark.parametrize(
    ("before", "after", "location", "magnitude", "reason"),
    [
        ("Copyright 2025 Acme. All rights reserved.", "Copyright 2026 Acme. All rights reserved.", "body", 0.02, "canonically identical"), ("Home Pricing", "Home Pricing Blog", "navigation", 0.5, "boilerplate"),
        ("We use cookies to improve things", "We use cookies to enhance things", "cookie_banner", 0.5, "boilerplate"), ("Trusted by 4,200 developers", "Trusted by 5,100 developers", "body", 0.5, "live counter"),
        ("A fairly long sentence about nothing", "A fairly long sentence about noting", "body", 0.02, "magnitude below threshold (0.02 < 0.12)"), ("Pro plan: Rs 999 per month", "Pro plan - Rs 999 / month", "body", 0.25, "pricing block reworded"),
        ("Blog", "News", "body", 0.5, "content too short"), ("Rs 999/month", "Rs 1499/month", "pricing", 0.5, None), ("Starting at $19/month", "Starting at $39/month", "footer", 0.5, None), ("5 projects", "10 projects", "pricing", 0.5, None),
        ("Integrates with Slack and GitHub", "Integrates with Slack, GitHub and Salesforce", "integrations", 0.5, None), ("", "Introducing AI-powered analytics for every plan", "product", 0.5, None),
        ("12 345 678 901", "12 345 678 902", "body", 0.5, "numeric-only"), ("Follow along with everyone", "please share this page", "body", 0.5, "social"), ("read privacy policy here", "privacy policy moved", "body", 0.5, "generic site chrome"),
    ],
)
def test_noise_rules(spark, before, after, location, magnitude, reason):
    r = noise.filter_noise(changes(spark, (before, after, location, "modified", magnitude))).first()
    assert r.is_noise == (reason is not None)
    assert reason is None or r.noise_reason.startswith(reason)


def test_own_rules(spark):
    mine = [("mine", lambda: F.when(F.col("after") == "x", "mine"))]
    got = noise.filter_noise(changes(spark, ("a", "x", "body", "modified", 0.5), ("a", "b", "body", "modified", 0.5)), mine)
    assert {r.after: r.noise_reason for r in got.collect()} == {"x": "mine", "b": None}
    assert [tuple(r) for r in noise.noise_breakdown(got).collect()] == [("mine", 1)] and noise.meaningful_only(got).count() == 1


@pytest.mark.parametrize(
    ("before", "after", "location", "kind", "category", "signal"),
    [
        ("Rs 999/month", "Rs 1499/month", "pricing", "text_change", "pricing", "price_direction"), ("$49/month", "$79/month", "pricing", "text_change", "pricing", "price_delta_ratio"), ("₹999", "₹1,499", "pricing", "text_change", "pricing", "has_price_token"),
        ("EUR 20 monthly", "EUR 30 monthly", "pricing", "text_change", "pricing", "has_billing_period"), ("20 USD", "30 USD", "pricing", "text_change", "pricing", "has_price_token"), ("Free forever plan", "$19 per month plan", "pricing", "text_change", "pricing", "free_tier_shift"),
        ("", "We are hiring a machine learning engineer", "careers", "added", "hiring", "ml_role_count"), ("5 projects", "10 projects", "pricing", "text_change", "features", "plan_limit_changed"),
        ("", "Introducing AI-powered analytics, now available", "product", "added", "features", "ai_mention"), ("Integrates with Slack", "Integrates with Slack and Salesforce", "integrations", "text_change", "integrations", "new_partner_count"),
        ("Ship infrastructure", "The leading platform for teams, built for developers", "header", "headline_change", "messaging", "positioning_language"),
    ],
)
def test_classes(spark, before, after, location, kind, category, signal):
    r = classify.classify(changes(spark, (before, after, location, kind, 0.8))).first()
    assert r.category == category and signal in r.signals
    assert r.change_type == classify.CATEGORY_TYPES[category]


def test_other_and_role_words_without_context(spark):
    got = classify.classify(changes(spark, ("Our office is in Berlin", "Our office is in Hamburg", "body", "text_change", 0.5), ("", "Our machine learning engineer wrote about it", "blog", "text_change", 0.5))).collect()
    assert got[0].category == "other" and got[0].change_type == "text_change" and got[1].category != "hiring"


def test_worked_example(spark):
    r = relevance.score_changes(classify.classify(changes(spark, ("Rs 999/month", "Rs 1499/month", "pricing", "text_change", 0.12))).withColumn("is_noise", F.lit(False))).first()
    assert (r.classifier_confidence, r.relevance_score, r.severity) == (0.97, 85.85, "critical")
    assert "Price increased from 999 to 1499" in r.evidence and r.signals["price_delta_ratio"] == 0.5005


def test_score_order(spark):
    rows = changes(spark, ("$100/month", "$105/month", "pricing", "text_change", 0.5), ("$100/month", "$300/month", "pricing", "text_change", 0.5), ("words here now", "words there now", "main", "text_change", 0.5), ("words here now", "words there now", "footer", "text_change", 0.5))
    s = [r.relevance_score for r in relevance.score_changes(classify.classify(rows).withColumn("is_noise", F.lit(False))).orderBy("seq").collect()]
    assert s[1] > s[0] and s[2] > s[3]
    noisy = relevance.score_changes(classify.classify(rows).withColumn("is_noise", F.lit(True))).collect()
    assert all(r.relevance_score <= 29 and r.severity == "noise" for r in noisy)


@pytest.mark.parametrize(("score", "band"), [(0, "noise"), (29.99, "noise"), (30, "low"), (49.9, "low"), (50, "medium"), (69.9, "medium"), (70, "high"), (84.9, "high"), (85, "critical"), (100, "critical")])
def test_bands(spark, score, band):
    assert spark.range(1).select(relevance.severity(F.lit(float(score)))).first()[0] == band


@pytest.mark.parametrize(("own", "model", "out"), [(72.0, None, 72.0), (70.0, 76.0, 76.0), (50.0, 100.0, 62.0), (50.0, 0.0, 38.0)])
def test_blend(spark, own, model, out):
    assert spark.range(1).select(relevance.blend(F.lit(own), F.lit(model).cast("double"))).first()[0] == out


def test_pipeline_invariants(spark):
    got = evaluate.evaluate_pairs(pairs(spark, (V1, V2)))
    rows, f = got.collect(), evaluate.page_funnel(got, ["pair_id"]).first()
    assert f.raw_changes == f.noise_changes + f.meaningful_changes == len(rows) and f.high_impact_changes <= f.meaningful_changes
    kept = {r.after: r for r in rows if not r.is_noise}
    assert kept["Rs 1499/month"].category == "pricing" and kept["10 projects"].category == "features" and "AI-powered analytics" in kept
    assert all(r.noise_reason for r in rows if r.is_noise) and all(r.is_noise for r in rows if r.location in ("footer", "navigation", "cookie_banner"))
    top = evaluate.top_changes(got, ["pair_id"]).orderBy("rank").collect()
    assert top[0].category == "pricing" and len(top) <= 5
    counts = evaluate.category_counts(got, ["pair_id"]).first().categories
    assert sum(counts.values()) == f.meaningful_changes


def test_narration(spark):
    scored = relevance.score_changes(classify.classify_survivors(noise.filter_noise(changes(spark, ("Rs 999/month", "Rs 1499/month", "pricing", "text_change", 0.3), ("a b c d e f g", "a b c d e f h", "footer", "text_change", 0.1)))))
    gated = narrate.budgeted(scored.withColumn("page", F.lit(1)), ["page"], 8)
    told = {r.before: r for r in narrate.narrate(gated.withColumn("subject", F.lit("Firm"))).collect()}
    r = told["Rs 999/month"]
    assert r.title == "Firm increased pricing" and r.llm_status == "ok" and '"Rs 999/month" became "Rs 1499/month"' in r.summary
    assert told["a b c d e f g"].llm_status == "skipped"
    facts = spark.createDataFrame([("ok", True, "rs 999", None, "Rs 999/month", "x"), ("ok", False, "", "", "a", "b"), ("failed", False, "zzz", "", "a", "b")], "llm_status string, is_meaningful boolean, claimed_before string, claimed_after string, before string, after string")
    assert [x.reject_reason for x in narrate.validate(facts).collect()] == [None, "not meaningful", "not grounded"]


def test_each_search_of_a_detector_stands_once_in_the_plan(spark):
    rows = spark.createDataFrame([("a plan for $5", "a pro plan for $7 per month", "text_change", "pricing", 0.5)], "before string, after string, change_type string, location string, magnitude double")
    df = classify.classify(rows)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(classify.P.any_case(classify.P.PLAN_NAME)) <= 2  # the flag, and the name in the evidence
    assert plan.count(classify.P.any_case(classify.P.BILLING_PERIOD)) == 1
    got, (best, second, *_) = df.first(), classify.detect(rows).first().detected
    assert (got.category, got.evidence) == (best.category, best.evidence) and got.signals["detector_score"] == round(best.score, 4) and got.signals["detector_margin"] == round(best.score - second.score, 4)
    assert classify.scores(rows).first().scores.asDict() == {x.category: x.score for x in classify.detect(rows).first().detected}


def test_arrow_batches_are_bounded_where_the_user_set_no_bound(spark):
    own, rows = spark.newSession(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    step = lambda: with_python(own.range(1), ["id"], StructField("x", LongType()), lambda v: v)
    step()
    assert own.conf.get(rows) == "1000"
    own.conf.set(rows, "7")
    step()
    assert own.conf.get(rows) == "7"
