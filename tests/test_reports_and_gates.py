"""The bundle of reports, rollups, the budget gate's states, narrators that raise, relational stores, and the word gate's letters."""

import random
import re

from pyspark.sql import functions as F

from changelens.functions import patterns, text
from changelens.operators import narrate
from changelens.plans import analytics
from changelens.sources import captures as sources


def change_rows(spark, n=400, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        noise, score = r.random() < 0.4, round(r.uniform(0, 100), 2)
        at = f"2024-01-{r.randrange(1, 25):02d} {r.randrange(24):02d}:{r.randrange(60):02d}:00"
        rows.append((i, r.randrange(6) if i % 50 else None, r.choice(["pricing", "other"]), r.choice(["low", "high"]), noise, r.choice(["a", "b"]) if noise and i % 7 else None, score, at))
    return spark.createDataFrame(rows, "id long, competitor_id long, category string, severity string, is_noise boolean, noise_reason string, relevance_score double, detected_at string").withColumn("detected_at", F.to_timestamp_ntz("detected_at"))


def same(a, b):
    assert a.columns == b.columns
    rows = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    assert rows(a) == rows(b)


def test_bundle_scans_once_and_equals_the_reports(spark, tmp_path):
    at, as_of = str(tmp_path / "changes"), "2024-01-20 12:00:00"
    change_rows(spark).write.parquet(at)
    changes = spark.read.parquet(at)
    names = spark.createDataFrame([(k, f"n{k}") for k in range(8)], "id long, name string")
    counts = analytics.bundle(changes, as_of, 5)
    assert counts._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    got = analytics.analytics_payload(names, changes, as_of, 5, keep=lambda df: df.persist())
    same(got["categories"], analytics.category_distribution(changes, as_of, 5))
    same(got["severities"], analytics.severity_distribution(changes))
    same(got["timeline"], analytics.activity_timeline(changes, as_of, 5))
    same(got["noise_reasons"], analytics.noise_reason_breakdown(changes))
    same(got["top_competitors"], analytics.top_competitors(names, changes))
    stats = analytics.dashboard_stats(changes, as_of).first().asDict()
    assert got["stats"].first().asDict() == {k: stats[k] for k in got["stats"].columns}


def test_rollups_equal_scans_after_appends_and_deletes(spark):
    first, second = change_rows(spark, 300), change_rows(spark, 200, 9).withColumn("id", F.col("id") + 1000)
    whole = first.unionByName(second).filter(~F.coalesce(F.col("competitor_id") == 2, F.lit(False)))
    removed = first.unionByName(second).filter("competitor_id = 2")
    rollup = analytics.rollup_after(analytics.daily_rollup(first), second, removed)
    same(rollup.select(*analytics.ROLLUP, "n", "high"), analytics.daily_rollup(whole).select(*analytics.ROLLUP, "n", "high"))
    for start, end in (("2024-01-05 06:30:00", "2024-01-20 18:00:00"), ("2024-01-05 06:30:00", "2024-01-05 18:00:00"), ("2024-01-10 00:00:00", None)):
        rows = analytics.rollup_window(rollup, whole, start, end)
        period = whole.filter(F.col("detected_at") >= F.lit(start).cast("timestamp_ntz")) if end is None else whole.filter(F.col("detected_at").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
        assert analytics.rolled_funnel(rows).first() == analytics.funnel(period).first()
        same(analytics.rolled(rows, "day"), analytics.activity_timeline(period).withColumnRenamed("day", "day"))
        same(analytics.rolled(rows, "category").filter("meaningful > 0").select("category", F.col("meaningful").alias("n")), analytics.category_distribution(period))
    assert analytics.rolled_funnel(rollup.limit(0)).first().raw_changes == 0


def plain_gate(rows, budget, least):
    out, calls, down = {}, 0, False
    for i, score, noise, said in sorted(rows, key=lambda x: (-x[1], x[0])):
        if noise:
            out[i] = "skipped"
        elif down or score < least or calls >= budget:
            out[i] = "budget" if calls >= budget and not down and score >= least else "skipped"
        else:
            out[i] = said
            calls += said in ("ok", "failed", "rate_limited")
            down = said in ("failed", "rate_limited")
    return out


def test_budget_gate_gives_all_five_states(spark):
    seen = set()
    for seed in range(10):
        r = random.Random(seed)
        # A provider either answers all calls or skips all of them.
        answers = ["skipped"] if seed == 5 else ["ok"] * 6 + ["failed", "rate_limited"] * (seed % 2)
        rows = [(i, round(r.uniform(20, 100), 1), r.random() < 0.2, r.choice(answers)) for i in range(30)]
        df = spark.createDataFrame([(1, *x) for x in rows], "page int, seq int, relevance_score double, is_noise boolean, said string")
        got = {x.seq: x.llm_status for x in narrate.budgeted(df, ["page"], 8, 40.0, answer="said").collect()}
        assert got == plain_gate(rows, 8, 40.0)
        seen |= set(got.values())
    assert seen == {"ok", "skipped", "failed", "rate_limited", "budget"}


def test_a_narrator_that_raises_fails_alone(spark):
    df = spark.createDataFrame([(1, "pricing", "main", "a", "b", 80.0), (2, "pricing", "main", "boom", "b", 80.0)], "id int, category string, location string, before string, after string, relevance_score double")
    df = df.withColumns({"signals": F.create_map(F.lit("x"), F.lit(1.0)), "evidence": F.array(F.lit("e")), "classifier_confidence": F.lit(0.5), "subject": F.lit("Firm"), "change_type": F.lit("text_change")})

    def call(prompt):
        if "boom" in prompt:
            raise TimeoutError
        return {"title": "told", "summary": None}

    got = {r.id: r for r in narrate.narrated_by(call, df).collect()}
    plain = {r.id: r for r in narrate.narrate(df).collect()}
    assert (got[1].title, got[1].llm_status, got[1].llm_error, got[1].summary) == ("told", "ok", None, plain[1].summary)
    assert (got[2].title, got[2].llm_status, got[2].llm_error) == (plain[2].title, "failed", "TimeoutError")


def test_relational_store_round_trip(spark, tmp_path):
    spark._jvm.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    url = "jdbc:derby:memory:changelens;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    sources.write_jdbc(spark.range(1000).selectExpr("id", "concat('n', id) AS name"), url, "urls", "overwrite", 2, **options)
    sources.write_jdbc(spark.range(1000, 1010).selectExpr("id", "concat('n', id) AS name"), url, "urls", **options)
    back = sources.jdbc_table(spark, url, "urls", "id", 300, **options)
    assert back.rdd.getNumPartitions() == 4 and sorted(r[0] for r in back.select("id").collect()) == list(range(1010))
    some = back.filter("id >= 1005").select("name")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*" in plan and some.count() == 5
    assert sources.jdbc_table(spark, url, "urls", **options).rdd.getNumPartitions() == 1


def test_word_gate_knows_every_letter_that_patterns_take_for_ascii(spark):
    letters = [chr(c) for c in [*range(0x80, 0x3000), 0xFB00, 0xFB05] if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c,) for c in letters], "c string").withColumn("c", text.folded("c"))
    taken = {r.c for r in df.filter(F.col("c").rlike("(?iu)^[a-z]$") & ~F.col("c").rlike("^[A-Za-z]$")).collect()}
    assert taken == {"\u0130", "\u0131"}
    lines = ["\u0130ntroducing dashboards", "\u0131ntroduc\u0131ng x", "INTRODUCING y", "we are h\u0130ring", "nothing"]
    df = spark.createDataFrame([(x,) for x in lines], "t string").withColumn("t", text.folded("t"))
    for name in patterns.NEEDS:
        pattern = getattr(patterns, name, None)
        if not isinstance(pattern, str):
            continue
        words = text.words_of("t", (name,))
        got = df.select(text.if_words(words, name, text.matches("t", pattern), F.lit(False)).alias("gated"), text.matches("t", pattern).alias("plain")).collect()
        assert all(r.gated == r.plain for r in got), name
    assert re.search("introducing", lines[2], re.I)


def test_payloads_cut_at_every_length_never_gain_a_value():
    import json

    from changelens.functions.payloads import find_object

    whole = {"title": "Prices up", "score": 81.5, "text": "one, two, {three}", "kept": True, "last": None}
    text_ = json.dumps(whole)
    for n in range(len(text_) + 1):
        found = find_object(text_[:n])
        assert found is None or all(k in whole and (whole[k] == v or k == "score" or (k == "title" and whole[k].startswith(v))) for k, v in found.items())
    assert find_object(text_) == whole and find_object(text_[:-1]) == whole


def test_narration_judges_no_noise(spark, monkeypatch):
    from changelens.plans import evaluate, queries

    rows, seen, survivors = queries.change_rows(spark, "/root/testdata/sf0.001"), [], queries.classify.classify_survivors
    monkeypatch.setattr(queries.classify, "classify_survivors", lambda df: seen.append(df.filter("is_noise").count()) or survivors(df))
    got = {(r.doc_id, r.seq, r.title, r.summary) for r in queries.QUERIES["narration"](spark, "/root/testdata/sf0.001").collect()}
    assert seen == [0]
    told = narrate.narrate(narrate.candidates(evaluate.judged(rows)).withColumn("subject", F.concat(F.lit("C"), F.col("doc_id").cast("string"))))
    assert got and got == {(r.doc_id, r.seq, r.title, r.summary) for r in told.collect()}
