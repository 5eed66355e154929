"""Snapshots, scans, reports, sources, streams and the entry contract."""

import hashlib
import importlib
import sys

from pyspark.sql import functions as F

from changelens.operators import snapshots
from changelens.plans import analytics, evaluate, pipeline
from changelens.sources import captures as sources
from changelens.sources.store import kept
from changelens.streaming import captures as streaming

from .test_changes import V1, V2


def captures(spark, *rows):
    return spark.createDataFrame(rows, "id long, tracked_url_id long, timestamp string, content_hash string").withColumn("timestamp", F.to_timestamp_ntz("timestamp"))


def test_a_b_a_is_stored_three_times(spark):
    got = snapshots.stored(captures(spark, (1, 1, "2024-01-01", "a"), (2, 1, "2024-01-02", "a"), (3, 1, "2024-01-03", "b"), (4, 1, "2024-01-04", "a"), (5, 2, "2024-01-01", "a"))).orderBy("id").collect()
    assert [r.id for r in got] == [1, 3, 4, 5] and str(got[0].touched_at).startswith("2024-01-02")


def test_pair_selection(spark):
    rows = [("u", "2023-01-01", 200, "A", 1), ("u", "2023-06-01", 200, "B", 2), ("u", "2024-01-01", 200, "C", 3), ("v", "2023-01-01", 200, "A", 4), ("v", "2023-02-01", 200, "A", 5), ("w", "2023-01-01", 404, "A", 6), ("w", "2023-02-01", 404, "", 7), ("w", "2023-03-01", 404, "", 8)]
    df = spark.createDataFrame(rows, "url string, timestamp string, status_code int, digest string, id long")
    assert {r.url: (r.before_id, r.after_id) for r in snapshots.select_pair(df).collect()} == {"u": (1, 3), "w": (6, 8)}


def test_archive_dates_and_index(spark):
    df = spark.createDataFrame([("2023",), ("202306",), ("20230704",), ("20230101120000",), ("x",)], "v string").select(snapshots.parse_archive_date(F.col("v")).cast("string").alias("x"))
    assert [r.x for r in df.collect()] == ["2023-01-01 00:00:00", "2023-06-01 00:00:00", "2023-07-04 00:00:00", "2023-01-01 12:00:00", None]
    rows = [("u", "20230101120000", "200", "A", "1"), ("u", "20230102120000", "200", "A", "1"), ("u", "20230103120000", "200", "B", "1"), ("u", "bad", "200", "C", "1"), ("u", "20230104120000", "404", "D", "1")]
    index = spark.createDataFrame(rows, "url string, timestamp string, statuscode string, digest string, length string")
    assert [r.digest for r in sources.archive_index(index).collect()] == ["A", "B"] and [r.digest for r in sources.archive_index(index, -1).collect()] == ["B"]


def test_scan(spark):
    rows = [(1, 1, 9, "https://f.com/pricing", "2024-01-01", V1, None), (2, 1, 9, "https://f.com/pricing", "2024-01-02", V1, None), (3, 1, 9, "https://f.com/pricing", "2024-01-03", V2, None), (4, 2, 9, "https://f.com/x", "2024-01-01", None, "timeout")]
    df = spark.createDataFrame(rows, "id long, tracked_url_id long, competitor_id long, url string, timestamp string, html string, error string").withColumn("timestamp", F.to_timestamp_ntz("timestamp"))
    got = pipeline.scan(df, spark.createDataFrame([(9, "Firm")], "id long, name string"))
    assert [r.id for r in got.snapshots.orderBy("id").collect()] == [1, 3]
    told = got.intelligence.orderBy(F.desc("relevance_score")).collect()
    assert told[0].title.startswith("Firm") and {r.snapshot_id for r in told} == {3}
    run = got.runs.first()
    assert (run.urls_scanned, run.urls_failed, run.status) == (2, 1, "completed") and run.raw_changes == run.noise_changes + run.meaningful_changes == got.changes.count()


def test_commands(spark, tmp_path, capsys):
    from pyspark.sql import SparkSession

    from changelens.__main__ import main

    store, at = str(tmp_path / "store"), str(tmp_path / "captures")
    main(["init", store])
    main(["add", store, "Firm", "f.com", "2024-01-01"])
    key = int(capsys.readouterr().out.split()[-1])
    try:
        main(["add", store, "FIRM", "f.com", "2024-01-01"])
    except SystemExit as stop:
        assert stop.code == 1
    rows = [(1, 1, key, "https://f.com/pricing", "2024-01-01", V1, None), (2, 1, key, "https://f.com/pricing", "2024-01-03", V2, None)]
    spark.createDataFrame(rows, "id long, tracked_url_id long, competitor_id long, url string, timestamp string, html string, error string").withColumn("timestamp", F.to_timestamp_ntz("timestamp")).write.parquet(at)
    main(["scan", at, store])
    counts = {name: sources.read_table(spark, store, name).count() for name in ("competitors", "snapshots", "changes", "intelligence", "scan_runs")}
    assert counts["competitors"] == 1 and counts["snapshots"] == 2 and counts["changes"] >= counts["intelligence"] > 0 and counts["scan_runs"] == 1
    # A replay adds nothing; a reset leaves empty tables, which a seed fills day by day.
    main(["scan", at, store])
    again = {name: sources.read_table(spark, store, name).count() for name in counts}
    assert again == counts
    main(["graph"])
    main(["list", store])
    main(["analytics", store, "2024-01-04"])
    main(["digest", store, "2024-01-01", "2024-01-04"])
    told = capsys.readouterr().out
    assert "Firm" in told and "Change digest" in told and SparkSession.getActiveSession() is not None


def test_scan_of_pages(spark):
    """One in four pages has an unchanged second capture: it gives no change, the others give what evaluation gives for the same pair."""
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    got = entry.queries()["scan_changes"](spark, sf).collect()
    pages = {r.page_id for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert {r.tracked_url_id for r in got} == {p for p in pages if p % 4} and len({r.change_key for r in got}) == len(got)
    assert {r.snapshot_id for r in got} == {2 * p + 1 for p in pages if p % 4}
    pairs = {(r.pair_id, r.seq): r for r in entry.queries()["evaluate_pairs"](spark, sf).collect() if r.pair_id % 4}
    # The evaluation's pair has a new copyright year in the footer besides.
    shared = [r for r in got if (r.tracked_url_id, r.seq) in pairs and r.after == pairs[r.tracked_url_id, r.seq].after]
    assert len(shared) > len(got) / 2 and all(r.category == pairs[r.tracked_url_id, r.seq].category for r in shared)


def test_scan_of_pages_reads_each_page_once(spark):
    """What a scan has parsed, aligned and judged is read by later steps as a table: no Python step is left in the plan of its result."""
    import __spark_entry__ as entry

    plan = entry.queries()["scan_changes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "kept-" in plan


def test_scan_of_changes_alone_is_that_with_snapshots(spark):
    old, new = V1, V2
    rows = [(1, 1, 1, "https://f.com/pricing", "2024-01-01", old, None), (2, 1, 1, "https://f.com/pricing", "2024-01-03", new, None), (3, 2, 1, "https://f.com/x", "2024-01-01", "", None), (4, 2, 1, "https://f.com/x", "2024-01-02", new, None)]
    captures = spark.createDataFrame(rows, "id long, tracked_url_id long, competitor_id long, url string, timestamp string, html string, error string").withColumn("timestamp", F.to_timestamp_ntz("timestamp"))
    names = spark.createDataFrame([(1, "FIRM")], "id long, name string")
    whole, alone = pipeline.scan(captures, names), pipeline.scan(captures, names, keep=kept, storing=False)
    found = lambda scan: sorted((r.tracked_url_id, r.snapshot_id, r.seq, r.before, r.after, r.category, r.relevance_score, r.change_key) for r in scan.changes.collect())
    assert alone.snapshots is None and found(alone) == found(whole) and {r[0] for r in found(alone)} == {1, 2}
    # A page without a body is compared by lines with what came after it.
    assert all(r[3] == "" for r in found(alone) if r[0] == 2)


def test_report_counts_completed_pages_only(spark):
    pages = spark.createDataFrame([("a.com", "completed", 100, 80, 20, 8, {"pricing": 2, "features": 3}), ("b.com", "completed", 50, 40, 10, 4, {"pricing": 1, "hiring": 2}), ("c.com", "no_snapshots", 0, 0, 0, 0, {})], "url string, status string, raw_changes int, noise_changes int, meaningful_changes int, high_impact_changes int, categories map<string,int>")
    r = evaluate.merge_report(pages).first()
    assert (r.pages_evaluated, r.raw_changes, r.noise_changes, r.noise_reduction) == (2, 150, 120, 80.0)
    counts = evaluate.merge_counts(pages)
    assert counts.first().asDict() == {"name": "features", "n": 3} and {x.name: x.n for x in counts.collect()}["pricing"] == 3
    assert "noise reduction 80.00 %" in evaluate.format_report(evaluate.merge_report(pages), pages, counts)


def test_top_competitors_keeps_those_without_changes(spark):
    names = spark.createDataFrame([(1, "only noise"), (2, "none"), (3, "some")], "id long, name string")
    log = spark.createDataFrame([(1, True, 10.0), (3, False, 90.0), (3, True, 5.0)], "competitor_id long, is_noise boolean, relevance_score double")
    assert [(r.name, r.changes, r.high_impact) for r in analytics.top_competitors(names, log).collect()] == [("some", 1, 1), ("none", 0, 0)]


def test_robots_schedule_and_decoding(spark):
    df = spark.createDataFrame([("https://a.com/1",), ("https://a.com/2",), ("https://b.com/1",)], "url string")
    robots = spark.createDataFrame([("https://a.com", False, 4.0)], "origin string, allowed boolean, crawl_delay double")
    got = {r.url: (r.allowed, r.start_after) for r in sources.schedule(sources.robots_gate(df, robots)).collect()}
    first, second = sorted(("https://a.com/1", "https://a.com/2"), key=lambda u: hashlib.md5(u.encode()).hexdigest())
    assert got == {first: (False, 0.0), second: (False, 4.0), "https://b.com/1": (True, 0.0)}
    many = spark.range(3000).select(F.concat(F.lit("https://a.com/"), (F.col("id") % 2900).cast("string")).alias("url"), "id")
    starts = sorted(r.start_after for r in sources.schedule(sources.robots_gate(many, robots), key="id").collect())
    assert starts == [4.0 * i for i in range(3000)]
    bodies = spark.createDataFrame([("é".encode(), None), ("é".encode("latin-1"), "iso-8859-1"), (b'<meta charset="iso-8859-1">\xe9', None), (b"\x93x\x94", None), (None, None)], "b binary, c string")
    assert [r.x for r in bodies.select(sources.decode_body("b", "c").alias("x")).collect()] == ["é", "é", '<meta charset="iso-8859-1">é', "“x”", None]


def test_tables_and_reports(spark, tmp_path):
    at = str(tmp_path / "store")
    sources.create_tables(spark, at)
    sources.append(spark.createDataFrame([(1, "Firm", True)], "id long, name string, active boolean"), at, "competitors")
    assert sources.read_table(spark, at, "competitors").select("name", "active").first() == ("Firm", True)
    sources.save_report(spark.range(1), "text", str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report" / "text")).first()[0] == "text"


def test_stream_follows_content(spark, tmp_path):
    inbox, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    batch = lambda *rows: spark.createDataFrame(rows, streaming.CAPTURE.replace("timestamp timestamp_ntz", "timestamp string")).withColumn("timestamp", F.to_timestamp_ntz("timestamp"))

    def run(*rows):
        batch(*rows).coalesce(1).write.mode("append").parquet(inbox)
        query = streaming.follow(streaming.capture_stream(spark, inbox), out, mark)
        query.awaitTermination(180)
        return {(r.id, r.kind, r.previous_id) for r in spark.read.parquet(out).collect()}, [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]

    many = [(1000 + k, 1000 + k, 9, "w", "2024-01-01", "z", "x") for k in range(40)]
    first, _ = run((1, 1, 9, "u", "2024-01-01", "a", "x"), (2, 1, 9, "u", "2024-01-02", "a", "x"), (3, 2, 9, "v", "2024-01-01", "b", "x"), *many)
    assert {x for x in first if x[0] < 1000} == {(1, "new", None), (3, "new", None)} and len(first) == 42
    second, progress = run((4, 1, 9, "u", "2024-01-03", "a", "x"), (5, 1, 9, "u", "2024-01-04", "c", "x"))
    assert second - first == {(5, "new", 1)}
    # State is written for the URLs of the batch, not for all that are known.
    assert sum(p["numRowsUpdated"] for p in progress) <= 2 and progress[-1]["numRowsTotal"] == 42
    third, _ = run((5, 1, 9, "u", "2024-01-04", "c", "x"), (6, 1, 9, "u", "2024-01-02", "q", "x"), (7, 1, 9, "u", "2024-01-05", "a", "x"))
    assert third - second == {(6, "late", None), (7, "new", 5)}
    # With a timer, a URL without captures is told of.
    idle = streaming.follow(streaming.capture_stream(spark, inbox), str(tmp_path / "out2"), str(tmp_path / "mark2"), idle_ms=10)
    try:
        for _ in range(60):
            idle.awaitTermination(1)
            told = {r.kind for r in spark.read.schema(streaming.EVENT).parquet(str(tmp_path / "out2")).collect()} if (tmp_path / "out2").exists() else set()
            if "idle" in told:
                break
    finally:
        idle.stop()
    assert told >= {"new", "idle"}


def test_entry_survives_without_the_corpus_operators(monkeypatch):
    import __spark_entry__ as entry

    assert {"evaluate_pairs", "noise_reason", "dashboard_stats"} <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    bare = importlib.reload(entry)
    assert "pipeline" not in bare.queries() and "evaluate_pairs" in bare.queries()
    monkeypatch.undo()
    importlib.reload(entry)


def test_edits_and_narrators(spark):
    from changelens.operators import narrate
    from changelens.sources import edits

    have = spark.createDataFrame([(1, "Firm", "https://f.com", True, "daily")], "id long, name string, website_url string, active boolean, tracking_frequency string").withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    wanted = spark.createDataFrame([("FIRM", "https://f2.com", ""), ("New", "new.com", ""), ("Bad", "http://127.0.0.1", "")], "name string, website_url string, description string")
    got = edits.new_competitors(have, wanted, "2024-01-01").collect()
    assert [(r.name, r.website_url, r.active) for r in got] == [("New", "https://new.com", True)] and got[0].id > 1
    urls = spark.createDataFrame([(1, "https://f.com/a")], "competitor_id long, url string")
    asked = spark.createDataFrame([(1, "f.com/a", ""), (1, "f.com/pricing#x", ""), (1, "ftp://f.com", "")], "competitor_id long, url string, label string")
    assert [(r.url, r.page_type) for r in edits.new_urls(urls, asked, "2024-01-01").collect()] == [("https://f.com/pricing", "pricing")]
    assert not edits.toggled(have, have.select("id"), "2024-01-02").first().active
    assert edits.merged(have, spark.createDataFrame([(1, "Firma", None)], "id long, name string, website_url string")).first()[1:3] == ("Firma", "https://f.com")
    assert narrate.narrator("unknown")[0] == "deterministic"
    facts = spark.createDataFrame([("pricing", "main", "a", "b", {"x": 1.0}, ["e"], 50.0, 0.5)], "category string, location string, before string, after string, signals map<string,double>, evidence array<string>, relevance_score double, classifier_confidence double")
    assert '"before":"a"' in narrate.context(facts).first().prompt
