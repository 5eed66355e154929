"""Keyed tables and scans against the store: replays, splits into batches, untouched files, failures, hot URLs."""

import itertools
import os
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from changelens.operators import ordered, snapshots
from changelens.plans import pipeline
from changelens.sources import store as st

from .test_changes import V1, V2

CAPTURE = "id long, tracked_url_id long, competitor_id long, url string, timestamp string, html string, error string"
V3 = V2.replace("</h1>", " for everyone</h1>", 1) + "<p>Introducing a new analytics dashboard for all of our teams</p>"


def captures(spark, rows):
    return spark.createDataFrame(rows, CAPTURE).withColumn("timestamp", F.to_timestamp_ntz("timestamp"))


ROWS = [
    (1, 1, 9, "https://f.com/pricing", "2024-01-01", V1, None), (2, 1, 9, "https://f.com/pricing", "2024-01-02", V1, None), (3, 1, 9, "https://f.com/pricing", "2024-01-03", V2, None),
    (4, 1, 9, "https://f.com/pricing", "2024-01-04", V2, None), (5, 1, 9, "https://f.com/pricing", "2024-01-05", V1, None), (6, 2, 9, "https://f.com/x", "2024-01-02", None, "timeout"),
    (7, 2, 9, "https://f.com/x", "2024-01-03", V3, None), (8, 3, 8, "https://g.com/", "2024-01-01", V2, None), (9, 3, 8, "https://g.com/", "2024-01-05", V3, None),
]


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([(9, "Firm"), (8, "Other")], "id long, name string")


def keep(df):
    return df.checkpoint()


def contents(stores):
    changes = sorted((r.change_key, r.snapshot_id, r.previous_snapshot_id, r.before, r.after, r.relevance_score, r.is_noise) for r in stores.changes.read().collect())
    told = sorted((r.change_key, r.title, r.relevance_score) for r in stores.intelligence.read().collect())
    kept = sorted((r.tracked_url_id, r.id, r.content_hash, r.timestamp, r.touched_at, r.title) for r in stores.snapshots.read().collect())
    return changes, told, kept


def test_a_split_in_time_gives_the_same_changes(spark, names, tmp_path):
    whole = pipeline.Stores.at(spark, str(tmp_path / "whole"), 8)
    out = pipeline.scan_store(captures(spark, ROWS), names, whole, keep)
    assert {r.id: r.status for r in out.collect()} == {1: "baseline", 2: "unchanged", 3: "changed", 4: "unchanged", 5: "changed", 6: "failed", 7: "baseline", 8: "baseline", 9: "changed"}
    expected = contents(whole)
    assert len(expected[2]) == 6 and expected[0] and expected[1]
    split, statuses = pipeline.Stores.at(spark, str(tmp_path / "split"), 8), {}
    for rows in ([r for r in ROWS if r[4] < "2024-01-04"], [r for r in ROWS if r[4] >= "2024-01-04"]):
        statuses |= {r.id: r.status for r in pipeline.scan_store(captures(spark, rows), names, split, keep).collect()}
    assert statuses == {r.id: r.status for r in out.collect()} and contents(split) == expected
    ids = [r.id for r in whole.changes.read().collect()]
    assert len(set(ids)) == len(ids) and {r.change_id for r in whole.intelligence.read().collect()} <= set(ids)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_merge_touches_only_its_buckets_and_numbers_without_clashes(spark, tmp_path):
    table = st.KeyedTable(spark, str(tmp_path / "t"), "id long, name string, v int", ["name"], "name", 16)
    first = spark.range(200).selectExpr("concat('n', id) AS name", "cast(id AS int) AS v")
    table.merge(first, number="id")
    before, ids = files(table.path), {r.name: r.id for r in table.read().collect()}
    assert len(set(ids.values())) == 200
    one = spark.createDataFrame([("n7", 700), ("n7", 701), ("new", 1), (None, 3), (None, 3)], "name string, v int")
    table.merge(one, number="id")
    touched = {f"bucket={b}" for b in table.touched(one)}
    after = files(table.path)
    assert all(after.get(f) == t for f, t in before.items() if f.split(os.sep)[-2] not in touched)
    assert all(f.split(os.sep)[-2] in touched for f in set(after) - set(before))
    rows = {r.name: (r.id, r.v) for r in table.read().collect()}
    assert len(rows) == 202 and rows["n7"] == (ids["n7"], 701) and len({i for i, _ in rows.values()}) == 202 and all(rows[n][0] == i for n, i in ids.items())
    table.merge(one, number="id")
    assert {r.name: (r.id, r.v) for r in table.read().collect()} == rows
    plan = table.read([1, 2])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters", 1)[1][:200]
    table.merge(one.limit(0))
    assert table.read().count() == 202


def test_a_broken_exchange_is_finished(spark, tmp_path):
    table = st.KeyedTable(spark, str(tmp_path / "t"), "name string, v int", ["name"], "name", 4)
    table.merge(spark.createDataFrame([("a", 1), ("b", 1)], "name string, v int"))
    ready = spark.createDataFrame([("a", 2)], "name string, v int").select("*", table.bucket())
    other = table.read(table.touched(ready)).filter("name <> 'a'")
    ready.unionByName(other).write.partitionBy("bucket").parquet(f"{table.path}__merged")  # as a merge leaves it that died before the exchange
    assert {r.name: r.v for r in table.read().collect()} == {"a": 2, "b": 1} and not os.path.exists(f"{table.path}__merged")


def test_one_bad_page_fails_alone(spark, names, monkeypatch):
    deep = "<div>" * 3 + "BAD" + "</div>" * 3
    from changelens.operators import diff, html

    def page(text):
        if text and "BAD" in text:
            raise RecursionError("too deep")
        return html.extract_page(text)

    def align(before, after):
        if any("everyone" in b["text"] for b in after or []):
            raise ValueError("no")
        return diff.align(before, after)

    monkeypatch.setattr(pipeline, "with_page", lambda df, col, error: __import__("changelens.arrow", fromlist=["x"]).with_python(df, [col], html.with_page(df.limit(0), col).schema["page"], page, error))
    monkeypatch.setattr(pipeline, "diff_pairs", lambda df, pair, error: _diff_with(diff, align, df, pair, error, monkeypatch))
    seen = Observation("scan")
    rows = [*ROWS, (10, 4, 9, "https://f.com/bad", "2024-01-01", deep, None)]
    got = pipeline.scan(captures(spark, rows), names, keep=keep, observation=seen)
    status = {r.id: (r.status, r.error) for r in got.outcomes.collect()}
    assert status[10] == ("failed", "RecursionError") and status[9] == ("failed", "ValueError") and status[6] == ("failed", "timeout") and status[3] == ("changed", None)
    assert seen.get == {"captures": 9, "failed": 1}
    assert {r.snapshot_id for r in got.changes.collect()} == {3, 5}
    assert {r.competitor_id: (r.urls_scanned, r.urls_failed) for r in got.runs.collect()} == {9: (3, 2), 8: (1, 1)}


def _diff_with(diff, align, df, pair, error, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(diff, "align", align)
        return diff.diff_pairs(df, pair, error=error)


def plain_lag(rows):
    out, last = {}, {}
    for i, key, at, v in sorted(rows, key=lambda r: (str(r[1]), r[2] or "", r[0])):
        out[i] = last.get(key)
        last[key] = v
    return out


def test_windows_of_a_hot_key_equal_plain_ones(spark):
    r = random.Random(4)
    rows = [(i, 1 if i % 3 == 0 else r.randrange(2, 40), f"2024-01-{r.randrange(1, 29):02d} {r.randrange(24):02d}:00:00", r.choice("abc")) for i in range(1500)]
    rows += [(2000, None, "2024-01-01 00:00:00", "a"), (2001, None, "2024-01-02 00:00:00", "b"), (2002, 1, "2024-01-05 00:00:00", None), (2003, 1, None, "a")]
    df = spark.createDataFrame(rows, "id long, k int, at string, v string").withColumn("at", F.to_timestamp_ntz("at"))
    got = ordered.lagged(df, ["v"], "k", "at", "id", hot_rows=100, slices=16)
    assert {x.id: x.previous_v for x in got.collect()} == plain_lag(rows)
    counted = {x.id: x.n for x in ordered.numbered(df, "n", "k", "at", "id", hot_rows=100, slices=16).collect()}
    for key in {x[1] for x in rows}:
        own = sorted((x for x in rows if x[1] == key), key=lambda x: (x[2] or "", x[0]))
        assert [counted[x[0]] for x in own] == list(range(1, len(own) + 1))
    assert ordered.lagged(df.limit(0), ["v"], "k", "at", "id").count() == 0


def test_a_hot_key_is_spread_over_tasks(spark, monkeypatch):
    df = spark.range(30_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN -1 ELSE id % 5000 END AS k", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) AS at", "id % 7 AS v")
    assert ordered.SLICE not in ordered.sliced(df.filter("k >= 0"), "k", "at", hot_rows=1_000).columns
    cut = ordered.sliced(df, "k", "at", hot_rows=1_000, slices=16)
    sizes = [r.n for r in cut.groupBy("k", ordered.SLICE).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) < 1_200 and sum(sizes) == 30_000
    monkeypatch.setattr(ordered.sliced, "__defaults__", (16, 1_000))
    points = snapshots.stored(df.selectExpr("id", "k AS tracked_url_id", "at AS timestamp", "cast(v DIV 3 AS string) AS content_hash"))
    expected = 0
    last = {}
    for i in range(30_000):
        k, h = (-1 if i % 3 == 0 else i % 5000), (i % 7) // 3
        expected += last.get(k) != h
        last[k] = h
    assert points.count() == expected


def test_pairs_and_spread_equal_plain_ones(spark):
    r = random.Random(5)
    rows = [(i, r.randrange(4), f"2024-01-{r.randrange(1, 20):02d}", r.choice([200, 200, 404, None]), r.choice(["a", "b", "c", "", None])) for i in range(120)] + [(200, 9, "2024-01-01", 404, "a"), (201, 9, "2024-01-02", 404, "b"), (202, 8, "2024-01-02", 200, "b")]
    df = spark.createDataFrame(rows, "id long, url int, timestamp string, status_code int, digest string")
    expected = {}
    for url, group in itertools.groupby(sorted(rows, key=lambda x: (x[1], x[2], x[0])), key=lambda x: x[1]):
        own = list(group)
        usable = [x for x in own if x[3] == 200] or own
        once = [x for k, x in enumerate(usable) if not x[4] or all(y[4] != x[4] for y in usable[:k])]
        if len(once) > 1:
            expected[url] = (once[0][0], once[-1][0], len(once))
    assert {x.url: (x.before_id, x.after_id, x.n) for x in snapshots.select_pair(df).collect()} == expected
    chosen = set()
    for _, group in itertools.groupby(sorted(rows, key=lambda x: (x[1], x[2], x[0])), key=lambda x: x[1]):
        own = [list(g)[-1][0] for _, g in itertools.groupby(group, key=lambda x: x[2])]
        chosen |= set(own[:3]) | set(own[-4:])
    assert {x.id for x in snapshots.spread(df, 7).collect()} == chosen
