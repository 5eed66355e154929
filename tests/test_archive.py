"""Archive folders: times of names, pruned folders and files, cut and empty bodies."""

import os

from pyspark.sql import Observation

from changelens.sources import captures as sources


def test_malformed_index_rows_are_counted(spark):
    rows = [("u", "20230101120000", "200", "A"), ("u", "20230102120000", "-", "B"), ("u", "bad", "200", "C"), (None, "20230104120000", "404", "D"), ("u", None, None, None), ("u", "20230105120000", "200", "E")]
    seen = Observation("index")
    index = sources.archive_index(spark.createDataFrame(rows, "url string, timestamp string, statuscode string, digest string").coalesce(1), observation=seen)
    index.write.format("noop").mode("overwrite").save()
    assert sorted(r.digest for r in index.collect()) == ["A", "E"] and seen.get["rows"] == 6 and seen.get["malformed"] == 3


def test_archive_folder(spark, tmp_path):
    files = {"url_1/20240105T101500_abc123abc123.html": "<p>one</p>", "url_1/20240206101500_abc123abc124.html": "<p>" + "x" * 50 + "</p>", "url_2/20240105101500_ff.html": "  ", "url_22/20240105101500_ff.html": "<p>two</p>", "url_1/odd name.html": "<p>odd</p>"}
    for name, body in files.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(body)
    got = {os.path.basename(r.path).split("?")[0]: r for r in sources.archive_folder(spark, str(tmp_path), limit=20).collect()}
    assert len(got) == 4  # two URLs have a file of the same name
    first = got["20240105T101500_abc123abc123.html"]
    assert (first.tracked_url_id, str(first.timestamp), first.hash12, first.body_cut, first.error) == (1, "2024-01-05 10:15:00", "abc123abc123", False, None)
    assert got["20240206101500_abc123abc124.html"].body_cut and len(got["20240206101500_abc123abc124.html"].html) == 20
    assert [r.error for r in sources.archive_folder(spark, str(tmp_path), urls=[2]).collect()] == ["empty body"]
    some = sources.archive_folder(spark, str(tmp_path), urls=[1, 22], since="2024-01-01", until="2024-01-31")
    assert sorted(r.tracked_url_id for r in some.collect()) == [1, 22] and len(some.inputFiles()) == 2
    year = sources.archive_folder(spark, str(tmp_path), since="2023-12-01", until="2024-02-06 10:15:00")
    assert sorted((r.tracked_url_id, str(r.timestamp)[:10]) for r in year.collect()) == [(1, "2024-01-05"), (1, "2024-02-06"), (2, "2024-01-05"), (22, "2024-01-05")]
