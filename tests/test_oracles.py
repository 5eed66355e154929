"""Spark and DuckDB side by side on the smallest tables, for one query of each kind; the driver compares all."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["content_hash", "redact", "url_safe", "canonicalise", "grounding_check", "snapshot_dedupe", "capture_pair", "line_changes", "noise_reason", "classify_changes", "relevance_score", "top_competitors", "competitor_rollup", "due_by_frequency", "category_merge", "score_coercion", "archive_index", "archive_index_newest", "evaluation_suite", "decoded_bodies", "request_schedule", "scan_runs", "validated_payloads", "new_competitors", "new_tracked_urls", "merged_competitors"]


def _rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted("|".join("" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    assert _rows(entry.queries()[name](spark, SF).toPandas()) == _rows(con.sql(entry.oracle_sql()[name]).df())
