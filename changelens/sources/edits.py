"""Edits of the competitor tables as set operations: new rows with their defaults, toggles, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import normalize_url, page_type, unsafe_reason
from ..plans.analytics import name_conflicts


def new_competitors(competitors: DataFrame, wanted: DataFrame, as_of: str) -> DataFrame:
    """Rows to append for wanted (name, website_url, description): names that are taken and unsafe URLs are left out; ids lie above the largest."""
    fresh = wanted.withColumn("id", F.lit(None).cast("long"))
    free = fresh.join(name_conflicts(competitors, fresh).select("name").distinct(), "name", "left_anti").filter(unsafe_reason("website_url").isNull())
    start = competitors.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__start"))
    ordered = free.dropDuplicates(["name"]).crossJoin(F.broadcast(start))  # one row
    # A hash keeps ids apart without numbering rows in one task.
    numbered = ordered.withColumn("id", F.col("__start") + 1 + F.pmod(F.xxhash64("name"), F.lit(1 << 40)))
    at = F.lit(as_of).cast("timestamp_ntz")
    return numbered.select(
        "id", F.trim("name").alias("name"), normalize_url("website_url").alias("website_url"), "description", F.lit("daily").alias("tracking_frequency"), F.lit(True).alias("active"), at.alias("created_at"), at.alias("updated_at")
    )


def new_urls(tracked_urls: DataFrame, wanted: DataFrame, as_of: str) -> DataFrame:
    """Rows to append for wanted (competitor_id, url, label): safe URLs the competitor does not have yet, with their page type."""
    asked = wanted.filter(unsafe_reason("url").isNull()).withColumn("url", normalize_url("url")).dropDuplicates(["competitor_id", "url"])
    fresh = asked.join(tracked_urls.select("competitor_id", "url"), ["competitor_id", "url"], "left_anti")
    none = F.lit(None).cast("string")
    return fresh.select(
        F.xxhash64("competitor_id", "url").alias("id"), "competitor_id", "url", "label", page_type("url").alias("page_type"), F.lit(False).alias("render_js"), F.lit(True).alias("active"), F.lit(None).cast("timestamp_ntz").alias("last_checked"),
        none.alias("last_status"), none.alias("last_error"), F.lit(as_of).cast("timestamp_ntz").alias("created_at"),
    )


def toggled(competitors: DataFrame, ids: DataFrame, as_of: str) -> DataFrame:
    """competitors with active turned over for the given ids (id)."""
    marked = competitors.join(ids.select("id", F.lit(True).alias("__turn")).distinct(), "id", "left")
    turn = F.coalesce("__turn", F.lit(False))
    return marked.withColumns({"active": F.col("active") != turn, "updated_at": F.when(turn, F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("updated_at"))}).drop("__turn")


def merged(rows: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """rows with the columns of changes where a key occurs there; null in changes leaves a value."""
    other = changes.select(F.col(key), *(F.col(c).alias(f"__{c}") for c in changes.columns if c != key))
    joined = rows.join(other, key, "left")
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c != key and c in changes.columns else F.col(c) for c in rows.columns))
