"""Captures in time: latest, previous, deduplicated, and pairs for evaluation. A URL with very many captures is split in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import SLICE, lagged, numbered, running, sliced


def latest(snapshots: DataFrame, url: str = "tracked_url_id", at: str = "timestamp", key: str = "id") -> DataFrame:
    """The newest capture of each URL, by time, then id."""
    rows = F.struct(*(F.col(f"`{c}`") for c in snapshots.columns))
    return snapshots.groupBy(F.col(url).alias("__url")).agg(F.max_by(rows, F.struct(at, key)).alias("__row")).select("__row.*")


def with_previous(snapshots: DataFrame, columns: list[str], url: str = "tracked_url_id", at: str = "timestamp", key: str = "id") -> DataFrame:
    """snapshots with previous_<column> of the capture before, for each of columns."""
    return lagged(snapshots, columns, url, at, key)


def stored(captures: DataFrame, url: str = "tracked_url_id", at: str = "timestamp", key: str = "id", digest: str = "content_hash") -> DataFrame:
    """Captures that are stored: those whose hash is not that of the one before; touched_at is the last time the same content was seen."""
    points = stored_points(captures.select(url, at, key, digest), url, at, key, digest).drop(SLICE)
    return captures.join(points.select(F.col(url).alias("__url"), F.col(key).alias("__key"), "touched_at"), F.col(url).eqNullSafe(F.col("__url")) & (F.col(key) == F.col("__key"))).drop("__url", "__key")


def stored_points(captures: DataFrame, url: str, at: str, key: str, digest: str, keep=lambda df: df) -> DataFrame:
    """(url, at, key, digest, touched_at, slice) of the captures that are stored. Only these narrow columns are sorted; `keep` cuts their plan between the steps."""
    cut = keep(sliced(captures, url, at))
    own = [url, at, key, digest, *([SLICE] if SLICE in cut.columns else [])]
    before = lagged(cut.select(*own, F.lit(True).alias("__there")), [digest, "__there"], url, at, key, ready=True)
    new = F.col("previous___there").isNull() | ~F.col(digest).eqNullSafe(F.col(f"previous_{digest}"))
    runs = running(keep(before).select(*own, new.alias("__new")), {"__run": F.col("__new").cast("int")}, url, at, key, ready=True)
    seen = runs.groupBy(url, "__run").agg(F.min_by(F.struct(*own), F.struct(at, key)).alias("__point"), F.max(at).alias("touched_at"))
    return seen.select("__point.*", "touched_at")


def spread(captures: DataFrame, n: int, url: str = "url", at: str = "timestamp", key: str = "id") -> DataFrame:
    """The first and the last n/2 captures of each URL; of equal times the latest row."""
    rows = F.struct(*(F.col(f"`{c}`") for c in captures.columns))
    one = captures.groupBy(F.col(url).alias("__url"), F.col(at).alias("__at")).agg(F.max_by(rows, key).alias("__row")).select("__row.*")
    placed = numbered(one, "__nth", url, at, key)
    size = one.groupBy(F.col(url).alias("__u")).agg(F.count(F.lit(1)).alias("__n"))
    counted = placed.join(size, F.col(url).eqNullSafe(F.col("__u"))).drop("__u")
    return counted.filter((F.col("__nth") <= n // 2) | (F.col("__n") - F.col("__nth") < n - n // 2)).drop("__nth", "__n")


def select_pair(captures: DataFrame, url: str = "url", at: str = "timestamp", status: str = "status_code", digest: str = "digest", key: str = "id") -> DataFrame:
    """(url, before_<key>, after_<key>, n): earliest and latest distinct capture with status 200, of any status where none has it; URLs with fewer than two are left out."""
    order, good = F.struct(at, key), F.coalesce(F.col(status) == 200, F.lit(False))
    # Of a digest the first capture counts, an empty digest's captures all do: a row a digest, combined before the shuffle.
    same = F.when(F.coalesce(digest, F.lit("")) != "", F.col(digest)).otherwise(F.concat(F.lit("\0"), F.col(key).cast("string")))
    once = captures.groupBy(url, same.alias("__same"), good.alias("__good")).agg(F.min(order).alias("__first"))
    any_digest = once.groupBy(url, "__same").agg(F.min("__first").alias("__any"), F.min(F.when(F.col("__good"), F.col("__first"))).alias("__200"))
    pick = lambda c: (F.min(c)[key], F.max(c)[key], F.count(c))
    found = any_digest.groupBy(url).agg(*(x.alias(f"{side}_{i}") for side in ("__200", "__any") for i, x in enumerate(pick(side))))
    use = lambda i: F.when(F.col("__200_2") > 0, F.col(f"__200_{i}")).otherwise(F.col(f"__any_{i}"))
    return found.select(url, use(0).alias(f"before_{key}"), use(1).alias(f"after_{key}"), use(2).alias("n")).filter("n >= 2")


def collapse_digests(captures: DataFrame, url: str = "url", at: str = "timestamp", digest: str = "digest", key: str = "id") -> DataFrame:
    """Captures whose digest differs from that of the one before, as an archive index lists them."""
    before = F.col(f"previous_{digest}")
    return lagged(captures, [digest], url, at, key).filter(before.isNull() | (before != F.col(digest))).drop(f"previous_{digest}")


def parse_archive_date(c: Column) -> Column:
    """YYYY, YYYYMM, YYYYMMDD or fourteen digits as a time; null where it is none of these."""
    digits = F.regexp_replace(c, r"[^0-9]", "")
    padded = F.when(F.length(digits) == 4, F.concat(digits, F.lit("0101000000"))).when(F.length(digits) == 6, F.concat(digits, F.lit("01000000"))).when(F.length(digits) == 8, F.concat(digits, F.lit("000000"))).when(
        F.length(digits) == 14, digits
    )
    return F.try_to_timestamp(padded, F.lit("yyyyMMddHHmmss"))
