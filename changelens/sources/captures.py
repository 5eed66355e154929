"""Where captures come from and where results go. Fetching itself stays outside; these read what was fetched."""

from __future__ import annotations

import re
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.urls import origin
from ..operators.snapshots import collapse_digests
from ..schema import TABLES, table_schema
from .store import KEYS, keyed


def from_rows(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """In-memory captures (url, html)."""
    return spark.createDataFrame(rows, "url string, html string").withColumn("renderer", F.lit("memory"))


def _decode(body: bytes | None, declared: str | None) -> str | None:
    if body is None:
        return None
    meta = re.search(rb"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", body[:4096])
    for name in ("utf-8", declared, meta and meta[1].decode("ascii"), "cp1252"):
        try:
            if name:
                return bytes(body).decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return bytes(body).decode("latin-1")


@F.pandas_udf(StringType())
def decode_body(bodies: pd.Series, charsets: pd.Series) -> pd.Series:
    """Bytes as text: UTF-8, the declared charset, the page's own, cp1252, latin-1."""
    return pd.Series([_decode(b, c) for b, c in zip(bodies, charsets, strict=True)])


_STAMP = r"/url_(\d+)/(\d{8})T?(\d{6})_([0-9a-f]{1,64})\.html$"


def _days(since: str | None, until: str | None) -> str:
    """A pattern of the names of files from one day to another (YYYY-MM-DD), by day up to two months, by month up to ten years; the exact bounds are filters."""
    if since is None or until is None:
        return "*.html"
    first, last = date.fromisoformat(since[:10]), date.fromisoformat(until[:10])
    if (last - first).days < 62:
        names = [(first + timedelta(days=k)).strftime("%Y%m%d") for k in range((last - first).days + 1)]
    else:
        names = [f"{m // 12:04d}{m % 12 + 1:02d}" for m in range(first.year * 12 + first.month - 1, last.year * 12 + last.month)]
    return "*.html" if not names or len(names) > 120 else "{" + ",".join(f"{n}*" for n in names) + "}"


def archive_folder(spark: SparkSession, path: str, limit: int | None = None, urls: list[int] | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Stored bodies url_<id>/<stamp>_<hash12>.html: (path, tracked_url_id, timestamp, hash12, html, body_cut, error).

    Times are those of the names; a file with another name has the time it was written. Empty bodies
    carry an error. With `limit`, html is its first characters and body_cut tells of it. With `urls`,
    and `since` and `until`, only the folders and files whose names may hold these are listed and
    read (files with other names are then left out).
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = reader.option("pathGlobFilter", _days(since, until)).load(path if urls is None else [f"{path}/url_{int(u)}" for u in urls])
    part = lambda k: F.nullif(F.regexp_extract("path", _STAMP, k), F.lit(""))
    named = F.try_to_timestamp(F.concat(part(2), part(3)), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    text = files.select(
        "path", part(1).cast("long").alias("tracked_url_id"), F.coalesce(named, F.col("modificationTime").cast("timestamp_ntz")).alias("timestamp"), part(4).alias("hash12"), decode_body("content", F.lit(None).cast("string")).alias("html")
    )
    cut = text.withColumn("body_cut", F.lit(False)) if limit is None else text.withColumns({"body_cut": F.length("html") > limit, "html": F.left("html", F.lit(limit))})
    if since is not None and until is not None:
        cut = cut.filter(F.col("timestamp").between(F.lit(since).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz")))
    return cut.withColumn("error", F.when(F.trim(F.coalesce("html", F.lit(""))) == "", "empty body"))


def archive_index(rows: DataFrame, limit: int = 40, observation: Observation | None = None) -> DataFrame:
    """Index rows (url, timestamp, statuscode, digest as text, an id if they have one) -> captures with status 200, equal neighbours folded, at most |limit| of a URL (the newest where negative), malformed rows skipped; `observation` counts rows and malformed ones in the same pass."""
    n = max(1, min(200, abs(limit)))
    at = F.try_to_timestamp("timestamp", F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    key = F.col("id") if "id" in rows.columns else F.xxhash64("url", "timestamp", "digest")
    read = rows.withColumns({"at": at, "status_code": F.col("statuscode").try_cast("int"), "id": key})
    if observation is not None:
        read = read.observe(observation, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("at").isNull() | F.col("status_code").isNull()).alias("malformed"))
    good = read.filter(F.col("at").isNotNull() & (F.col("status_code") == 200))
    order = F.col("at").desc() if limit < 0 else F.col("at").asc()
    nth = F.row_number().over(Window.partitionBy("url").orderBy(order, "id"))
    return collapse_digests(good, at="at").withColumn("__nth", nth).filter(F.col("__nth") <= n).drop("__nth")


def robots_gate(captures: DataFrame, robots: DataFrame) -> DataFrame:
    """captures with allowed and crawl_delay by robots (origin, allowed, crawl_delay); unknown origins are allowed."""
    joined = captures.withColumn("origin", origin("url")).join(robots, "origin", "left")
    return joined.withColumn("allowed", F.coalesce("allowed", F.lit(True)))


def schedule(captures: DataFrame, delay: float = 1.5, key: str = "url") -> DataFrame:
    """captures with start_after: seconds from the first request of the origin, spaced by the longer of delay and crawl_delay.

    Requests go out in the order of a hash of their URL, then of key. An origin is numbered in 256
    parts by that hash, so that one with a third of all requests is spread over many tasks.
    """
    hashed = captures.withColumn("__hash", F.md5("url")).withColumn("__part", F.left("__hash", F.lit(2)))
    sizes = hashed.groupBy("origin", "__part").agg(F.count(F.lit(1)).alias("__n"))
    ahead = F.coalesce(F.sum("__n").over(Window.partitionBy("origin").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("origin", "__part").orderBy("__hash", key))
    numbered = hashed.withColumn("__nth", nth).join(sizes.select("origin", "__part", ahead.alias("__ahead")), ["origin", "__part"])
    start = (F.col("__ahead") + F.col("__nth") - 1) * F.greatest(F.lit(delay), F.coalesce("crawl_delay", F.lit(0.0)))
    return numbered.withColumn("start_after", start).drop("__hash", "__part", "__nth", "__ahead")


def body_name(tracked_url_id: Column, at: Column, digest: Column) -> Column:
    """Name of a stored body: url_<id>/<stamp>_<hash12>.html."""
    return F.concat(F.lit("url_"), tracked_url_id.cast("string"), F.lit("/"), F.date_format(at, "yyyyMMddHHmmss"), F.lit("_"), F.left(digest, F.lit(12)), F.lit(".html"))


def create_tables(spark: SparkSession, location: str) -> None:
    """Empty tables where there are none yet; those with a key begin with their first merge."""
    for name in TABLES:
        if name not in KEYS:
            spark.createDataFrame([], table_schema(name)).write.mode("ignore").parquet(f"{location}/{name}")


def append(df: DataFrame, location: str, name: str) -> None:
    """Add rows to a table by its schema, missing columns null; rows of a table with a key replace those with the same key."""
    if name in KEYS:
        keyed(df.sparkSession, location, name).merge(df)
        return
    fields = table_schema(name).fields
    df.select(*(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields)).write.mode("append").parquet(f"{location}/{name}")


def read_table(spark: SparkSession, location: str, name: str) -> DataFrame:
    if name in KEYS:
        return keyed(spark, location, name).read().drop("bucket")
    return spark.read.schema(table_schema(name)).parquet(f"{location}/{name}")


def save_report(report: DataFrame, text: str, path: str) -> None:
    """A report as JSON rows and as text."""
    report.write.mode("overwrite").json(f"{path}/json")
    report.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/text")


def jdbc_table(spark: SparkSession, url: str, name: str, key: str | None = None, rows_per_part: int = 1_000_000, **options: str) -> DataFrame:
    """A table of a relational store, where its driver is on the class path; filters and columns are pushed to the store.

    With `key`, a whole-number column, the table is read in parts of about rows_per_part rows, by
    ranges between the smallest and the largest key, which the store is asked for first.
    """
    reader = spark.read.format("jdbc").options(url=url, **options)
    if key is not None:
        low, high, n = spark.read.format("jdbc").options(url=url, **options).option("query", f'SELECT MIN("{key}") AS lo, MAX("{key}") AS hi, COUNT(*) AS n FROM {name}').load().first()
        if n and low is not None and high > low:
            parts = max(1, min(-(-int(n) // rows_per_part), int(high) - int(low) + 1))
            reader = reader.option("partitionColumn", key).option("lowerBound", int(low)).option("upperBound", int(high) + 1).option("numPartitions", parts)
    return reader.option("dbtable", name).load()


def write_jdbc(df: DataFrame, url: str, name: str, mode: str = "append", connections: int = 8, **options: str) -> None:
    """Rows to a table of a relational store, over at most so many connections at once."""
    df.write.format("jdbc").options(url=url, dbtable=name, numPartitions=str(connections), **options).mode(mode).save()
