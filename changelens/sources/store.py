"""Stored tables with a key: replays add nothing, and only the touched parts of a table are written.

A table lies in folders bucket=<n>, by a hash of a column (the tracked URL of a snapshot). A merge
reads the buckets that the new rows fall into and no others (a partition filter, at most `buckets`
numbers), replaces rows with equal keys and writes these buckets back by dynamic partition
overwrite. The merged rows are written beside the table first: if the job dies while the buckets
are exchanged, the next merge or read finds them and finishes the exchange.

Rows may be numbered: a new key gets the number (bucket << 40) + its place in the bucket, after
the largest number there; a known key keeps its own. Numbers never clash, and no task numbers more
than the new rows of a bucket.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..schema import TABLES

BUCKETS = 256
#: Tables with a key: their keys, and the column whose hash names the bucket.
KEYS = {
    "snapshots": (["tracked_url_id", "id"], "tracked_url_id"),
    "changes": (["change_key"], "change_key"),
    "intelligence": (["change_key"], "change_key"),
    "scan_runs": (["competitor_id", "started_at"], "competitor_id"),
}
#: Numbers of a bucket.
NUMBERS = 1 << 40


def kept(df: DataFrame) -> DataFrame:
    """df computed once: written as a Parquet table to the folder in spark.checkpoint.dir, until the application ends, and read back; persisted where there is no such folder."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        return df.persist()
    at = f"{shared.rstrip('/')}/kept-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


@dataclass
class KeyedTable:
    """A table at `path` with columns `ddl`, unique `keys`, and folders by a hash of column `by`."""

    spark: SparkSession
    path: str
    ddl: str
    keys: list[str]
    by: str
    buckets: int = BUCKETS
    schema: StructType = field(init=False)

    def __post_init__(self) -> None:
        self.schema = StructType.fromDDL(self.ddl)
        self._whole = StructType([*self.schema.fields, StructField("bucket", IntegerType())])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.by), F.lit(self.buckets)).cast("int").alias("bucket")

    def _fs(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _exists(self, at: str) -> bool:
        fs, path = self._fs(at)
        return fs.exists(path)

    def _drop(self, at: str) -> None:
        fs, path = self._fs(at)
        fs.delete(path, True)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The table's rows with their bucket; of some buckets only, where these are given."""
        self.recover()
        if not self._exists(self.path):
            return self.spark.createDataFrame([], self._whole)
        rows = self.spark.read.schema(self._whole).parquet(self.path)
        return rows if buckets is None else rows.filter(F.col("bucket").isin(*buckets))

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets that rows fall into: at most `buckets` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def merge(self, rows: DataFrame, number: str | None = None) -> None:
        """Put rows in the place of those with equal keys (the last of several by all columns), keep all others."""
        self.recover()
        fresh = f"{self.path}__new/{uuid.uuid4().hex}"
        names = self.schema.names
        typed = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema))
        typed.select(*names, self.bucket()).write.parquet(fresh)  # the plan of rows runs once
        given = self.spark.read.parquet(fresh)
        touched = sorted(r[0] for r in given.select("bucket").distinct().collect())
        if touched:
            same = F.row_number().over(Window.partitionBy("bucket", *self.keys).orderBy(*(F.desc(n) for n in names)))
            once = given.withColumn("__nth", same).filter("__nth = 1").drop("__nth")
            old = self.read(touched).select(*names, "bucket")
            if number:
                once = self._numbered(once, old, number)
            kept = old.join(once, reduce(and_, (once[k].eqNullSafe(old[k]) for k in ("bucket", *self.keys))), "left_anti")
            pending = f"{self.path}__merged"
            kept.unionByName(once.select(*names, "bucket")).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(pending)
            self.recover()
        self._drop(fresh)

    def _numbered(self, once: DataFrame, old: DataFrame, number: str) -> DataFrame:
        known = old.select("bucket", *self.keys, F.col(number).alias("__known"))
        top = old.groupBy(F.col("bucket").alias("__b")).agg(F.max(number).alias("__top"))  # a row a bucket
        joined = once.join(known.toDF("__kb", *(f"__k_{k}" for k in self.keys), "__known"), reduce(and_, (F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in self.keys), F.col("bucket") == F.col("__kb")), "left")
        placed = joined.join(F.broadcast(top), F.col("bucket") == F.col("__b"), "left")
        nth = F.row_number().over(Window.partitionBy("bucket", F.col("__known").isNull()).orderBy(*self.keys))
        base = F.coalesce(F.col("__top"), F.col("bucket").cast("long") * NUMBERS)
        return placed.withColumn(number, F.coalesce(F.col("__known"), base + nth)).select(*once.columns)

    def recover(self) -> None:
        """Finish the exchange of buckets that a merge has prepared."""
        pending = f"{self.path}__merged"
        if self._exists(f"{pending}/_SUCCESS"):
            ready = self.spark.read.schema(self._whole).parquet(pending)
            ready.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
            self._drop(pending)


def keyed(spark: SparkSession, location: str, name: str, buckets: int = BUCKETS) -> KeyedTable:
    """One of the tables with a key in a store."""
    return KeyedTable(spark, f"{location}/{name}", TABLES[name], *KEYS[name], buckets)
