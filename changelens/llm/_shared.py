"""Helpers shared by the corpus operators: staging, shipping and bounded Arrow batches."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every text contract here: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Text that one step inside a Python task holds in numpy form at a time.
CHUNK_BYTES = 4 << 20
CHUNK_ROWS = 1_000

ROOT = Path(__file__).resolve().parents[2]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none is configured and all run on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="changelens-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df once as a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    at = fresh_path(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def dropped(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    jvm, shared = df.sparkSession._jvm, shared_dir(df.sparkSession)
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if jvm.org.apache.hadoop.fs.Path(shared).getName() in str(path.getParent()):
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as the query that made them has ended: for steps that each read what the one before has written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and bound the rows of an Arrow batch where the user set no bound."""
    sc = spark.sparkContext
    on_path = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) not in on_path and not getattr(sc, "_changelens_shipped", False):
        at = os.path.join(tempfile.mkdtemp(prefix="changelens-ship-"), "changelens.zip")
        with zipfile.ZipFile(at, "w") as z:
            for p in (ROOT / "changelens").rglob("*.py"):
                z.write(p, p.relative_to(ROOT))
        sc.addPyFile(at)
        sc._changelens_shipped = True
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if rows not in spark.conf.getAll:  # a value that the user set stays, also the default one
        spark.conf.set(rows, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose files give work to less than half of the cores is dealt to all of them; any larger one is read as it lies. No job runs for it."""
    df, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def n_words(text) -> F.Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def as_bytes(column: pa.Array) -> pa.Array:
    """UTF-8 bytes of a string column, null as empty."""
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most CHUNK_ROWS rows whose texts hold about `limit` bytes; a longer single text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and (total + size > limit or i - start >= CHUNK_ROWS):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(size)
    if len(sizes) > start:
        yield batch.slice(start)


def collected_rows(df: DataFrame, bound: int) -> list:
    """Rows of a result whose size is bounded by construction; more than `bound` is an error, never a silent cut."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"expected at most {bound} rows")
    return rows
