"""Row-wise Python steps over Arrow batches, and dealing small tables to all cores before costly steps."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType

ROOT = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where their path does not hold it, and bound the rows of an Arrow batch where the user set no bound."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if rows not in spark.conf.getAll:  # a batch of pages, or of texts as bytes, is held several times by a worker
        spark.conf.set(rows, "1000")
    sc = spark.sparkContext
    on_path = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) in on_path or getattr(sc, "_changelens_shipped", False):
        return
    at = os.path.join(tempfile.mkdtemp(prefix="changelens-ship-"), "changelens.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in (ROOT / "changelens").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(at)
    sc._changelens_shipped = True


def spread(scan: DataFrame) -> DataFrame:
    """A freshly read table whose files give work to less than half of the cores, dealt to all of them; any larger table as it is.

    For small tables ahead of steps that cost far more than a shuffle. Planning a scan starts no job.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if 2 * scan.rdd.getNumPartitions() <= cores else scan


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Few and small rows ahead of steps that cost far more than a shuffle, dealt by their keys to as many tasks as the session shuffles to.

    The number is given, so that adaptive execution does not merge the partitions by their bytes.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def with_python(df: DataFrame, inputs: list[str], output: StructField, compute: Callable[..., object], error: str | None = None) -> DataFrame:
    """df with a column computed row by row from the Python values of `inputs`; other columns pass through as Arrow.

    With `error`, a row for which compute raises has null in the output and the exception's type
    in a column of that name, and all other rows stand; without it the job fails.
    """
    ship(df.sparkSession)
    base = df.drop(output.name, *([error] if error else []))
    names = base.columns
    kind = to_arrow_type(output.dataType)

    def tried(row: tuple) -> tuple[object, str | None]:
        try:
            return compute(*row), None
        except Exception as raised:
            if not error:
                raise
            return None, type(raised).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                values = [tried(row) for row in zip(*(part.column(c).to_pylist() for c in inputs), strict=True)]
                made = [pa.array([v for v, _ in values], kind), *([pa.array([e for _, e in values], pa.string())] if error else [])]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *made], names=[*names, output.name, *([error] if error else [])])

    return base.mapInArrow(run, StructType([*base.schema.fields, output, *([StructField(error, StringType())] if error else [])]))
