"""Token-id output: Parquet files with a list column of ids that allow selective reads.

Rows are range-partitioned by doc_id, so the files hold ascending documents. The list's ids are
dictionary encoded (a vocabulary of 50k ids takes at most 16 bits an id), doc_id and n_tokens are
delta encoded by the version 2 writer; row groups and pages are small and every column chunk has
its page index. A reader that wants lengths never touches the ids' pages, and a reader of some
documents skips row groups and pages by their doc_id bounds.

Defined results: a null or empty text is its end id alone; a null doc_id stands first; rows that
repeat a doc_id stand together, each a document; an empty table gives an empty, readable folder.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import chunks, prepare
from .tokenizing import default_file, encoder

#: Bytes of a row group, and bytes and rows of a page.
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 16 << 20, 128 << 10, 2_000
#: Rows of a file.
ROWS_PER_FILE = 20_000


def token_rows(docs: DataFrame, end_id: int = 0, file: str | None = None, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) of every row of docs."""
    prepare(docs.sparkSession)
    file, kind, end = file or default_file(), docs.schema["doc_id"].dataType.simpleString(), np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                ids = [x + end for x in encoder(file).encode([t or "" for t in batch.column("text").to_pylist()])]
                n = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), lists], names=["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>")


def write_tokens(docs: DataFrame, path: str, end_id: int = 0, file: str | None = None, text: str = "text", rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write the ids of docs in ascending doc_id order; columns part and place tell the order of the files and of the documents in each."""
    parts = max(1, -(-docs.count() // rows_per_file))
    ranged = docs.select("doc_id", F.col(text).alias("text")).repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    # The number of the file and the place in it: rows of one doc_id have no other order.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = token_rows(ordered, end_id, file).withColumns({"part": F.spark_partition_id(), "place": place})
    writer = rows.write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
    writer = writer.option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES).option("parquet.page.row.count.limit", PAGE_ROWS)
    writer = writer.option("parquet.enable.dictionary", "true").option("parquet.enable.dictionary#doc_id", "false").option("parquet.enable.dictionary#n_tokens", "false").option("parquet.enable.dictionary#place", "false")
    writer.option("parquet.dictionary.page.size", 1 << 20).parquet(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Documents with first <= doc_id <= last; the bounds skip row groups and pages."""
    out = spark.read.parquet(path)
    if first is not None:
        out = out.filter(F.col("doc_id") >= first)
    return out if last is None else out.filter(F.col("doc_id") <= last)


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(part, doc_id, n_tokens) without reading any ids."""
    return spark.read.parquet(path).select("part", "doc_id", "n_tokens")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the files; start counts the ids of all documents before."""
    read = spark.read.parquet(path)
    kind = read.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            edges, flat = lists.offsets.to_numpy(), memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
            crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            n = np.diff(edges).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("place"), batch.column("doc_id"), pa.array(n), pa.array(crc, pa.int64())], names=["part", "place", "doc_id", "n_tokens", "ids_crc32"])

    rows = read.select("part", "place", "doc_id", "ids").mapInArrow(run, f"part int, place long, doc_id {kind}, n_tokens long, ids_crc32 long")
    sums = read_lengths(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    sums = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return rows.join(sums, "part").select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")
