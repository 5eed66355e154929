"""Best-fit packing of documents into token sequences by the sum-of-squares rule.

Ids are made by the tokenizers library, an end id follows each document, and only documents
longer than a sequence are cut; all their pieces but the first are full. Of the text only figures
(lengths, checksums) are shuffled. Pieces are dealt by hash to partitions of about
PIECES_PER_PARTITION, each of which packs on its own: longest first, each piece goes to the open
bin that makes the sum over gaps of (open bins with that gap) squared smallest, the smallest gap
on a tie; a new bin opens only when no open bin has room. A partition leaves a handful of bins
partly empty, so partitions are large, and they bound a task's memory.

Defined results: a null or empty text is its end id alone; rows that repeat a doc_id are packed
each; sequences are gapless from offset 0; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import chunks, prepare, staged
from .tokenizing import default_file, encoder

PIECES_PER_PARTITION = 50_000
PIECE_SCHEMA = "doc_id {kind}, piece int, start long, length long, ids_crc32 long"


def cut_points(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of n ids: the first may be shorter, the others are full."""
    first = (n - 1) % capacity + 1
    return [0, *range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int, end_id: int, file: str, text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row of docs."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(encoder(file).encode([t or "" for t in batch.column("text").to_pylist()])):
                    ids = memoryview(ids + end)
                    n = len(ids) // 4
                    at = cut_points(n, capacity)
                    for k, (a, b) in enumerate(zip(at, [*at[1:], n], strict=True)):
                        row.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[4 * a : 4 * b]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, PIECE_SCHEMA.format(kind=kind))


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece."""
    order = np.argsort(-lengths, kind="stable")
    count = np.zeros(capacity + 1)
    count[0] = -0.5  # a full bin adds nothing: 2 * count + 1 = 0
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    n_bins = 0
    for i in order:
        n = int(lengths[i])
        # Moving a bin from gap g to gap g - n changes the sum by 2 * (count[g - n] - count[g] + 1).
        change = count[: capacity - n] - count[n:capacity]
        change[count[n:capacity] <= 0] = np.inf
        k = int(change.argmin()) if capacity > n else 0
        if capacity > n and change[k] < np.inf:
            gap = k + n
            b = bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b, n_bins = capacity, n_bins, n_bins + 1
        where[i], offset[i] = b, capacity - gap
        if gap > n:
            bins[gap - n].append(b)
            count[gap - n] += 1
    return where, offset


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, file: str | None = None, text: str = "text", per_partition: int = PIECES_PER_PARTITION) -> DataFrame:
    """Pieces of docs with sequence_id and offset."""
    cut = staged(pieces(docs, capacity, end_id, file or default_file(), text), "pack-pieces")
    parts = max(1, -(-cut.count() // per_partition))
    rank = F.xxhash64("doc_id", "piece", "ids_crc32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if own is None or not own.num_rows:
            return
        where, offset = sum_of_squares(own.column("length").to_numpy(), capacity)
        where += TaskContext.get().partitionId() << 40
        packed = own.append_column("sequence_id", pa.array(where)).append_column("offset", pa.array(offset))
        yield from packed.to_batches(max_chunksize=10_000)

    dealt = cut.withColumn("rank", rank).repartition(parts, "rank").sortWithinPartitions("rank", "doc_id", "start").drop("rank")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.mapInArrow(run, PIECE_SCHEMA.format(kind=kind) + ", sequence_id long, offset long")
