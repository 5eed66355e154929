"""Filter interaction audit: what each of several filters removes in every order they may be applied in.

One pass over the documents gives each a mask of the filters that it fails; masks are counted a
part (a language, say) into at most 2^n cells. Everything else follows from the cells: the orders
are visited by adjacent transpositions, each order differing from the one before in two
neighbouring steps, and only these two are counted anew. A filter's Shapley sum adds up along the
walk. Parts are walked in parallel, a row of cells each.

The last filter of the audit is table-wide: a document fails it where a smaller doc_id has an
identical text. Digests are grouped with map-side combining and only digests of several documents
meet their rows again, the hot ones by broadcast.

Defined results: a null text is empty; a null part is the empty string; a null doc_id is neither
smaller nor larger than any other, so it never fails the table-wide filter, and has no label; rows
that share a doc_id are documents of their own and do not make each other duplicates; several
labels of one doc_id count as good (or toxic) if one of them says so; an empty table has no parts
and gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import UPPER, as_bytes, chunks, prepare, staged
from .components import HOT_SHARE

#: An audit visits n! orders, so more filters than these are refused.
MAX_FILTERS = 8
_CAPITALS, _SYMBOLS = UPPER.encode(), b"#$%&*|"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@dataclass(frozen=True)
class Filter:
    """A letter and a test: fails(text in UTF-8, its words, its code points)."""

    letter: str
    fails: Callable[[bytes, list[bytes], int], bool]


FILTERS = (
    Filter("A", lambda text, words, points: len(words) < 200),
    Filter("B", lambda text, words, points: 100 * len(set(words)) < 50 * len(words)),
    Filter("C", lambda text, words, points: 100 * (len(text) - len(text.translate(None, _CAPITALS))) > 3 * points),
    Filter("D", lambda text, words, points: len(text.translate(None, _SYMBOLS)) < len(text)),
)
#: Letter of the table-wide filter, which is the last bit of a mask.
DUPLICATE = "E"


def judged(docs: DataFrame, filters=FILTERS, part: str = "lang", text: str = "text") -> DataFrame:
    """(doc_id, part, mask, digest) of every row: bit k of mask is set where filter k fails; digest is the SHA-256 of the text."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                points = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
                masks, digests = [], []
                for text, n in zip(as_bytes(batch.column("text")).to_pylist(), points, strict=True):
                    words = text.split()  # at the six ASCII white spaces
                    masks.append(sum(1 << k for k, f in enumerate(filters) if f.fails(text, words, int(n))))
                    digests.append(hashlib.sha256(text).digest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "mask", "digest"])

    narrow = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, part string, mask int, digest binary")


def with_duplicates(rows: DataFrame, bit: int) -> DataFrame:
    """rows (doc_id, digest, mask) with `bit` added to mask where a smaller doc_id has the same digest; digest goes."""
    rows = staged(rows, "audit-rows")
    groups = rows.filter(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("n"))
    groups = staged(groups.filter("first_id < last_id").drop("last_id"), "audit-groups")
    often = F.col("n") > max(1.0, rows.count() * HOT_SHARE)
    hot = F.broadcast(groups.filter(often).select("digest", F.col("first_id").alias("hot_id")))  # at most 1 / HOT_SHARE rows
    met = rows.join(hot, "digest", "left")
    rest = met.filter(F.col("hot_id").isNull()).drop("hot_id").join(groups.filter(~often).drop("n"), "digest", "left")
    both = rest.unionByName(met.filter(F.col("hot_id").isNotNull()).withColumnRenamed("hot_id", "first_id"))
    fails = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return both.withColumn("mask", F.col("mask") + fails.cast("int") * bit).drop("digest", "first_id")


def cells(docs: DataFrame, labels: DataFrame, filters=FILTERS, part: str = "lang", text: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): documents a part and mask, and those labelled good and toxic. At most 2^(filters + 1) rows a part."""
    rows = with_duplicates(judged(docs, filters, part, text), 1 << len(filters))
    of_label = labels.filter(F.col("doc_id").isNotNull() & ((F.col("quality") == 1) | (F.col("toxic") == 1))).groupBy("doc_id")
    known = of_label.agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    counts = [F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")]
    with_id = rows.filter(F.col("doc_id").isNotNull()).join(staged(known, "audit-labels"), "doc_id", "left").select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    without = rows.filter(F.col("doc_id").isNull()).select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return with_id.unionByName(without).groupBy("part", "mask").agg(*counts)


def transpositions(n: int) -> Iterator[tuple[tuple[int, ...], int | None]]:
    """Every order of range(n), each with the place p whose item changed places with the next one since the order before (None at first)."""
    order, heading = list(range(n)), [-1] * n
    yield tuple(order), None
    while True:
        movable = [x for x in order if 0 <= (to := order.index(x) + heading[x]) < n and order[to] < x]
        if not movable:
            return
        x = max(movable)
        at = order.index(x)
        to = at + heading[x]
        order[at], order[to] = order[to], order[at]
        for y in range(x + 1, n):
            heading[y] = -heading[y]
        yield tuple(order), min(at, to)


def walk(n: np.ndarray, good: np.ndarray, toxic: np.ndarray, letters: str) -> list[dict]:
    """A row for each order and step from the cells of one part: arrays by mask, of 2^len(letters) entries."""
    f, masks = len(letters), np.arange(len(n))
    table = np.stack([n, good, toxic]).astype(np.int64)
    single = [int(n[1 << k]) for k in range(f)]
    failing = [int(n[masks & (1 << k) > 0].sum()) for k in range(f)]
    shapley, orders, steps = np.zeros(f, np.int64), [], []

    def count(order: tuple[int, ...], at: int) -> tuple[int, int, int]:
        """What the filter at step `at` removes: (documents, good ones, toxic ones)."""
        before = sum(1 << k for k in order[:at])
        hit = (masks & before == 0) & (masks & (1 << order[at]) > 0)
        return tuple(int(x) for x in table[:, hit].sum(1))

    current: list[tuple[int, int, int]] = []
    for order, swapped in transpositions(f):
        for at in range(f) if swapped is None else (swapped, swapped + 1):
            current[at : at + 1] = [count(order, at)]
        for at, k in enumerate(order):
            shapley[k] += current[at][0]
        orders.append(order)
        steps.append(list(current))
    out = []
    for order, removed in zip(orders, steps, strict=True):
        left = int(n.sum())
        for at, k in enumerate(order):
            left -= removed[at][0]
            out.append({
                "filter_order": "".join(letters[i] for i in order), "step": at + 1, "kept": left, "removed": removed[at][0], "redundant": failing[k] - removed[at][0], "unique_fails": single[k],
                "good_lost": removed[at][1], "toxic_lost": removed[at][2], "shapley": int(shapley[k]),
            })
    return out


def audit(docs: DataFrame, labels: DataFrame, filters=FILTERS, part: str = "lang", text: str = "text") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part, order and step."""
    letters = "".join(f.letter for f in filters) + DUPLICATE
    if len(letters) > MAX_FILTERS or len(set(letters)) < len(letters):
        raise ValueError(f"at most {MAX_FILTERS} filters of different letters")
    prepare(docs.sparkSession)
    gathered = cells(docs, labels, filters, part, text).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 2^MAX_FILTERS of a part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, own in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                by_mask = np.zeros((3, 1 << len(letters)), np.int64)
                for c in own:
                    by_mask[:, c["mask"]] = c["n"], c["good"], c["toxic"]
                rows = walk(*by_mask, letters)
                columns = {"part": [name] * len(rows)} | {c: [r[c] for r in rows] for c in rows[0]}
                yield pa.RecordBatch.from_pydict(columns, pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in COUNTS)]))

    return gathered.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
