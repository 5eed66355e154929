"""Line dedup: repeated lines are looked up in sharded minimal perfect hash tables.

One pass counts the documents of every line (map-side combined). The lines that reach
`min_docs` go into shards; each shard is a minimal perfect hash (levels of bit arrays with
ranks) that indexes two flat arrays, a 64-bit fingerprint and a document count. A second pass
probes the arrays with each document's line hashes. While all shards together stay within
`broadcast_bytes` (a checked size) they are broadcast and documents are not shuffled at all.
Beyond it the probes go to the shards, salted, so that a very frequent line is spread over
several tasks, and only the positions of lines to drop come back.

Defined results: a null or empty text is one empty line; an empty key is never dropped; a
document counts once for a line however often it holds it; repeated rows count as documents
of their own; every other column is passed on, and kept_text, n_lines, n_dropped replace
columns of those names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import LOWER, SPACE, UPPER, chunks, prepare, staged

KEYS_PER_SHARD = 500_000
BROADCAST_BYTES = 64 << 20
SALTS = 8
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Position of each key in a level: splitmix64 of the key and the level."""
    with np.errstate(over="ignore"):
        z = keys + _STEP * np.uint64(level + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (z ^ (z >> np.uint64(31))) % np.uint64(size)


class PerfectHash:
    """Minimal perfect hash over uint64 keys: level l holds the keys that are alone in their slot there.

    A key's index is the rank of its bit over all levels. Keys equal in all 64 bits never part;
    build() returns them apart, for an exact list.
    """

    LEVELS = 48

    def __init__(self, bits: list[np.ndarray]) -> None:
        self.bits = bits
        self.sizes = [len(b) * 8 for b in bits]
        self.ranks, base = [], 0
        for b in bits:
            ones = np.bitwise_count(b).astype(np.int64)
            self.ranks.append(base + np.concatenate([[0], np.cumsum(ones)[:-1]]))
            base += int(ones.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        bits, rest = [], np.arange(len(keys))
        for level in range(cls.LEVELS):
            if not len(rest):
                break
            size = max(64, -(-len(rest) * 3 // 2 // 8) * 8)
            slot = _slot(keys[rest], level, size).astype(np.int64)
            alone = np.bincount(slot, minlength=size) == 1
            bits.append(np.packbits(alone, bitorder="little"))
            rest = rest[~alone[slot]]
        return cls(bits), rest

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; of a key outside the set any index or -1."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.bits):
            if not len(left):
                break
            slot = _slot(keys[left], level, self.sizes[level]).astype(np.int64)
            byte, bit = slot >> 3, (slot & 7).astype(np.uint8)
            hit = (bits[byte] >> bit) & 1 == 1
            below = np.bitwise_count(bits[byte] & ((np.uint8(1) << bit) - np.uint8(1)))
            out[left[hit]] = (self.ranks[level][byte] + below)[hit]
            left = left[~hit]
        return out


class Shard:
    """A perfect hash with its fingerprint and count arrays."""

    def __init__(self, sizes: bytes, bits: bytes, prints: bytes, counts: bytes, rest: bytes) -> None:
        edges = np.cumsum(np.frombuffer(sizes, "<i8"))
        self.table = PerfectHash(np.split(np.frombuffer(bits, np.uint8), edges[:-1]) if len(edges) else [])
        self.prints, self.counts = np.frombuffer(prints, "<u8"), np.frombuffer(counts, "<i8")
        self.rest = {(int(a), int(b)): int(n) for a, b, n in np.frombuffer(rest, "<u8").reshape(-1, 3)}

    @staticmethod
    def build(h1: np.ndarray, h2: np.ndarray, n: np.ndarray) -> dict[str, bytes]:
        table, rest = PerfectHash.build(h1)
        at = table.index(h1)
        inside = np.ones(len(h1), bool)
        inside[rest] = False
        prints, counts = np.zeros(int(inside.sum()), "<u8"), np.zeros(int(inside.sum()), "<i8")
        prints[at[inside]], counts[at[inside]] = h2[inside], n[inside]
        return {
            "sizes": np.array([len(b) for b in table.bits], "<i8").tobytes(),
            "bits": b"".join(b.tobytes() for b in table.bits),
            "prints": prints.tobytes(),
            "counts": counts.tobytes(),
            "rest": np.stack([h1[rest], h2[rest], n[rest].astype(np.uint64)], 1).astype("<u8").tobytes(),
        }

    def documents(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Documents of each line, 0 where the index has no such line."""
        at = self.table.index(h1)
        known = at >= 0
        known[known] = self.prints[at[known]] == h2[known]
        out = np.zeros(len(h1), np.int64)
        out[known] = self.counts[at[known]]
        if self.rest:
            for i in np.nonzero(~known)[0]:
                out[i] = self.rest.get((int(h1[i]), int(h2[i])), 0)
        return out


def line_keys(text: Column) -> Column:
    """Keys of a text's lines: stripped of ASCII white space at both ends, A-Z lower-cased."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.transform(lines, lambda x: F.translate(F.btrim(x, F.lit(SPACE)), UPPER, LOWER))


def _hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))


def shard_count(keys: int) -> int:
    return max(1, -(-keys // KEYS_PER_SHARD))


def line_index(docs: DataFrame, min_docs: int, text: str = "text") -> DataFrame:
    """Shards (shard, n_keys, sizes, bits, prints, counts, rest) of the lines in at least min_docs documents."""
    spark = docs.sparkSession
    prepare(spark)
    keys = docs.select(F.explode(F.array_distinct(line_keys(F.col(text)))).alias("key")).filter(F.length("key") > 0)
    counted = staged(
        keys.select(_hashes(F.col("key")).alias("h")).groupBy("h.h1", "h.h2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs),
        "line-counts",
    )
    n_shards = shard_count(counted.count())

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = (pdf[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
        return pd.DataFrame([{"shard": int(pdf["shard"].iloc[0]), "n_keys": len(pdf)} | Shard.build(h1, h2, pdf["n"].to_numpy(np.int64))])

    shards = counted.withColumn("shard", F.pmod(F.col("h1"), F.lit(n_shards))).groupBy("shard")
    return staged(shards.applyInPandas(build, "shard long, n_keys long, sizes binary, bits binary, prints binary, counts binary, rest binary"), "line-shards")


_PARTS = ("sizes", "bits", "prints", "counts", "rest")


def _cut(texts: list[str | None], drop: Iterator[np.ndarray]) -> tuple[list[str], list[int], list[int]]:
    """Kept texts, lines and dropped lines, from a boolean array of dropped lines for each text."""
    kept, lines, dropped = [], [], []
    for text, gone in zip(texts, drop, strict=True):
        text, n = text or "", int(gone.sum())
        if n:
            text = "\n".join([x for x, g in zip(text.split("\n"), gone, strict=True) if not g])
        kept.append(text)
        lines.append(len(gone))
        dropped.append(n)
    return kept, lines, dropped


def _with(batch: pa.RecordBatch, names: list[str], kept, lines, dropped) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*(batch.column(c) for c in names), pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
        names=[*names, "kept_text", "n_lines", "n_dropped"],
    )


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with kept_text, n_lines and n_dropped: lines found in at least min_docs documents are gone."""
    spark = docs.sparkSession
    shards = line_index(docs, min_docs, text)
    size, total = shards.agg(F.coalesce(F.sum(sum(F.length(c) for c in _PARTS)), F.lit(0)), F.coalesce(F.sum("n_keys"), F.lit(0))).first()
    n_shards = shard_count(int(total))
    base = docs.drop("kept_text", "n_lines", "n_dropped")
    names = base.columns
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in base.schema)}, kept_text string, n_lines long, n_dropped long"

    def of_batch(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, pa.Array]:
        flat = batch.column(column)
        return np.diff(flat.offsets.to_numpy()), flat.flatten()

    if size <= broadcast_bytes:
        held = spark.sparkContext.broadcast({r["shard"]: tuple(bytes(r[c]) for c in _PARTS) for r in shards.toLocalIterator()})

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = {k: Shard(*v) for k, v in held.value.items()}
            for whole in batches:
                for batch in chunks(whole, text):
                    per_doc, flat = of_batch(batch, "__h")
                    h1, h2 = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h1", "h2"))
                    gone = np.zeros(len(h1), bool)
                    for k, t in tables.items():
                        own = np.nonzero(h1 % n_shards == k)[0] if n_shards > 1 else np.arange(len(h1))
                        gone[own] = t.documents(h1[own].view(np.uint64), h2[own].view(np.uint64)) >= min_docs
                    gone &= flat.field("full").to_numpy(zero_copy_only=False)
                    yield _with(batch, names, *_cut(batch.column(text).to_pylist(), iter(np.split(gone, np.cumsum(per_doc)[:-1]))))

        hashed = F.transform(line_keys(F.col(text)), lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(7), k).alias("h2"), (F.length(k) > 0).alias("full")))
        return base.withColumn("__h", hashed).mapInArrow(probe, schema)

    # The shards meet the probes of their lines; a shard is dealt out to SALTS tasks, a text's lines by its hash.
    own = base.withColumns({"__t1": F.xxhash64(text), "__t2": F.xxhash64(F.lit(7), F.col(text))})
    lines = own.select("__t1", "__t2", F.posexplode(line_keys(F.col(text))).alias("pos", "key")).filter(F.length("key") > 0)
    probes = lines.select("__t1", "__t2", "pos", _hashes(F.col("key")).alias("h")).select(
        F.pmod(F.col("h.h1"), F.lit(n_shards)).alias("shard"), F.pmod(F.col("__t2"), F.lit(SALTS)).alias("salt"), F.lit(1).alias("kind"),
        "__t1", "__t2", F.col("pos").cast("int").alias("pos"), "h.h1", "h.h2", *(F.lit(None).cast("binary").alias(c) for c in _PARTS),
    )
    none = [F.lit(None).cast(t).alias(c) for c, t in (("__t1", "long"), ("__t2", "long"), ("pos", "int"), ("h1", "long"), ("h2", "long"))]
    arrays = shards.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"), F.lit(0).alias("kind"), *none, *_PARTS)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = None, None
        for batch in batches:
            shard, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "kind"))
            h1, h2 = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in ("h1", "h2"))
            gone = np.zeros(len(shard), bool)
            edges = np.nonzero(np.concatenate([[True], (np.diff(shard) != 0) | (np.diff(kind) != 0)]))[0]
            for a, b in zip(edges, [*edges[1:], len(shard)], strict=True):
                if kind[a] == 0:
                    at, now = shard[a], Shard(*(batch.column(c)[int(a)].as_py() for c in _PARTS))
                elif at == shard[a]:
                    gone[a:b] = now.documents(h1[a:b], h2[a:b]) >= min_docs
            yield batch.select(["__t1", "__t2", "pos"]).filter(pa.array(gone))

    # Texts that occur several times give their probes once.
    dealt = probes.dropDuplicates(["__t1", "__t2", "pos"]).unionByName(arrays).repartition("shard", "salt").sortWithinPartitions("shard", "kind", "salt")
    hits = dealt.mapInArrow(look_up, "__t1 long, __t2 long, pos int").groupBy("__t1", "__t2").agg(F.collect_list("pos").alias("__pos"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, text):
                texts, masks = batch.column(text).to_pylist(), []
                for t, pos in zip(texts, batch.column("__pos").to_pylist(), strict=True):
                    mask = np.zeros((t or "").count("\n") + 1, bool)
                    mask[pos or []] = True
                    masks.append(mask)
                yield _with(batch, names, *_cut(texts, iter(masks)))

    return own.join(hits, ["__t1", "__t2"], "left").select(*(F.col(f"`{c}`") for c in names), "__pos").mapInArrow(cut, schema)
