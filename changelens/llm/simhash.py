"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within 4 bits are found without comparing all pairs. The 64 bits are cut into
three blocks; of 4 differing bits some block holds at least two, so the other two blocks
together differ in at most 2 bits. For each of the three pairs of blocks a fingerprint emits its
ball of half that radius: itself and every variant with one bit flipped there (3 + 64 * 2 = 131
variants). Two fingerprints within 2 bits on a pair of blocks share a variant of it. Variants are
shuffled, and the fingerprints that meet at one are verified over all 64 bits.
(The undivided ball of radius 2 has 2,081 variants a fingerprint and finds the same links.)

Equal fingerprints are joined before, so a large group of copies emits one ball. Within a variant
only links that join two still separate sets are given: enough for components, at most one fewer
than its fingerprints. Components come from star contraction, distributed. Fingerprints with many
documents and components with many fingerprints meet their ids by broadcast, in bounded number.

Defined results: a null or blank text has fingerprint zero and links like any other; fewer than
four words are one shingle; rows that share a doc_id are each a row of the result; a null doc_id
is never a component's id unless all its documents lack one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import as_bytes, chunks, prepare, staged
from .components import components, join_hot

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints whose balls one task emits at most, and from how many on another core is worth a task.
PRINTS_PER_TASK, PRINTS_WORTH_A_TASK = 500_000, 10_000
#: Bits of each pair of blocks [0, 21), [21, 42), [42, 64).
BLOCKS = (range(0, 21), range(21, 42), range(42, 64))
PAIRS = tuple(tuple(b for k, block in enumerate(BLOCKS) if k != left_out for b in block) for left_out in range(3))


def fingerprint(text: bytes, k: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a text in UTF-8: bit b is set if over half the shingles' XXH64 have it."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= k:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    plain = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(plain[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)
    bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):  # bounded memory for very long texts
        part = hashes[i : i + (1 << 14)]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fp): 64-bit fingerprints as signed longs."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                fps = np.array([fingerprint(t) for t in as_bytes(batch.column("text")).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _balls() -> tuple[np.ndarray, np.ndarray]:
    """For each variant: the mask of its pair of blocks, and the bit to flip; a tag of the pair fills the bits left out."""
    keep, flip = [], []
    for n, bits in enumerate(PAIRS):
        mask = sum(1 << b for b in bits)
        free = next(b for b in range(64) if not mask >> b & 1)
        keep += [mask] * (len(bits) + 1)
        flip += [(n + 1) << free] + [(1 << b) | (n + 1) << free for b in bits]
    return np.array(keep, np.uint64), np.array(flip, np.uint64)


def variants(fps: DataFrame) -> DataFrame:
    """(variant, fp): the balls of distinct fingerprints."""
    keep, flip = _balls()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("fp").to_numpy().view(np.uint64)
            for i in range(0, len(own), 256):
                part = own[i : i + 256]
                ball = (part[:, None] & keep) ^ flip
                yield pa.RecordBatch.from_arrays([pa.array(ball.ravel().view(np.int64)), pa.array(np.repeat(part, len(keep)).view(np.int64))], names=["variant", "fp"])

    return fps.mapInArrow(run, "variant long, fp long")


def spanning_links(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links within the radius among distinct fingerprints, enough to span each component.

    A walk over what is not yet reached: a reached fingerprint is compared with the rest only, and
    all it finds leave the rest at once.
    """
    rest, found = np.arange(len(fps)), []
    while len(rest):
        reached, rest = [int(rest[0])], rest[1:]
        while reached and len(rest):
            i = reached.pop()
            near = np.bitwise_count(fps[rest] ^ fps[i]) <= radius
            own = rest[near].tolist()
            found += [(i, j) for j in own]
            reached += own
            rest = rest[~near]
    return found


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): verified links between distinct fingerprints that span every group of linked ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, []  # the parts of the last variant's fingerprints

        def joined(groups: list[np.ndarray]) -> pa.RecordBatch:
            pairs = [(int(g[i].view(np.int64)), int(g[j].view(np.int64))) for g in groups for i, j in spanning_links(g, radius)]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])

        def whole(parts: list[np.ndarray]) -> list[np.ndarray]:
            return [np.concatenate(parts)] if sum(map(len, parts)) > 1 else []

        for batch in batches:  # sorted by variant: a variant's fingerprints are a run
            key, own = batch.column("variant").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            if not len(key):
                continue
            edges = np.concatenate([[0], np.nonzero(np.diff(key))[0] + 1, [len(key)]])
            groups: list[np.ndarray] = []
            if key[0] != last:
                groups += whole(carried)
                carried = []
            carried.append(own[: edges[1]])
            if len(edges) > 2:
                groups += whole(carried)
                sizes = np.diff(edges)
                groups += [own[edges[k] : edges[k + 1]] for k in np.nonzero(sizes[1:-1] > 1)[0] + 1]
                carried = [own[edges[-2] :]]
            last = key[-1]
            yield joined(groups)
        yield joined(whole(carried))

    # A fingerprint becomes 131 rows, so the few files of all fingerprints are dealt out before.
    n, cores = fps.count(), fps.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n // PRINTS_PER_TASK), min(cores, n // PRINTS_WORTH_A_TASK))
    dealt = variants(fps.repartition(parts, "fp")).repartition("variant").sortWithinPartitions("variant")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for every row: component_id is the smallest doc_id reachable over links."""
    if radius != RADIUS:
        raise ValueError("the blocks are laid out for a radius of 4")
    own = staged(fingerprints(docs, text), "simhash-prints")
    prints = staged(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    roots = staged(components(links(prints.select("fp"), radius)), "simhash-roots")
    linked = staged(prints.select("fp", "least").join(roots, F.col("fp") == F.col("node")).select("fp", "least", "root"), "simhash-linked")
    first = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    joint = join_hot(linked.select("fp", "root"), first, "root", linked.count()).select("fp", "component_id")
    by_print = staged(prints.join(joint, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n"), "simhash-ids")
    return join_hot(own, by_print, "fp", own.count()).select("doc_id", "fp", "component_id")
