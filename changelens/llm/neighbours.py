"""Approximate nearest neighbours by inner product: a neighbour graph from NN-descent, searched greedily.

The index folds equal vectors into one node. Every node starts with neighbours from a few blocks
of nodes on the same side of random hyperplanes. Then NN-descent: in each round a node's neighbours
and those that have it as a neighbour meet at it (a join of the edges with the nodes' vectors), and
each keeps the best of whom it met; only pairs with an edge that is new since its last turn are
tried. Rounds end when few edges change. Vectors travel as one byte a component with a scale.

A query starts from the best of a bounded sample of entry nodes and, where its own vector is a node,
from that node's neighbours; each round it expands the `width` best nodes of its beam that it has
not expanded yet, until none is left or `rounds` are done. Asks are a few bytes of vectors sent to
the nodes, whose neighbours' vectors lie beside them. The best of the beam are scored again in
double precision with the original vectors, and equal vectors are unfolded.

Nothing is held whole anywhere: edges, beams and messages are tables, hot nodes (at most 1,000, each
with over a thousandth of all rows) are split by a salt or met by broadcast, and every round is
written to the shared folder.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component take no
part, nor those of another length than the most frequent one (of equally frequent ones the
shortest), nor rows with a null id; rows that share an id are vectors of their own; ties go to the
smaller id; a query has as many neighbours as there are other vectors, if these are fewer; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import prepare, staged, tidy
from .components import HOT_SHARE, join_hot

NODE = "node long, code binary, scale float"


@dataclass(frozen=True)
class Settings:
    """Neighbours of a node; blocks a node is in at first, nodes of a block, and neighbours it takes from each; edges of a node that are tried a round (as many new as old), partners taken at a meeting, rounds, and the share of changed edges that ends them."""

    neighbours: int = 40
    trees: int = 12
    leaf: int = 1_024
    of_leaf: int = 10
    tried: int = 12
    met: int = 8
    rounds: int = 5
    settled: float = 0.03
    #: A node that so many rows concern is met apart (split by a salt, or by broadcast), if these are over a thousandth of all.
    crowd: int = 512
    #: Search: nodes of a beam, nodes expanded a round, rounds, entry nodes (a bounded sample), and how many times k are scored again.
    beam: int = 128
    width: int = 16
    search_rounds: int = 12
    entries: int = 512
    again: int = 3


def _parts(spark: SparkSession, rows: int, each: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def vector_rows(vectors: DataFrame, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(row, id, key, vec, code, scale, dims) of the rows that take part, all lengths; row tells rows apart, key equal vectors."""
    prepare(vectors.sparkSession)
    kind = vectors.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists, keep, keys, plain, codes, scales = batch.column("id"), batch.column("vec"), [], [], [], [], []
            for i, one in enumerate(lists):
                if not one.is_valid or not len(one.values) or one.values.null_count or not ids[i].is_valid:
                    continue
                x = one.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # no negative zero
                most = np.abs(x).max()
                if not np.isfinite(x).all() or not most:
                    continue
                keep.append(i)
                keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                plain.append(x.tobytes())
                codes.append(np.rint(x * (127 / most)).astype(np.int8).tobytes())
                scales.append(most / 127)
            columns = [ids.take(pa.array(keep, pa.int64())), *(pa.array(c, pa.binary()) for c in (keys, plain, codes)), pa.array(scales, pa.float32()), pa.array([len(c) for c in codes], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "vec", "code", "scale", "dims"])

    given = vectors.select(F.col(id).alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    return given.mapInArrow(run, f"id {kind}, key binary, vec binary, code binary, scale float, dims int").withColumn("row", F.monotonically_increasing_id())


def _matrix(codes: pa.Array, scales: np.ndarray) -> np.ndarray:
    """Float vectors of a column of codes."""
    flat = np.frombuffer(b"".join(codes.to_pylist()), np.int8)
    return flat.reshape(len(codes), -1).astype(np.float32) * scales[:, None]


def _best(scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the `most` largest entries of each row that are not -inf."""
    most = min(most, scores.shape[1])
    column = np.argpartition(-scores, most - 1, axis=1)[:, :most]
    row = np.repeat(np.arange(len(scores)), most)
    column = column.ravel()
    use = scores[row, column] > -np.inf
    return row[use], column[use]


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of sorted rows cut anew so that none ends inside a group of equal keys, but for groups over 4,096 rows."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
        whole = table.to_batches()[0] if table.num_rows else batch
        marks = [whole.column(k).to_numpy(zero_copy_only=False) for k in keys]
        turns = np.flatnonzero(np.logical_or.reduce([m[1:] != m[:-1] for m in marks])) + 1
        last = int(turns[-1]) if len(turns) else 0
        if whole.num_rows - last > 4_096:
            last = whole.num_rows
        if last:
            yield whole.slice(0, last)
        rest = whole.slice(last)
    if rest is not None and rest.num_rows:
        yield rest


def first_edges(nodes: DataFrame, n: int, dims: int, s: Settings) -> DataFrame:
    """(node, nbr, score): neighbours within blocks of about `leaf` nodes that lie on the same sides of random hyperplanes."""
    bits = max(0, int(np.ceil(np.log2(max(1, n / s.leaf)))))
    planes = np.random.default_rng(3).normal(size=(dims, s.trees * bits)).astype(np.float32)
    powers = 1 << np.arange(bits, dtype=np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            scale = batch.column("scale").to_numpy()
            side = (_matrix(batch.column("code"), scale) @ planes > 0).reshape(batch.num_rows, s.trees, bits) @ powers
            spread = pa.ListArray.from_arrays(pa.array(np.arange(0, side.size + 1, s.trees, dtype=np.int32)), pa.array(side.ravel().astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("code"), batch.column("scale"), spread], names=["node", "code", "scale", "sides"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for tree in np.unique(part.column("tree").to_numpy()):
                own = part.filter(pa.array(part.column("tree").to_numpy() == tree))
                node, x = own.column("node").to_numpy(), _matrix(own.column("code"), own.column("scale").to_numpy())
                near = x @ x.T
                np.fill_diagonal(near, -np.inf)
                a, b = _best(near, s.of_leaf)
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b]), pa.array(near[a, b])], names=["node", "nbr", "score"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            while (size := sum(b.num_rows for b in held)) >= s.leaf * 3 // 2:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                yield from block(whole.slice(0, s.leaf))
                held = [whole.slice(s.leaf)] if size > s.leaf else []
        if any(b.num_rows for b in held):
            yield from block(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    placed = nodes.mapInArrow(place, f"{NODE}, sides array<long>").select("node", "code", "scale", F.posexplode("sides").alias("tree", "side"))
    mix = F.xxhash64("node", "tree")
    parts = max(1, min(_parts(nodes.sparkSession, n * s.trees, 100_000), n * s.trees // (4 * s.leaf)))
    ranged = placed.repartitionByRange(parts, "tree", "side", mix).sortWithinPartitions("tree", "side", mix)
    return ranged.select("tree", "node", "code", "scale").mapInArrow(meet, "node long, nbr long, score float")


def _ranked(edges: DataFrame, key: str, most: int, parts: int, extra: list[Column]) -> DataFrame:
    """The `most` best distinct nbr of each key (key, nbr, score, and a flag for each of extra), in one shuffle."""
    tie = F.xxhash64(key, "nbr")  # not the smallest id, or it would be everyone's neighbour
    once = edges.repartition(parts, key).groupBy(key, "nbr").agg(F.max("score").alias("score"), *extra)
    return once.withColumn("__nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), tie))).filter(F.col("__nth") <= most).drop("__nth")


def _turn(edges: DataFrame, parts: int, round_: int, s: Settings) -> DataFrame:
    """Edges (node, nbr, score, fresh) cut to the best of each node, with pick: those that are tried in the next round."""
    best = _ranked(edges, "node", s.neighbours, parts, [F.min("fresh").alias("fresh")])
    draw = F.row_number().over(Window.partitionBy("node", "fresh").orderBy(F.xxhash64("node", "nbr", F.lit(round_))))
    return best.withColumn("pick", draw <= s.tried)


def descend(edges: DataFrame, nodes: DataFrame, parts: int, s: Settings) -> DataFrame:
    """(node, nbr, score) of pairs that meet at a common neighbour and are better than what they have: one round's join of neighbours' neighbours."""
    worst = edges.groupBy("node").agg(F.when(F.count(F.lit(1)) >= s.neighbours, F.min("score")).alias("worst"))
    known = staged(nodes.join(worst, "node", "left"), "ann-worst")
    picked = edges.filter("pick")
    fore, back = picked.select(F.col("node").alias("at"), F.col("nbr").alias("node"), "fresh"), picked.select(F.col("nbr").alias("at"), "node", "fresh")
    both = staged(fore.unionByName(back), "ann-meetings")
    share = max(s.crowd, both.count() * HOT_SHARE)
    busy = both.groupBy("at").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > share)  # at most 1 / HOT_SHARE rows
    salted = both.join(F.broadcast(busy), "at", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / (s.crowd / 4))), F.lit(0))).drop("n")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _grouped(batches, ["at", "salt"]):
            at, salt, node = (batch.column(c).to_numpy() for c in ("at", "salt", "node"))
            fresh = batch.column("fresh").to_numpy(zero_copy_only=False)
            floor = np.nan_to_num(batch.column("worst").to_numpy(zero_copy_only=False).astype(np.float32), nan=-np.inf)
            x = _matrix(batch.column("code"), batch.column("scale").to_numpy())
            edges_ = np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]) | (salt[1:] != salt[:-1])) + 1, [len(at)]])
            found: list[list[np.ndarray]] = [[], [], []]
            for start, stop in zip(edges_[:-1].tolist(), edges_[1:].tolist(), strict=True):
                for i in range(start, stop, 256):  # of a crowded node, some at a time
                    own, first = np.unique(node[i : min(stop, i + 256)], return_index=True)
                    if len(own) < 2:
                        continue
                    first = first + i
                    near = x[first] @ x[first].T
                    near[(near <= floor[first][:, None]) | ~(fresh[first][:, None] | fresh[first][None, :])] = -np.inf
                    np.fill_diagonal(near, -np.inf)
                    a, b = _best(near, s.met)
                    for k, values in enumerate((own[a], own[b], near[a, b])):
                        found[k].append(values)
            if found[0]:
                a, b, score = (np.concatenate(f) for f in found)
                once = _distinct(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(a[once]), pa.array(b[once]), pa.array(score[once])], names=["node", "nbr", "score"])

    meetings = salted.join(known, "node").select("at", "salt", "node", "fresh", "code", "scale", "worst")
    return meetings.repartition(parts, "at", "salt").sortWithinPartitions("at", "salt", F.xxhash64("node")).mapInArrow(meet, "node long, nbr long, score float")


def _distinct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of one of each pair."""
    order = np.lexsort((b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    return order[new]


@dataclass
class Index:
    """nodes (node, key, vec, code, scale, members), edges (node, nbr, score), the vectors' length, and what it was built with."""

    nodes: DataFrame
    edges: DataFrame
    n: int
    dims: int
    settings: Settings
    history: list[float]


def build(rows: DataFrame, k: int = 20, settings: Settings = Settings()) -> Index:
    """The index of rows from vector_rows (written before): every vector is in it; of equal ones the k + 1 smallest ids are kept at their node."""
    spark, s = rows.sparkSession, settings
    lengths = rows.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("dims", F.struct("n", -F.col("dims")))).first()
    dims = lengths[0] or 0
    with tidy(spark):
        nth = F.row_number().over(Window.partitionBy("key").orderBy("id", "row"))
        ids = rows.filter(F.col("dims") == dims).withColumn("nth", nth).filter(F.col("nth") <= k + 1)  # cut before the shuffle, too
        folded = ids.groupBy("key").agg(*(F.min(c).alias(c) for c in ("vec", "code", "scale")), F.array_sort(F.collect_list(F.struct("id", "row"))).alias("members"))
        nodes = staged(folded.withColumn("node", F.monotonically_increasing_id()), "ann-nodes")
        n = nodes.count()
        codes = nodes.select("node", "code", "scale")
        parts = _parts(spark, n, 20_000)
        fresh = F.lit(True).alias("fresh")
        edges = staged(_turn(first_edges(codes, n, dims, s).select("*", fresh), parts, 0, s), "ann-edges")
        history = []
        for round_ in range(1, s.rounds + 1):
            found = descend(edges, codes, parts, s).select("*", fresh)
            old = edges.select("node", "nbr", "score", (F.col("fresh") & ~F.col("pick")).alias("fresh"))
            edges = staged(_turn(old.unionByName(found), parts, round_, s), "ann-edges")
            changed, total = edges.agg(F.count_if("fresh"), F.count(F.lit(1))).first()
            history.append(changed / max(1, total))
            if history[-1] <= s.settled:
                break
    return Index(nodes, edges.select("node", "nbr", "score"), n, dims, s, history)


def search(index: Index, asked: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, id, score) of the k nearest found for each row of `asked` (rows like those of vector_rows, written before). A row of the index is not its own neighbour."""
    spark, s, nodes = asked.sparkSession, index.settings, index.nodes
    with tidy(spark):
        asked = asked.filter(F.col("dims") == index.dims)
        queries = asked.groupBy("key").agg(*(F.min(c).alias(c) for c in ("vec", "code", "scale")), F.count(F.lit(1)).alias("n"))
        queries = staged(queries.join(nodes.select("key", "node"), "key", "left").withColumn("q", F.monotonically_increasing_id()), "ann-queries")
        n_queries = queries.count()
        parts, q_parts = _parts(spark, index.n, 20_000), _parts(spark, n_queries, 20_000)
        lean = queries.select("q", F.col("code").alias("q_code"), F.col("scale").alias("q_scale"))

        entries = nodes.select("node", "code", "scale").orderBy(F.xxhash64("node")).limit(s.entries).toArrow()  # a bounded sample
        if entries.num_rows:
            entry, at = entries.column("node").to_numpy(), _matrix(entries.column("code").combine_chunks(), entries.column("scale").to_numpy())
        else:
            entry, at = np.zeros(0, np.int64), np.zeros((0, index.dims), np.float32)

        def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and len(entry):
                    near = _matrix(batch.column("q_code"), batch.column("q_scale").to_numpy()) @ at.T
                    a, b = _best(near, s.width)
                    yield pa.RecordBatch.from_arrays([batch.column("q").take(pa.array(a)), pa.array(entry[b]), pa.array(near[a, b])], names=["q", "nbr", "score"])

        own = queries.filter(F.col("node").isNotNull()).select("q", "node").join(index.edges, "node").select("q", "nbr", "score")
        start = lean.mapInArrow(enter, "q long, nbr long, score float").unionByName(own).select("*", F.lit(False).alias("done"))
        # Each node beside its neighbours' vectors, kept where it lies through the rounds; a lost part is read and joined again.
        wide = index.edges.select("node", "nbr").join(nodes.select(F.col("node").alias("nbr"), "code", "scale"), "nbr").repartition(parts, "node")
        wide = wide.groupBy("node").agg(F.collect_list(F.struct("nbr", "code", "scale")).alias("near")).persist(StorageLevel.DISK_ONLY)  # at most `neighbours` of a node

        def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                near = batch.column("near")
                flat, row = near.flatten(), np.repeat(np.arange(batch.num_rows), near.value_lengths().to_numpy())
                q = _matrix(batch.column("q_code"), batch.column("q_scale").to_numpy())
                x = _matrix(flat.field("code"), flat.field("scale").to_numpy())
                score = np.einsum("ij,ij->i", q[row], x)
                use = score > np.nan_to_num(batch.column("floor").to_numpy(zero_copy_only=False).astype(np.float32), nan=-np.inf)[row]
                yield pa.RecordBatch.from_arrays([batch.column("q").take(pa.array(row[use])), flat.field("nbr").take(pa.array(np.flatnonzero(use))), pa.array(score[use])], names=["q", "nbr", "score"])

        def turned(rows: DataFrame) -> DataFrame:
            """The beam of each query; go: the nodes that it expands next, floor: the worst score of a full beam."""
            best = _ranked(rows, "q", s.beam, q_parts, [F.max("done").alias("done")])
            mine = Window.partitionBy("q")
            go = ~F.col("done") & (F.row_number().over(Window.partitionBy("q", "done").orderBy(F.desc("score"), F.xxhash64("q", "nbr"))) <= s.width)
            return best.withColumns({"go": go, "floor": F.when(F.count(F.lit(1)).over(mine) >= s.beam, F.min("score").over(mine))})

        beam = staged(turned(start), "ann-beam")
        try:
            for _ in range(s.search_rounds):
                asks = beam.filter("go").select("q", F.col("nbr").alias("node"), "floor")
                total = asks.count()
                if not total:
                    break
                asks = staged(asks.join(lean, "q"), "ann-asks")
                # A node that very many queries expand is met by broadcast.
                often = F.broadcast(asks.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(s.crowd, total * HOT_SHARE)).select("node", F.lit(True).alias("hot")))
                marked = asks.join(often, "node", "left")
                cold = marked.filter(F.col("hot").isNull()).drop("hot").join(wide, "node")
                hot = marked.filter("hot").drop("hot").join(F.broadcast(wide.join(often.drop("hot"), "node", "left_semi")), "node")
                found = cold.unionByName(hot).select("q", "q_code", "q_scale", "floor", "near").mapInArrow(expand, "q long, nbr long, score float")
                beam = staged(turned(beam.select("q", "nbr", "score", (F.col("done") | F.col("go")).alias("done")).unionByName(found.select("*", F.lit(False).alias("done")))), "ann-beam")
        finally:
            wide.unpersist()
        return staged(_exact(beam, queries, asked, nodes, k, s, q_parts), "ann-found")


def _exact(beam: DataFrame, queries: DataFrame, asked: DataFrame, nodes: DataFrame, k: int, s: Settings, parts: int) -> DataFrame:
    """The best of the beams scored with the original vectors, equal vectors unfolded, and each row without itself."""
    kind = nodes.schema["members"].dataType.elementType["id"].dataType.simpleString()
    few = beam.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "nbr"))).filter(F.col("nth") <= s.again * k).select("q", "nbr")
    self_ = queries.filter(F.col("node").isNotNull()).select("q", F.col("node").alias("nbr"))
    pairs = staged(few.unionByName(self_).distinct(), "ann-pairs")
    scored = pairs.join(nodes.select(F.col("node").alias("nbr"), "vec", "members"), "nbr").repartition(parts, "q")
    gathered = scored.groupBy("q").agg(F.collect_list(F.struct("vec", "members")).alias("found"))  # at most again * k + 1
    near = gathered.join(queries.select("q", "key", "n", F.col("vec").alias("q_vec")), "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for q, found in zip(batch.column("q_vec").to_pylist(), batch.column("found").to_pylist(), strict=True):
                x = np.frombuffer(q)
                flat = [(float(np.dot(np.frombuffer(f["vec"]), x)), m["id"], m["row"]) for f in found for m in f["members"]]
                lists.append([{"score": a, "id": b, "row": c} for a, b, c in sorted(flat, key=lambda t: (-t[0], t[1], t[2]))[: k + 1]])
            out = pa.array(lists, pa.list_(pa.struct([("score", pa.float64()), ("id", batch.schema.field("found").type.value_type.field("members").type.value_type.field("id").type), ("row", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), out], names=["key", "n", "near"])

    told = staged(near.select("key", "n", "q_vec", "found").mapInArrow(run, f"key binary, n long, near array<struct<score: double, id: {kind}, row: long>>"), "ann-near")
    rows = join_hot(asked.select("key", F.col("id").alias("query_id"), F.col("row").alias("q_row")), told, "key", asked.count())
    others = rows.withColumn("near", F.slice(F.filter("near", lambda x: x["row"] != F.col("q_row")), 1, k))
    return others.select("query_id", F.posexplode("near").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.id", "x.score")


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id: str = "vec_id", vec: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found among all other vectors for each row where `queries` (over column id) holds."""
    rows = staged(vector_rows(vectors, id, vec), "ann-rows")
    return search(build(rows, k, settings), rows.filter(queries), k)
