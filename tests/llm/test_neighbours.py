"""Nearest neighbours against brute force: exact on small tables, recall on larger ones, and every odd input."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from changelens.llm import neighbours as nn

SCHEMA = "vec_id long, embedding array<float>, label int, row string, key string, score string"
SMALL = nn.Settings(neighbours=8, trees=3, leaf=16, of_leaf=4, tried=6, rounds=2, beam=24, width=4, search_rounds=4, entries=8)


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "r", "k", "s") for i, v in vectors], SCHEMA)


def brute(vectors, k, every):
    """Neighbours of each query row by exact double products; ties to the smaller id."""
    fit = [(i, np.array(v, np.float32).astype(float)) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    lengths = [len(v) for _, v in fit]
    dims = max(sorted(set(lengths)), key=lengths.count, default=0)
    fit = [(i, v) for i, v in fit if len(v) == dims]
    out = []
    for at, (i, v) in enumerate(fit):
        if i % every == 0:
            near = sorted((-float(np.dot(v, w)), j) for other, (j, w) in enumerate(fit) if other != at)[:k]
            out += [(i, n, j, round(-s, 9)) for n, (s, j) in enumerate(near, 1)]
    return sorted(out)


def rows_of(found):
    assert found.columns == ["query_id", "rank", "id", "score"]
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in found.collect())


def unit(seed, dims=8):
    r = random.Random(seed)
    return [r.gauss(0, 1) for _ in range(dims)]


ODD = [(1, None), (2, []), (3, [0.0] * 8), (4, [1.0] * 7 + [None]), (5, [1.0] * 7 + [math.nan]), (6, [math.inf] + [1.0] * 7), (7, [1.0, 2.0]), (None, unit(9))]


def test_odd_vectors_copies_and_repeated_ids(spark):
    vectors = [(i, unit(i)) for i in range(10, 60)] + ODD + [(100 + i, unit(10)) for i in range(40)] + [(20, unit(20)), (20, unit(77)), (0, [-0.0, 0.0, 1.0] + [0.0] * 5), (200, [0.0, -0.0, 1.0] + [0.0] * 5)]
    got = rows_of(nn.nearest(table(spark, vectors).repartition(3), F.col("id") % 10 == 0, k=6, settings=SMALL))
    assert got == brute(vectors, 6, 10)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    vectors = [(i, unit(i)) for i in range(n)]
    assert rows_of(nn.nearest(table(spark, vectors), F.col("id") % 1 == 0, k=20, settings=SMALL)) == brute(vectors, 20, 1)
    assert rows_of(nn.nearest(table(spark, ODD[:6]), F.col("id") % 1 == 0, k=3, settings=SMALL)) == []


def test_recall_and_crowds(spark):
    """A third of the vectors are near copies of one; crowded nodes are split and give no worse a graph."""
    base = np.array(unit(1, 16))
    vectors = [(i, (base + 0.01 * np.array(unit(i, 16)) if i % 3 == 0 else np.array(unit(i, 16))).tolist()) for i in range(900)]
    for settings in (SMALL, nn.Settings(neighbours=8, trees=3, leaf=64, of_leaf=4, tried=6, rounds=2, beam=48, width=8, search_rounds=4, entries=8, crowd=16)):
        found = nn.nearest(table(spark, vectors).repartition(3), F.col("id") % 20 == 0, k=5, settings=settings).collect()
        true = {}
        for q, _, j, _ in brute(vectors, 5, 20):
            true.setdefault(q, set()).add(j)
        hits = sum(r.id in true[r.query_id] for r in found)
        assert len(found) == 5 * len(true) and hits >= 0.9 * len(found)


def test_rounds_improve_the_graph(spark):
    vectors = [(i, unit(i, 16)) for i in range(600)]
    rows = nn.staged(nn.vector_rows(table(spark, vectors)), "test-rows")
    score = lambda rounds: nn.build(rows, 5, nn.Settings(neighbours=8, trees=1, leaf=16, of_leaf=4, tried=8, rounds=rounds)).edges.agg(F.sum("score")).first()[0]
    assert score(0) < score(1) < score(3)


def test_foreign_queries(spark):
    vectors = [(i, unit(i)) for i in range(200)]
    rows = nn.staged(nn.vector_rows(table(spark, vectors)), "test-rows")
    index = nn.build(rows, 3, SMALL)
    asked = nn.staged(nn.vector_rows(table(spark, [(1, unit(1000)), (2, unit(5)), (3, None)])).withColumn("row", -1 - F.col("row")), "test-asked")
    found = {(r.query_id, r["rank"]): r.id for r in nn.search(index, asked, 3).collect()}
    plain = np.array([np.float32(v) for _, v in vectors], float)
    for q, v in ((1, unit(1000)), (2, unit(5))):
        assert [found[q, k] for k in (1, 2, 3)] == np.argsort(-(plain @ np.array(np.float32(v), float)))[:3].tolist()
    assert len(found) == 6
