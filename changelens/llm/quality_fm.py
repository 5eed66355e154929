"""Quality classifier: a factorisation machine over hashed words and structure statistics.

score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pair sum is taken in time
linear in a document's features, as half of |sum v_i x_i|^2 - sum |v_i x_i|^2.

Features: words (A-Z lower-cased) hashed to 2^14 buckets with log counts scaled to unit length,
and figures of the text's form (length, shares of capitals, digits, signs, repeated lines and
words, words equal to the one before, word length), each as a one-of-bins indicator.

The model is fitted on a bounded sample of about SAMPLE_ROWS labelled documents chosen by a hash
of doc_id; their features are gathered on the driver, at most a row's distinct buckets each.
Every document is scored whole.

Defined results: a null or empty text has the features of an empty form and gets that score;
labels that are null, and documents without label, are not learned from; without any label, or
with labels of one kind only, the score is that kind's share (0.5 without labels); repeated rows
get equal scores; other columns are passed on and columns named like an output are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import as_bytes, chunks, prepare

BUCKETS, FACTORS = 1 << 14, 8
SAMPLE_ROWS = 4_000
THRESHOLD = 0.3
_WHITE = b" \t\n\x0b\x0c\r"
_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
_SIGNS = b"#*$%&|<>!?@^~_=+{}[]\\"
#: Upper edges of the bins of each figure.
EDGES = {
    "log2 words": (2, 4, 6, 8, 10, 12),
    "capitals of letters": (0.02, 0.05, 0.1, 0.3, 0.6),
    "digits": (0.005, 0.02, 0.05, 0.1, 0.3),
    "signs a word": (0.01, 0.03, 0.1, 0.3, 1.0),
    "repeated lines": (0.01, 0.1, 0.2, 0.3, 0.5),
    "distinct words": (0.1, 0.3, 0.5, 0.7, 0.9),
    "letters a word": (2, 4, 6, 8, 12),
    "words a line": (2, 5, 10, 30, 100),
    "words in a row": (0.01, 0.05, 0.1, 0.3, 0.6),
}
_FIRST = {name: BUCKETS + sum(len(e) + 1 for e in list(EDGES.values())[:k]) for k, name in enumerate(EDGES)}
DIMS = BUCKETS + sum(len(e) + 1 for e in EDGES.values())


def _without(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's features."""
    words = text.lower().split()
    hashed = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) & (BUCKETS - 1)
    at, count = np.unique(hashed, return_counts=True)
    value = np.log1p(count)
    value = value / max(np.sqrt((value * value).sum()), 1e-9)
    upper, lower, n = _without(text, _UPPER), _without(text, _LOWER), max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    inside = max(1, len(text) - _without(text, _WHITE))
    figures = (
        np.log2(n), upper / max(1, upper + lower), _without(text, _DIGITS) / inside, _without(text, _SIGNS) / n,
        1 - len(set(lines)) / max(1, len(lines)), len(at) / n, inside / n, n / max(1, len(lines)), sum(map(eq, words, words[1:])) / n,
    )
    bins = [_FIRST[name] + int(np.searchsorted(edges, x)) for (name, edges), x in zip(EDGES.items(), figures, strict=True)]
    return np.concatenate([at, bins]).astype(np.int32), np.concatenate([value, np.full(len(bins), 0.5)]).astype(np.float32)


@dataclass
class Machine:
    """b, w and v of the model; constant: a fixed score where nothing could be learned."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    constant: float | None = None

    def raw(self, at: np.ndarray, x: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores before the sigmoid of rows [edges[k], edges[k + 1]), and what the gradient needs."""
        vx = self.v[at] * x[:, None]
        sums = np.add.reduceat(vx, edges[:-1])
        squares = np.add.reduceat((vx * vx).sum(1), edges[:-1])
        return self.bias + np.add.reduceat(self.w[at] * x, edges[:-1]) + 0.5 * ((sums * sums).sum(1) - squares), sums, vx

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if self.constant is not None or not rows:
            return np.full(len(rows), self.constant or 0.0)
        edges = np.concatenate([[0], np.cumsum([len(a) for a, _ in rows])])
        raw, _, _ = self.raw(np.concatenate([a for a, _ in rows]), np.concatenate([x for _, x in rows]), edges)
        return 1 / (1 + np.exp(-raw.astype(np.float64)))

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 8, rate: float = 0.1, strength: float = 1e-5, size: int = 64) -> Machine:
        rng = np.random.default_rng(5)
        m = cls(0.0, np.zeros(DIMS, np.float32), rng.normal(0, 0.02, (DIMS, FACTORS)).astype(np.float32))
        if len(set(y.tolist())) < 2:
            m.constant = float(y.mean()) if len(y) else 0.5
            return m
        gw, gv, gb = np.full(DIMS, 1e-3, np.float32), np.full((DIMS, FACTORS), 1e-3, np.float32), 1e-3
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), size):
                own = order[k : k + size]
                at, x = np.concatenate([rows[i][0] for i in own]), np.concatenate([rows[i][1] for i in own])
                edges = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in own])])
                raw, sums, vx = m.raw(at, x, edges)
                error = ((1 / (1 + np.exp(-raw)) - y[own]) / len(own)).astype(np.float32)
                row = np.repeat(np.arange(len(own)), np.diff(edges))
                used, back = np.unique(at, return_inverse=True)
                dw, dv = np.zeros(len(used), np.float32), np.zeros((len(used), FACTORS), np.float32)
                np.add.at(dw, back, error[row] * x)
                np.add.at(dv, back, (error[row] * x)[:, None] * (sums[row] - vx))
                dw += strength * m.w[used]
                dv += strength * m.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                gb += float(error.sum()) ** 2
                m.w[used] -= rate * dw / np.sqrt(gw[used])
                m.v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
                m.bias -= rate * float(error.sum()) / np.sqrt(gb)
        return m


def train(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS) -> Machine:
    """A machine from about `rows` of the labelled documents where `learn` (over doc_id) holds."""
    prepare(docs.sparkSession)
    known = labels.filter(learn & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("__label"))
    n = known.count()
    chosen = known.filter(F.pmod(F.xxhash64(F.lit(13), F.col("doc_id")), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, rows / max(1, n)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                found = [features(t) for t in as_bytes(batch.column("text")).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), *(pa.array([f[k].tobytes() for f in found], pa.binary()) for k in (0, 1))], names=["id", "label", "at", "x"])

    # The chosen labels are about `rows` small rows, so they are broadcast.
    chosen = F.broadcast(chosen)
    met = docs.select("doc_id", F.col(text).alias("text"), F.monotonically_increasing_id().alias("__row")).join(chosen, "doc_id")
    # Rows that repeat a labelled doc_id are thinned by a hash of the row, so that about `rows` are gathered in all.
    many = docs.select("doc_id").join(chosen, "doc_id").count()
    thin = F.pmod(F.xxhash64(F.lit(17), "__row"), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, rows / max(1, many))))
    sample = met if many <= 1.2 * rows else met.filter(thin)
    narrow = sample.select(F.col("doc_id").cast("string").alias("id"), F.col("__label").cast("int").alias("label"), "text")
    got = narrow.mapInArrow(run, "id string, label int, at binary, x binary").limit(2 * rows).toArrow().sort_by("id")
    found = [(np.frombuffer(a, np.int32), np.frombuffer(x, np.float32)) for a, x in zip(got.column("at").to_pylist(), got.column("x").to_pylist(), strict=True)]
    return Machine.fit(found, got.column("label").to_numpy().astype(np.float32))


def rate(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """docs with score, the estimated chance of label 1, and predicted (score >= THRESHOLD)."""
    spark = docs.sparkSession
    prepare(spark)
    base = docs.drop("score", "predicted")
    names = base.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), "score double, predicted int"])
    held = spark.sparkContext.broadcast(machine)  # DIMS * (FACTORS + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, text):
                score = held.value.score([features(t) for t in as_bytes(batch.column(text)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))], names=[*names, "score", "predicted"])

    return base.mapInArrow(run, schema)
