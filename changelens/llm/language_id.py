"""Language identification in two steps: the family first, then the language within it.

Texts become square roots of hashed byte-trigram counts, scaled to unit length. One linear
separator a family (one against the rest) picks the family; inside it one-versus-one linear
support vector machines (squared hinge) vote, each trained on the two languages' documents only.

The model is fitted on a bounded sample: at most SAMPLE_ROWS labelled rows, spread evenly over the
labels, each with LEAST_ROWS at least where it has so many, chosen by a hash of the row; their
features (16 kB each) are computed in tasks and gathered on the driver. Where there are more than
SAMPLE_ROWS / LEAST_ROWS labels, the most frequent ones are learned. Every document is then scored
whole, in bounded batches.

Defined results: a null text, or one without any letter, is `und` with score 0; rows with a null
label are not learned from; without any label every text is `und`; null and repeated doc_ids
change nothing, and repeated rows get equal results; texts of any length are read whole; an empty
table gives an empty table; other columns are passed on and columns named like an output are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import as_bytes, chunks, collected_rows, prepare

DIMS = 4096
SAMPLE_ROWS = 2_400
#: Rows that every learned label has in the sample, where it has so many.
LEAST_ROWS = 2
UNKNOWN = "und"
#: Families of the languages that are told apart within one; any other label is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "hr", "sr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "indo-aryan": ("hi", "bn", "mr", "ne", "ur", "pa"),
}
_ASCII_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))


def family_of(label: str) -> str:
    return next((f for f, own in FAMILIES.items() if label in own), label)


def features(texts: list[bytes]) -> np.ndarray:
    """A row of DIMS for each text: square roots of hashed trigram counts, of unit length."""
    out = np.zeros((len(texts), DIMS), np.float32)
    for i, text in enumerate(texts):
        b = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint32)
        if len(b) < 3:
            continue
        mixed = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
        row = np.sqrt(np.bincount((mixed ^ mixed >> np.uint32(15)) & np.uint32(DIMS - 1), minlength=DIMS))
        out[i] = row / max(np.sqrt((row * row).sum()), 1e-9)
    return out


def has_letter(text: bytes) -> bool:
    return len(text.translate(None, _ASCII_LETTERS)) < len(text) or (not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace"))))


def svm(x: np.ndarray, y: np.ndarray, strength: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Weights and bias of a linear squared-hinge classifier for y in {-1, 1}, by accelerated gradient steps."""
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = look = np.zeros(x1.shape[1], np.float32)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x1 @ look))
        grad = strength * look - 2 * (share * y * slack) @ x1
        new = look - 0.25 * grad
        look = new + k / (k + 3) * (new - w)
        w = new
    return w


@dataclass
class Model:
    """families: their labels; of_family, of_pair: rows of weights with the bias last."""

    families: list[tuple[str, list[str]]]
    of_family: np.ndarray
    pairs: dict[tuple[str, str], np.ndarray]

    @classmethod
    def fit(cls, x: np.ndarray, labels: list[str]) -> Model:
        own = np.array(labels)
        groups: dict[str, list[str]] = {}
        for label in sorted(set(labels)):
            groups.setdefault(family_of(label), []).append(label)
        families = sorted(groups.items())
        member = {label: f for f, many in families for label in many}
        fam = np.array([member[label] for label in labels])
        weights = [svm(x, np.where(fam == f, 1, -1).astype(np.float32)) for f, _ in families] if len(families) > 1 else [np.zeros(DIMS + 1)]
        pairs = {}
        for _, many in families:
            for a, b in combinations(many, 2):
                two = (own == a) | (own == b)
                pairs[a, b] = svm(x[two], np.where(own[two] == a, 1, -1).astype(np.float32))
        return cls(families, np.array(weights, np.float32), pairs)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        sure = lambda margin: 1 / (1 + np.exp(-4 * margin))
        of_family = x @ self.of_family[:, :-1].T + self.of_family[:, -1]
        best = of_family.argmax(1)
        names, score = np.empty(len(x), object), np.ones(len(x))
        if len(self.families) > 1:
            score = sure(of_family[np.arange(len(x)), best])
        for k, (_, many) in enumerate(self.families):
            rows = np.nonzero(best == k)[0]
            votes, trust = np.zeros((len(rows), len(many))), np.zeros((len(rows), len(many)))
            for (i, a), (j, b) in combinations(enumerate(many), 2):
                w = self.pairs[a, b]
                p = sure(x[rows] @ w[:-1] + w[-1])
                votes[:, i] += p >= 0.5
                votes[:, j] += p < 0.5
                trust[:, i] += p
                trust[:, j] += 1 - p
            won = (votes + trust / (2 * len(many))).argmax(1)
            names[rows] = np.array(many, object)[won]
            if len(many) > 1:
                score[rows] *= trust[np.arange(len(rows)), won] / (len(many) - 1)
        return list(names), score


def train(docs: DataFrame, learn: Column, text: str = "text", label: str = "lang", rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from about `rows` documents of those where `learn` holds and the label is not null."""
    prepare(docs.sparkSession)
    labelled = docs.filter(learn & F.col(label).isNotNull())
    counts = labelled.groupBy(F.col(label).alias("__label")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "__label").limit(rows // LEAST_ROWS)
    known = collected_rows(counts, rows // LEAST_ROWS)
    if not known:
        return None
    each = max(LEAST_ROWS, rows // len(known))
    # By a hash of the row: a label whose rows share a doc_id is sampled like any other. Some more than asked for pass, and are cut.
    share = labelled.sparkSession.createDataFrame([(r["__label"], min(1.0, (1.5 * each + 20) / r["n"])) for r in known], labelled.select(F.col(label).alias("__label")).schema.add("__share", "double"))
    draw = F.xxhash64(F.lit(11), F.col("doc_id"), F.monotonically_increasing_id())
    drawn = labelled.select("doc_id", F.col(label).alias("__label"), F.col(text).alias("text"), draw.alias("__draw")).join(F.broadcast(share), "__label")  # at most rows / LEAST_ROWS labels
    drawn = drawn.filter(F.pmod(F.col("__draw"), F.lit(1_000_000)) < F.col("__share") * 1_000_000)
    sample = drawn.withColumn("__nth", F.row_number().over(Window.partitionBy("__label").orderBy("__draw"))).filter(F.col("__nth") <= each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                x = features(as_bytes(batch.column("text")).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "label", "x"])

    narrow = sample.select(F.col("__draw").cast("string").alias("id"), F.col("__label").cast("string").alias("label"), "text")
    got = narrow.mapInArrow(run, "id string, label string, x binary").toArrow().sort_by([("id", "ascending"), ("label", "ascending")])
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, DIMS)
    return Model.fit(x, got.column("label").to_pylist())


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    spark = docs.sparkSession
    prepare(spark)
    base = docs.drop("lang_pred", "score")
    names = base.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), "lang_pred string, score double"])
    held = spark.sparkContext.broadcast(model)  # a few rows of DIMS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, text):
                texts = as_bytes(batch.column(text)).to_pylist()
                lettered = np.array([has_letter(t) for t in texts], bool)
                if held.value is None:
                    found, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                else:
                    found, score = held.value.predict(features(texts))
                    found = [n if ok else UNKNOWN for n, ok in zip(found, lettered, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.string()), pa.array(np.where(lettered, score, 0.0).astype(float))], names=[*names, "lang_pred", "score"])

    return base.mapInArrow(run, schema)
