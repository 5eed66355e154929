"""Quality rules as a short-circuit cascade.

The base figures of a text (words, characters in words, symbols, repeated lines, words in
repeated 5-word windows) are part of the result, so they are always measured. The verdict goes
through rules over the text; each rule runs only on documents that passed the ones before it.
On a sample of rows that pass the base test each rule's time and the sets of rules that reject a
document are found; the next rule is always the one with most rejections per second among what the
rules before it leave. The order changes the time, never the verdict: a
document is kept if no rule rejects it.

Defined results: a null or empty text has no words and fails; a text of any length is read
whole; documents are judged row by row, so repeated rows get equal results; other columns are
passed on and columns named like an output are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._shared import as_bytes, chunks, prepare

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER, LOWER, BEYOND = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(128, 256))
#: Documents whose cost and verdicts order the cascade; a parameter of cascade().
SAMPLE_ROWS = 1_000
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], k: int = WINDOW) -> int:
    """Words inside k-word windows that occur twice or more, the first occurrence included."""
    if len(words) <= k:
        return 0
    windows = list(zip(*(words[i:] for i in range(k)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    number: dict[tuple, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in windows), np.int64, len(windows))
    twice = np.nonzero(np.bincount(ids)[ids] > 1)[0]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + k, -1)
    return int((np.cumsum(cover) > 0).sum())


def measure(text: bytes, chars: int) -> tuple[int, int, int, int, int]:
    """The figures of STATS for a text in UTF-8 with so many code points."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    white = len(text) - len(text.translate(None, WHITE))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), chars - white, symbols, len(lines) - len(set(lines)), repeated_words(words)


@dataclass(frozen=True)
class Rule:
    """A named test; rejects(text, stats) is true for a bad document."""

    name: str
    rejects: Callable[[bytes, tuple[int, int, int, int, int]], bool]


def _dense_symbols(text: bytes, s) -> bool:
    return 10 * s[2] > s[0] and s[2] >= 5


def _repeated_lines(text: bytes, s) -> bool:
    lines = sum(1 for x in text.split(b"\n") if x.strip())
    return lines >= 4 and 10 * s[3] > 4 * lines


def _stutter(text: bytes, s) -> bool:
    """Over 30 % of the words equal the word before."""
    words = text.split()
    return 10 * sum(map(eq, words, words[1:])) > 3 * len(words)


def _shouting(text: bytes, s) -> bool:
    upper, lower = (len(text) - len(text.translate(None, x)) for x in (UPPER, LOWER))
    return upper + lower >= 50 and upper > lower


def _word_length(text: bytes, s) -> bool:
    return s[0] >= 50 and not 2 * s[0] <= s[1] <= 15 * s[0]


def _few_letters(text: bytes, s) -> bool:
    """Under 60 % of the characters in words are ASCII letters or lie beyond ASCII."""
    ascii_only = text.translate(None, BEYOND)
    others = len(ascii_only.translate(None, WHITE + UPPER + LOWER))
    return s[0] >= 50 and 10 * (s[1] - others) < 6 * s[1]


def _mostly_bullets(text: bytes, s) -> bool:
    lines = [x.lstrip() for x in text.split(b"\n") if x.strip()]
    return len(lines) >= 10 and 10 * sum(x[:1] in (b"-", b"*") or x[:3] == "•".encode() for x in lines) > 9 * len(lines)


RULES = (
    Rule("dense symbols", _dense_symbols),
    Rule("repeated lines", _repeated_lines),
    Rule("stutter", _stutter),
    Rule("shouting", _shouting),
    Rule("word length", _word_length),
    Rule("few letters", _few_letters),
    Rule("mostly bullets", _mostly_bullets),
)


def _read(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[tuple]]]:
    for whole in batches:
        for batch in chunks(whole, text):
            chars = pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_pylist()
            texts = as_bytes(batch.column(text)).to_pylist()
            yield batch, texts, [measure(t, int(c)) for t, c in zip(texts, chars, strict=True)]


def base_fails(stats: tuple) -> bool:
    return stats[0] < MIN_WORDS or 100 * stats[4] > MAX_REPEAT_PERCENT * stats[0]


def estimate(docs: DataFrame, rules=RULES, text: str = "text", rows: int = SAMPLE_ROWS) -> tuple[list[float], dict[int, int]]:
    """(seconds a document of each rule, documents by the set of rules that reject them, as a bit mask) over the rows of a sample that pass the base test.

    About `rows` rows are drawn by a hash over the whole table and measured in the tasks that read
    them; each task gives a row for each mask it has seen, of at most 2^rules.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, masks = [0.0] * len(rules), Counter()
        for _, texts, stats in _read(batches, text):
            for t, s in zip(texts, stats, strict=True):
                if base_fails(s):
                    continue
                mask = 0
                for k, rule in enumerate(rules):
                    began = time.perf_counter()
                    mask |= bool(rule.rejects(t, s)) << k
                    spent[k] += time.perf_counter() - began
                masks[mask] += 1
        yield pa.RecordBatch.from_pydict({"key": list(range(-len(rules), 0)) + list(masks), "value": spent + [float(n) for n in masks.values()]}, pa.schema([("key", pa.int64()), ("value", pa.float64())]))

    share = min(1.0, rows / max(1, docs.count()))
    drawn = docs.select(text).filter(F.pmod(F.xxhash64(F.lit(7), F.monotonically_increasing_id()), F.lit(1 << 40)) < int(share * (1 << 40)))
    found = {r["key"]: r["value"] for r in drawn.mapInArrow(run, "key long, value double").groupBy("key").agg(F.sum("value").alias("value")).collect()}  # at most rules + 2^rules rows
    masks = {k: int(v) for k, v in found.items() if k >= 0}
    n = max(1, sum(masks.values()))
    return [found.get(k - len(rules), 0.0) / n for k in range(len(rules))], masks


def ordered(rules, seconds: list[float], masks: dict[int, int]) -> tuple[Rule, ...]:
    """Rules one after the other, each time the one with most rejections per second among the documents that the rules before leave."""
    left, out = list(range(len(rules))), []
    while left:
        gone = sum(1 << k for k in out)
        gain = {k: sum(n for mask, n in masks.items() if not mask & gone and mask >> k & 1) / max(seconds[k], 1e-9) for k in left}
        out.append(max(left, key=lambda k: (gain[k], -seconds[k], -k)))
        left.remove(out[-1])
    return tuple(rules[k] for k in out)


def cascade(docs: DataFrame, rules=RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with the figures of STATS, base_failed, and kept: neither the base nor any rule rejects it."""
    in_order = ordered(rules, *estimate(docs, rules, text, sample_rows))
    base = docs.drop(*STATS, "base_failed", "kept")
    names = base.columns
    schema = StructType([*base.schema.fields, *StructType.fromDDL(", ".join([*(f"{s} long" for s in STATS), "base_failed boolean", "kept boolean"])).fields])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, stats in _read(batches, text):
            failed = [base_fails(s) for s in stats]
            alive = [i for i, f in enumerate(failed) if not f]
            for rule in in_order:  # only the survivors of the rules before
                alive = [i for i in alive if not rule.rejects(texts[i], stats[i])]
            kept = np.zeros(len(texts), bool)
            kept[alive] = True
            figures = [pa.array([s[k] for s in stats], pa.int64()) for k in range(len(STATS))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *figures, pa.array(failed, pa.bool_()), pa.array(kept)], names=[*names, *STATS, "base_failed", "kept"])

    return base.mapInArrow(judge, schema)
