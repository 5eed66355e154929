"""Phrase collocation mining with generalised suffix automata, one for each shard of the corpus.

A task cuts its texts into pieces and words and builds, for every million words or so, the suffix
automaton of their pieces down to a bounded depth: a state is a substring of at most so many
words, with the state of its prefix, a suffix link to the state without its first word, and the
number of its end positions, which flow down the suffix links. States are ranked with numpy, level
by level, in place of one insertion a word; they give each substring of the shard with its count.

Counts are reduced globally in two passes. Most substrings are rare everywhere, so the first pass
shuffles only 64-bit entries (a key and a small count) of words and word pairs, packed in binary
blocks by key range, and marks the keys that reach `min_count` in a bitmap of fixed size. The
second pass emits, as text and with exact counts, what the bitmap lets through, and longer phrases
only where both their prefix and their suffix passed. Keys that collide, or a full bitmap, let
more through and change no result.

A phrase's parts are at least as frequent as the phrase, so their counts are there to score it.
A candidate is subsumed by longer ones through its extensions by one word (prefix and suffix link
of the longer state); as counts only shrink with length, these decide for all longer ones.

Defined results: a null text is empty; a null language is `und`; only A-Z are lower-cased; texts
without words give nothing; an empty table gives no rows; rows that repeat a doc_id or a text are
texts of their own; texts of any length are cut anywhere between words and counted over the cut;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import as_bytes, chunks, prepare, staged, tidy

UNKNOWN = "und"
#: Largest count in an entry: its low byte.
MOST = 255

_WORD, _SPACE, _BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _SPACE
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(12).integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64 of each number."""
    with np.errstate(over="ignore"):
        z = x + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


@dataclass(frozen=True)
class Limits:
    """Bytes that one step holds in numpy form, words of a shard's automaton, rows of an output batch, bits of the bitmap of frequent keys (2^28: 32 MB, whatever the corpus), and entries that a reducing task merges at a time."""

    block_bytes: int = 1 << 20
    shard_words: int = 750_000
    batch_rows: int = 50_000
    bitmap_bits: int = 28
    merge_entries: int = 4_000_000


@dataclass
class Words:
    """Words in text order: two hashes, the piece and the language of each, and their lower-cased bytes end to end."""

    hashes: np.ndarray  # (2, n)
    piece: np.ndarray
    lang: np.ndarray
    size: np.ndarray
    data: np.ndarray

    @classmethod
    def joined(cls, parts: list[Words]) -> Words:
        return cls(np.concatenate([p.hashes for p in parts], axis=1), *(np.concatenate([getattr(p, c) for p in parts]) for c in ("piece", "lang", "size", "data")))

    def tail(self, n: int) -> Words:
        at = max(0, len(self.size) - n)
        return Words(self.hashes[:, at:], self.piece[at:], self.lang[at:], self.size[at:], self.data[int(self.size[:at].sum()) :])


def words_of(texts: list[bytes], langs: np.ndarray, first_piece: int = 0, block_bytes: int = Limits.block_bytes) -> Iterator[Words]:
    """Words of some texts, in blocks that end between words. Pieces are numbered from first_piece, in steps of one a break."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    at = 0
    while at < len(data):
        end = min(len(data), at + block_bytes)
        while end < len(data) and _KIND[data[end]] == _WORD:  # to the end of the word
            gap = np.flatnonzero(_KIND[data[end : end + 4096]] != _WORD)
            end = end + int(gap[0]) if len(gap) else min(len(data), end + 4096)
        block = data[at:end]
        kind = _KIND[block]
        is_word = np.concatenate([[False], kind == _WORD, [False]])
        turns = np.flatnonzero(is_word[1:] != is_word[:-1])
        begins, size = turns[::2], turns[1::2] - turns[::2]
        breaks = np.flatnonzero(kind == _BREAK)
        if len(begins):
            letters = _LOWER[block[is_word[1:-1]]]
            edges = np.cumsum(size) - size
            place = np.arange(len(letters)) - np.repeat(edges, size)
            hashes = []
            with np.errstate(over="ignore"):
                for table, base in zip(_RANDOM, _BASES, strict=True):
                    power = np.multiply.accumulate(np.full(int(size.max()), base, np.uint64))
                    hashes.append(mixed(np.add.reduceat(table[letters] * power[place], edges)))
            lang = langs[np.searchsorted(starts, begins + at, side="right") - 1]
            yield Words(np.array(hashes), first_piece + np.searchsorted(breaks, begins), lang.astype(np.int32), size.astype(np.int32), letters)
        first_piece += len(breaks)
        at = end


@dataclass
class Level:
    """States of one depth: prefix state and suffix link in the level above, last word, end positions."""

    prefix: np.ndarray
    link: np.ndarray
    last: np.ndarray
    count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


class Automaton:
    """Suffix automaton of a shard's pieces down to a depth.

    The `seen` leading words are context whose end positions were counted before; passes(depth,
    automaton) tells which states of that depth may be part of longer ones.
    """

    def __init__(self, words: Words, depth: int, seen: int = 0, passes=None):
        tongue = mixed(words.lang.astype(np.uint64) * np.uint64(2) + np.uint64(1))
        for turn in range(64):  # another mixture in the rare case that two words of the shard meet at one number
            state, unique = pd.factorize(mixed(words.hashes[0] + np.uint64(turn)) ^ words.hashes[1] ^ tongue)
            n = len(unique)
            first = np.empty(n, np.int64)
            first[state[::-1]] = np.arange(len(state) - 1, -1, -1)
            if (words.hashes[:, first][:, state] == words.hashes).all() and (words.lang[first][state] == words.lang).all():
                break
        self.first = first
        self.keys = [words.hashes[0][first]]
        self.levels = [Level(np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n))]
        longest, word = [state.copy()], state
        same_piece = np.concatenate([[False], words.piece[1:] == words.piece[:-1]])
        here = np.arange(len(state))  # positions that have a state of the level above, and that state
        for d in range(2, depth + 1):
            of = word if d == 2 else deeper.copy()
            ok = np.ones(len(self.keys[-1]), bool) if passes is None else passes(d - 1, self)
            good = same_piece & (of >= 0)
            good[1:] &= of[:-1] >= 0
            good[0] = False
            here = np.flatnonzero(good)
            here = here[ok[of[here]] & ok[of[here - 1]]]
            pair = of[here - 1] * np.int64(n) + word[here]
            state, unique = pd.factorize(pair)
            level = Level(unique // n, np.zeros(len(unique), np.int64), unique % n)
            level.link[state] = of[here]
            self.levels.append(level)
            with np.errstate(over="ignore"):
                self.keys.append(mixed(self.keys[-1][level.prefix] * np.uint64(3) + self.keys[0][level.last]))
            deeper = np.full(len(word), -1, np.int64)
            deeper[here] = state
            longest[-1][here] = -1
            longest.append(deeper)
        for own in longest:
            own[:seen] = -1
        for d in range(depth - 1, -1, -1):  # end positions flow from longer states to their suffixes
            level = self.levels[d]
            level.count = np.bincount(longest[d][longest[d] >= 0], minlength=len(level.last))
            if d + 1 < depth:
                below = self.levels[d + 1]
                level.count = level.count + np.bincount(below.link, below.count, minlength=len(level.last)).astype(np.int64)


def _shards(batches: Iterator[pa.RecordBatch], depth: int, limits: Limits) -> Iterator[tuple[Words, int, list[str]]]:
    """(words, leading words that are context, names of the languages) for each shard of a task."""
    names: list[str] = []
    held: list[Words] = []
    n, piece, context = 0, 0, 0
    for whole in batches:
        for batch in chunks(whole, "text", limits.block_bytes):
            texts, own = as_bytes(batch.column("text")).to_pylist(), batch.column("lang").to_pylist()
            names += sorted(set(own).difference(names))
            code = {name: k for k, name in enumerate(names)}
            for words in words_of(texts, np.array([code[x] for x in own], np.int64), piece, limits.block_bytes):
                held.append(words)
                n += len(words.size)
                piece = int(words.piece[-1])
                if n >= limits.shard_words:
                    shard, held = Words.joined(held), []
                    yield shard, context, names
                    held = [shard.tail(depth - 1)]
                    n = context = len(held[0].size)
                    del shard
            piece += len(texts) + sum(map(len, texts)) + 1  # past every piece of these texts
    if n > context:
        yield Words.joined(held), context, names


def _keyed(automaton: Automaton, level: int, words: Words, langs: np.ndarray) -> np.ndarray:
    """Global keys of a level's states: hashes of the language and the words."""
    return mixed(automaton.keys[level] ^ langs[words.lang[automaton.first[_first_word(automaton, level)]]]) ^ np.uint64(level)


def _first_word(automaton: Automaton, level: int) -> np.ndarray:
    state = np.arange(len(automaton.levels[level].last))
    for d in range(level, 0, -1):
        state = automaton.levels[d].prefix[state]
    return state


def _lang_keys(names: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(name.encode()) for name in names], np.uint64)


def _merged(entries: np.ndarray) -> np.ndarray:
    """Entries with equal keys added up; counts stop at MOST."""
    ordered = np.sort(entries)
    key = ordered >> np.uint64(8)
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat((ordered & np.uint64(MOST)).astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
    return (key[at] << np.uint64(8)) | np.minimum(total, MOST).astype(np.uint64)


def frequent_keys(rows: DataFrame, min_count: int, limits: Limits = Limits()) -> np.ndarray:
    """Bitmap over the leading bitmap_bits bits of the keys of words and pairs whose entries reach min_count."""
    spark = rows.sparkSession
    bits = min(16, max(1, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))
    least = min(min_count, MOST)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, context, names in _shards(batches, 2, limits):
            automaton, langs = Automaton(words, 2, context), _lang_keys(names)
            entries = []
            for d, level in enumerate(automaton.levels):
                used = level.count > 0
                entries.append((_keyed(automaton, d, words, langs)[used] & ~np.uint64(MOST)) | np.minimum(level.count[used], MOST).astype(np.uint64))
            ordered = np.sort(np.concatenate(entries))
            edges = np.searchsorted(ordered, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist() + [len(ordered)]
            full = [k for k in range(1 << bits) if edges[k] < edges[k + 1]]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([ordered[edges[k] : edges[k + 1]].tobytes() for k in full], pa.binary())], names=["part", "entries"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for part, block in zip(batch.column("part").to_pylist(), batch.column("entries").to_pylist(), strict=True):
                own = held.setdefault(part, [])
                own.append(np.frombuffer(block, np.uint64))
                if sum(map(len, own[1:])) > limits.merge_entries:
                    held[part] = [_merged(np.concatenate(own))]
        for part, own in held.items():
            found = _merged(np.concatenate(own))
            often = found[(found & np.uint64(MOST)) >= least]
            flags = np.zeros(1 << (limits.bitmap_bits - bits), bool)
            flags[((often >> np.uint64(64 - limits.bitmap_bits)) & np.uint64(len(flags) - 1)).astype(np.int64)] = True
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "flags": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    blocks = rows.mapInArrow(emit, "part int, entries binary").repartitionById(1 << bits, "part")
    bitmap = np.zeros(1 << (limits.bitmap_bits - 3), np.uint8)
    step = len(bitmap) >> bits
    for r in blocks.mapInArrow(mark, "part int, flags binary").collect():  # 2^bitmap_bits bits in all
        bitmap[r["part"] * step : (r["part"] + 1) * step] = np.frombuffer(r["flags"], np.uint8)
    return bitmap


def _marked(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys >> np.uint64(64 - (8 * len(bitmap) - 1).bit_length())
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 > 0


def phrase_counts(docs: DataFrame, max_words: int = 3, min_count: int = 10, text: str = "text", lang: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """(lang, phrase, f) of every phrase of up to max_words words that occurs min_count times or more in its language; with phrase null, f is the number of all words."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))
    with tidy(spark):
        held = spark.sparkContext.broadcast(frequent_keys(rows, min_count, limits))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, context, names in _shards(batches, max_words, limits):
            langs, passed = _lang_keys(names), {}

            def passes(depth: int, automaton: Automaton, words=words, langs=langs, passed=passed) -> np.ndarray:
                """Words and pairs are looked up; longer states passed by their parts."""
                if depth <= 2:
                    passed[depth] = _marked(held.value, _keyed(automaton, depth - 1, words, langs))
                    return passed[depth]
                return np.ones(len(automaton.levels[depth - 1].last), bool)

            automaton = Automaton(words, max_words, context, passes)
            if max_words <= 2:
                passes(max_words, automaton)
            edges = np.cumsum(words.size, dtype=np.int64) - words.size
            first = automaton.first
            place = np.repeat(edges[first] - (np.cumsum(words.size[first]) - words.size[first]), words.size[first])
            data = words.data[np.arange(len(place)) + place].tobytes()
            offsets = np.concatenate([[0], np.cumsum(words.size[first])]).astype(np.int64)
            spelt = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            of_lang, known = words.lang[first], pa.array(names, pa.large_string())
            told = np.bincount(words.lang[context:], minlength=len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.nulls(len(names), pa.string()), pa.array(told, pa.int64())], names=["lang", "phrase", "f"])
            phrases = spelt
            for d, level in enumerate(automaton.levels):
                if d:
                    phrases = pc.binary_join_element_wise(phrases.take(pa.array(level.prefix)), spelt.take(pa.array(level.last)), pa.scalar(" ", pa.large_string()))
                use = np.flatnonzero(passed.get(d + 1, np.ones(len(level.last), bool)) & (level.count > 0))
                tongue = of_lang[_first_word(automaton, d)]
                for k in range(0, len(use), limits.batch_rows):
                    part = use[k : k + limits.batch_rows]
                    yield pa.RecordBatch.from_arrays([known.take(pa.array(tongue[part])).cast(pa.string()), phrases.take(pa.array(part)).cast(pa.string()), pa.array(level.count[part], pa.int64())], names=["lang", "phrase", "f"])

    found = rows.mapInArrow(emit, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    with tidy(spark):
        return staged(found.filter((F.col("f") >= min_count) | F.col("phrase").isNull()), "phrase-counts")


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, cover_percent: int = 50, top: int = 2_000, text: str = "text", lang: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of 2 to max_words words in each language, by score, then count, then phrase.

    a is the phrase's count, l and r those of the two parts of its lowest-scoring cut, score
    floor(1,000,000 a a / (l r)); phrases inside a longer one with at least cover_percent of their count are left out.
    """
    counts = phrase_counts(docs, max_words, min_count, text, lang, limits)
    known = counts.filter(F.col("phrase").isNotNull())
    words = F.split("phrase", " ")
    several = known.filter(F.instr("phrase", " ") > 0).select("lang", "phrase", F.col("f").alias("a"), words.alias("words"), F.size(words).alias("size"))
    part = lambda start, n: F.array_join(F.slice("words", start, n), " ")

    longer = several.filter("size > 2").select("lang", "a", F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1))).alias("phrase"))
    covers = longer.groupBy("lang", "phrase").agg(F.max("a").alias("covered"))
    kept = several.join(covers, ["lang", "phrase"], "left").filter(F.col("covered").isNull() | (100 * F.col("covered") < cover_percent * F.col("a")))

    cuts = kept.select("lang", "phrase", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    of = lambda side, name: known.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    scored = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    scored = scored.withColumns({"__up": wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(8,0)"), "__down": wide("l") * wide("r")}).withColumn("score", F.expr("__up div __down"))
    lowest = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rows = staged(lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), "phrase-scores")

    # The first ones of ever fewer, larger shares of a language: no task sorts all of its phrases.
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    for shares in (max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 8, 1):
        share = F.pmod(F.xxhash64("phrase"), F.lit(shares))
        rows = rows.withColumn("__share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__share").orderBy(*order))).filter(F.col("rank") <= top).drop("__share")
    totals = counts.filter(F.col("phrase").isNull()).select("lang", F.col("f").alias("n"))
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
