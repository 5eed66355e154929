"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every source's documents stand in a shuffled order (a hash of doc_id). A document's virtual
finish time is its source's cumulative size up to it, divided by the source's target; the k-th
repeat of a source continues the count. The mix is the documents in ascending finish time, cut
where the total budget is reached, so every source arrives at its target together.

The cumulative sizes come from two levels: sums of hash ranges of a source, then a running sum
inside one range, so that a source with a third of all rows is spread over all tasks. The cut
is found by narrowing histograms of finish times, never by sorting all rows in one task.

Defined results: a null text or size counts 0 and is never taken; null sources form one source,
last; ids may be numbers or texts, a null one stands first; rows that repeat a doc_id are rows of their own (ordered by their size); an empty table gives
an empty mix; a column named like one of the operator's is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import n_words, staged

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
#: Hash ranges of a source for the cumulative sizes.
RANGES = 1024
#: Rows around the cut that one task may order.
CUT_ROWS = 50_000
_STEPS = 1024


def shuffle_rank(doc_id: Column) -> Column:
    """A 60-bit hash of the document's id: its place in the shuffled order."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("#mix"))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = MAX_REPEATS, share: float = 1.0) -> DataFrame:
    """(source, source_size) -> with weight and target: weights by rank of source, target at most repeats x size.

    Water filling in closed form: sources in order of cap / weight; the first k that are capped
    leave the rest of the budget to the others by weight.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    w = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    w = w.withColumn("level", level)
    # The level rises over the capped sources and falls after them: its maximum is the one that holds.
    fill = F.max("level").over(every)
    return w.withColumn("target", F.least(F.col("cap"), fill * F.col("weight"))).select("source", "source_size", "weight", "target")


def _queued(docs: DataFrame, sums: DataFrame, size: Column) -> DataFrame:
    """Rows as struct __row with __size, __rank, cumulative __done and their source's figures."""
    rows = docs.select(F.struct("*").alias("__row"), size.alias("__size"), F.col("source").alias("__source"), shuffle_rank(F.col("doc_id")).alias("__rank"))
    rows = rows.withColumn("__range", _range(F.col("__rank")))
    on = rows["__source"].eqNullSafe(sums["source"]) & (rows["__range"] == sums["range"])
    inside = Window.partitionBy("source", "range").orderBy("__rank", F.col("__row.doc_id"), "__size").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(sums, on).withColumn("__done", F.col("before") + F.sum("__size").over(inside))


def _range(rank: Column) -> Column:
    return F.shiftright(rank, 50).cast("int") % RANGES


def _key(vft: Column) -> Column:
    """The place of a document in the mix: finish time, then source, rank and id."""
    return F.struct(vft.alias("vft"), F.coalesce("source", F.lit("\U0010ffff")).alias("s"), F.col("__rank").alias("r"), F.col("__row.doc_id").alias("d"), F.col("__done").alias("c"))


def _finish(repeat: Column) -> Column:
    return (repeat * F.col("source_size") + F.col("__done")) / F.col("target")


def mix(docs: DataFrame, size: Column | None = None, weights=WEIGHTS, repeats: int = MAX_REPEATS, share: float = 1.0) -> DataFrame:
    """docs (doc_id, source, ...) with size, source_size, target, n_taken (copies that the mix takes) and finish_times (of these)."""
    size = n_words(F.col("text")) if size is None else F.coalesce(size, F.lit(0)).cast("long")
    base = docs.select("source", size.alias("size"), _range(shuffle_rank(F.col("doc_id"))).alias("range"))
    ranges = staged(base.groupBy("source", "range").agg(F.sum("size").alias("range_size")), "mix-ranges")
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, repeats, share)
    up_to = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    with_before = ranges.withColumn("before", F.coalesce(F.sum("range_size").over(up_to), F.lit(0))).withColumnRenamed("source", "s")
    sums = staged(with_before.join(targets, F.col("s").eqNullSafe(targets["source"])).drop("s"), "mix-sums")

    narrow = staged(
        _queued(docs, sums, size)
        .filter((F.col("__size") > 0) & (F.col("target") > 0))
        .select(F.struct(F.col("__row.doc_id").alias("doc_id")).alias("__row"), "__size", "__rank", "__done", "source", "source_size", "target"),
        "mix-queue",
    )
    copies = narrow.select("*", F.explode(F.sequence(F.lit(0), F.least(F.ceil(F.col("target") / F.col("source_size")), F.lit(repeats)).cast("int") - 1)).alias("__repeat"))
    copies = copies.select("__size", _key(_finish(F.col("__repeat"))).alias("__key"))
    budget = share * (ranges.agg(F.sum("range_size")).first()[0] or 0)
    cut = _cut(copies, budget)
    rows = _queued(docs, sums, size)
    if cut is None:
        times = F.array().cast("array<double>")
    else:
        last = F.struct(*(F.lit(cut[f.name]).cast(f.dataType).alias(f.name) for f in copies.schema["__key"].dataType))
        possible = [F.when((F.col("__size") > 0) & (F.col("target") > 0) & (F.lit(e) < F.ceil(F.col("target") / F.col("source_size"))) & (_key(_finish(F.lit(e))) <= last), _finish(F.lit(e))) for e in range(repeats)]
        times = F.filter(F.array(*possible), lambda x: x.isNotNull())
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "n_taken", "finish_times")]
    out = rows.select(*(F.col(f"__row.`{c}`").alias(c) for c in own), F.col("__size").alias("size"), "source_size", "target", times.alias("finish_times"))
    return out.withColumn("n_taken", F.size("finish_times").cast("long"))


def _cut(copies: DataFrame, budget: float):
    """Key of the last copy that the mix takes: the largest whose running size stays within the budget."""
    low, before = 0.0, 0
    high, n = copies.agg(F.max("__key.vft"), F.count(F.lit(1))).first()
    if not n:
        return None
    vft, closed = F.col("__key.vft"), True
    while n > CUT_ROWS and high > low:
        part = copies.filter((vft >= low) & ((vft <= high) if closed else (vft < high)))
        slot = F.least(F.floor((vft - F.lit(low)) / F.lit((high - low) / _STEPS)), F.lit(_STEPS - 1))
        slots = part.groupBy(slot.alias("slot")).agg(F.sum("__size").alias("size"), F.count(F.lit(1)).alias("n"), F.min(vft).alias("low"), F.max(vft).alias("high")).orderBy("slot").collect()
        total = before
        for r in slots:  # at most _STEPS rows
            if total + r["size"] > budget:
                break
            total += r["size"]
        else:
            return copies.agg(F.max("__key")).first()[0] if closed else part.agg(F.max("__key")).first()[0]
        before, closed = total, True
        if (r["low"], r["high"], r["n"]) == (low, high, n):
            break
        low, high, n = r["low"], r["high"], r["n"]
    part = copies.filter((vft >= low) & (vft <= high))
    running = part.withColumn("total", F.lit(before) + F.sum("__size").over(Window.orderBy("__key").rowsBetween(Window.unboundedPreceding, 0)))
    last = running.filter(F.col("total") <= budget).agg(F.max("__key")).first()[0]
    return last or copies.filter(vft < low).agg(F.max("__key")).first()[0]


def mixed_stream(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row for each copy taken, globally range-sorted by virtual finish time."""
    taken = mix(docs, **options).filter(F.col("n_taken") > 0)
    return taken.withColumn("finish_time", F.explode("finish_times")).orderBy("finish_time").drop("finish_times")
