"""Windows over time within a key that may hold a third of all rows.

A plain window sorts all rows of a key in one task. Here the keys that hold over a thousandth of
the rows (at most 1,000 keys, counted with map-side combining) are cut into slices at quantiles of
the time; every window runs within (key, slice), so a hot key is spread over many tasks. What
crosses a border is carried over: a summary with one row for each key and slice hands the last
values, the number of rows and the sums of each slice to the ones behind it. Results equal those
of the plain window. Only rows of one key at one instant stay together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Keys with more than this share of all rows, and with more rows than this, are cut into so many slices.
HOT_SHARE, HOT_ROWS, SLICES = 1 / 1_000, 10_000, 64
SLICE = "__slice"


def _at(rows: DataFrame, at: str) -> Column:
    """Time, or a number, as a number that quantiles can be taken of; null stands before all."""
    value = F.col(at).cast("long") if isinstance(rows.schema[at].dataType, IntegralType) else F.unix_micros(F.col(at).cast("timestamp"))
    return F.coalesce(value, F.lit(-(1 << 62)))


def sliced(rows: DataFrame, key: str, at: str, slices: int = SLICES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows with the number of their slice of time, 0 but for hot keys; as they are where no key is hot. One small job tells."""
    counts = rows.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("n"))
    total, most = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    least = max(float(hot_rows), total * HOT_SHARE)
    if most <= least:
        return rows
    hot = counts.filter(F.col("n") > least).select("__key")
    marked = rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("__key")), "left_semi")
    shares = F.array(*(F.lit(k / slices) for k in range(1, slices)))
    bounds = marked.groupBy(F.col(key).alias("__key")).agg(F.percentile_approx(_at(rows, at), shares, 1_000).alias("__bounds"))
    met = rows.join(F.broadcast(bounds), F.col(key).eqNullSafe(F.col("__key")), "left")
    return met.withColumn(SLICE, F.coalesce(F.size(F.filter("__bounds", lambda b: b < _at(rows, at))), F.lit(0))).drop("__key", "__bounds")


def _order(at: str, id: str) -> list[Column]:
    return [F.asc(at), F.asc(id)]


def lagged(rows: DataFrame, columns: list[str], key: str, at: str, id: str, prefix: str = "previous_", ready: bool = False, **options) -> DataFrame:
    """rows with <prefix><column>: the value of the row before of the same key, by (at, id); null for the first.

    `ready` rows have been through sliced() already, and keep their slices.
    """
    cut = rows if ready else sliced(rows, key, at, **options)
    if SLICE not in cut.columns:
        plain = Window.partitionBy(key).orderBy(*_order(at, id))
        return cut.withColumns({f"{prefix}{c}": F.lag(c).over(plain) for c in columns})
    extra = [] if ready else [SLICE]
    own = Window.partitionBy(key, SLICE).orderBy(*_order(at, id))
    # A struct tells a carried null from no row before.
    local = cut.withColumns({"__before": F.lag(F.struct(*columns)).over(own), "__first": F.row_number().over(own) == 1})
    last = cut.groupBy(F.col(key).alias("__key"), F.col(SLICE).alias("__of")).agg(F.max_by(F.struct(*columns), F.struct(at, id)).alias("__last"))
    carried = last.withColumn("__carried", F.lag("__last").over(Window.partitionBy("__key").orderBy("__of"))).filter(F.col("__carried").isNotNull()).drop("__last")
    joined = local.join(carried, F.col(key).eqNullSafe(F.col("__key")) & (F.col(SLICE) == F.col("__of")) & F.col("__first"), "left")
    before = F.coalesce("__before", "__carried")
    return joined.withColumns({f"{prefix}{c}": before[c] for c in columns}).drop("__before", "__first", "__key", "__of", "__carried", *extra)


def running(rows: DataFrame, sums: dict[str, Column], key: str, at: str, id: str, ready: bool = False, **options) -> DataFrame:
    """rows with, for each name, the running sum of an integer column over the rows of the key up to this one, by (at, id)."""
    cut = rows if ready else sliced(rows, key, at, **options)
    if SLICE not in cut.columns:
        plain = Window.partitionBy(key).orderBy(*_order(at, id)).rowsBetween(Window.unboundedPreceding, 0)
        return cut.withColumns({n: F.sum(F.coalesce(c.cast("long"), F.lit(0))).over(plain) for n, c in sums.items()})
    extra = [] if ready else [SLICE]
    cut = cut.withColumns({f"__one_{n}": F.coalesce(c.cast("long"), F.lit(0)) for n, c in sums.items()})
    own = Window.partitionBy(key, SLICE).orderBy(*_order(at, id)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("__key").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(F.col(key).alias("__key"), F.col(SLICE).alias("__of")).agg(*(F.sum(f"__one_{n}").alias(f"__all_{n}") for n in sums))
    ahead = totals.select("__key", "__of", *(F.sum(f"__all_{n}").over(before).alias(f"__ahead_{n}") for n in sums))
    ahead = ahead.filter(F.greatest(F.lit(-(1 << 62)), *(F.col(f"__ahead_{n}") for n in sums)) > -(1 << 62))  # slices with one before
    local = cut.withColumns({n: F.sum(f"__one_{n}").over(own) for n in sums})
    joined = local.join(ahead, F.col(key).eqNullSafe(F.col("__key")) & (F.col(SLICE) == F.col("__of")), "left")
    return joined.withColumns({n: F.col(n) + F.coalesce(F.col(f"__ahead_{n}"), F.lit(0)) for n in sums}).drop("__key", "__of", *extra, *(f"__one_{n}" for n in sums), *(f"__ahead_{n}" for n in sums))


def numbered(rows: DataFrame, name: str, key: str, at: str, id: str, **options) -> DataFrame:
    """rows with their place (from 1) among the rows of the key by (at, id)."""
    return running(rows, {name: F.lit(1)}, key, at, id, **options)
