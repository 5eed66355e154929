"""Analytics over stored changes: each report is one aggregation, a top-k or a join with a small dimension.

`as_of` stands for now in every report over a period, so results do not depend on the clock.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FREQUENCY_MINUTES, HIGH_IMPACT, SEVERITY_ORDER


def _at(as_of: datetime | str) -> Column:
    return F.lit(str(as_of)).cast("timestamp_ntz")


def noise_reduction(noise: Column, raw: Column) -> Column:
    return F.when(raw > 0, F.round(noise / raw * 100.0, 2)).otherwise(0.0)


def _high() -> Column:
    return F.col("relevance_score") >= HIGH_IMPACT


def _meaningful() -> Column:
    return ~F.col("is_noise")


def funnel(changes: DataFrame) -> DataFrame:
    """One row: raw, noise, meaningful, high-impact changes and the noise reduction."""
    return changes.agg(*_funnel()).withColumn("noise_reduction", noise_reduction(F.col("noise_changes"), F.col("raw_changes")))


def _funnel() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("raw_changes"), F.count_if(F.col("is_noise")).alias("noise_changes"), F.count_if(_meaningful()).alias("meaningful_changes"), F.count_if(_meaningful() & _high()).alias("high_impact_changes"),
    ]


def dashboard_stats(changes: DataFrame, as_of) -> DataFrame:
    """Totals over all rows and over the last seven days, in one pass."""
    week = _meaningful() & (F.col("detected_at") >= _at(as_of) - F.expr("interval 7 days"))
    totals = changes.agg(
        F.count(F.lit(1)).alias("total_changes"), F.count_if(F.col("is_noise")).alias("noise_changes"), F.count_if(_high()).alias("high_impact_total"),
        F.count_if(week).alias("changes_this_week"), F.count_if(week & _high()).alias("high_impact_this_week"),
    )
    return totals.withColumn("noise_reduction", noise_reduction(F.col("noise_changes"), F.col("total_changes")))


def last_scan(scan_runs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """When the last scan ended, else the last capture: two one-row aggregates."""
    return scan_runs.agg(F.max("finished_at").alias("f")).crossJoin(snapshots.agg(F.max("timestamp").alias("s"))).select(F.coalesce("f", "s").alias("last_scan"))


def entity_counts(competitors: DataFrame, tracked_urls: DataFrame, snapshots: DataFrame) -> DataFrame:
    a = competitors.agg(F.count(F.lit(1)).alias("competitors"), F.count_if(F.col("active")).alias("active_competitors"))
    return a.crossJoin(tracked_urls.agg(F.count(F.lit(1)).alias("tracked_urls"))).crossJoin(snapshots.agg(F.count(F.lit(1)).alias("snapshots")))


def _recent(changes: DataFrame, as_of, days: int | None) -> DataFrame:
    return changes if days is None else changes.filter(F.col("detected_at") >= _at(as_of) - F.make_dt_interval(days=F.lit(days)))


def category_distribution(changes: DataFrame, as_of=None, days: int | None = None) -> DataFrame:
    return _recent(changes.filter(_meaningful()), as_of, days).groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")


def severity_distribution(changes: DataFrame) -> DataFrame:
    order = F.array_position(F.array(*map(F.lit, SEVERITY_ORDER)), F.col("severity"))
    return changes.filter(_meaningful()).groupBy("severity").agg(F.count(F.lit(1)).alias("n")).orderBy(F.when(order == 0, 99).otherwise(order), "severity")


def day_bucket(c: Column) -> Column:
    return F.to_date(c)


def activity_timeline(changes: DataFrame, as_of=None, days: int | None = None) -> DataFrame:
    """Changes a day; days without any have no row."""
    return _recent(changes, as_of, days).groupBy(day_bucket(F.col("detected_at")).alias("day")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(_meaningful()).alias("meaningful"), F.count_if(_meaningful() & _high()).alias("high_impact")
    ).orderBy("day")


def noise_reason_breakdown(changes: DataFrame, limit: int = 12) -> DataFrame:
    found = changes.filter(F.col("is_noise") & F.col("noise_reason").isNotNull())
    return found.groupBy("noise_reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "noise_reason").limit(limit)


def top_competitors(competitors: DataFrame, changes: DataFrame, limit: int = 5) -> DataFrame:
    """Competitors by meaningful changes. The filter stands after the join: one with noise only is left out, one without any change counts 0."""
    per_key = changes.groupBy("competitor_id", "is_noise").agg(F.count(F.lit(1)).alias("n"), F.count_if(_high()).alias("h"))
    joined = competitors.join(per_key, competitors["id"] == per_key["competitor_id"], "left").filter(F.col("is_noise").isNull() | ~F.col("is_noise"))
    grouped = joined.groupBy(competitors["id"].alias("competitor_id"), "name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("changes"), F.coalesce(F.sum("h"), F.lit(0)).alias("high_impact"))
    return grouped.orderBy(F.desc("changes"), "competitor_id").limit(limit)


#: Reports of a bundle and the column that each is grouped by.
BUNDLE = {"categories": "category", "severities": "severity", "timeline": "day", "noise_reasons": "noise_reason", "competitors": "competitor_id"}


def bundle(changes: DataFrame, as_of, days: int = 30) -> DataFrame:
    """All counts of the dashboard in one scan of changes, by grouping sets: (report, key, total, noise, meaningful, high, meaningful_high, last_*).

    report `totals` has one row; the others have a row for each value of their column, as text.
    last_* count the changes of the last `days` days, week_* those of the last seven.
    """
    within = lambda n: F.col("detected_at") >= _at(as_of) - F.make_dt_interval(days=F.lit(n))
    rows = changes.select(
        day_bucket(F.col("detected_at")).cast("string").alias("day"), "category", "severity", "noise_reason", F.col("competitor_id").cast("string").alias("competitor_id"),
        F.col("is_noise").alias("noise"), _high().alias("high"), within(days).alias("last"), within(7).alias("week"),
    )
    columns = list(BUNDLE.values())
    grouped = rows.groupingSets([[], *([c] for c in columns)], *columns)
    kept = ~F.col("noise")
    counts = {
        "total": F.lit(True), "noise": F.col("noise"), "meaningful": kept, "high": F.col("high"), "meaningful_high": kept & F.col("high"), "last_total": F.col("last"), "last_meaningful": F.col("last") & kept,
        "last_meaningful_high": F.col("last") & kept & F.col("high"), "week_meaningful": F.col("week") & kept, "week_meaningful_high": F.col("week") & kept & F.col("high"),
    }
    found = grouped.agg(F.grouping_id(*columns).alias("__set"), *(F.count_if(c).alias(n) for n, c in counts.items()))
    # Bit k from the left of the set's number is 0 where column k is grouped by.
    number = {name: (1 << len(columns)) - 1 - (1 << (len(columns) - 1 - k)) for k, name in enumerate(BUNDLE)}
    report, key = F.lit("totals"), F.lit(None).cast("string")
    for name, column in BUNDLE.items():
        own = F.col("__set") == number[name]
        report, key = F.when(own, name).otherwise(report), F.when(own, F.col(column)).otherwise(key)
    return found.select(report.alias("report"), key.alias("key"), *counts)


def analytics_payload(competitors: DataFrame, changes: DataFrame, as_of, days: int = 30, keep=lambda df: df) -> dict[str, DataFrame]:
    """All reports over the same changes, by name, from one bundle; `keep` (a checkpoint, or a written table) makes its scan run once for all of them."""
    counts = keep(bundle(changes, as_of, days))
    of = lambda report: counts.filter(F.col("report") == report)
    n = lambda report, column, name: of(report).filter(F.col(column) > 0).select(F.col("key").alias(name), F.col(column).alias("n"))
    order = F.array_position(F.array(*map(F.lit, SEVERITY_ORDER)), F.col("severity"))
    low = F.col("meaningful") > 0
    found = of("competitors").select(F.col("key").cast("long").alias("competitor_id"), "meaningful", F.col("meaningful_high").alias("h"), F.lit(True).alias("__any"))
    # A competitor with noise only is left out, one without any change counts 0.
    top = competitors.select(F.col("id").alias("competitor_id"), "name").join(found, "competitor_id", "left").filter(F.col("__any").isNull() | low)
    return {
        "stats": of("totals").select(
            F.col("total").alias("total_changes"), F.col("noise").alias("noise_changes"), F.col("high").alias("high_impact_total"), F.col("week_meaningful").alias("changes_this_week"), F.col("week_meaningful_high").alias("high_impact_this_week"),
            noise_reduction(F.col("noise"), F.col("total")).alias("noise_reduction"),
        ),
        "categories": n("categories", "last_meaningful", "category").orderBy(F.desc("n"), "category"),
        "severities": n("severities", "meaningful", "severity").orderBy(F.when(order == 0, 99).otherwise(order), "severity"),
        "timeline": of("timeline").filter("last_total > 0").select(F.col("key").cast("date").alias("day"), F.col("last_total").alias("total"), F.col("last_meaningful").alias("meaningful"), F.col("last_meaningful_high").alias("high_impact")).orderBy("day"),
        "noise_reasons": n("noise_reasons", "noise", "noise_reason").filter(F.col("noise_reason").isNotNull()).orderBy(F.desc("n"), "noise_reason").limit(12),
        "top_competitors": top.select("competitor_id", "name", F.coalesce("meaningful", F.lit(0)).alias("changes"), F.coalesce("h", F.lit(0)).alias("high_impact")).orderBy(F.desc("changes"), "competitor_id").limit(5),
    }


#: What a daily rollup is grouped by.
ROLLUP = ("day", "competitor_id", "category", "severity", "is_noise", "noise_reason")


def daily_rollup(changes: DataFrame) -> DataFrame:
    """Counts (n, high) of changes by day, competitor, category, severity and noise reason: every report over whole days is a sum of them."""
    return changes.groupBy(day_bucket(F.col("detected_at")).alias("day"), *ROLLUP[1:]).agg(F.count(F.lit(1)).alias("n"), F.count_if(_high()).alias("high"))


def rollup_after(rollup: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """A rollup after changes were added and others removed (with their competitor, say); only these are read."""
    parts = [rollup]
    for changes, sign in ((added, 1), (removed, -1)):
        if changes is not None:
            parts.append(daily_rollup(changes).withColumns({c: F.col(c) * sign for c in ("n", "high")}))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy(*ROLLUP).agg(F.sum("n").alias("n"), F.sum("high").alias("high")).filter("n <> 0")


def rollup_window(rollup: DataFrame, changes: DataFrame, start, end=None) -> DataFrame:
    """Rollup rows of the changes from `start` to `end`, both counted: whole days from the rollup, the days of the two ends from the changes of these days."""
    at, first = F.col("detected_at"), day_bucket(_at(start))
    whole, ends = F.col("day") > first, (day_bucket(at) == first) & (at >= _at(start))
    if end is not None:
        last = day_bucket(_at(end))
        whole &= F.col("day") < last
        ends = day_bucket(at).isin(first, last) & (at >= _at(start)) & (at <= _at(end))
        edge = changes.filter((at >= first.cast("timestamp_ntz")) & (at <= _at(end)) & ends)
    else:
        edge = changes.filter((at >= _at(start)) & ends)
    return rollup.filter(whole).unionByName(daily_rollup(edge))


def rolled_funnel(rows: DataFrame) -> DataFrame:
    """The funnel of rollup rows."""
    kept = ~F.col("is_noise")
    total = lambda c, v="n": F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0))
    counts = rows.agg(total(F.lit(True)).alias("raw_changes"), total(F.col("is_noise")).alias("noise_changes"), total(kept).alias("meaningful_changes"), total(kept, "high").alias("high_impact_changes"))
    return counts.withColumn("noise_reduction", noise_reduction(F.col("noise_changes"), F.col("raw_changes")))


def rolled(rows: DataFrame, by: str) -> DataFrame:
    """(by, total, meaningful, high_impact) of rollup rows, for any column of ROLLUP."""
    kept = ~F.col("is_noise")
    total = lambda c, v: F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0))
    return rows.groupBy(by).agg(F.sum("n").alias("total"), total(kept, "n").alias("meaningful"), total(kept, "high").alias("high_impact"))


def _source_url() -> Column:
    return F.coalesce(F.nullif(F.col("source_url"), F.lit("")), F.col("change_url"), F.lit(""))


def recent_intelligence(intelligence: DataFrame, competitors: DataFrame, changes: DataFrame, limit: int = 20, competitor_id: int | None = None, category: str | None = None, least: float | None = None) -> DataFrame:
    """Newest narrated changes with their competitor and change, optional filters pushed to the scan."""
    rows = intelligence
    for column, value in (("competitor_id", competitor_id), ("category", category)):
        rows = rows if value is None else rows.filter(F.col(column) == value)
    rows = rows if least is None else rows.filter(F.col("relevance_score") >= least)
    names = competitors.select(F.col("id").alias("competitor_id"), F.col("name").alias("competitor"))
    facts = changes.select(F.col("id").alias("change_id"), F.col("change_type"), F.col("source_url").alias("change_url"))
    joined = rows.join(facts, "change_id").join(names, "competitor_id")
    out = joined.withColumn("source_url", _source_url()).drop("change_url")
    return out.orderBy(F.desc("created_at"), F.desc("relevance_score"), F.desc("id")).limit(limit)


list_intelligence = recent_intelligence


def last_status(intelligence: DataFrame) -> DataFrame:
    return intelligence.agg(F.max_by("llm_status", F.struct("created_at", "id")).alias("llm_status"))


def list_changes(
    changes: DataFrame, competitors: DataFrame, competitor_id: int | None = None, category: str | None = None, severity: str | None = None, include_noise: bool = False, least: float | None = None, limit: int = 50, offset: int = 0
) -> DataFrame:
    rows = changes if include_noise else changes.filter(_meaningful())
    for column, value in (("competitor_id", competitor_id), ("category", category), ("severity", severity)):
        rows = rows if value is None else rows.filter(F.col(column) == value)
    rows = rows if least is None else rows.filter(F.col("relevance_score") >= least)
    named = rows.join(competitors.select(F.col("id").alias("competitor_id"), F.col("name").alias("competitor")), "competitor_id")
    return named.orderBy(F.desc("detected_at"), F.desc("relevance_score"), F.desc("id")).offset(offset).limit(limit)


def get_change(changes: DataFrame, change_id: int) -> DataFrame:
    """One change with its word-level segments."""
    from ..operators.diff import with_word_diff

    return with_word_diff(changes.filter(F.col("id") == change_id))


def newest(rows: DataFrame, at: str = "created_at", limit: int = 1) -> DataFrame:
    """The newest rows of a log: digests, evaluations, scan runs."""
    return rows.orderBy(F.desc(at), F.desc("id")).limit(limit)


def competitor_summary(competitors: DataFrame, tracked_urls: DataFrame, changes: DataFrame, scan_runs: DataFrame) -> DataFrame:
    """A row a competitor: one grouped aggregate per table, joined on the id."""
    urls = tracked_urls.groupBy("competitor_id").agg(F.count(F.lit(1)).alias("urls"), F.count_if(F.col("active")).alias("active_urls"))
    found = changes.groupBy("competitor_id").agg(*_funnel(), F.max(F.when(_meaningful(), F.col("detected_at"))).alias("last_change"))
    runs = scan_runs.groupBy("competitor_id").agg(F.max("finished_at").alias("last_scan"))
    out = competitors
    for part in (urls, found, runs):
        out = out.join(part.withColumnRenamed("competitor_id", "id"), "id", "left")
    counts = [c for c in out.columns if c in ("urls", "active_urls", "raw_changes", "noise_changes", "meaningful_changes", "high_impact_changes")]
    return out.fillna(0, counts)


def list_competitors(competitors: DataFrame, active_only: bool = False) -> DataFrame:
    return (competitors.filter("active") if active_only else competitors).orderBy("name", "id")


def name_conflicts(competitors: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of wanted (id, name) whose name another competitor has, without regard to case."""
    taken = competitors.select(F.lower("name").alias("__name"), F.col("id").alias("__id"))
    return wanted.join(taken, (F.lower(F.trim("name")) == F.col("__name")) & ~F.col("id").eqNullSafe(F.col("__id")), "left_semi")


def period_stats(changes: DataFrame, start, end, competitor_id: int | None = None) -> DataFrame:
    """The funnel of a period, both ends included."""
    rows = changes.filter(F.col("detected_at").between(_at(start), _at(end)))
    return funnel(rows if competitor_id is None else rows.filter(F.col("competitor_id") == competitor_id))


def highlights(intelligence: DataFrame, competitors: DataFrame, start, end, limit: int = 8, competitor_id: int | None = None) -> DataFrame:
    rows = intelligence.filter(F.col("created_at").between(_at(start), _at(end)))
    rows = rows if competitor_id is None else rows.filter(F.col("competitor_id") == competitor_id)
    named = rows.join(competitors.select(F.col("id").alias("competitor_id"), F.col("name").alias("competitor")), "competitor_id")
    return named.orderBy(F.desc("relevance_score"), F.desc("created_at"), F.desc("id")).limit(limit)


def due_competitors(competitors: DataFrame) -> DataFrame:
    """What a tick scans: active and not manual, whatever the frequency."""
    return competitors.filter(F.col("active") & (F.col("tracking_frequency") != "manual")).orderBy("id")


def due_by_frequency(competitors: DataFrame, scan_runs: DataFrame, as_of) -> DataFrame:
    """What is due by its own frequency: the last scan is at least as old as it asks."""
    last = scan_runs.groupBy("competitor_id").agg(F.max("finished_at").alias("__last"))
    minutes = F.element_at(F.create_map(*(F.lit(x) for kv in FREQUENCY_MINUTES.items() for x in kv)), F.col("tracking_frequency"))
    joined = due_competitors(competitors).join(last.withColumnRenamed("competitor_id", "id"), "id", "left")
    return joined.filter(F.col("__last").isNull() | (F.col("__last") + F.make_dt_interval(mins=minutes) <= _at(as_of))).drop("__last")


def link_analyses(changes: DataFrame, analyses: DataFrame, key: list[str]) -> DataFrame:
    """changes with the last analysis (by seq) of the same key."""
    kept = F.struct(*(F.col(c) for c in analyses.columns if c not in key))
    last = analyses.groupBy(*key).agg(F.max_by(kept, "seq").alias("analysis"))
    return changes.join(last, key, "left")


def without_competitor(tables: dict[str, DataFrame], competitor_ids: DataFrame) -> dict[str, DataFrame]:
    """Tables without what belongs to the given competitors (id): children go with their parent."""
    ids = competitor_ids.select(F.col("id").alias("__gone")).distinct()
    key = lambda name: "id" if name == "competitors" else "competitor_id"
    return {name: df.join(ids, df[key(name)] == ids["__gone"], "left_anti") if key(name) in df.columns else df for name, df in tables.items()}


def detail_funnel(changes: DataFrame, competitor_id: int) -> DataFrame:
    return funnel(changes.filter(F.col("competitor_id") == competitor_id))


def by_day_heading(changes: DataFrame) -> DataFrame:
    """Changes under the heading of their day, newest first."""
    return changes.groupBy(F.date_format("detected_at", "yyyy-MM-dd").alias("heading")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).orderBy(F.desc("heading"))


def share_of_total(counts: DataFrame, n: str = "n") -> DataFrame:
    """Grouped counts with their percentage of the total."""
    total = F.sum(n).over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("share", F.round(F.col(n) / total * 100.0, 2))


def relative_time(at: Column, as_of) -> Column:
    """just now, m, h or d ago."""
    s = F.unix_timestamp(_at(as_of).cast("timestamp")) - F.unix_timestamp(at.cast("timestamp"))
    part = lambda by, unit: F.concat(F.floor(s / by).cast("string"), F.lit(f"{unit} ago"))
    return F.when(s < 60, "just now").when(s < 3600, part(60, "m")).when(s < 86400, part(3600, "h")).otherwise(part(86400, "d"))
