"""Periodic digests: the funnel of a period, its best records, and a text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .analytics import highlights, period_stats


def narrative(records: DataFrame) -> DataFrame:
    """One row: headline, distinct categories in order, and how many records there are."""
    found = records.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("category")).alias("categories"))
    headline = F.when(F.col("n") == 0, "No significant changes in this period").otherwise(
        F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " notable change").otherwise(" notable changes"), F.lit(" across "), F.array_join("categories", ", "))
    )
    return found.withColumn("headline", headline)


def render(stats: dict, headline: str, records: list, start, end, only_high: bool = True) -> str:
    """A digest's text from one row of figures and at most ten records."""
    shown = [r for r in records if r["relevance_score"] >= 70] if only_high else records
    shown = shown or records
    lines = ["# Change digest", f"{start} to {end}", "", headline, ""]
    lines += [f"- [{r['severity']} {r['relevance_score']:.0f}] {r['competitor']}: {r['title']}" for r in shown[:10]] or ["Nothing to report."]
    lines += ["", f"{stats['raw_changes']} raw, {stats['noise_changes']} noise ({stats['noise_reduction']:.1f} %), {stats['meaningful_changes']} meaningful, {stats['high_impact_changes']} high impact"]
    return "\n".join(lines)


def generate(intelligence: DataFrame, competitors: DataFrame, changes: DataFrame, start, end, limit: int = 8) -> DataFrame:
    """The digest row of a period; only the top `limit` records and two one-row aggregates reach the driver."""
    spark = changes.sparkSession
    best = highlights(intelligence, competitors, start, end, limit)
    stats = period_stats(changes, start, end).first().asDict()
    told = narrative(best).first()
    content = render(stats, told["headline"], best.collect(), start, end)
    row = [(str(start), str(end), "Change digest", content, told["headline"], *(int(stats[c]) for c in ("raw_changes", "noise_changes", "meaningful_changes", "high_impact_changes")), float(stats["noise_reduction"]), "rules")]
    schema = "period_start string, period_end string, title string, content string, headline string, raw_changes int, noise_changes int, meaningful_changes int, high_impact_changes int, noise_reduction double, generated_by string"
    out = spark.createDataFrame(row, schema)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("period_start", "period_end")})
