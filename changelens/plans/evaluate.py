"""Evaluation of page pairs: the deterministic core pipeline, its funnel and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.classify import classify_survivors
from ..operators.diff import diff_captures, diff_html
from ..operators.noise import filter_noise
from ..operators.relevance import score_changes
from ..operators.snapshots import select_pair, spread
from ..schema import CATEGORIES, HIGH_IMPACT
from .analytics import noise_reduction


@dataclass(frozen=True)
class Suite:
    """What an evaluation covers: captures of `urls` from `start` to `end`, at most `limit` of each."""

    urls: tuple = ()
    start: str = "2023-01-01"
    end: str = "2025-01-01"
    limit: int = 40


def suite_pairs(captures: DataFrame, suite: Suite, url: str = "url", at: str = "timestamp", **columns: str) -> DataFrame:
    """The pair of captures of each URL that a suite compares: of those in its period, spread over it, the first and the last distinct one."""
    own = captures.filter(F.col(at).between(F.lit(suite.start).cast("timestamp_ntz"), F.lit(suite.end).cast("timestamp_ntz")))
    own = own.filter(F.col(url).isin(*suite.urls)) if suite.urls else own
    return select_pair(spread(own, suite.limit, url=url, at=at), url=url, at=at, **columns)


def judged(changes: DataFrame, round_between_stages: bool = False) -> DataFrame:
    """Raw changes -> noise reason, class and score."""
    return score_changes(classify_survivors(filter_noise(changes)), round_between_stages)


def evaluate_pairs(pairs: DataFrame, pair: list[str] | None = None) -> DataFrame:
    """Pairs (pair_id, url, before_html, after_html) -> judged changes."""
    return judged(diff_html(pairs, pair or ["pair_id"]))


def evaluate_captures(pairs: DataFrame, pair: list[str]) -> DataFrame:
    """As evaluate_pairs, with texts (before_text, after_text) where a body is missing."""
    return judged(diff_captures(pairs, pair))


def page_funnel(changes: DataFrame, page: list[str]) -> DataFrame:
    meaningful = ~F.col("is_noise")
    found = changes.groupBy(*page).agg(
        F.count(F.lit(1)).alias("raw_changes"), F.count_if(F.col("is_noise")).alias("noise_changes"), F.count_if(meaningful).alias("meaningful_changes"),
        F.count_if(meaningful & (F.col("relevance_score") >= HIGH_IMPACT)).alias("high_impact_changes"),
    )
    return found.withColumn("noise_reduction", noise_reduction(F.col("noise_changes"), F.col("raw_changes")))


def category_counts(changes: DataFrame, page: list[str]) -> DataFrame:
    """Page with categories: map of meaningful changes by category, without zeros."""
    counts = changes.filter(~F.col("is_noise")).groupBy(*page).agg(*(F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES))
    entries = F.map_filter(F.create_map(*(x for c in CATEGORIES for x in (F.lit(c), F.col(c)))), lambda k, v: v > 0)
    return counts.select(*page, entries.alias("categories"))


def top_changes(changes: DataFrame, page: list[str], n: int = 5) -> DataFrame:
    """The n best changes of each page, texts cut to 200 characters, three distinct pieces of evidence."""
    rank = F.row_number().over(Window.partitionBy(*page).orderBy(F.desc("relevance_score"), "seq"))
    best = changes.filter(~F.col("is_noise")).withColumn("rank", rank).filter(F.col("rank") <= n)
    return best.select(*page, "rank", "category", "relevance_score", "severity", F.left("before", F.lit(200)).alias("before"), F.left("after", F.lit(200)).alias("after"), F.slice(F.array_distinct("evidence"), 1, 3).alias("evidence"))


def page_status(pages: DataFrame) -> DataFrame:
    """pages (n_captures, error) with status: failed, no_snapshots or completed."""
    return pages.withColumn("status", F.when(F.col("error").isNotNull(), "failed").when(F.coalesce("n_captures", F.lit(0)) < 2, "no_snapshots").otherwise("completed"))


def merge_report(pages: DataFrame) -> DataFrame:
    """One row over the completed pages: sums, and the reduction of the sums."""
    done = pages.filter(F.col("status") == "completed")
    sums = done.agg(F.count(F.lit(1)).alias("pages_evaluated"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("raw_changes", "noise_changes", "meaningful_changes", "high_impact_changes")))
    return sums.withColumn("noise_reduction", noise_reduction(F.col("noise_changes"), F.col("raw_changes")))


def merge_counts(pages: DataFrame, counts: str = "categories") -> DataFrame:
    """Maps of completed pages summed by key, the largest first."""
    each = pages.filter(F.col("status") == "completed").select(F.explode(counts).alias("name", "n"))
    return each.groupBy("name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "name")


def format_report(report: DataFrame, pages: DataFrame, categories: DataFrame, max_pages: int = 200) -> str:
    """The report as text: one summary row, category rows, and at most max_pages page rows."""
    r = report.first()
    lines = ["Evaluation", f"pages {r['pages_evaluated']}  raw {r['raw_changes']}  noise {r['noise_changes']}  meaningful {r['meaningful_changes']}  high impact {r['high_impact_changes']}  noise reduction {r['noise_reduction']:.2f} %"]
    lines += ["", "Categories"] + [f"  {c['name']}: {c['n']}" for c in categories.limit(20).collect()]
    lines += ["", "Pages"] + [f"  {p['url']}  {p['status']}  raw {p['raw_changes'] or 0}  noise {p['noise_changes'] or 0}  meaningful {p['meaningful_changes'] or 0}" for p in pages.orderBy("url").limit(max_pages).collect()]
    return "\n".join(lines)
