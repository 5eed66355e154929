"""The scan pipeline: captures -> stored snapshots -> changes -> narrated records -> funnels, one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..arrow import dealt
from ..functions.text import content_hash, folded, word_count
from ..operators.diff import diff_pairs
from ..operators.html import blocks_to_text, text_blocks, with_blocks, with_page
from ..operators.narrate import assemble, budgeted, narrate
from ..operators.ordered import SLICE, lagged
from ..operators.snapshots import stored_points
from ..schema import NARRATE_MIN_SCORE
from ..sources.store import BUCKETS, KeyedTable, keyed
from .analytics import noise_reduction
from .evaluate import judged

RETRYABLE = (408, 425, 429, 500, 502, 503, 504)


def is_retryable(status: Column) -> Column:
    return status.isin(*RETRYABLE)


def normalise_captures(captures: DataFrame, stored_limit: int | None = None) -> DataFrame:
    """captures (html) with title, blocks, normalized_text, word_count and content_hash of the whole page.

    raw_html is the body to store: whole, or its first stored_limit characters, and then body_cut
    tells of it. A page that can't be read has the error's type in `error`, and no content.
    """
    given = captures if "error" in captures.columns else captures.withColumn("error", F.lit(None).cast("string"))
    page = with_page(given, "html", error="__error").withColumn("error", F.coalesce("error", "__error")).drop("__error")
    text = page.withColumns({"blocks": F.col("page.blocks"), "normalized_text": blocks_to_text(F.col("page.blocks")), "title": F.col("page.title")}).drop("page")
    hashed = text.withColumns({"content_hash": F.when(F.col("error").isNull(), content_hash("normalized_text")), "word_count": word_count("normalized_text")})
    body = F.col("html") if stored_limit is None else F.left("html", F.lit(stored_limit))
    return hashed.withColumns({"raw_html": body, "body_cut": F.length("html") > F.length(body)}).drop("html")


def capture_status(rows: DataFrame) -> DataFrame:
    """rows (error, previous_content_hash, content_hash, is_first) with status: failed, baseline, unchanged or changed."""
    same = F.col("previous_content_hash").eqNullSafe(F.col("content_hash"))
    return rows.withColumn("status", F.when(F.col("error").isNotNull(), "failed").when(F.col("previous_id").isNull(), "baseline").when(same, "unchanged").otherwise("changed"))


@dataclass
class Scan:
    """What a scan gives.

    snapshots: rows to put into the store by (tracked_url_id, id), new ones and stored ones that
    were seen again; changes and intelligence: judged and narrated; pages and runs: funnels by page
    and by competitor; outcomes: a row a capture with status (failed, baseline, unchanged, changed,
    or late: at or before what is stored of its URL, as in a replay), previous_id and error.
    """

    snapshots: DataFrame | None
    changes: DataFrame
    intelligence: DataFrame
    pages: DataFrame
    runs: DataFrame
    outcomes: DataFrame


def change_key(url: Column, before: Column, after: Column, seq: Column) -> Column:
    """Key of a change that is the same in every replay."""
    return F.sha2(F.concat_ws("|", url.cast("string"), before.cast("string"), after.cast("string"), seq.cast("string")).cast("binary"), 256)


#: What a scan does, in order.
STEPS = (
    "read: parse each new page once, whole; a page that can't be read is failed", "place: each capture after what is stored of its URL: late, baseline, unchanged or changed", "align: blocks of changed captures with those before",
    "judge: noise rules, classes, scores", "gate: the best changes of a page, within the budget", "narrate: templates, or a narrator that is passed in", "assemble: funnels by page and competitor", "store: keyed merges of changes, records, runs, then snapshots",
)
_POINT = "id long, tracked_url_id long, timestamp timestamp_ntz, content_hash string"


def placed(facts: DataFrame, stored: DataFrame | None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(captures, points) of facts (id, tracked_url_id, timestamp, content_hash) after what is stored; narrow rows only.

    captures: each with status and previous_id, the stored capture it is compared with. points: each
    capture that is stored, or is in the store already (known), with touched_at and previous_id.
    """
    spark, own = facts.sparkSession, ["id", "tracked_url_id", "timestamp", "content_hash"]
    if stored is None:
        stored = spark.createDataFrame([], _POINT + ", touched_at timestamp_ntz")
    seen = F.greatest("timestamp", F.coalesce("touched_at", "timestamp"))
    heads = stored.groupBy("tracked_url_id").agg(F.max_by(F.struct("id", "timestamp", "content_hash"), F.struct("timestamp", "id")).alias("head"), F.max(seen).alias("seen"))
    heads = heads.join(facts.select("tracked_url_id").distinct(), "tracked_url_id", "left_semi")
    met = facts.select(*own).join(heads.select(F.col("tracked_url_id").alias("__url"), "seen"), F.col("tracked_url_id") == F.col("__url"), "left").drop("__url")
    late = F.coalesce(F.col("timestamp") <= F.col("seen"), F.lit(False))
    # The last stored row stands first in its URL, so the first new capture is compared with it.
    head_rows = heads.select(F.col("head.id").alias("id"), "tracked_url_id", F.col("head.timestamp").alias("timestamp"), F.col("head.content_hash").alias("content_hash"), F.lit(True).alias("known"))
    line = met.filter(~late).select(*own, F.lit(False).alias("known")).unionByName(head_rows)
    points = stored_points(line.select(*own), "tracked_url_id", "timestamp", "id", "content_hash", keep)
    points = lagged(keep(points), ["id"], "tracked_url_id", "timestamp", "id", ready=True).drop(SLICE)
    points = points.join(head_rows.select("tracked_url_id", "id", "known"), ["tracked_url_id", "id"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    marks = points.filter(~F.col("known")).select("tracked_url_id", "id", "previous_id", F.lit(True).alias("new"))
    judged_ = met.join(marks, ["tracked_url_id", "id"], "left")
    status = F.when(late, "late").when(F.col("new").isNull(), "unchanged").when(F.col("previous_id").isNull(), "baseline").otherwise("changed")
    return judged_.select(*own, "previous_id", status.alias("status")), points


def scan(
    captures: DataFrame, competitors: DataFrame, budget: int = 8, narrator: Callable[[DataFrame], DataFrame] | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df,
    stored: DataFrame | None = None, stored_limit: int | None = None, observation: Observation | None = None, storing: bool = True,
) -> Scan:
    """captures (id, tracked_url_id, competitor_id, url, timestamp, html, error) through the whole pipeline, after what is stored of their URLs.

    `stored` are rows of the snapshots table (of the touched buckets, say); the first new capture of
    a URL is compared with the newest of them, so any split of captures in time into scans gives
    the changes that one scan gives. Unchanged captures are filtered out before any tree is compared.
    Each new page is parsed once, whole. Where several results of a scan are written, `keep` (a
    checkpoint, or a written table) makes the two Python steps run once for all of them.

    Where nothing is put into a store, storing=False keeps of the pages only what is compared, and
    the scan has no snapshots.

    Nothing raises for one page: a page that can't be read or aligned is `failed` with its error's
    type and no changes. `observation` counts captures and failed ones while the pages are read.
    """
    read = normalise_captures(captures.filter(F.col("error").isNull()), stored_limit)
    if observation is not None:
        read = read.observe(observation, F.count(F.lit(1)).alias("captures"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    # Of blocks only what is compared meets; a text of a page that was read now is that of its blocks.
    narrow = lambda blocks: F.transform(blocks, lambda x: F.struct(x["text"].alias("text"), x["location"].alias("location"), x["tag"].alias("tag")))
    size = F.coalesce(F.length("raw_html"), F.lit(0)).alias("size")
    if not storing:
        read = read.select("id", "tracked_url_id", "competitor_id", "url", "timestamp", "error", "content_hash", size, narrow("blocks").alias("blocks"))
    facts = keep(read)
    good = facts.filter(F.col("error").isNull())
    found, points = placed(good, stored, keep)
    found, points = keep(found), keep(points)

    new = points.filter(~F.col("known"))
    fresh = good.join(new.select("tracked_url_id", "id", "touched_at"), ["tracked_url_id", "id"]).drop("blocks", "error") if storing else None
    if stored is None or not storing:
        snapshots = fresh
    else:  # stored rows whose content was seen again
        again = points.filter("known").select("tracked_url_id", "id", F.col("touched_at").alias("__seen"))
        again = stored.join(again, ["tracked_url_id", "id"]).filter(F.col("__seen") > F.coalesce("touched_at", "timestamp")).withColumn("touched_at", F.col("__seen")).drop("__seen")
        snapshots = fresh.unionByName(again, allowMissingColumns=True)

    changed = new.filter(F.col("previous_id").isNotNull()).select("tracked_url_id", "id", "previous_id")
    here = good if not storing else good.select("tracked_url_id", "id", "competitor_id", "url", "timestamp", size, narrow("blocks").alias("blocks"))
    bodies = here.select("tracked_url_id", "id", "size", "blocks", F.lit(None).cast("string").alias("text"))
    if stored is not None:
        heads = stored.join(changed.select("tracked_url_id", F.col("previous_id").alias("id")), ["tracked_url_id", "id"], "left_semi")
        heads = with_blocks(heads.select("tracked_url_id", "id", "raw_html", "normalized_text"), "raw_html", "blocks", error="__bad").drop("__bad")
        bodies = bodies.unionByName(heads.select("tracked_url_id", "id", size, narrow("blocks").alias("blocks"), F.coalesce("normalized_text", F.lit("")).alias("text")))
    before = bodies.select("tracked_url_id", F.col("id").alias("previous_id"), F.col("size").alias("old_size"), F.col("blocks").alias("old_blocks"), F.col("text").alias("old_text"))
    after = here.select("tracked_url_id", "id", "competitor_id", "url", "timestamp", "size", "blocks")
    pairs = changed.join(before, ["tracked_url_id", "previous_id"]).join(after, ["tracked_url_id", "id"])
    both = (F.col("size") > 0) & (F.col("old_size") > 0)  # by blocks of HTML where both bodies are there, else by lines
    lines = lambda text: narrow(text_blocks(folded(F.when(~both, text))))
    page = ["tracked_url_id", "competitor_id", "url", "snapshot_id", "previous_snapshot_id", "detected_at"]
    blocks = pairs.select(
        "tracked_url_id", "competitor_id", "url", F.col("id").alias("snapshot_id"), F.col("previous_id").alias("previous_snapshot_id"), F.col("timestamp").alias("detected_at"),
        F.when(both, F.col("old_blocks")).otherwise(lines(F.coalesce("old_text", blocks_to_text(F.col("old_blocks"))))).alias("before_blocks"), F.when(both, F.col("blocks")).otherwise(lines(blocks_to_text(F.col("blocks")))).alias("after_blocks"),
    )
    raw = keep(diff_pairs(blocks, page, error="error"))
    lost = raw.filter(F.col("error").isNotNull()).select("tracked_url_id", F.col("snapshot_id").alias("id"), F.col("error").alias("lost"))
    found_changes = dealt(raw.filter(F.col("error").isNull()).drop("error"), "tracked_url_id", "snapshot_id", "seq")
    changes = keep(judged(found_changes, round_between_stages=True)).withColumn("change_key", change_key(F.col("tracked_url_id"), F.col("previous_snapshot_id"), F.col("snapshot_id"), F.col("seq")))

    gated = budgeted(changes, ["tracked_url_id", "snapshot_id"], budget)
    named = gated.join(competitors.select(F.col("id").alias("competitor_id"), F.col("name").alias("subject")), "competitor_id", "left")
    told = (narrator or narrate)(named)
    records = told.filter(~F.col("is_noise") & (F.col("relevance_score") >= NARRATE_MIN_SCORE))
    narrated = told.withColumn("title", F.when(~F.col("is_noise") & (F.col("relevance_score") >= NARRATE_MIN_SCORE), F.col("title")))
    pages = assemble(narrated, ["competitor_id", "tracked_url_id", "snapshot_id"])

    unread = facts.filter(F.col("error").isNotNull()).unionByName(captures.filter(F.col("error").isNotNull()), allowMissingColumns=True)
    about = facts.select("tracked_url_id", "id", "competitor_id", "url")
    outcomes = found.join(about, ["tracked_url_id", "id"]).join(lost, ["tracked_url_id", "id"], "left")
    outcomes = outcomes.select("id", "tracked_url_id", "competitor_id", "url", "timestamp", F.when(F.col("lost").isNotNull(), "failed").otherwise(F.col("status")).alias("status"), "previous_id", F.col("lost").alias("error"))
    outcomes = outcomes.unionByName(unread.select("id", "tracked_url_id", "competitor_id", "url", "timestamp", F.lit("failed").alias("status"), F.lit(None).cast("long").alias("previous_id"), "error"))
    return Scan(snapshots, changes, records, pages, scan_runs(outcomes, pages), outcomes)


@dataclass
class Stores:
    """The tables that a scan reads and writes, with keys: a replayed scan adds nothing."""

    snapshots: KeyedTable
    changes: KeyedTable
    intelligence: KeyedTable
    scan_runs: KeyedTable

    @classmethod
    def at(cls, spark: SparkSession, location: str, buckets: int = BUCKETS) -> Stores:
        return cls(*(keyed(spark, location, f.name, buckets) for f in fields(cls)))


def scan_store(captures: DataFrame, competitors: DataFrame, stores: Stores, keep: Callable[[DataFrame], DataFrame], **options) -> DataFrame:
    """Scan captures against the store and put all results into it; (outcomes) of the scan.

    Only the buckets of the captures' URLs are read and written. Snapshots come last, so a scan
    that is broken off and run again finds the same work and puts the same keys.
    """
    held = stores.snapshots.read(stores.snapshots.touched(captures)).drop("bucket")
    got = scan(captures, competitors, keep=keep, stored=held, **options)
    outcomes, snapshots = keep(got.outcomes), keep(got.snapshots)
    stores.changes.merge(got.changes.withColumn("source_url", F.col("url")), number="id")
    touched = stores.changes.touched(got.intelligence)
    ids = stores.changes.read(touched).select("change_key", F.col("id").alias("change_id"))
    stores.intelligence.merge(got.intelligence.withColumns({"source_url": F.col("url"), "created_at": F.col("detected_at"), "confidence": F.col("classifier_confidence")}).join(ids, "change_key"), number="id")
    at = outcomes.groupBy("competitor_id").agg(F.min("timestamp").alias("started_at"), F.max("timestamp").alias("finished_at"), F.count_if(F.col("status") != "late").alias("n")).filter("n > 0").drop("n")
    stores.scan_runs.merge(got.runs.join(at, "competitor_id"), number="id")
    stores.snapshots.merge(snapshots)
    return outcomes


def scan_runs(captures: DataFrame, pages: DataFrame) -> DataFrame:
    """One row a competitor: URLs scanned and failed, merged funnel, and status."""
    urls = captures.groupBy("competitor_id").agg(F.count_distinct("tracked_url_id").alias("urls_scanned"), F.count_distinct(F.when(F.col("error").isNotNull(), F.col("tracked_url_id"))).alias("urls_failed"))
    counts = ("raw_changes", "noise_changes", "meaningful_changes", "high_impact_changes")
    merged = pages.groupBy("competitor_id").agg(*(F.sum(c).alias(c) for c in counts))
    runs = urls.join(merged, "competitor_id", "left").fillna(0, list(counts))
    status = F.when(F.col("urls_scanned") == 0, "no_urls").when(F.col("urls_failed") == F.col("urls_scanned"), "failed").otherwise("completed")
    return runs.withColumns({"noise_reduction": noise_reduction(F.col("noise_changes"), F.col("raw_changes")), "status": status})
