"""Exact dedup by progressive refinement, with DataFrame functions only.

Texts are equal when identical after all ASCII white space is deleted. Rows are grouped by
normalised length (counted with map-side combining), then, where a length occurs twice, by a
hash of the first `prefix` characters, and only the groups that survive have their full text
read and hashed with SHA-256. What is counted is narrow; texts of rows that are alone are never
shuffled. Of a group the row with the longest original text stays, then the smallest doc_id.

Defined results: null counts as an empty text, so null, empty and blank texts are one group; a
null doc_id loses against any other, and ids may be numbers or texts; rows that repeat a doc_id and text are copies and one of
them stays; other columns are passed on; columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import SPACE, staged

PREFIX = 256
#: Repeated lengths, and (length, prefix hash) groups of several rows, up to this many are broadcast to the next scan (16 bytes each).
BROADCAST_GROUPS = 1_000_000
OUTPUTS = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def _measured(docs: DataFrame, text: str) -> DataFrame:
    own = [c for c in docs.columns if c not in OUTPUTS]
    plain = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("__row"), normalised(F.col(text)).alias("__norm"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("__chars"))
    return plain.withColumn("__length", F.length("__norm"))


def _few(keys: DataFrame) -> DataFrame:
    """A written table of keys, broadcast where it is small enough."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_GROUPS else keys


def exact_dedup(docs: DataFrame, text: str = "text", carry: list[str] | None = None, digests: bool = False) -> DataFrame:
    """Rows of docs (the columns in carry, else all) with keep_id, group_size, kept and text_sha256.

    text_sha256 is the digest of the normalised text; without `digests` it is null for rows whose
    length or prefix is already unique, as their full text needs no reading.
    """
    measured = _measured(docs, text)
    # First by length alone; prefixes are hashed only where a length occurs twice.
    lengths = staged(measured.groupBy("__length").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("__length"), "dedup-lengths")
    again = _few(lengths)
    prefixed = measured.join(again, "__length", "left_semi").withColumn("__prefix", F.xxhash64(F.substring("__norm", 1, PREFIX)))
    survivors = staged(prefixed.groupBy("__length", "__prefix").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("__length", "__prefix", F.lit(True).alias("__again")), "dedup-prefixes")
    survivors = _few(survivors)
    in_length = measured.join(again.withColumn("__twice", F.lit(True)), "__length", "left")
    measured = in_length.withColumn("__prefix", F.when(F.col("__twice"), F.xxhash64(F.substring("__norm", 1, PREFIX))))

    own = [c for c in (carry or docs.columns) if c not in OUTPUTS]
    digest = F.sha2(F.col("__norm").cast("binary"), 256)
    rows = measured.join(survivors, ["__length", "__prefix"], "left").select(
        F.struct(*(F.col(f"__row.`{c}`").alias(c) for c in own)).alias("__row"), F.col("__row.doc_id").alias("__id"), "__chars", "__again",
        (digest if digests else F.when(F.col("__again"), digest)).alias("__digest"),
    )
    if digests:  # every row is hashed once, so the narrow rows are kept
        rows = staged(rows, "dedup-digests")
    alone = rows.filter(F.col("__again").isNull()).select("__row.*", F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("__digest").alias("text_sha256"))

    again = staged(rows.filter("__again").withColumn("__at", F.monotonically_increasing_id()), "dedup-survivors")
    best = F.min(F.struct((-F.col("__chars")).alias("chars"), F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__at").alias("at")))
    # Written, so that both sides of the join are plain exchanges and a large group of copies can be split.
    groups = staged(again.groupBy("__digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")), "dedup-groups")
    shared = again.join(groups, "__digest").select("__row.*", F.col("best.id").alias("keep_id"), "group_size", (F.col("__at") == F.col("best.at")).alias("kept"), F.col("__digest").alias("text_sha256"))
    return alone.unionByName(shared)
