"""Connected components of links between 64-bit nodes, by alternating large-star and small-star steps.

Each step is a minimum a node (combined before the shuffle) and a join; nothing is collected but
a count and a checksum of the links. Steps end when the links no longer change: then every link
leads from a node to its component's smallest node. Stars grow a hub that may hold a third of all
links: hubs are looked up by broadcast, so their links are not gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import staged

#: Keys that hold more than this share of all rows are hot: there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 1_000


def join_hot(rows: DataFrame, by_key: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined on key with by_key, which has one row a key and n, how many of the `total` rows have it.

    The rows of hot keys meet a broadcast of at most 1 / HOT_SHARE rows and stay where they are;
    all others are shuffled.
    """
    often = F.col("n") > max(1.0, total * HOT_SHARE)
    hot, rest = F.broadcast(by_key.filter(often).drop("n")), by_key.filter(~often).drop("n")
    return rows.join(hot, key).unionByName(rows.join(F.broadcast(by_key.filter(often).select(key)), key, "left_anti").join(rest, key))


def _both(links: DataFrame) -> DataFrame:
    return links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(links: DataFrame, n: int) -> DataFrame:
    near = _both(links)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return join_hot(near.filter(F.col("v") > F.col("u")), least, "u", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(links: DataFrame, n: int) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = join_hot(down, least, "u", n)
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(moved.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has a link; root is the component's smallest node."""
    links = staged(links.select("u", "v").filter("u != v").distinct(), "links")
    before, n = None, links.count()
    for _ in range(rounds):
        # Written after each star, as the next one reads its links several times.
        links = staged(_large_star(links, n), "links")
        links = staged(_small_star(links, n), "links")
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before, n = now, now[0]
    else:
        raise RuntimeError("components did not settle")
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
