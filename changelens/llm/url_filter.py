"""URL filters as a temporal join, with DataFrame functions only.

A block list is a log of dated entries (list, kind, value, action, at): `domain` covers a host
and all hosts below it, `host` one host, `prefix` a host with the first segments of a path.
Consecutive equal actions fold together, and an addition holds from its date until the removal
after it: disjoint validity intervals for each entry. A capture has a key for each parent domain,
its host and each path prefix; an as-of join on the key finds the intervals that hold at the
capture's fetch time. Captures with equal URL and time are judged once, so copies of a hot page
are folded before the shuffle. The intervals are broadcast only while their counted rows are few.

Defined results: a null or unparsable URL, or a null time, is not blocked and has no reason; at
the instant of a removal an entry no longer holds, at the instant of an addition it does; of
several entries that hold, the most specific kind (prefix, host, domain), then the longest, then
the first value and list is the reason; entries with null fields are ignored; columns named like
an output are replaced; paths and entries are compared in lower case; the host of an IPv6
address is the address in its brackets, and has no parent domains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Intervals up to this many rows are broadcast; more are shuffled to the captures.
BROADCAST_INTERVALS = 200_000
OUTPUTS = ("host", "blocked", "kind", "value", "list", "since")


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot, an IPv6 address in its brackets; null where there is none."""
    host = F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:\[\]]+)", 1))
    return F.nullif(F.regexp_replace(host, r"\.$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def keys_of(url: Column) -> Column:
    """Array of (kind, value): each parent domain with two labels or more, the host, each path prefix."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    segments = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    tail = lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    upper = lambda n: F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    entry = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    address = host.startswith("[")  # an address has no parent domains
    domains = F.transform(upper(F.when(address, 0).otherwise(F.size(labels) - 1)), lambda i: entry("domain", tail(i)))
    prefixes = F.transform(upper(F.size(segments)), lambda i: entry("prefix", F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/"))))
    return F.when(host.isNotNull(), F.concat(domains, F.array(entry("host", host)), prefixes))


def validity(entries: DataFrame) -> DataFrame:
    """(list, kind, value, since, until): until is null while an entry still holds."""
    known = entries.select("list", "kind", F.lower("value").alias("value"), "action", "at").dropna()
    # Of several actions at one instant a removal is the last.
    once = known.groupBy("list", "kind", "value", "at").agg(F.max("action").alias("action"))
    own = Window.partitionBy("list", "kind", "value").orderBy("at")
    turns = once.withColumn("last", F.lag("action").over(own)).filter(F.col("last").isNull() | (F.col("last") != F.col("action")))
    return turns.withColumn("until", F.lead("at").over(own)).filter(F.col("action") == "add").select("list", "kind", "value", F.col("at").alias("since"), "until")


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """captures with host, blocked, and kind, value, list and since of the entry that blocks."""
    own = [c for c in captures.columns if c not in OUTPUTS]
    intervals = validity(entries)
    if intervals.count() <= BROADCAST_INTERVALS:
        intervals = F.broadcast(intervals)
    asked = captures.select(F.col(url).alias("__url"), F.col(at).alias("__at")).dropna().distinct()
    keyed = asked.select("__url", "__at", F.explode(keys_of(F.col("__url"))).alias("__key")).select("__url", "__at", F.col("__key.kind").alias("kind"), F.lower("__key.value").alias("value"))
    held = keyed.join(intervals, ["kind", "value"]).filter((F.col("since") <= F.col("__at")) & (F.col("until").isNull() | (F.col("__at") < F.col("until"))))
    place = F.struct(F.element_at(F.create_map(F.lit("prefix"), F.lit(0), F.lit("host"), F.lit(1), F.lit("domain"), F.lit(2)), F.col("kind")).alias("order"), (-F.length("value")).alias("size"), "value", "list", "kind", "since")
    judged = held.groupBy("__url", "__at").agg(F.min(place).alias("__why"))
    joined = captures.select(*(F.col(f"`{c}`") for c in own)).join(judged, (F.col(url) == F.col("__url")) & (F.col(at) == F.col("__at")), "left")
    why = {c: F.col(f"__why.{c}") for c in ("kind", "value", "list", "since")}
    return joined.select(*(F.col(f"`{c}`") for c in own), host_of(F.col(url)).alias("host"), F.col("__why").isNotNull().alias("blocked"), *(x.alias(c) for c, x in why.items()))
