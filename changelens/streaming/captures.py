"""A stream of captures: per URL the last content is state, and only new content goes on.

The state of a URL is one small value (hash, time and id of its last content) in a RocksDB state
store with a change log, so a micro-batch reads and writes the URLs that it holds, not the store. A
timer a URL tells when nothing has been captured for a while. The sink is a file sink of exactly
once; a capture that comes again is equal to what is known or late, and adds nothing.

Defined results: captures of a URL are taken by (timestamp, id); one at or before the last known
time of its URL is late and is given with kind `late`, without changing the state; a null hash is
a content of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

CAPTURE = "id long, tracked_url_id long, competitor_id long, url string, timestamp timestamp_ntz, content_hash string, normalized_text string"
EVENT = "tracked_url_id long, kind string, id long, timestamp timestamp_ntz, content_hash string, previous_id long, previous_hash string"
_EVENT = Row(*(f.split(" ")[0] for f in EVENT.split(", ")))
STATE = "content_hash string, timestamp timestamp_ntz, id long, seen timestamp_ntz"
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def capture_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(CAPTURE).option("maxFilesPerTrigger", files_per_batch).parquet(path)


class LastContent(StatefulProcessor):
    """Gives a row for each capture with new content (kind `new`), each late one (`late`), and each URL without captures for `idle_ms` (`idle`)."""

    def __init__(self, idle_ms: int | None = None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        url = key[0]
        known = self.last.get() if self.last.exists() else None
        digest, at, id_, seen = known or (None, None, None, None)
        for r in sorted(rows, key=lambda r: (r.timestamp, r.id)):
            if seen is not None and (r.timestamp < seen or (r.timestamp == seen and r.id <= id_)):
                if not (r.id == id_ and r.timestamp == at):
                    yield _EVENT(url, "late", r.id, r.timestamp, r.content_hash, None, None)
                continue
            if known is None or r.content_hash != digest:
                yield _EVENT(url, "new", r.id, r.timestamp, r.content_hash, id_, digest)
                known, digest, at, id_ = True, r.content_hash, r.timestamp, r.id
            seen = r.timestamp
        self.last.update((digest, at, id_, seen))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists():
            digest, at, id_, _ = self.last.get()
            yield _EVENT(key[0], "idle", id_, at, digest, None, None)

    def close(self) -> None:
        pass


def new_content(stream: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Events (EVENT) of a stream of captures."""
    narrow = stream.select("tracked_url_id", "id", "timestamp", "content_hash")  # no bodies in the state's shuffle
    return narrow.groupBy("tracked_url_id").transformWithState(LastContent(idle_ms), EVENT, "Append", "None" if idle_ms is None else "ProcessingTime")


def follow(stream: DataFrame, out_path: str, checkpoint: str, idle_ms: int | None = None) -> StreamingQuery:
    """The events go to out_path: run what is there, then stop; with timers for idle URLs, go on until stopped."""
    for name, value in ROCKSDB.items():
        stream.sparkSession.conf.set(name, value)
    writer = new_content(stream, idle_ms).writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if idle_ms is None else writer.trigger(processingTime="1 second")).start()


def daily_activity(changes: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Changes a day on a stream (detected_at, is_noise), late rows within `lateness` counted."""
    timed = changes.withColumn("at", F.col("detected_at").cast("timestamp")).withWatermark("at", lateness)
    return timed.groupBy(F.window("at", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("is_noise")).alias("meaningful")).select(F.col("w.start").alias("day"), "total", "meaningful")
