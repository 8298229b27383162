"""Structured Streaming over the event log.

Each function starts a query that takes what is there (availableNow) and returns what it wrote. The
sink is a table of versions: every micro-batch appends the rows that changed with its number, and the
reader takes the latest version of each key, so a restart that repeats a micro-batch changes nothing.
State is bounded by the watermark, but for sessions(), whose result is complete at every micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenfold.sources.storage import fresh_path

LATE = "1 hour"
#: A batch without events for so long, in event time, is over: its state goes, its last counters stay in the sink.
SILENT_MS = 30 * 86_400_000


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a stream; time stamps get a zone, which watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return files.withColumn("at", F.col("ts").cast("timestamp"))


def drained(rows: DataFrame, keys: list[str], mode: str) -> DataFrame:
    """Run a stream to its end into a table of versions and return the latest version of each key."""
    spark = rows.sparkSession
    out, marks = fresh_path(spark, "sink"), fresh_path(spark, "marks")

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_version", F.lit(number)).write.mode("append").parquet(out)

    rows.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    written = spark.read.parquet(out)
    values = [c for c in written.columns if c not in (*keys, "_version")]
    latest = F.max_by(F.struct(*values), "_version").alias("x")
    return written.groupBy(*keys).agg(latest).select(*keys, "x.*") if values else written.select(*keys).distinct()


def tumbling(spark: SparkSession, sf_dir: str, width: str = "1 hour") -> DataFrame:
    """Events and value of each window and type."""
    e = source(spark, sf_dir).withWatermark("at", LATE)
    w = e.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    flat = w.select(F.col("window.start").cast("timestamp_ntz").alias("begin"), "event_type", "n", "total")
    return drained(flat, ["begin", "event_type"], "update")


def sliding(spark: SparkSession, sf_dir: str, width: str = "3 hours", slide: str = "1 hour") -> DataFrame:
    """Events a second over a sliding window."""
    e = source(spark, sf_dir).withWatermark("at", LATE)
    w = e.groupBy(F.window("at", width, slide)).agg(F.count("*").alias("n"))
    flat = w.select(F.col("window.start").cast("timestamp_ntz").alias("begin"), "n", F.round(F.col("n") / 10800.0, 9).alias("per_second"))
    return drained(flat, ["begin"], "update")


def sessions(spark: SparkSession, sf_dir: str, gap: str = "12 hours") -> DataFrame:
    """Sessions of each user; rows of the complete result."""
    e = source(spark, sf_dir)
    s = e.groupBy("user_id", F.session_window("at", gap)).agg(F.count("*").alias("n"))
    flat = s.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("begin"), "n")
    return drained(flat, ["user_id", "begin"], "complete")


def terminal_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's terminal transitions counted once, however often they are delivered within LATE of each other.

    The stream drops repeats and writes what is left; the counts are read from that table, so no state is kept for an item.
    """
    e = source(spark, sf_dir).where(F.col("event_type").isin("purchase", "error"))
    keyed = e.withColumn("item_id", F.col("user_id") * 100 + F.col("event_id") % 20)
    both = keyed.unionByName(keyed)  # delivered twice
    once = both.withWatermark("at", LATE).dropDuplicatesWithinWatermark(["item_id", "event_id"]).select("item_id", "event_id", "event_type")
    return drained(once, ["item_id", "event_id"], "append").groupBy("item_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"))


def batch_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each batch in keyed state: an item counts once, by its first terminal transition of the stream's order. State of batches that are silent for SILENT_MS goes."""
    e = source(spark, sf_dir).withWatermark("at", LATE).select("at", "user_id", (F.col("user_id") * 100 + F.col("event_id") % 20).alias("item_id"), "event_id", F.unix_micros("at").alias("us"), "event_type")

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        items, ended = (set(x) for x in state.get) if state.exists else (set(), set())
        first: dict[int, tuple] = {i: tuple(t) for i, *t in ended}
        until = state.getCurrentWatermarkMs() + 1
        for part in parts:
            until = max(until, int(part["us"].max()) // 1000 + SILENT_MS)
            items |= set(part["item_id"].tolist())
            for i, u, n, kind in part[part["event_type"].isin(["purchase", "error"])][["item_id", "us", "event_id", "event_type"]].itertuples(index=False):
                first[i] = min(first.get(i, (u, n, kind == "purchase")), (u, n, kind == "purchase"))
        state.update((sorted(items), [(i, *t) for i, t in sorted(first.items())]))
        state.setTimeoutTimestamp(until)
        ok = sum(t[2] for t in first.values())
        yield pd.DataFrame({"batch_id": [key[0]], "total": [len(items)], "succeeded": [ok], "failed": [len(first) - ok]})

    kept = "items array<long>, ended array<struct<i:long,us:long,n:long,ok:boolean>>"
    rows = e.groupBy("user_id").applyInPandasWithState(fold, "batch_id long, total long, succeeded long, failed long", kept, "update", GroupStateTimeout.EventTimeTimeout)
    return drained(rows, ["batch_id"], "update")


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as commands of the life cycle: a batch for each user, six items in each; twelve of the log's days pass as one, so that leases and idle hours matter."""
    return commands_of(source(spark, sf_dir))


def commands_of(e: DataFrame) -> DataFrame:
    """commands() of events with their time as `at`."""
    number = F.col("event_id")
    ms = F.floor(F.unix_micros("at") / 12000).cast("long")
    of = lambda k, *kinds: F.element_at(F.array(*map(F.lit, kinds)), (number % k + 1).cast("int"))
    kind = (
        F.when(F.col("event_type") == "view", "append").when(F.col("event_type") == "signup", of(8, "seal", "finalize", "create", "finalize", "create", "create", "create", "create"))
        .when(F.col("event_type") == "click", of(5, "retry", "claim", "confirm", "start", "start")).when(F.col("event_type") == "purchase", "succeed").otherwise(of(3, "skip", "fail", "cancel"))
    )
    return e.select(
        F.col("user_id").alias("batch_id"), (number % 6).alias("item_id"), F.timestamp_millis(ms).alias("at"), ms.alias("ms"), number.alias("seq"), kind.alias("kind"), (number % 4).alias("token"),
        F.when(number % 2 == 1, number % 8).alias("expected"), (F.floor("value").cast("long") % 4).alias("faces"), of(3, "cpu", "gpu", "tpu").alias("processor"),
    )


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as images and faces of a second; an hour of the log is one."""
    e = source(spark, sf_dir)
    return e.select(F.col("user_id").alias("scope"), F.floor(F.unix_seconds("at") / 3600).cast("long").alias("second"), F.lit(1).cast("long").alias("images"), (F.floor("value").cast("long") % 4).alias("faces"))
