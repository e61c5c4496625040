"""Structured Streaming jobs over the event log.

The log is a directory of Parquet files. Order is (ts, id) within a key and late rows are bounded by a watermark. State is kept
in the checkpoint folder, so a job goes on after executors or the driver are lost.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomgraph.sources.tables import shared_dir, ship


def event_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """New files of the log; at most files_per_batch in a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def activity_windows(touches: DataFrame, gap_ms: int = 60_000, late: str | None = "10 minutes") -> DataFrame:
    """Edit windows by (agent, path): a gap of up to gap_ms goes on, a longer one opens a new window."""
    t = touches.withColumn("at", F.timestamp_millis("ts"))
    if late and t.isStreaming:
        t = t.withWatermark("at", late)
    return t.groupBy("agent", "path", F.session_window("at", f"{gap_ms} milliseconds").alias("w")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("updated_at"), F.count(F.lit(1)).alias("n")).drop("w")


def expire(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State of one lease: its expiry. Emits it as expired when event time passes that; a later heartbeat moves it."""
    if state.hasTimedOut:
        (until,) = state.get
        state.remove()
        return iter([pd.DataFrame({"lease": [keys[0]], "expired_at": [until]})])
    until = state.get[0] if state.exists else 0
    for b in batches:
        until = max(until, int(b["expires_at"].max()))
    state.update((until,))
    state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
    return iter([])


def lease_expiry(heartbeats: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(lease, expired_at) from a stream of (lease, at timestamp, expires_at ms)."""
    ship(heartbeats.sparkSession)
    return heartbeats.withWatermark("at", late).groupBy("lease").applyInPandasWithState(expire, "lease string, expired_at long", "until long", "append", GroupStateTimeout.EventTimeTimeout)


def timer_expiry(signs: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(key, expired_at) from a stream of (key, at timestamp, until ms, ended): what lapses unless a later sign moves its time; a sign that it ended stops its clock.

    Sessions, waiters and requests lapse like leases: until is the last sign plus 60 s, plus 15 s, or the deadline. The signs of a
    key that come before its time is over are a session of Spark's own, which ends when the watermark has passed that time: no
    Python runs for a key. A sign that comes when the time is over starts anew.
    """
    # A millisecond more, as the watermark must have passed the time, not only reached it; a time that is over at once lasts that long.
    left = F.greatest(F.col("until") - F.unix_millis("at"), F.lit(0)) + 1
    w = F.session_window("at", F.concat(left.cast("string"), F.lit(" milliseconds")))
    lapsed = signs.withWatermark("at", late).groupBy("key", w.alias("w")).agg(F.max("until").alias("expired_at"), F.max(F.coalesce("ended", F.lit(False))).alias("ended"))
    return lapsed.filter("not ended").select("key", "expired_at")


def presence(heartbeats: DataFrame) -> DataFrame:
    """Last heartbeat of each agent."""
    return heartbeats.groupBy("agent").agg(F.max("ts").alias("heartbeat_at"))


def online(seen: DataFrame, now: int, alive_ms: int = 60_000) -> DataFrame:
    """presence() as of now: online up to alive_ms after the last heartbeat."""
    return seen.withColumn("online", F.lit(now) - F.col("heartbeat_at") <= alive_ms)


def debounced(changes: DataFrame, write, interval: str = "250 milliseconds", checkpoint: str | None = None):
    """A query that hands each burst's distinct paths to `write(batch, number)`; a burst is what comes within an interval."""

    def once(batch: DataFrame, number: int) -> None:
        write(batch.groupBy("path").agg(F.max("modified").alias("modified")), number)

    q = changes.writeStream.foreachBatch(once).trigger(processingTime=interval)
    return (q.option("checkpointLocation", checkpoint) if checkpoint else q).start()


def bursts(changes: DataFrame, quiet_ms: int = 250, late: str | None = "10 minutes") -> DataFrame:
    """(root, started_at, ended_at, paths, changes): one row for each burst of changes (root, path, at timestamp) below a root, which ends when nothing changes for quiet_ms; its paths once each, in order."""
    if late and changes.isStreaming:
        changes = changes.withWatermark("at", late)
    w = F.session_window("at", f"{quiet_ms} milliseconds")
    rows = changes.groupBy("root", w.alias("w")).agg(F.min("at").alias("started"), F.max("at").alias("ended"), F.sort_array(F.collect_set("path")).alias("paths"), F.count(F.lit(1)).alias("changes"))
    return rows.select("root", F.unix_millis("started").alias("started_at"), F.unix_millis("ended").alias("ended_at"), "paths", "changes")


#: How often the log is looked at, and how long no frame is sent at most.
TICK_MS, FLOOR_MS = 300, 3_000


def frame_due(moved: bool, now: int, last: int, floor_ms: int = FLOOR_MS) -> bool:
    """Whether a tick sends a snapshot: always when the log moved, however far, else when none was sent for the floor."""
    return moved or now - last >= floor_ms


def pump(events: DataFrame, status, label: str, for_ms: int, tick_ms: int = TICK_MS, floor_ms: int = FLOOR_MS) -> DataFrame:
    """(at, last_id, events, json): frames of a stream of events (id) over some time: one a tick when events came, however many, and one each floor_ms when none did.

    Ticks come from a stream of Spark's own beside the events, as a batch without rows isn't run.
    """
    spark = events.sparkSession
    base = f"{shared_dir(spark)}/loomgraph/{label}-{uuid.uuid4().hex}"
    ticks = spark.readStream.format("rate").option("rowsPerSecond", max(1, 1000 // tick_ms)).load().select(F.lit(None).cast("long").alias("id"))
    sent = {"at": 0, "last_id": None}

    def once(batch: DataFrame, number: int) -> None:
        seen = batch.agg(F.max("id").alias("last_id"), F.count("id").alias("n")).first()
        now = int(time.time() * 1000)
        sent["last_id"] = seen.last_id if seen.n else sent["last_id"]
        if frame_due(seen.n > 0, now, sent["at"], floor_ms):
            sent["at"] = now
            rows = status().agg(F.to_json(F.array_sort(F.collect_list(F.struct("section", "key", "value")))).alias("json"))
            rows.select(F.lit(now).alias("at"), F.lit(sent["last_id"]).cast("long").alias("last_id"), F.lit(seen.n).cast("long").alias("events"), "json").write.mode("append").parquet(f"{base}/out")

    q = events.select("id").unionByName(ticks).writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(processingTime=f"{tick_ms} milliseconds").foreachBatch(once).start()
    q.awaitTermination(for_ms / 1000)
    q.stop()
    return spark.read.schema("at long, last_id long, events long, json string").parquet(f"{base}/out")


def swept(stream: DataFrame, sweep, label: str) -> DataFrame:
    """Run a stream over all there is now; behind each micro-batch `sweep(now)`, with now as the batch's last event time (ms, column ts), is written: what lapses, in its order."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/loomgraph/{label}-{uuid.uuid4().hex}"
    schema: list = []
    seen: list[int] = []

    def once(batch: DataFrame, number: int) -> None:
        now = batch.agg(F.max("ts")).first()[0]
        if now is not None:
            out = sweep(now)
            schema[:] = [out.schema]
            out.write.mode("overwrite").parquet(f"{base}/out/batch={number}")
            seen.append(number)

    stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(once).start().awaitTermination()
    return spark.read.schema(schema[0]).parquet(f"{base}/out/batch={seen[-1]}")


def snapshots(stream: DataFrame, status, label: str) -> DataFrame:
    """(batch, last_id, events, json): a snapshot behind each micro-batch that moved the log. status(batch): one row a section; the batch's events are counted once however many there are."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/loomgraph/{label}-{uuid.uuid4().hex}"

    def once(batch: DataFrame, number: int) -> None:
        at = batch.agg(F.max("id").alias("last_id"), F.count(F.lit(1)).alias("events"))
        rows = status().agg(F.to_json(F.array_sort(F.collect_list(F.struct("section", "key", "value")))).alias("json"))
        at.filter("events > 0").crossJoin(rows).select(F.lit(number).cast("long").alias("batch"), "last_id", "events", "json").write.mode("append").parquet(f"{base}/out")  # one row each

    stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(once).start().awaitTermination()
    return spark.read.schema("batch long, last_id long, events long, json string").parquet(f"{base}/out")


def run_to_table(df: DataFrame, mode: str, label: str, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all there is now and read its result from the shared folder. With a checkpoint of its own it goes on where the last run with it ended."""
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/loomgraph/{label}-{uuid.uuid4().hex}"
    seen: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        seen.append(number)

    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    if not seen:
        return spark.createDataFrame([], df.schema)
    wanted = seen[-1:] if mode == "complete" else seen
    return spark.read.schema(df.schema).parquet(*[f"{base}/out/batch={n}" for n in wanted])
