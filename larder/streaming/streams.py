"""Structured Streaming forms, with file sources; each has a batch twin."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

from larder.operators.limits import CLOSED, breaker_step
from larder.storage import delete, fresh


def events_stream(spark: SparkSession, sf_dir: str, watermark: str = "1 hour") -> DataFrame:
    """The events table as a stream of its files; zoneless times become instants, so that a watermark can be set."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    single = not any(True for _ in _children(spark, path))
    reader = spark.readStream.schema(schema)
    raw = reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def _children(spark: SparkSession, path: str):
    """The files in a folder, by Hadoop's own listing; none if the path is a file."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(p).isDirectory():
        yield from fs.listStatus(p)


def run_once(stream: DataFrame, mode: str, key: str | None = None) -> DataFrame:
    """All that is there now, through the stream, as a table in the shared folder; its state is kept there too.

    Each batch replaces its own folder, so that a batch run again leaves nothing twice. In mode complete the last batch is the
    result; in mode update the last row of each key; in mode append all rows.
    """
    spark, folder = stream.sparkSession, fresh(stream.sparkSession, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    writer.foreachBatch(put).start().awaitTermination()
    found = spark.read.schema(f"{stream.schema.toDDL()}, batch long").parquet(f"{folder}/out")
    if mode == "complete":
        found = found.join(F.broadcast(found.agg(F.max("batch").alias("batch"))), "batch", "left_semi")  # one row
    elif mode == "update":
        last = Window.partitionBy(key).orderBy(F.desc("batch"))
        found = found.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return found.drop("batch")


def daily_usage(events: DataFrame) -> DataFrame:
    """Tumbling days."""
    return events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


def debounced(events: DataFrame, quiet: str = "5 minutes") -> DataFrame:
    """Bursts: a user's events with no pause as long as `quiet`."""
    return events.groupBy(F.session_window("ts", quiet).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def request_rates(events: DataFrame, length: str = "12 hours", slide: str = "6 hours") -> DataFrame:
    """Sliding windows for monitoring."""
    return events.groupBy(F.window("ts", length, slide).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")


def breaker_states(events: DataFrame, failures: int = 5, seconds: int = 60, probes: int = 2) -> DataFrame:
    """(user_id, state, failures_in_row) of events(user_id, ts, event_id, failed) after each batch, from keyed state.

    An open breaker has a timer: once the watermark is `seconds` past its opening, it is half-open without any call.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches, state):
        held = state.get if state.exists else CLOSED
        if state.hasTimedOut:
            held = ("half_open", held[1], held[2], 0)
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
            for at, failed in zip(rows["ts"].astype("datetime64[us]").astype("int64"), rows["failed"], strict=True):
                held, _, _ = breaker_step(tuple(held), int(at), bool(failed), failures, seconds * 1_000_000, probes)
        state.update(tuple(held))
        if held[0] == "open":
            state.setTimeoutTimestamp(max(held[2] // 1000 + 1000 * seconds, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "state": [held[0]], "failures_in_row": [held[1]]})

    kept = "state string, bad long, opened long, tried long"
    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, state string, failures_in_row long", kept, "update", GroupStateTimeout.EventTimeTimeout)


def file_changes(before: DataFrame, now: DataFrame, key: str = "path", version: str = "hash") -> DataFrame:
    """(key, change) of two polls of a folder: new, changed and deleted files; what is as it was is left out."""
    both = before.select(key, F.col(version).alias("_old")).join(now.select(key, F.col(version).alias("_new")), key, "full")
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def poll(files: DataFrame, folder: str, key: str = "path", version: str = "hash") -> DataFrame:
    """A poll that remembers: changes since the last one under this folder, whose snapshot is then replaced by this one's.

    Called by a scheduler, or from foreachBatch of a stream with a trigger of 30 seconds.
    """
    spark = files.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = sorted(int(p.getPath().getName()[2:]) for p in system.listStatus(path) if p.getPath().getName().startswith("n=")) if system.exists(path) else []
    now = files.select(key, version)
    now.write.parquet(f"{folder}/n={done[-1] + 1 if done else 0}")
    before = spark.read.schema(now.schema).parquet(f"{folder}/n={done[-1]}") if done else spark.createDataFrame([], now.schema)
    return file_changes(before, spark.read.schema(now.schema).parquet(f"{folder}/n={done[-1] + 1 if done else 0}"), key, version)


def gates(counted: DataFrame, by: str, order: list[str], every: int) -> DataFrame:
    """counted with opens: each `every`-th write of a counter opens a gate, to maintenance, say."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return counted.withColumn("opens", n % every == 0)


class Limiter(StatefulProcessor):
    """A client's exact sliding-window limit, from the list of its last allowed times; refused requests don't count."""

    def __init__(self, micros: int, most: int):
        self.micros, self.most = micros, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "at long")
        self.handle = handle

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values(["at", "request"])
        recent, allowed = deque(at for (at,) in self.recent.get()), []
        for at in asked["at"]:
            while recent and recent[0] <= at - self.micros:
                recent.popleft()
            allowed.append(len(recent) < self.most)
            if allowed[-1]:
                recent.append(int(at))
        self.recent.put([(at,) for at in recent])
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        ends = (max(recent) + self.micros) // 1000 + 1
        self.handle.registerTimer(max(ends, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"client": [key[0]] * len(asked), "request": asked["request"], "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        return iter(())

    def close(self) -> None:
        pass


def limited(requests: DataFrame, client: str, ts: str, order: str, seconds: int, most: int) -> DataFrame:
    """(client, request, allowed) of a stream: at most `most` requests of a client in (t - seconds, t], refused ones not counted.

    State is a list of at most `most` times for each client that was active within the window; a timer, set to when the
    last allowed request leaves the window, clears it once the watermark is there. requests has a watermark on ts; what is
    later than that is dropped. Within a batch requests go by time and then by order. State is kept by RocksDB.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = requests.select(F.col(client).cast("long").alias("client"), F.col(order).cast("long").alias("request"), F.unix_micros(ts).alias("at"), ts)
    found = rows.groupBy("client").transformWithStateInPandas(Limiter(seconds * 1_000_000, most), "client long, request long, allowed boolean", "append", "eventTime")
    return found.select(F.col("client").alias(client), F.col("request").alias(order), "allowed")


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of finished snapshots in a folder, in order."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    names = [p.getPath().getName() for p in system.listStatus(path)]
    return sorted(int(n[2:]) for n in names if n.startswith("n=") and system.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))


def watch(stream: DataFrame, folder: str, key: str = "path", version: str = "hash", stamp: str = "seen", every: int = 0, maintain: Callable[[SparkSession, int], None] | None = None) -> None:
    """The poll loop as a stream: each batch of (key, version, deleted, stamp) is merged into the snapshot, and what changed is written.

    Of a batch's rows of one key the last by stamp counts. Snapshot and changes of batch n are written to folder/n=n and
    folder/changes/n=n, each replaced as a whole if a batch is run again; a batch reads the snapshot of the last finished
    batch before it, so a restart anywhere, in the middle of a write too, leaves the changes of a run without one. Old
    snapshots go. After each `every`-th batch maintain(spark, n) is called, by the batch's number and so at the same
    batches after a restart. Ends when all that is there is read.
    """
    spark = stream.sparkSession
    fields = f"{key} string, {version} string"

    def step(batch: DataFrame, n: int) -> None:
        done = [v for v in versions(spark, folder) if v < n]
        before = spark.read.schema(fields).parquet(f"{folder}/n={done[-1]}") if done else spark.createDataFrame([], fields)
        last = batch.groupBy(F.col(key).cast("string").alias(key)).agg(F.max_by(F.struct(F.col(version).cast("string").alias("v"), "deleted"), stamp).alias("l"))
        both = before.join(last, key, "full").select(key, F.col(version).alias("old"), F.when(F.col("l").isNull(), F.col(version)).when(~F.col("l.deleted"), F.col("l.v")).alias("new"))
        both.where("new is not null").select(key, F.col("new").alias(version)).write.mode("overwrite").parquet(f"{folder}/n={n}")
        change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").otherwise("changed")
        both.where("not (old <=> new)").select(key, change.alias("change")).write.mode("overwrite").parquet(f"{folder}/changes/n={n}")
        for old in done[:-1]:
            delete(spark, f"{folder}/n={old}")
        if every and maintain and (n + 1) % every == 0:
            maintain(spark, n)

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """(n, key, change) of all batches of watch()."""
    return spark.read.option("basePath", f"{folder}/changes").parquet(f"{folder}/changes")
