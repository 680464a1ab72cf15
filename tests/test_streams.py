"""Streams over several batches and restarts against their batch forms."""

import random

import pytest

from larder.operators import limits
from larder.streaming import streams as S

SCHEMA = "event_id long, user_id long, ts timestamp"


def test_limiter_over_batches(spark, tmp_path):
    """The same requests, a file for each batch, give what the batch form gives; state of silent clients goes."""
    rng = random.Random(6)
    at, rows = 1_000_000, []
    for i in range(900):
        at += rng.choice([0, 1, 5, 30])
        rows.append((i, rng.randrange(12) if i < 600 else rng.randrange(3), at))
    table = spark.createDataFrame(rows, "event_id long, user_id long, at long").selectExpr("event_id", "user_id", "timestamp_seconds(at) AS ts")
    want = {r["event_id"]: r["allowed"] for r in limits.sliding_exact(table, "user_id", "ts", "event_id", 60, 3).collect()}
    got, folder = {}, str(tmp_path)
    for n in range(6):
        table.where(f"event_id div 150 = {n}").coalesce(1).write.mode("append").parquet(f"{folder}/in")

        def put(batch, number):
            got.update({r["event_id"]: r["allowed"] for r in batch.collect()})

        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").withWatermark("ts", "1 minute")
        found = S.limited(stream, "user_id", "ts", "event_id", 60, 3)
        found.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    assert got == want and 0 < sum(want.values()) < len(want)


def test_watch_restarts(spark, tmp_path):
    """A run that is killed within a batch, after its snapshot is written, and started again finds what a whole run finds."""
    folder, opened = str(tmp_path), []
    rounds = [[("a", "1", False), ("b", "1", False), ("c", "1", False)], [("b", "2", False), ("c", None, True), ("d", "1", False)], [("a", "1", False), ("c", "3", False), ("x", None, True)], [("d", None, True)]]

    def run(maintain):
        stream = spark.readStream.schema("path string, hash string, deleted boolean, seen int").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        S.watch(stream, folder, every=2, maintain=maintain)

    def killed(_, n):
        raise RuntimeError("killed")

    for i, rows in enumerate(rounds):
        spark.createDataFrame([(*r, i) for r in rows], "path string, hash string, deleted boolean, seen int").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if i in (1, 3):
            with pytest.raises(Exception, match="killed"):
                run(killed)
        run(lambda _, n: opened.append(n))
    got = sorted(tuple(r) for r in S.changes(spark, folder).select("n", "path", "change").collect())
    assert got == [(0, "a", "new"), (0, "b", "new"), (0, "c", "new"), (1, "b", "changed"), (1, "c", "deleted"), (1, "d", "new"), (2, "c", "new"), (3, "d", "deleted")]
    assert opened == [1, 3] and len(S.versions(spark, folder)) <= 3
    last = S.versions(spark, folder)[-1]
    assert sorted(tuple(r) for r in spark.read.parquet(f"{folder}/n={last}").collect()) == [("a", "1"), ("b", "2"), ("c", "3")]
