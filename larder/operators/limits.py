"""Rate limits, a circuit breaker, token budgets and sessions."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fixed_window(requests: DataFrame, client: str, ts: str, seconds: int, most: int, order: str) -> DataFrame:
    """requests with allowed: the first `most` of each client's window of so many seconds."""
    bucket = F.floor(F.unix_micros(ts) / (seconds * 1_000_000))
    rows = requests.withColumn("bucket", bucket)
    n = F.row_number().over(Window.partitionBy(client, "bucket").orderBy(ts, order))
    return rows.withColumn("allowed", n <= most).drop("bucket")


def sliding_bound(requests: DataFrame, client: str, ts: str, seconds: int, most: int) -> DataFrame:
    """requests with recent, the requests of the client in (t - seconds, t], and over: an upper bound of what is refused."""
    at = F.unix_micros(ts)
    frame = Window.partitionBy(client).orderBy(at).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return requests.withColumn("recent", F.count("*").over(frame)).withColumn("over", F.col("recent") > most)


def _in_order(rows: DataFrame, client: str, ts: str, order: str, *more: str) -> DataFrame:
    """(client, order, at, ...): each client's rows in one task, in order of time."""
    return rows.select(client, F.col(order).cast("long").alias(order), F.unix_micros(ts).alias("at"), *more).repartition(client).sortWithinPartitions(client, "at", order)


def sliding_exact(requests: DataFrame, client: str, ts: str, order: str, seconds: int, most: int) -> DataFrame:
    """(client, order, allowed): refused requests don't count, so each depends on those before.

    A client is one stream and so one task's work, but it is streamed: only the last `most` allowed times are held.
    """
    width = seconds * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = object()
        recent: deque[int] = deque()
        for batch in batches:
            allowed = []
            for who, at in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if who != now:
                    now = who
                    recent.clear()
                while recent and recent[0] <= at - width:
                    recent.popleft()
                allowed.append(len(recent) < most)
                if allowed[-1]:
                    recent.append(at)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(allowed, pa.bool_())], [client, order, "allowed"])

    kind = requests.schema[client].dataType.simpleString()
    return _in_order(requests, client, ts, order).mapInArrow(run, f"{client} {kind}, {order} long, allowed boolean")


#: A breaker before its first call: state, failures in a row, when it opened, probes tried.
CLOSED = ("closed", 0, 0, 0)


def breaker_step(now: tuple[str, int, int, int], at: int, failed: bool, failures: int, micros: int, probes: int) -> tuple[tuple[str, int, int, int], str, bool]:
    """(next, state at the call, whether it is admitted) of one call to a breaker."""
    state, bad, opened, tried = now
    if state == "open" and at - opened >= micros:
        state, tried = "half_open", 0
    shown, admitted = state, state == "closed" or state == "half_open" and tried < probes
    if admitted:
        tried += state == "half_open"
        if not failed:
            state, bad = "closed", 0
        else:
            bad += 1
            if state == "half_open" or bad >= failures:
                state, opened = "open", at
    return (state, bad, opened, tried), shown, admitted


def breaker(calls: DataFrame, key: str, ts: str, order: str, failures: int = 5, seconds: int = 60, probes: int = 2) -> DataFrame:
    """(key, order, state, admitted): closed until so many failures in a row, open for a time, then half-open for some probes.

    A key is one stream and one task's work; four values are held for it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = object(), CLOSED
        for batch in batches:
            out = []
            for who, at, failed in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if who != now:
                    now, held = who, CLOSED
                held, shown, admitted = breaker_step(held, at, bool(failed), failures, seconds * 1_000_000, probes)
                out.append((shown, admitted))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s for s, _ in out], pa.string()), pa.array([a for _, a in out], pa.bool_())], [key, order, "state", "admitted"])

    kind = calls.schema[key].dataType.simpleString()
    return _in_order(calls, key, ts, order, "failed").mapInArrow(run, f"{key} {kind}, {order} long, state string, admitted boolean")


def within_budget(rows: DataFrame, by: list[str], order: list[Column], tokens: str, budget: int) -> DataFrame:
    """The ranked rows of each group up to the first that would exceed the budget: tokens are positive, so sums only grow."""
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(tokens).over(frame)).where(F.col("used") <= budget)


def session_id(messages: DataFrame, key: str, salt: str) -> DataFrame:
    """(key, session_id): 16 digits of the SHA-256 of the salt and all messages, in order of turn."""
    listed = messages.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("turn", F.concat("role", F.lit(":"), "text").alias("m")))).alias("l"))
    joined = F.concat(F.lit(salt + "|"), F.array_join(F.transform("l", lambda x: x["m"]), "|"))
    return listed.select(key, F.left(F.sha2(joined, 256), F.lit(16)).alias("session_id"))


