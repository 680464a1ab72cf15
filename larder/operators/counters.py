"""Counters and latency histograms taken in flight: while rows are written, not by another pass over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Upper bounds of the latency buckets, in milliseconds.
BUCKETS = (1.0, 5.0, 10.0, 50.0, 100.0, 500.0, 1000.0, 5000.0)


def counters(layers: Sequence[str], layer: str = "layer", cached: str = "cached", latency: str = "latency_ms", saved: str = "saved", buckets: Sequence[float] = BUCKETS) -> dict[str, Column]:
    """Aggregates by name, for a known list of layers: hits and misses, cost saved, latencies up to each bound, their sum and number.

    A layer that isn't listed counts as `other`; what is null counts for no bound.
    """
    known = F.when(F.col(layer).isin(list(layers)), F.col(layer)).otherwise("other")
    found: dict[str, Column] = {}
    for name in (*layers, "other"):
        mine = F.coalesce(known == name, F.lit(False))
        found[f"hits_total {name}"] = F.count_if(mine & F.col(cached)).cast("double")
        found[f"misses_total {name}"] = F.count_if(mine & ~F.col(cached)).cast("double")
        found[f"cost_saved_total {name}"] = F.coalesce(F.sum(F.when(mine, F.col(saved))), F.lit(0.0)).cast("double")
        for bound in buckets:
            found[f"latency_bucket {name} {bound:g}"] = F.count_if(mine & (F.col(latency) <= bound)).cast("double")
        found[f"latency_sum {name}"] = F.coalesce(F.sum(F.when(mine, F.col(latency))), F.lit(0.0)).cast("double")
        found[f"latency_count {name}"] = F.count_if(mine & F.col(latency).isNotNull()).cast("double")
    return found


def observed(rows: DataFrame, aggregates: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """rows as they are, and the aggregates of what passes when they are first written or read to their end."""
    seen = Observation()
    return rows.observe(seen, *(c.alias(name) for name, c in aggregates.items())), seen


def series(spark: SparkSession, seen: Observation) -> DataFrame:
    """(metric, layer, bound, value) of an observation, one row for each aggregate; waits until it is there."""
    rows = []
    for name, value in seen.get.items():
        metric, layer, *bound = name.split(" ")
        rows.append((metric, layer, float(bound[0]) if bound else None, float(value)))
    return spark.createDataFrame(rows, "metric string, layer string, bound double, value double")
