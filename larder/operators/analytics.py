"""Usage and cost analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.storage import spill

#: Prices per million tokens (input, output); the longest prefix counts, then `_default`.
PRICES = {
    "gpt-4.1": (2.00, 8.00), "gpt-4.1-mini": (0.40, 1.60), "gpt-4.1-nano": (0.10, 0.40), "gpt-4o": (2.50, 10.00), "gpt-4o-mini": (0.15, 0.60),
    "gpt-4-turbo": (10.00, 30.00), "gpt-4": (30.00, 60.00), "gpt-3.5-turbo": (0.50, 1.50), "o1": (15.00, 60.00), "o1-mini": (1.10, 4.40),
    "o1-pro": (150.00, 600.00), "o3": (10.00, 40.00), "o3-mini": (1.10, 4.40), "o4-mini": (1.10, 4.40),
    "claude-opus-4-6": (15.00, 75.00), "claude-sonnet-4-6": (3.00, 15.00), "claude-haiku-4-5": (0.80, 4.00), "claude-3.5-sonnet": (3.00, 15.00),
    "claude-3-opus": (15.00, 75.00), "claude-3-haiku": (0.25, 1.25),
    "gemini-2.5-pro": (1.25, 10.00), "gemini-2.5-flash": (0.15, 0.60), "gemini-2.0-flash": (0.10, 0.40), "gemini-1.5-pro": (1.25, 5.00), "gemini-1.5-flash": (0.075, 0.30),
    "llama-3.3-70b": (0.60, 0.60), "llama-3.1-405b": (3.00, 3.00), "llama-3.1-70b": (0.70, 0.80), "llama-3.1-8b": (0.10, 0.10), "llama3.2": (0.00, 0.00), "llama3": (0.00, 0.00),
    "deepseek-v3": (0.27, 1.10), "deepseek-r1": (0.55, 2.19), "mistral-large": (2.00, 6.00), "mistral-small": (0.20, 0.60), "mixtral-8x7b": (0.50, 0.50),
    "command-r-plus": (2.50, 10.00), "command-r": (0.15, 0.60), "qwen-2.5-72b": (0.60, 0.60), "qwen-2.5-7b": (0.10, 0.10), "_default": (0.50, 1.50),
}


def prices(spark, table: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    rows = [(k, *v) for k, v in (table or PRICES).items()]
    return spark.createDataFrame(rows, "prefix string, input_rate double, output_rate double")


def read_prices(spark, path: str) -> DataFrame:
    """A price file: a JSON object of models, each with `input` and `output` per million tokens; read anew by each query that asks."""
    rows = spark.read.option("wholetext", "true").text(path).select(F.explode(F.from_json("value", "map<string,struct<input:double,output:double>>")).alias("prefix", "p"))
    return rows.select("prefix", F.col("p.input").alias("input_rate"), F.col("p.output").alias("output_rate"))


def export_csv(daily: DataFrame, path: str, order: str) -> None:
    """Daily rows as CSV in order, and beside them the totals of all whole-number and double columns, as `summary`."""
    numbers = [f.name for f in daily.schema.fields if f.dataType.typeName() in ("long", "integer", "double")]
    daily.repartitionByRange(order).sortWithinPartitions(order).write.option("header", "true").csv(f"{path}/daily")
    daily.agg(*(F.sum(c).alias(c) for c in numbers)).write.option("header", "true").csv(f"{path}/summary")


def priced(usage: DataFrame, table: DataFrame) -> DataFrame:
    """usage(model, input_tokens, output_tokens, ...) with rates and cost: each distinct model is matched once, then joined."""
    models = usage.select("model").distinct()
    met = models.join(F.broadcast(table), F.col("model").startswith(F.col("prefix")) | (F.col("prefix") == "_default"))  # the price list: some dozens of rows
    best = Window.partitionBy("model").orderBy(F.col("prefix") == "_default", F.desc(F.length("prefix")))
    rates = met.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "prefix")
    micros = F.col("input_tokens") * F.col("input_rate") + F.col("output_tokens") * F.col("output_rate")
    cost = F.floor(micros + 0.5) / 1e6  # six decimals, halves up
    return usage.join(rates, "model").withColumn("cost", cost)


def ranked_values(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value, below, upto, n): of each distinct value of a group how many rows are below it, and below or equal; n of all.

    Values are counted first, then dealt into ranges and written. Ranks run within a range of a group and are raised by the counts
    of the ranges before, of which there are as many as partitions; so no group is one task's work.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_c"))
    ranged = spill(counted.repartitionByRange(by, value).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy(by, "_range").agg(F.sum("_c").alias("_sum"))
    order = Window.partitionBy(by).orderBy("_range")
    sums = sums.select(by, "_range", F.coalesce(F.sum("_sum").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_sum").over(Window.partitionBy(by)).alias("n"))
    within = F.sum("_c").over(Window.partitionBy(by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    found = ranged.withColumn("_within", within).join(sums, [by, "_range"])
    upto = F.col("_before") + F.col("_within")
    return found.select(by, value, (upto - F.col("_c")).alias("below"), upto.alias("upto"), "n")


def at_rank(rank: Column, value: str) -> Column:
    """The value of a group's ranked_values that holds a rank, from 0."""
    return F.max(F.when((F.col("below") <= rank) & (rank < F.col("upto")), F.col(value)))


def percentiles(rows: DataFrame, by: str, value: str, wanted: dict[str, float], nearest: bool = False) -> DataFrame:
    """(by, <name>...): each wanted share's percentile of a group, by linear interpolation; nearest: the value of rank int(n * p)."""
    parts = {}
    for name, p in wanted.items():
        exact = (F.col("n") - 1) * p
        parts[name] = [F.least(F.floor(F.col("n") * p), F.col("n") - 1)] if nearest else [F.floor(exact), F.ceil(exact)]
    ranked = ranked_values(rows, by, value)
    found = ranked.groupBy(by).agg(F.first("n").alias("n"), *(at_rank(r, value).alias(f"{name}_{i}") for name, ranks in parts.items() for i, r in enumerate(ranks)))
    share = lambda p: (F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p)
    of = lambda name, p: F.col(f"{name}_0") if nearest else F.col(f"{name}_0") + (F.col(f"{name}_1") - F.col(f"{name}_0")) * share(p)
    return found.select(by, *(of(name, p).alias(name) for name, p in wanted.items()))
