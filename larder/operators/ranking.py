"""What a capped store keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.storage import spill

#: Up to so many rows are kept by a top-k, which takes that many from each task; more are ranked by ranges.
TOP = 10_000


def keep_most_valuable(rows: DataFrame, most: int, *order: Column, top: int = TOP) -> DataFrame:
    """The first `most` rows by `order`, most valuable first; the order is total.

    Beyond `top` rows are dealt into ranges, sorted and written. Whole ranges stay or go by their counts, of which there are as
    many as partitions; rows are ranked only in the one range that the cut falls into.
    """
    if most <= top:
        return rows.orderBy(*order).limit(most)
    ranged = spill(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = F.broadcast(sizes.withColumn("_before", before).where(F.col("_before") < most))  # a row for each partition at most
    found = ranged.join(sizes, "_range")
    whole = found.where(F.col("_before") + F.col("_n") <= most)
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    cut = found.where(F.col("_before") + F.col("_n") > most).withColumn("_rank", rank).where(F.col("_before") + F.col("_rank") <= most)
    return whole.select(*rows.columns).unionByName(cut.select(*rows.columns))
