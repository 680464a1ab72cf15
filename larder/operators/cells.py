"""Vectors in cells around centroids: a stored index that is read by cell, and an exact similarity join of two large sides.

Vectors of a cell lie in blocks, one row each, so that a cell may be of any size; blocks of two sides that share a cell meet
by an equi-join and are multiplied as matrices. Only centroids pass through the driver, `cells` times the vectors' width.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.functions.vectors import matrix
from larder.storage import fresh, spill

#: Vectors in a block.
BLOCK = 1024
#: Angles are compared with this much to spare.
SLACK = 1e-7


def _unit(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return matrix(column) if len(column) else np.empty((0, 0))


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in batches if len(b))


def _angles(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ centre.T, -1, 1))


def centroids(items: DataFrame, cells: int = 16, rounds: int = 10) -> np.ndarray:
    """Unit centroids by spherical k-means over all of items(id, vector).

    The first are the vectors of least hash. In a round each batch is dealt to its nearest centroids and leaves one sum for
    each; these are added up by dimension. A centroid without members stays. Vectors without direction count for none.
    """
    rows = items.where("vector is not null").select("id", F.col("vector").cast("array<double>").alias("vector"))
    centre = _unit(rows.orderBy(F.xxhash64("id"), "id").limit(cells).select("vector").toArrow().column("vector"))
    for _ in range(rounds if len(centre) == cells else 0):

        def sums(batches: Iterator[pa.RecordBatch], centre=centre) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros_like(centre), np.zeros(len(centre), dtype=bool)
            for batch in _full(batches):
                unit = _unit(batch.column(0))
                unit = unit[(unit != 0).any(axis=1)]
                near = (unit @ centre.T).argmax(axis=1)
                np.add.at(total, near, unit)
                n[near] = True
            found = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(list(total[found]), pa.list_(pa.float64()))], ["cell", "total"])

        parts = rows.select("vector").mapInArrow(sums, "cell long, total array<double>").select("cell", F.posexplode("total").alias("at", "x"))
        table = parts.groupBy("cell", "at").agg(F.sum("x").alias("x")).toArrow()  # cells times width
        moved = np.zeros_like(centre)
        moved[table.column("cell").to_numpy(), table.column("at").to_numpy()] = table.column("x").to_numpy()
        length = np.linalg.norm(moved, axis=1, keepdims=True)
        centre = np.where(length > 1e-10, moved / np.maximum(length, 1e-10), centre)
    return centre


def assigned(items: DataFrame, centre: np.ndarray) -> DataFrame:
    """items(id, vector) with cell, the nearest centroid, and angle, the distance from it; vectors without direction are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _full(batches):
            unit = _unit(batch.column(1))
            good = np.flatnonzero((unit != 0).any(axis=1))
            angles = _angles(unit[good], centre)
            cell = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(good)), pa.array(list(unit[good]), pa.list_(pa.float64())), pa.array(cell, pa.int64()), pa.array(angles[np.arange(len(good)), cell], pa.float64())], ["id", "vector", "cell", "angle"]
            )

    rows = items.where("vector is not null").select("id", "vector")
    return (rows if len(centre) else rows.limit(0)).mapInArrow(run, "id long, vector array<double>, cell long, angle double")


def _blocks(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """(cell, ids, vectors) of rows(id, vector, cell): as many rows for each cell as it has blocks."""
    counts = rows.groupBy("cell").agg(F.ceil(F.count("*") / size).alias("blocks"))
    placed = rows.join(F.broadcast(counts), "cell")  # one row for each cell
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    pair = F.struct("id", "vector")
    listed = placed.groupBy("cell", "block").agg(F.sort_array(F.collect_list(pair)).alias("rows"))
    return listed.select("cell", F.col("rows.id").alias("ids"), F.col("rows.vector").alias("vectors"))


def _multiplied(met: DataFrame, threshold: float, k: int | None) -> DataFrame:
    """(query_id, id, similarity) of met(asked, wanted, ids, vectors): of each two blocks the pairs over a threshold, a query's k best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                asked, wanted, ids, vectors = (batch.column(c)[i].values for c in range(4))
                near = _unit(wanted) @ _unit(vectors).T
                asked, ids = asked.to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False)
                keep = (near >= threshold) & (asked[:, None] != ids[None, :])
                if k is not None and len(ids) > k:
                    kept = np.where(keep, near, -np.inf)
                    keep &= near >= np.partition(kept, len(ids) - k, axis=1)[:, len(ids) - k, None]
                q, c = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(asked[q], pa.int64()), pa.array(ids[c], pa.int64()), pa.array(near[q, c], pa.float64())], ["query_id", "id", "similarity"])

    found = met.select("asked", "wanted", "ids", "vectors").mapInArrow(run, "query_id long, id long, similarity double")
    return found.withColumn("similarity", F.round("similarity", 6))


def _pairs(queries: DataFrame, stored: DataFrame, threshold: float, k: int | None) -> DataFrame:
    """queries(id, vector, cell), which may be in several cells, against the blocks of stored(cell, ids, vectors)."""
    asked = _blocks(queries).withColumnsRenamed({"ids": "asked", "vectors": "wanted"})
    return _multiplied(asked.join(stored, "cell"), threshold, k)


class Index(NamedTuple):
    folder: str
    centre: np.ndarray
    #: Rows at the last build, and now.
    built: int
    rows: int


def build(items: DataFrame, cells: int = 16, rounds: int = 10, folder: str | None = None) -> Index:
    """The index of items(id, vector), written to a folder by cell. Runs jobs."""
    folder = folder or fresh(items.sparkSession, "cells")
    centre = centroids(items, cells, rounds)
    rows = _write(items, centre, f"{folder}/blocks", "overwrite")
    return _state(items.sparkSession, Index(folder, centre, rows, rows))


def _write(items: DataFrame, centre: np.ndarray, path: str, mode: str) -> int:
    """Ranges of cells are written, so that a large cell has several files and small ones share a task."""
    blocks = spill(_blocks(spill(assigned(items, centre))))
    blocks.repartitionByRange("cell", F.xxhash64("ids")).write.mode(mode).partitionBy("cell").parquet(path)
    return blocks.agg(F.sum(F.size("ids"))).first()[0] or 0


def _state(spark: SparkSession, index: Index) -> Index:
    rows = [(i, v.tolist(), index.built, index.rows) for i, v in enumerate(index.centre)]
    spark.createDataFrame(rows, "cell long, vector array<double>, built long, rows long").coalesce(1).write.mode("overwrite").parquet(f"{index.folder}/centroids")
    return index


def load(spark: SparkSession, folder: str) -> Index:
    """A written index; only its centroids are read."""
    rows = spark.read.parquet(f"{folder}/centroids").orderBy("cell").collect()
    return Index(folder, np.array([r["vector"] for r in rows]), *((rows[0]["built"], rows[0]["rows"]) if rows else (0, 0)))


def stored(spark: SparkSession, index: Index, cells: list[int] | None = None) -> DataFrame:
    """The blocks of some cells, or of all: only these cells' files are read."""
    blocks = spark.read.schema("ids array<bigint>, vectors array<array<double>>, cell bigint").parquet(f"{index.folder}/blocks")
    return blocks if cells is None else blocks.where(F.col("cell").isin(cells))


def add(index: Index, new: DataFrame) -> Index:
    """The index with new(id, vector), whose ids it doesn't have, dealt to the cells there are; built anew where it has doubled since it was.

    A rebuild reads the old blocks and writes another folder, so that readers of the old one are not disturbed. Runs jobs.
    """
    spark = new.sparkSession
    if not len(index.centre):
        return build(new, folder=index.folder)
    fresh_rows = new.where("vector is not null").count()
    if index.rows + fresh_rows >= 2 * index.built:
        old = stored(spark, index).select(F.explode(F.arrays_zip("ids", "vectors")).alias("r")).select(F.col("r.ids").alias("id"), F.col("r.vectors").alias("vector"))
        return build(old.unionByName(new.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))), len(index.centre))
    more = _write(new, index.centre, f"{index.folder}/blocks", "append")
    return _state(spark, index._replace(rows=index.rows + more))


def probed(queries: DataFrame, centre: np.ndarray, probes: int) -> DataFrame:
    """(id, vector, cell): each of queries(query_id, vector) once for each of its nearest cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _full(batches):
            unit = _unit(batch.column(1))
            near = np.argsort(-(unit @ centre.T), axis=1, kind="stable")[:, :probes]
            row = np.repeat(np.arange(len(unit)), near.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(list(unit[row]), pa.list_(pa.float64())), pa.array(near.ravel(), pa.int64())], ["id", "vector", "cell"])

    return queries.where("vector is not null").select("query_id", "vector").mapInArrow(run, "id long, vector array<double>, cell long")


def search(index: Index, queries: DataFrame, probes: int = 3, k: int = 10) -> DataFrame:
    """(query_id, id, similarity, rank): the k nearest of the cells that each of queries(query_id, vector) is nearest to.

    The cells that any query probes are collected, at most as many as there are, and only their files are read. An item isn't
    its own neighbour; ties go to the smaller id. Queries without a vector find nothing. Runs jobs while it is built.
    """
    spark = queries.sparkSession
    if not len(index.centre):
        return spark.createDataFrame([], "query_id long, id long, similarity double, rank int")
    asked = spill(probed(queries, index.centre, probes))
    cells = [r["cell"] for r in asked.select("cell").distinct().collect()]
    found = _pairs(asked, stored(spark, index, cells), -1.0, k)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def similar(left: DataFrame, right: DataFrame, threshold: float, cells: int = 64, rounds: int = 3) -> DataFrame:
    """(query_id, id, similarity): all pairs of left(query_id, vector) and right(id, vector) of a cosine of at least threshold.

    Exact, for a positive threshold. Left vectors lie in the cell they are nearest to. With t the angle of the threshold, a
    right vector can be near one of them only if it is within t of the cell's radius, and its angle to that centroid is at
    most 2t larger than to its own, by the triangle inequality; it goes to the cells for which both hold. The higher the
    threshold, the fewer they are. Equal ids of the two sides are no pair. Vectors without direction match nothing. Nothing
    but centroids and radii, one for each cell, passes through the driver. Runs jobs while it is built.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be positive")
    centre = centroids(left.select(F.col("query_id").alias("id"), "vector"), cells, rounds)
    if not len(centre):
        return left.sparkSession.createDataFrame([], "query_id long, id long, similarity double")
    mine = spill(assigned(left.select(F.col("query_id").alias("id"), "vector"), centre))
    radius = np.full(len(centre), -np.inf)
    for r in mine.groupBy("cell").agg(F.max("angle").alias("radius")).collect():  # one row for each cell
        radius[r["cell"]] = r["radius"]
    turn = math.acos(min(1.0, threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _full(batches):
            unit = _unit(batch.column(1))
            angles = _angles(unit, centre)
            reached = (angles <= radius + turn + SLACK) & (unit != 0).any(axis=1, keepdims=True)
            reached &= angles <= angles.min(axis=1, keepdims=True) + 2 * turn + SLACK
            row, cell = np.nonzero(reached)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(list(unit[row]), pa.list_(pa.float64())), pa.array(cell, pa.int64())], ["id", "vector", "cell"])

    theirs = right.where("vector is not null").select("id", "vector").mapInArrow(run, "id long, vector array<double>, cell long")
    return _pairs(mine.select("id", "vector", "cell"), _blocks(spill(theirs)), threshold, None)
