"""Vectors: exact cosine expressions and blocked top-k search. The stored index is in operators/cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.operators.ranking import keep_most_valuable


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector isn't finite or its norm is under 1e-10."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.try_divide(dot(a, b), norms)
    good = (F.sqrt(dot(a, a)) >= 1e-10) & (F.sqrt(dot(b, b)) >= 1e-10)
    return F.when(good & value.isNotNull() & ~F.isnan(value) & (F.abs(value) <= 2), value).otherwise(F.lit(0.0))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column, scaled to unit length; rows that aren't finite or have no length are zero."""
    flat, sizes = column.flatten(), pa.compute.list_value_length(column)
    if len(column) and not column.null_count and not flat.null_count and pa.compute.min_max(sizes)["min"] == pa.compute.min_max(sizes)["max"]:
        rows = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)  # no object for each number
    else:
        rows = np.array(column.to_pylist(), dtype=np.float64).reshape(len(column), -1)
    bad = ~np.isfinite(rows).all(axis=1)
    rows[bad] = 0
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.where(norms >= 1e-10, rows / np.maximum(norms, 1e-10), 0.0)


def blocks(queries: DataFrame, size: int, *more: str) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, unit vectors, ...) of queries(query_id, vector, ...), `size` at a time through the driver."""
    held: list = []
    for row in queries.select("query_id", "vector", *(F.col(c).cast("long") for c in more)).toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield _block(held)
            held = []
    if held:
        yield _block(held)


def _block(rows: list) -> tuple[np.ndarray, ...]:
    ids, vectors, *more = zip(*rows, strict=True)
    return np.array(ids), matrix(pa.array(vectors)), *(np.array(x) for x in more)


def _block_search(ids: np.ndarray, unit: np.ndarray, scopes: np.ndarray | None, k: int | None, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            own = None if scopes is None else batch.column(2).to_numpy(zero_copy_only=False)
            for at in range(0, len(keys), 2048):
                part = keys[at : at + 2048]
                near = unit @ matrix(batch.column(1).slice(at, 2048)).T
                keep = near >= threshold
                keep &= ids[:, None] != part[None, :]
                if own is not None:
                    keep &= scopes[:, None] == own[None, at : at + 2048]
                if k is not None and len(part) > k:
                    bar = np.partition(np.where(keep, near, -np.inf), len(part) - k, axis=1)[:, len(part) - k]
                    keep &= near >= bar[:, None]
                q, c = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(part[c]), pa.array(near[q, c])], ["query_id", "id", "similarity"])

    return run


def search(queries: DataFrame, items: DataFrame, k: int | None = None, threshold: float = -1.0, block: int = 4096, scope: str | None = None) -> DataFrame:
    """(query_id, id, similarity): items(id, vector) with cosine of at least threshold to queries(query_id, vector), the k nearest.

    Blocks of queries are broadcast and multiplied with each batch of items; only a batch's k best for a query leave
    a task. An item isn't its own neighbour. With `scope`, a whole-number column of both, only equal ones meet, before the
    k nearest are taken. Similarity is rounded to six decimals; ties go to the smaller id.
    """
    found = items.sparkSession.createDataFrame([], "query_id long, id long, similarity double")
    extra = [scope] if scope else []
    for ids, unit, *scopes in blocks(queries, block, *extra):
        rows = items.select("id", "vector", *(F.col(c).cast("long") for c in extra))
        found = found.unionByName(rows.mapInArrow(_block_search(ids, unit, scopes[0] if scopes else None, k, threshold), found.schema))
    found = found.withColumn("similarity", F.round("similarity", 6))
    if k is None:
        return found
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _section_block(ids: np.ndarray, unit: np.ndarray, k: int, within: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                listed, keys = part.column(1), part.column(0).to_numpy(zero_copy_only=False)
                sizes = pa.compute.list_value_length(listed).to_numpy(zero_copy_only=False)
                near = np.round(np.maximum.reduceat(unit @ matrix(listed.flatten()).T, np.append(0, np.cumsum(sizes)[:-1]), axis=1), 6)
                keep = near >= (np.partition(near, len(keys) - k, axis=1)[:, len(keys) - k, None] - within if len(keys) > k else -np.inf)
                q, c = np.nonzero(keep)
                # Of one similarity the k smallest ids are enough, as ties go to these.
                order = np.lexsort((keys[c], near[q, c], q))
                q, c = q[order], c[order]
                fresh = np.append(True, (q[1:] != q[:-1]) | (near[q[1:], c[1:]] != near[q[:-1], c[:-1]]))[: len(q)]
                first = np.arange(len(q)) - np.maximum.accumulate(np.where(fresh, np.arange(len(q)), 0)) < k
                q, c = q[first], c[first]
                yield pa.RecordBatch.from_arrays([*map(pa.array, (ids[q], keys[c], near[q, c], near.min(axis=1)[q], near.max(axis=1)[q]))], ["query_id", "id", "similarity", "low", "high"])

    return run


def near_sections(queries: DataFrame, sections: DataFrame, k: int, within: float = 0.0, block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Sections(id, vectors) that may be among the k nearest to each of queries(query_id, vector), by a section's nearest vector:
    (query_id, id, similarity); and (query_id, low, high), the least and the greatest similarity of any section.

    None is left out that is up to `within` less similar than the k-th, but of one similarity only those of the k smallest ids
    are sure to be there. One pass over sections for each block of queries; a batch's own nearest leave a task.
    """
    found = sections.sparkSession.createDataFrame([], "query_id long, id long, similarity double, low double, high double")
    for ids, unit in blocks(queries, block):
        found = found.unionByName(sections.where(F.size("vectors") > 0).select("id", "vectors").mapInArrow(_section_block(ids, unit, k, within), found.schema))
    extremes = found.groupBy("query_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return found.select("query_id", "id", "similarity"), extremes


def section_search(queries: DataFrame, sections: DataFrame, k: int, block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """The k nearest of near_sections, (query_id, id, similarity, rank), and the extremes."""
    found, extremes = near_sections(queries, sections, k, block=block)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), extremes


def upsert(items: DataFrame, new: DataFrame, most: int = 50_000, order: str = "added") -> DataFrame:
    """items(id, vector, ...) with those of new in their place; over `most` the oldest by `order` go.

    New rows whose vectors have another length than the store's are left out; of new rows of one id the last by `order` counts.
    """
    last = new.groupBy("id").agg(F.max_by(F.struct(*[c for c in new.columns if c != "id"]), order).alias("r")).select("id", "r.*")
    width = items.agg(F.max(F.size("vector")).alias("width"))
    fits = last.crossJoin(F.broadcast(width)).where(F.col("width").isNull() | (F.size("vector") == F.col("width"))).drop("width")  # one row
    rows = items.join(fits.select("id"), "id", "left_anti").unionByName(fits.select(*items.columns))
    return keep_most_valuable(rows, most, F.desc(order), F.desc("id"))


def remove(items: DataFrame, ids: DataFrame) -> DataFrame:
    """items without those of ids(id)."""
    return items.join(ids.select("id"), "id", "left_anti")


def hashed_embedding(text: Column, width: int = 64) -> Column:
    """A unit vector of signed counts of hashed words: a stand-in where no embedder is given, the same everywhere."""
    slots = F.transform(F.split(F.lower(text), r"(?U)[^\w]+"), lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(width)).alias("at"), F.when(F.pmod(F.xxhash64(w, F.lit("sign")), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("by"), (w != "").alias("real")))
    # Bound to a variable, so that words are hashed once for a text and not once for each place.
    bound = F.transform(F.array(F.filter(slots, lambda s: s["real"])), lambda real: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.aggregate(F.filter(real, lambda s: s["at"] == i), F.lit(0.0), lambda a, s: a + s["by"])))
    raw = bound[0]
    scaled = F.transform(F.array(raw), lambda r: F.transform(F.array(F.sqrt(dot(r, r))), lambda n: F.transform(r, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))[0])
    return scaled[0]
