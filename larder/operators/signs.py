"""An exact cosine join of sparse vectors by the signs of their numbers.

Two unit vectors of a cosine over c are nearer than 2 - 2 * c by their squared distance. Where one of them has no number of the
other's sign, both numbers' squares count in full. So if a vector's smallest square is s, fewer than (2 - 2 * c) / s numbers of
both can stand at such places, unless the other's smallest is less (`most`). Vectors are dealt into tiers by this bound; in a tier,
places are dealt into one more band than numbers can differ, so that one band agrees in all signs. Each vector of a tier meets
those of its own and of lower tiers by bands and by how many numbers the other may have; what agrees is compared by two words of
bits, and what differs at few enough of them by all numbers. Vectors over all tiers are multiplied with all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.vectors import matrix
from larder.storage import spill

#: Of each tier how many numbers may differ at most, and how many a vector has at least that can't. What has fewer is multiplied with all others.
TIERS = [(0, 1), (1, 1), (2, 4), (3, 6), (5, 8), (8, 8)]
#: Vectors over all tiers, and the others, that one group of the product holds; it is split further up to the last number of groups.
WIDE, OTHERS, GROUPS = 16_384, 65_536, 16
#: A similarity that six decimals show as more than `near` is over it by more than this.
MARGIN = 1e-7
#: More than single precision may lack; what it finds is multiplied again.
ROUGH = 1e-3

FORM = "id long, unit binary, plus long, minus long, tier int, low int, high int"


def _signed(near: float):
    """Rows of FORM. unit: the numbers at length one; plus, minus: bits of the places above and below zero; low, high: numbers that can't differ, and all."""
    limit = 2 * (1 - near) - MARGIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                unit = matrix(part.column(1))
                if not unit.shape[1]:
                    continue
                bit = np.uint64(1) << (np.arange(unit.shape[1], dtype=np.uint64) % np.uint64(64))
                plus, minus = (np.bitwise_xor.reduce(np.where(x, bit, np.uint64(0)), axis=1).view(np.int64) for x in (unit > 0, unit < 0))
                squares = np.sort(np.where(unit != 0, unit * unit, np.inf), axis=1)
                m = (unit != 0).sum(axis=1)
                low = m - (np.cumsum(squares, axis=1) < limit).sum(axis=1)
                most = np.ceil(limit / squares[:, 0] - 1e-9) - 1
                tier = np.searchsorted([t for t, _ in TIERS], most)
                tier[low < np.array([n for _, n in TIERS] + [0])[tier]] = len(TIERS)
                rows = np.flatnonzero(m)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)), pa.array([x.tobytes() for x in unit[rows]], pa.binary()), pa.array(plus[rows]), pa.array(minus[rows]), *(pa.array(x[rows].astype(np.int32)) for x in (tier, low, m))],
                    ["id", "unit", "plus", "minus", "tier", "low", "high"],
                )

    return run


def signed(items: DataFrame, near: float) -> DataFrame:
    """items(id, vector) that have a direction, as rows of FORM, to be joined at a cosine over near. Written once."""
    return spill(items.select(F.col("id").cast("long"), F.col("vector").cast("array<double>")).where("vector is not null").mapInArrow(_signed(near), FORM))


def _bands(items: DataFrame) -> DataFrame:
    """(in_tier, band, mask, may, least, step): one row for each band, under thirty in all."""
    rows = []
    for tier, (may, least) in enumerate(TIERS):
        for band in range(may + 1):
            mask = sum(1 << i for i in range(band, 64, may + 1))
            rows.append((tier, len(rows), mask - (mask >> 63 << 64), may, least, 2 if 0 < may < 5 else 1))
    listed = F.array(*(F.struct(*(F.lit(x).cast("long" if i == 2 else "int").alias(c) for i, (x, c) in enumerate(zip(row, ("in_tier", "band", "mask", "may", "least", "step"), strict=True)))) for row in rows))
    return F.broadcast(items.sparkSession.range(1, numPartitions=1).select(F.inline(listed)))


def _keyed(rows: DataFrame, step, of_left, *more) -> DataFrame:
    key = F.xxhash64("band", F.col("plus").bitwiseAND(F.col("mask")), F.col("minus").bitwiseAND(F.col("mask")), step, of_left)
    return rows.select(key.alias("key"), "id", "plus", "minus", *more)


def _alike(rows: DataFrame, alone: bool) -> DataFrame:
    """(query_id, id) of rows(left, FORM) that may be near by their signs; of one table alone each pair once, the greater id first."""
    bands = _bands(rows)
    to = F.floor(F.col("high") / F.col("step")).cast("int")
    own = rows.join(bands, F.col("tier") == F.col("in_tier"))
    own = own.withColumn("to", F.explode(F.sequence(F.floor(F.col("low") / F.col("step")).cast("int"), F.floor((F.col("high") + F.col("may")) / F.col("step")).cast("int"))))
    own = _keyed(own, F.col("to"), F.lit(True) if alone else ~F.col("left"), "may", "left").alias("o")
    met = _keyed(rows.join(bands, (F.col("tier") <= F.col("in_tier")) & (F.col("high") >= F.col("least"))), to, F.lit(True) if alone else F.col("left"), (F.col("tier") < F.col("in_tier")).alias("lower")).alias("m")
    differ = F.bit_count(F.col("o.plus").bitwiseXOR(F.col("m.plus"))) + F.bit_count(F.col("o.minus").bitwiseXOR(F.col("m.minus")))
    once = F.col("m.lower") | (F.col("m.id") < F.col("o.id") if alone else F.col("o.left"))
    pairs = own.join(met, (F.col("o.key") == F.col("m.key")) & (differ <= F.col("o.may")) & (F.col("o.id") != F.col("m.id")) & once)
    first = F.col("o.id") > F.col("m.id") if alone else F.col("o.left")
    return pairs.select(F.when(first, F.col("o.id")).otherwise(F.col("m.id")).alias("query_id"), F.when(first, F.col("m.id")).otherwise(F.col("o.id")).alias("id")).distinct()


def _units(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows)).reshape(len(rows), -1)


def _dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 2048):
            part = batch.slice(at, 2048)
            dots = np.einsum("ij,ij->i", _units(part.column(2)), _units(part.column(3)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(dots)], ["query_id", "id", "similarity"])


def _product(near: float):
    def run(group: pa.Table) -> pa.Table:
        found, (wide, others) = [], (group.filter(x) for x in (group["wide"], pa.compute.invert(group["wide"])))
        if len(wide) and len(others):
            wide, others = wide.combine_chunks().sort_by([("high", "ascending"), ("low", "ascending")]), others.combine_chunks()
            a, b = (x.column("id").to_numpy() for x in (wide, others))
            units, low, high = _units(others.column("unit")), others.column("low").to_numpy(), others.column("high").to_numpy()
            wide_low, wide_high = wide.column("low").to_numpy(), wide.column("high").to_numpy()
            asked = _units(wide.column("unit"))
            rough = asked.astype(np.float32), units.astype(np.float32)
            for i in range(0, len(a), 256):
                fits = np.flatnonzero((high >= wide_low[i : i + 256].min()) & (low <= wide_high[i : i + 256].max()))
                for j in range(0, len(fits), 4096):
                    c = fits[j : j + 4096]
                    q, k = np.nonzero(rough[0][i : i + 256] @ rough[1][c].T >= near - ROUGH)
                    dots = np.einsum("ij,ij->i", asked[i + q], units[c[k]])
                    found.append((a[i + q], b[c[k]], dots))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [[], [], []]
        table = pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "id", "similarity"])
        return table.filter(pa.compute.not_equal(table["query_id"], table["id"]))

    return run


def _with_all(wide: DataFrame, others: DataFrame, near: float) -> DataFrame | None:
    """(query_id, id, similarity) of wide vectors and all others, in groups of a bounded number of both; None where one has no rows. Runs jobs."""
    n, m = wide.count(), others.count()
    if not n or not m:
        return None
    across, along = -(-n // WIDE), max(-(-m // OTHERS), min(GROUPS, -(-m // 4096)))

    def dealt(rows: DataFrame, parts: int, times: int, first: bool) -> DataFrame:
        own, each = F.pmod(F.xxhash64("id"), F.lit(parts)), F.explode(F.sequence(F.lit(0), F.lit(times - 1)))
        rows = rows.select("id", "unit", "low", "high", own.alias("own"), each.alias("each"))
        return rows.select("id", "unit", "low", "high", F.lit(first).alias("wide"), (F.col("own") * along + F.col("each") if first else F.col("each") * along + F.col("own")).cast("int").alias("part"))

    both = dealt(wide, across, along, True).unionByName(dealt(others, along, across, False))
    return both.groupBy("part").applyInArrow(_product(near), "query_id long, id long, similarity double")


def near_pairs(left: DataFrame, right: DataFrame | None, near: float) -> DataFrame:
    """(query_id, id, similarity) of the rows that signed() gave for `near`, once each: those of left and right, or those of left alone of which id is less than query_id. Runs jobs."""
    wide, alone = len(TIERS), right is None
    rows = left.withColumn("left", F.lit(True))
    if not alone:
        rows = rows.unionByName(right.withColumn("left", F.lit(False)))
    pairs = _alike(rows.where(f"tier < {wide}").drop("unit"), alone)
    sides = left.select(F.col("id").alias("query_id"), F.col("unit").alias("asked")), (left if alone else right).select("id", "unit")
    found = pairs.join(sides[0], "query_id").join(sides[1], "id").select("query_id", "id", "asked", "unit").mapInArrow(_dots, "query_id long, id long, similarity double")
    more = _with_all(left.where(f"tier = {wide}"), left if alone else right, near)
    if alone and more is not None:
        more = more.select(F.greatest("query_id", "id").alias("query_id"), F.least("query_id", "id").alias("id"), "similarity").dropDuplicates(["query_id", "id"])
    swapped = None if alone else _with_all(right.where(f"tier = {wide}"), left.where(f"tier < {wide}"), near)
    if swapped is not None:
        swapped = swapped.select(F.col("id").alias("query_id"), F.col("query_id").alias("id"), "similarity")
    for x in (more, swapped):
        found = found if x is None else found.unionByName(x)
    return found.withColumn("similarity", F.round("similarity", 6)).where(F.col("similarity") > near)


def similar(left: DataFrame, right: DataFrame, near: float) -> DataFrame:
    """(query_id, id, similarity): all pairs of left(query_id, vector) and right(id, vector) of a cosine over near, rounded to six decimals, once each. Equal ids are no pair. Runs jobs."""
    return near_pairs(signed(left.select(F.col("query_id").alias("id"), "vector"), near), signed(right, near), near)
