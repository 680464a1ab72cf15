"""SimHash near-duplicates by a generalised pigeonhole over unequal bit partitions.

Fingerprints that are equal are one node. The 64 bits are dealt into m groups, correlated bits together, and group i
gets a threshold t_i with sum(t_i) >= k - m + 1: two fingerprints that differ in at most k bits then differ in at most
t_i bits of some group i. A group with threshold 0 is probed by its own bits; one with threshold 2 by those and by every
single flip of them, from both sides, which meets at every pair that differs in two bits or fewer; threshold 4 by two
flips. Dynamic programming picks m and the thresholds of least estimated cost (probe rows and expected candidates, from
statistics of all fingerprints). All pairs of a bucket are verified on the whole fingerprint.

For links of more bits, which need more shared points than there is room for, hot fingerprints are compared in blocks.
Buckets are streamed in key order. One of over BUCKET fingerprints isn't compared pair by pair: its fingerprints
are dealt out by all points within k/2 flips of the whole fingerprint. Two fingerprints are within k bits if
and only if they share such a point, and any that share one are linked, so each is linked to the least one there: as
many rows for each fingerprint however large the bucket, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .scratch import cleared, spill
from .words import LOWER_ASCII, portions, texts

#: Above so many fingerprints a bucket goes the way of shared points: about where comparing all costs as much.
BUCKET = 8192
#: The plan of probes is made for at least so many fingerprints, so that small inputs are probed like large ones.
PLANNED = 1 << 20
#: What a probe row costs, in comparisons of two fingerprints.
ROW_COST = 8


def shingles(words: list[bytes], width: int) -> list[bytes]:
    """All shingles of so many words, repeats included; all the words if there are fewer; none if there are none."""
    if len(words) > width:
        return [b" ".join(x) for x in zip(*(words[i:] for i in range(width)), strict=False)]
    return [b" ".join(words)] if words else []


def hashes(found: list[bytes], seed: int = 42) -> np.ndarray:
    """The XXH64 of each shingle."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(x, seed) for x in found], dtype=np.uint64)


def majority(values: np.ndarray) -> int:
    """A bit is set if it is set in over half of the values; none: zero."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(values), 65536):
        part = values[i : i + 65536]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(len(part), 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values)).view(">u8")[0])


def fingerprint_of(words: list[bytes], width: int, seed: int = 42) -> int:
    """The majority of all shingles' XXH64; no words: zero."""
    return majority(hashes(shingles(words, width), seed))


def fingerprints(docs: DataFrame, width: int = 4, text: str = "text", key: str = "doc_id", seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """(key, fp[, fp2]) of every row: fingerprints as signed longs, one for each seed. A null or empty text has zero."""
    names = ["fp", "fp2"][: len(seeds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text", 8 << 20):
            split = [t.translate(LOWER_ASCII).split() for t in texts(batch.column("text"))]
            found = [np.array([fingerprint_of(w, width, seed) for w in split], dtype=np.uint64).view(np.int64) for seed in seeds]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *map(pa.array, found)], ["key", *names])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, " + ", ".join(f"{n} long" for n in names)).withColumnRenamed("key", key)


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many rows of fps(fp) there are, and how often each two bits are set together. The driver gets 4097 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((64, 64)), 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(values), 8192):
                bits = np.unpackbits(values[i : i + 8192].astype(">i8").view(np.uint8)).reshape(-1, 64).astype(np.float32)
                both += bits.T @ bits
                n += len(bits)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097, dtype=np.int32)), pa.array(np.append(both.ravel(), n).astype(np.int64))], ["i", "x"])

    out = np.zeros(4097)
    for row in fps.select("fp").mapInArrow(run, "i int, x long").groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[row["i"]] = row["x"]
    return int(out[4096]), out[:4096].reshape(64, 64)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Deals the bits (0: the highest) into m groups of nearly equal size, correlated bits together."""
    share = both.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    linked = np.abs(both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    left, groups = list(range(64)), []
    for i in range(m):
        size = len(left) // (m - i)
        group = [max(left, key=lambda b: (linked[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (linked[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def probe_plan(n: int, both: np.ndarray, k: int) -> list[tuple[list[int], int]]:
    """[(bits of the group, flips in a probe)] of least estimated cost, such that sum(2 * flips) >= k - m + 1."""
    planned = max(n, PLANNED)
    share = both.diagonal() / max(n, 1)
    same = share**2 + (1 - share) ** 2 if n else np.full(64, 0.5)
    best: tuple[float, list] = (float("inf"), [])
    for m in range(1, k + 2):
        groups, need = group_bits(n, both, m), k - m + 1
        options = []
        for bits in groups:
            near = np.zeros(5)  # chance that two fingerprints differ in 0..4 bits of the group
            near[0] = 1
            for b in bits:
                near = near * same[b] + np.append(0, near[:-1]) * (1 - same[b])
            costs = []
            for flips in (0, 1, 2):
                rows = sum(len(list(combinations(range(len(bits)), f))) for f in range(flips + 1))
                meetings = [1, len(bits) + 1, 0][flips] * near[0] + (2 * near[1] + 2 * near[2] if flips else 0)
                if flips == 2:
                    meetings += rows * near[0] + len(bits) * (near[1] + near[2]) + 6 * (near[3] + near[4])
                costs.append(ROW_COST * rows * planned + meetings * planned * planned / 2)
            options.append(costs)
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # threshold so far -> cost, flips
        for costs in options:
            grown: dict[int, tuple[float, list[int]]] = {}
            for t, (cost, flips) in table.items():
                for f, extra in enumerate(costs):
                    to = min(need, t + 2 * f)
                    if to not in grown or cost + extra < grown[to][0]:
                        grown[to] = (cost + extra, [*flips, f])
            table = grown
        if need in table and table[need][0] < best[0]:
            best = (table[need][0], list(zip(groups, table[need][1], strict=True)))
    return best[1]


def probes(fps: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, ...): every row of fps(fp, ...) under each key by which its group may be met."""
    signed = lambda x: F.lit(x - (1 << 64) if x >> 63 else x).cast("long")

    def keys_of(part: int, bits: list[int], flips: int):
        values = [1 << (63 - b) for b in bits]
        own = F.col("fp").bitwiseAND(signed(sum(values)))
        flipped = F.array(*(signed(sum(x)) for f in range(flips + 1) for x in combinations(values, f)))
        return F.transform(flipped, lambda x: F.struct(F.lit(part).alias("part"), own.bitwiseXOR(x).alias("key")))

    keys = F.flatten(F.array(*(keys_of(i, *group) for i, group in enumerate(plan))))
    return fps.select(*fps.columns, F.explode(keys).alias("k")).select("k.part", "k.key", *fps.columns)


#: Buckets of so few rows are compared pair by pair at once.
SMALL = 16


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64))  # of a signed number it would count the absolute value


def _near(x: np.ndarray, y: np.ndarray, k: int, wide: int | None) -> np.ndarray:
    """Whether rows of fingerprints differ in k or fewer bits of the first and, if it is given, in `wide` or fewer of both."""
    first = _distance(x[..., 0], y[..., 0])
    return first <= k if wide is None else (first <= k) & (first + _distance(x[..., 1], y[..., 1]) <= wide)


def _forest(values: np.ndarray, k: int, wide: int | None) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among values: each is compared with those that no tree has reached yet."""
    left = np.unique(values, axis=0)
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = _near(left, x, k, wide)
            if near.any():
                yield from ((int(x[0]), int(y)) for y in left[near, 0])
                queue.extend(left[near])
                left = left[~near]


def bucket_links(rows: DataFrame, k: int, bucket: int, wide: int | None = None) -> DataFrame:
    """(a, b, hot): links among the fingerprints of each bucket of rows(part, key, fp[, fp2]), sorted by these within tasks.

    hot: the bucket holds over `bucket` rows, and a = b is one of them. A task streams its rows by key; it holds one
    batch and one bucket of at most so many fingerprints.
    """

    def table(a, b, hot):
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, dtype=np.int64)), pa.array(np.asarray(b, dtype=np.int64)), pa.array(np.full(len(a), hot))], ["a", "b", "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now, size = None, 0

        def linked(values: np.ndarray):
            if found := list(_forest(values, k, wide)):
                yield table([x for x, _ in found], [y for _, y in found], False)

        for batch in batches:
            if not len(batch):
                continue
            part, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            fp = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, batch.num_columns)], axis=1)
            cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(key) != 0)) + 1
            starts, ends = np.append(0, cuts), np.append(cuts, len(fp))
            sizes = ends - starts
            small = sizes <= SMALL
            small[[0, -1]] = False  # these may begin before this batch, or go on after it
            group = np.repeat(np.arange(len(sizes)), sizes)
            open_rows = np.flatnonzero(np.repeat(small & (sizes > 1), sizes))
            for step in range(1, SMALL):
                open_rows = open_rows[open_rows + step < len(fp)]
                open_rows = open_rows[group[open_rows] == group[open_rows + step]]
                if not len(open_rows):
                    break
                near = open_rows[_near(fp[open_rows], fp[open_rows + step], k, wide)]
                if len(near):
                    yield table(fp[near, 0], fp[near + step, 0], False)
            for i in np.flatnonzero(~small)[1:-1]:
                values = fp[starts[i] : ends[i]]
                yield from [table(values[:, 0], values[:, 0], True)] if len(values) > bucket else linked(values)
            for i in dict.fromkeys((0, len(sizes) - 1)):
                s, e = starts[i], ends[i]
                if (part[s], key[s]) != now:
                    if held and size <= bucket:
                        yield from linked(np.concatenate(held))
                    now, held, size = (part[s], key[s]), [], 0
                size += e - s
                held.append(fp[s:e])
                if size > bucket:
                    for x in held:
                        yield table(x[:, 0], x[:, 0], True)
                    held = []
        if held and size <= bucket:
            yield from linked(np.concatenate(held))

    return rows.mapInArrow(run, "a long, b long, hot boolean")


def in_blocks(fps: DataFrame, k: int, wide: int | None, bucket: int) -> DataFrame:
    """(a, b): links among all of fps(fp[, fp2]), compared in pairs of blocks, each pair of a size that fits a task."""
    blocks = max(1, -(-3 * fps.count() // bucket))
    own = F.pmod(F.xxhash64("fp"), F.lit(blocks)).cast("int")
    rows = fps.select("*", own.alias("i"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("j"))
    rows = rows.select(F.least("i", "j").alias("part"), F.greatest("i", "j").cast("long").alias("key"), *fps.columns)
    return bucket_links(rows.repartition("part", "key").sortWithinPartitions("part", "key"), k, 1 << 62, wide).select("a", "b")


def shared_points(fps: DataFrame, k: int) -> DataFrame:
    """(a, b) that link fps(fp) at k or fewer differing bits, k even, by their points within k/2 flips of both."""
    values = [1 << b for b in range(64)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    one = [signed(x) for x in [0, *values]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.unique(np.array([int(np.bitwise_xor.reduce(np.array(x, dtype=np.int64))) for x in combinations([*one, *[0] * (k // 2)], k // 2)], dtype=np.int64))
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fp), 64):
                part = fp[i : i + 64]
                yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ flips).ravel()), pa.array(np.repeat(part, len(flips)))], ["point", "fp"])

    rows = fps.select("fp").mapInArrow(run, "point long, fp long")
    least = spill(rows.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("point", "a"))
    return rows.join(least, "point").select("a", F.col("fp").alias("b")).where("a <> b").distinct()


def links(fps: DataFrame, k: int = 4, bucket: int = BUCKET, wide: int | None = None) -> DataFrame:
    """(a, b): edges among the fingerprints fps(fp[, fp2]), distinct rows, that connect just what links connect.

    A link: k or fewer differing bits of fp and, with `wide`, that many or fewer of fp and fp2 together, for any fp2 of
    either. Runs jobs while it is built: the statistics, and the test for hot buckets.
    """
    n, both = bit_statistics(fps)
    rows = probes(fps, probe_plan(n, both, k))
    found = spill(bucket_links(rows.repartition("part", "key").sortWithinPartitions("part", "key"), k, bucket, wide))
    direct = found.where("not hot").select("a", "b")
    if not found.where("hot").take(1):
        return direct
    hot = fps.join(spill(found.where("hot").select(F.col("a").alias("fp")).distinct()), "fp", "left_semi")
    return direct.unionByName(shared_points(hot, k) if wide is None and k <= 4 and k % 2 == 0 else in_blocks(spill(hot), k, wide, bucket))


def near_duplicates(docs: DataFrame, width: int = 4, k: int = 4, text: str = "text", key: str = "doc_id", bucket: int = BUCKET, wide: int | None = None) -> DataFrame:
    """(key, fp, component_id) of every row of docs.

    Fingerprints of k or fewer differing bits are linked; with `wide`, only if a second fingerprint, of another seed,
    agrees: at most so many of the 128 bits differ. component_id is the least key that links reach, itself
    included. Null and empty texts have fingerprint zero, which is linked like any other. A null key is kept and is never
    the least unless all keys of its component are null. Repeated rows are repeated in the result. Other columns of
    docs don't matter. An empty table gives none. A very long text is hashed whole, in one task. Runs jobs while it is built.
    """
    return united(spill(fingerprints(docs, width, text, key, (42,) if wide is None else (42, 43))), k, key, bucket, wide)


def united(rows: DataFrame, k: int, key: str, bucket: int = BUCKET, wide: int | None = None) -> DataFrame:
    """(key, fp, component_id) of rows(key, fp[, fp2]), a written table: as near_duplicates."""
    nodes = spill(rows.groupBy("fp").agg(F.min(key).alias("least")))
    fps = nodes.select("fp") if wide is None else spill(rows.select("fp", "fp2").distinct())
    roots = components(links(fps, k, bucket, wide)).select(F.col("node").alias("fp"), "root")
    rooted = spill(nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    of_root = spill(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = spill(rooted.join(of_root, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select(key, "fp", "component_id")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def numbered(docs: DataFrame, number: str) -> DataFrame:
    """docs with a column of distinct row numbers that stay the same whenever it is read, dense within each 2 ** 33.

    Rows of a table of files are numbered by their file and their place in it, and nothing is copied; others are written once.
    """
    if docs._jdf.queryExecution().analyzed().children().isEmpty() and docs.inputFiles():
        at = docs.metadataColumn("_metadata")
        path, place = (next(n for k in range(len(docs.columns) + 1) if (n := name + "_" * k) not in docs.columns) for name in ("_path", "_place"))
        placed = docs.withColumns({path: at["file_path"], place: at["row_index"]})
        nth = F.row_number().over(Window.orderBy(path)).cast("long") - 1  # of a row for each file
        files = spill(placed.select(path).distinct().select(path, F.shiftleft(nth, 33).alias(number)))
        return placed.join(F.broadcast(files), path).withColumn(number, F.col(number) + F.col(place)).select(*(F.col(f"`{c}`") for c in docs.columns), number)
    return spill(docs.withColumn(number, F.monotonically_increasing_id()))


def keep_one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies the first row of docs stays.

    Shingles of five words. Rows are linked that have a Jaccard similarity of 0.8 or more, all of them, and those that
    a 128-bit similarity of 0.8 or more links with eight differing bits at most in the first 64. Null and empty texts are near copies of each other by their fingerprint: one stays. An empty
    table gives none. Columns may have any names.
    """
    from .jaccard import joined, only_rows, sketches  # which need the shingles of this module

    number = "larder_row"
    while number in docs.columns:
        number += "_"
    every = numbered(docs, number)
    with cleared(spark):  # of all that is put aside only what the result reads is left
        rows = every.select(F.col(number).alias("row"), F.col("text").cast("string").alias("text"))
        sketched = spill(sketches(rows, 5, Fraction(4, 5)))
        near = united(sketched.select("row", "fp", "fp2"), 8, "row", wide=25).select("row", F.col("component_id").alias("root"))
        first = joined(rows, sketched, spill(near), 5, Fraction(4, 5)).where("row = root").select(F.col("row").alias(number))
        kept = spill(first, outer=True)
    return only_rows(every, kept, number).select(*docs.columns)
