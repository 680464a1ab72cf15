"""Near copies by the Jaccard similarity of shingle sets, exact above a bound, by prefix filtering.

Shingles have one order everywhere: frequent ones last, others by their hash. Of two sets of similarity t or more, each
holds a shared shingle among its first |x| - ceil(t * |x|) + 1, so sets that meet under none of these are never
similar. Frequent shingles are found on a sample of rows; that decides only how many sets meet, not which are found.

Sets that meet are compared by the parity of their shingles' counts in about |x| / 2 to |x| buckets: each bucket that differs
holds a shingle that only one of them has, so too many of these rule a pair out, and never a similar one. What is left is
nearly always similar. It is verified on all shingles, first one pair for each group, then what those pairs leave open.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .scratch import spill
from .simhash import hashes, majority, shingles
from .words import LOWER_ASCII, portions, texts

#: Of so many rows one is read for frequent shingles; a shingle counts from OFTEN rows of a batch on; most that are kept.
SAMPLED, OFTEN, FREQUENT = 8, 3, 65536
#: Rows of a bucket are paired with so many that follow in the first round, and that many times as many in each later one.
WINDOW = 16
#: Bytes of the bitmaps of rows that are broadcast at most; beyond, rows are joined.
BROADCAST = 64 << 20
#: Slots of the bitmaps that spare the shuffle what is met once; where they fill up at last, they only spare less.
SLOTS = 1 << 24


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles."""
    return np.unique(hashes(shingles(text.translate(LOWER_ASCII).split(), width)))


def frequent_shingles(rows: DataFrame, width: int) -> np.ndarray:
    """Sorted: at most FREQUENT shingles that many of rows(row, text) hold, by a sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text", 8 << 20):
            found = [shingle_set(t, width) for t in texts(batch.column("text"))]
            values, n = np.unique(np.concatenate(found), return_counts=True)
            often = n >= OFTEN
            yield pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["key", "n"])

    some = rows.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLED)) == 0).select("text")
    found = some.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(FREQUENT)
    return np.sort(np.array([r["key"] for r in found.collect()], dtype=np.int64).view(np.uint64))


def parity(x: np.ndarray) -> bytes:
    """The parity of the number of shingles in each of a half to one bucket a shingle, a power of two, 64 at least."""
    buckets = 1 << max(6, (len(x) - 1).bit_length() - 1)
    return np.packbits((np.bincount((x & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1).astype(np.uint8)).tobytes()


def sketches(rows: DataFrame, width: int, bound: Fraction) -> DataFrame:
    """(row, fp, fp2, digest, size, keys, parity) of rows(row, text), from one look at each text.

    fp, fp2: its fingerprints; digest: of its set; keys: the shingles under which it must meet all similar sets.
    """
    late, (p, q) = frequent_shingles(rows, width), bound.as_integer_ratio()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text", 8 << 20):
            out: list[tuple] = []
            for t in texts(batch.column("text")):
                found = shingles(t.translate(LOWER_ASCII).split(), width)
                every = hashes(found)
                x = np.unique(every)
                last = late[np.minimum(np.searchsorted(late, x), len(late) - 1)] == x if len(late) else np.zeros(len(x), dtype=bool)
                keys = np.concatenate([x[~last], x[last]])[: len(x) + (-p * len(x) // q) + 1 if len(x) else 0].view(np.int64)
                out.append((majority(every), majority(hashes(found, 43)), xxhash.xxh128_digest(x.tobytes()), len(x), keys, parity(x)))
            fp, fp2, digest, size, keys, sketch = zip(*out, strict=True)
            prints = [pa.array(np.array(f, dtype=np.uint64).view(np.int64)) for f in (fp, fp2)]
            columns = [*prints, pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], ["row", "fp", "fp2", "digest", "size", "keys", "parity"])

    return rows.select("row", "text").mapInArrow(run, "row long, fp long, fp2 long, digest binary, size long, keys array<long>, parity binary")


def bitmap(values: DataFrame, column: str) -> np.ndarray:
    """SLOTS bits: those of the values' slots are set. The driver gets at most SLOTS / 64 numbers."""
    slots = values.select(F.pmod(F.xxhash64(column), F.lit(SLOTS)).alias("s"))
    words = np.zeros(SLOTS // 64, dtype=np.int64)
    for r in slots.groupBy(F.expr("cast(s div 64 as int)").alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("w")).collect():
        words[r["i"]] = r["w"]
    return words


def within(words: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (words[slots >> 6] >> (slots & 63)) & 1 == 1


def only_rows(rows: DataFrame, kept: DataFrame, number: str) -> DataFrame:
    """The rows whose number is one of kept(number), distinct ids of monotonically_increasing_id or small numbers.

    Such ids are dense within a partition, so kept ones are a bit for each row. Where the bits of all partitions fit into BROADCAST,
    rows are tested where they are read and nothing of them is shuffled; beyond, they are joined.
    """
    at = F.col(number).bitwiseAND(F.lit((1 << 33) - 1))
    placed = kept.select(F.shiftright(number, 33).alias("_part"), at.alias("_at"))
    last = placed.groupBy("_part").agg(F.expr("max(_at) div 64").alias("_last"))
    if (last.agg(F.coalesce(F.sum(F.col("_last") + 1), F.lit(0))).first()[0] or 0) * 8 > BROADCAST:
        return rows.join(kept.select(number), number, "left_semi").select(*(F.col(f"`{c}`") for c in rows.columns))
    none = last.select("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("_word"), F.lit(0).cast("long").alias("_bits"))
    words = placed.select("_part", F.expr("_at div 64").alias("_word"), F.expr("shiftleft(1L, cast(_at % 64 as int))").alias("_bits")).unionByName(none)
    words = words.groupBy("_part", "_word").agg(F.bit_or("_bits").alias("_bits")).groupBy("_part").agg(F.sort_array(F.collect_list(F.struct("_word", "_bits"))).alias("_w"))
    bits = spill(words.select("_part", F.transform("_w", lambda w: w["_bits"]).alias("_words")))
    part, place, held = (next(n for k in range(len(rows.columns) + 1) if (n := name + "_" * k) not in rows.columns) for name in ("_part", "_at", "_words"))
    bits = bits.select(F.col("_part").alias(part), F.col("_words").alias(held))
    met = rows.withColumns({part: F.shiftright(number, 33), place: at}).join(F.broadcast(bits), part)  # at most BROADCAST bytes
    return met.where(F.expr(f"getbit(get(`{held}`, cast(`{place}` div 64 as int)), cast(`{place}` % 64 as int)) = 1")).select(*(F.col(f"`{c}`") for c in rows.columns))


def screened(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose column may be among keys(column): by a bitmap, so that nothing is shuffled; some others come along."""
    words, names = bitmap(keys, column), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(within(words, batch.column("_slot").to_numpy(zero_copy_only=False)))).select(names)

    return rows.withColumn("_slot", F.pmod(F.xxhash64(column), F.lit(SLOTS))).mapInArrow(run, rows.schema)


def met_keys(sets: DataFrame) -> DataFrame:
    """(key, row, size, place) of sets(row, size, keys): each key that two rows have, and the rows that have it.

    Keys are combined on the map side, so a common one is a row for each task. Those that only one row has are mostly left out
    by a bitmap before rows are joined.
    """
    twice = spill(sets.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    words = bitmap(twice, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, slots = batch.column("keys"), batch.column("slots")
            counts = pa.compute.list_value_length(keys).to_numpy(zero_copy_only=False)
            at = np.repeat(np.arange(len(batch)), counts)
            place = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
            keep = within(words, slots.flatten().to_numpy(zero_copy_only=False))
            at, place = at[keep], place[keep]
            yield pa.RecordBatch.from_arrays([pa.array(keys.flatten().to_numpy(zero_copy_only=False)[keep]), batch.column("row").take(pa.array(at)), batch.column("size").take(pa.array(at)), pa.array(place)], ["key", "row", "size", "place"])

    slotted = sets.select("row", "size", "keys", F.transform("keys", lambda k: F.pmod(F.xxhash64(k), F.lit(SLOTS))).alias("slots"))
    return slotted.mapInArrow(run, "key long, row long, size long, place long").join(twice, "key", "left_semi")


def _close(sketch: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, bound: Fraction) -> np.ndarray:
    """Whether the parities of rows i and j leave it open that these are similar."""
    p, q = bound.as_integer_ratio()
    length = np.array([len(s) for s in sketch], dtype=np.int64)
    out = np.zeros(len(i), dtype=bool)
    kinds = length[i] * (1 << 32) + length[j]
    for kind in np.unique(kinds):
        mine = np.flatnonzero(kinds == kind)
        for part in np.array_split(mine, max(1, -(-len(mine) * int(max(kind >> 32, kind & 0xFFFFFFFF)) // (16 << 20)))):
            x, y = (np.frombuffer(b"".join(sketch[rows[part]].tolist()), dtype=np.uint8).reshape(len(part), -1) for rows in (i, j))
            while x.shape[1] > y.shape[1]:  # half as many buckets: the parities of two make that of both
                x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
            while y.shape[1] > x.shape[1]:
                y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
            apart = np.bitwise_count(np.ascontiguousarray(x ^ y).view(np.uint64)).sum(axis=1, dtype=np.int64)
            out[part] = (p + q) * apart <= (q - p) * (size[i[part]] + size[j[part]])
    return out


def meetings(met: DataFrame, low: int, high: int, bound: Fraction) -> DataFrame:
    """(a, b, ra, rb, key) from met(key, row, root, size, place, parity), sorted by key, size and row within tasks.

    Pairs of rows of unlike root and one key, low to high places apart, that sizes, places and parities don't rule out; key
    is null. Besides, each key that has rows further apart, and nulls.
    """
    p, q = bound.as_integer_ratio()
    names = ["a", "b", "ra", "rb", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sketch = np.empty((0, 5), dtype=np.int64), np.empty(0, dtype=object)
        for batch in batches:
            rows = np.concatenate([held, np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)], axis=1)])
            new = np.empty(len(batch), dtype=object)
            new[:] = batch.column(5).to_pylist()
            sketch = np.concatenate([sketch, new])
            begin = len(held)
            for step in range(low, min(high, len(rows) - 1) + 1):
                j = np.arange(max(begin, step), len(rows))
                j = j[rows[j, 0] == rows[j - step, 0]]
                if not len(j):
                    break
                x, z = rows[j - step], rows[j]
                shared = 1 + np.minimum(x[:, 3] - x[:, 4], z[:, 3] - z[:, 4])  # at most, if this is the first shingle they share
                j = j[(x[:, 2] != z[:, 2]) & (q * x[:, 3] >= p * z[:, 3]) & ((p + q) * shared >= p * (x[:, 3] + z[:, 3]))]
                j = j[_close(sketch, rows[:, 3], j - step, j, bound)] if len(j) else j
                x, z = rows[j - step], rows[j]
                turned = x[:, 1] > z[:, 1]
                x, z = np.where(turned[:, None], z, x), np.where(turned[:, None], x, z)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 1]), pa.array(z[:, 1]), pa.array(x[:, 2]), pa.array(z[:, 2]), pa.nulls(len(x), pa.int64())], names)
            y = np.arange(max(begin, high + 1), len(rows))
            more = np.unique(rows[y[rows[y, 0] == rows[y - high - 1, 0]], 0])
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(more), pa.int64())] * 4, pa.array(more)], names)
            held, sketch = rows[-high - 1 :], sketch[-high - 1 :]

    return met.select("key", "row", "root", "size", "place", "parity").mapInArrow(run, "a long, b long, ra long, rb long, key long")


def verified(rows: DataFrame, pairs: DataFrame, width: int, bound: Fraction) -> DataFrame:
    """(a, b): roots ra and rb of the pairs(a, b, ra, rb) whose texts in rows(row, text) have the similarity.

    Only rows in a bitmap of all that are needed are read for shingles.
    """
    p, q = bound.as_integer_ratio()
    words = bitmap(pairs.select(F.explode(F.array("a", "b")).alias("row")), "row")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(within(words, batch.column("s").to_numpy(zero_copy_only=False))))
            for part in portions(iter([batch]), "text", 8 << 20):
                found = [shingle_set(t, width).tobytes() for t in texts(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(found, pa.binary())], ["row", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append((p + q) * shared >= p * (len(x) + len(y)))
            yield batch.select(["ra", "rb"]).filter(pa.array(good, pa.bool_())).rename_columns(["a", "b"])

    found = spill(rows.select("row", "text", F.pmod(F.xxhash64("row"), F.lit(SLOTS)).alias("s")).mapInArrow(sets, "row long, x binary"))
    both = pairs.join(found.withColumnRenamed("row", "a"), "a").join(found.select(F.col("row").alias("b"), F.col("x").alias("y")), "b")
    return both.select("ra", "rb", "x", "y").mapInArrow(run, "a long, b long")


def _renamed(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """pairs with ra and rb by names(root, to)."""
    for side in ("ra", "rb"):
        pairs = pairs.join(names.select(F.col("root").alias(side), F.col("to").alias("_to")), side, "left").withColumn(side, F.coalesce("_to", side)).drop("_to")
    return pairs


def unions(rows: DataFrame, pairs: DataFrame, width: int, bound: Fraction) -> DataFrame | None:
    """(root, to) of the roots that similar ones of the pairs(a, b, ra, rb) unite; none if nothing is united.

    First each root's pair with its least neighbour is verified, then the pairs between what is still apart.
    """
    low, high = F.least("ra", "rb"), F.greatest("ra", "rb")
    tree = spill(pairs.groupBy(high.alias("rb")).agg(F.min(F.struct(low.alias("ra"), "a", "b")).alias("m")).select("m.a", "m.b", "m.ra", "rb"))
    edges = spill(verified(rows, tree, width, bound))
    names = spill(components(edges).select(F.col("node").alias("root"), F.col("root").alias("to")))
    rest = spill(_renamed(pairs.join(tree.select("a", "b"), ["a", "b"], "left_anti"), names).where("ra <> rb"))
    if rest.take(1):
        more = spill(verified(rows, rest, width, bound))
        names = spill(components(edges.unionByName(more)).select(F.col("node").alias("root"), F.col("root").alias("to")))
    return names if names.take(1) else None


def joined(rows: DataFrame, sketched: DataFrame, roots: DataFrame, width: int, bound: Fraction) -> DataFrame:
    """(row, root): roots(row, root) of all of rows(row, text), their groups united where sets of two are similar.

    A root is the least row of its group, before and after. Texts of no words are like none. sketched: as of sketches, written.
    """
    real = sketched.where("size > 0")
    one_of_each = spill(real.groupBy("digest").agg(F.min("row").alias("row")).select("row"))
    sets = only_rows(real.select("row", "size", "keys", "parity"), one_of_each, "row")  # rows are tested as they are read; a copy would be nearly all of them
    copies = real.select("row", "digest").join(roots, "row")  # equal sets may have unlike fingerprints, by repeats
    least = copies.groupBy("digest").agg(F.min("root").alias("a"), F.max("root").alias("z")).where("a < z").select("digest", "a")
    edges = spill(copies.join(least, "digest").where("root <> a").select(F.col("root").alias("b"), "a").distinct())

    def renamed(names: DataFrame) -> DataFrame:
        return spill(roots.join(names, "root", "left").select("row", F.coalesce("to", "root").alias("root")))

    if edges.take(1):
        roots = renamed(spill(components(edges).select(F.col("node").alias("root"), F.col("root").alias("to"))))
    met = spill(met_keys(sets))
    low, high = 1, WINDOW
    while True:
        now = spill(met.join(roots, "row"))
        mixed = spill(now.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key"))
        open_rows = screened(now, mixed, "key").join(sets.select("row", "parity"), "row")
        found = spill(meetings(open_rows.repartition("key").sortWithinPartitions("key", "size", "row"), low, high, bound))
        pairs = spill(found.where("key is null").select("a", "b", "ra", "rb").distinct())
        names = unions(rows, pairs, width, bound) if pairs.take(1) else None
        if names is not None:
            roots = renamed(names)
        more = spill(found.where("key is not null").select("key").distinct())
        if not more.take(1):
            return roots
        met = spill(met.join(more, "key", "left_semi"))
        low, high = high + 1, high * WINDOW
