"""Best-fit-decreasing packing of tokenised documents.

Pieces of one length are interchangeable, and so are open bins of one remaining capacity. So the plan is made from the
number of pieces of each length alone: at most `capacity` counts, whatever the corpus. Lengths go down; for each, a segment
tree over remaining capacities finds the tightest open bin in logarithmic time, and runs of equal bins are filled at
once, as one document after the other would fill them. The plan's runs tell for the i-th piece of a length its sequence and
its place. Pieces of full length are sequences of their own and need no rank. Other ranks are counted within salted groups
of a length, whose number grows with the pieces, so that a common length isn't one task's work however large the corpus.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import spill
from .words import portions, texts

CAPACITY = 4096
#: Pieces that a ranking group has at most, in the mean; every length is dealt into pieces / GROUP groups.
GROUP = 4096
#: Bytes of a worker's memory of words, and what an entry takes besides its characters and ids. When it is full, words
#: that were met once are forgotten, or all if the others take more than half.
MEMORY, ENTRY = 80 << 20, 200
#: New words that go to the tokenizer as one text, with a mark between them that stands in no plain text.
JOINED, MARK = 256, "\x01"
#: The normaliser under which a plain text's words may be lower-cased and tokenised one by one.
WORDWISE = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
#: Texts of these characters alone are tokenised by words: there, white space, lower case and composition are plain.
PLAIN = re.compile("[\t\n\r\x20-\x7e¡-¬®-ÿŒœ‘’“”–—…]*")


class Numbers(dict):
    """Words by number, in the order of their first lookup."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Tokens:
    """Token ids as unsigned 32-bit numbers, followed by the end id.

    A tokenizer of the form WORDWISE never joins characters across white space, so a plain text's ids are its words' ids,
    and each word is tokenised once, by a tokenizer without that normaliser. Other texts, those that may hold a special
    token, and all texts under other tokenizers go to the tokenizer whole; it is loaded when the first of them comes.
    """

    _loaded: dict = {}

    def __init__(self, path: str, end: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.end, self.full = np.array([end], dtype="<u4"), None
        self.load = lambda: Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        self.by_words = (form["normalizer"] or {}).get("normalizers") == WORDWISE
        if self.by_words:
            self.tokenizer = Tokenizer.from_str(json.dumps(form | {"normalizer": None}))
            self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids[0]
        self.keep(np.empty(0, dtype=np.int64))

    @classmethod
    def of(cls, path: str, end: int) -> Tokens:
        if (path, end) not in cls._loaded:
            cls._loaded[path, end] = cls(path, end)
        return cls._loaded[path, end]

    def keep(self, kept: np.ndarray) -> None:
        """Forgets all words but those of the numbers kept, which are in order."""
        if not len(kept):
            self.numbers, self.characters = Numbers(), 0
            self.flat, self.ends, self.met = np.empty(1 << 16, dtype="<u4"), np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int32)
            return
        words, (flat, last) = list(self.numbers), self.gathered(kept)
        met = self.met[kept] // 2
        self.keep(kept[:0])
        self.numbers.update((words[n], i) for i, n in enumerate(kept.tolist()))
        self.characters, self.flat = sum(map(len, self.numbers)), flat
        self.ends, self.met = np.append(last, np.zeros_like(last)), np.append(met, np.zeros_like(met))

    def size(self) -> int:
        return self.characters + 4 * int(self.ends[len(self.numbers)]) + ENTRY * len(self.numbers)

    def gathered(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of given numbers, one after the other, and where each begins and the last ends."""
        begin, length = self.ends[words], self.ends[words + 1] - self.ends[words]
        last = np.append(0, np.cumsum(length))
        return self.flat[np.arange(last[-1]) + np.repeat(begin - last[:-1], length)], last

    def whole(self, text: str) -> np.ndarray:
        self.full = self.full or self.load()
        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def learn(self, known: int) -> None:
        """Tokenises the words numbered from `known` on, many as one text; the mark's id, which no word has, tells them apart."""
        new = list(itertools.islice(reversed(self.numbers), len(self.numbers) - known))[::-1]
        parts = [f" {MARK} ".join([*new[i : i + JOINED], ""]) for i in range(0, len(new), JOINED)]
        found = [np.array(x.ids, dtype="<u4") for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        ids = np.concatenate(found)
        is_mark = ids == self.mark
        begin = self.ends[known]
        ends = begin + np.cumsum(~is_mark)[is_mark]
        while len(self.flat) < ends[-1]:
            self.flat = np.append(self.flat, np.empty_like(self.flat))
        while len(self.ends) <= len(self.numbers):
            self.ends = np.append(self.ends, np.zeros_like(self.ends))
        while len(self.met) < len(self.numbers):
            self.met = np.append(self.met, np.zeros_like(self.met))
        self.flat[begin : ends[-1]] = ids[~is_mark]
        self.ends[known + 1 : len(self.numbers) + 1] = ends
        self.characters += sum(map(len, new))

    def all(self, listed: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        plain = [self.by_words and "<|" not in t and PLAIN.fullmatch(t) is not None for t in listed]
        if self.size() > MEMORY:
            self.keep(np.flatnonzero(self.met[: len(self.numbers)] > 1))
            if self.size() > MEMORY // 2:
                self.keep(np.empty(0, dtype=np.int64))
        known, numbers = len(self.numbers), self.numbers
        split = [t.lower().split() for t, p in zip(listed, plain, strict=True) if p]
        words = np.array([numbers[w] for s in split for w in s], dtype=np.int64)
        if len(numbers) > known:
            self.learn(known)
        if len(numbers):
            self.met[: len(numbers)] += np.bincount(words, minlength=len(numbers)).astype(np.int32)
        flat, last = self.gathered(words)
        cuts = last[np.append(0, np.cumsum([len(s) for s in split], dtype=np.int64))].tolist()
        at, out = iter(zip(cuts, cuts[1:], strict=False)), []
        for t, p in zip(listed, plain, strict=True):
            a, b = next(at) if p else (0, 0)
            out.append(np.append(flat[a:b] if p else self.whole(t), self.end))
        return out

    def __call__(self, text: str) -> bytes:
        return self.all([text])[0].tobytes()


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str | None = None, end: int = 1, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]): every document's ids and the end id, cut into pieces of `capacity` ids.

    ids: zstd-compressed little-endian unsigned 32-bit numbers; ids_crc32: of the plain ones. A null text is empty: one
    piece, the end id. path: the tokenizer's file, by default found anew on each executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, pack = Tokens.of(path or tokenizer_path(), end), zstandard.ZstdCompressor(level=1).compress
        for batch in portions(batches, "text", 1 << 20):
            rows: list[tuple] = []
            for i, ids in enumerate(tokens.all([t.decode("utf-8", "replace") for t in texts(batch.column("text"))])):
                for n, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((i, n, at, len(part), zlib.crc32(part), pack(part) if with_ids else None))
            at, n, start, length, crc, blob = zip(*rows, strict=True)
            columns = [batch.column("key").take(pa.array(at)), pa.array(n, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(blob, pa.binary())] * with_ids], ["key", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


class Tightest:
    """A segment tree over capacities 0..most: marks those of which a bin is open, finds the least one of at least x."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.open = bytearray(2 * self.size)

    def mark(self, x: int, is_open: bool) -> None:
        i = x + self.size
        self.open[i] = is_open
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] | self.open[2 * i + 1]

    def find(self, x: int) -> int | None:
        i = x + self.size
        if self.open[i]:
            return x
        while i > 1:  # up to the first right neighbour with an open bin, then down its left edge
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                break
            i //= 2
        else:
            return None
        while i < self.size:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.size


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """The runs (length, rank, first bin, pieces a bin, offset) of best fit decreasing, in order of length and rank.

    From `rank` on, up to the next run of the length, each bin in turn takes so many pieces, side by side from offset.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    free: dict[int, deque[tuple[int, int]]] = {}  # remaining capacity -> (first bin, bins)
    tree, bins = Tightest(capacity), 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if not free.setdefault(room, deque()):
                tree.mark(room, True)
            free[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.find(length)
            if room is None:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = free[room].popleft()
                if not free[room]:
                    tree.mark(room, False)
            each = room // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n:
                if left:  # fewer than a bin would take
                    runs.append((length, rank, first + full, left, capacity - room))
                    put(room - left * length, first + full, 1)
                    full, left = full + 1, 0
                put(room, first + full, n - full)
    return sorted(runs, key=lambda r: (r[0], r[1]))


def packed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """found(row, piece, length, [ids], ...), a written table, with sequence_id and offset instead of row.

    row numbers the table's rows. It is a column of it, since a number given while reading changes with the splits, that
    is with the executors there are. The driver gets one count per length, `capacity` at most; the plan it hands out has a
    few runs for each length. Equal lengths are told apart by row: repeated rows stay and take places of their own.
    Runs jobs: the counts are taken while the plan is built.
    """
    names = [c for c in found.columns if c != "row"]
    full = found.where(F.col("length") == capacity).select(*names, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = found.where(F.col("length") < capacity)
    totals = {r["length"]: r["n"] for r in rest.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = np.array(best_fit(totals, capacity), dtype=np.int64).reshape(-1, 5)
    groups = -(-sum(totals.values()) // GROUP) or 1
    salted = rest.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(groups)))
    counts = spill(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spill(counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    within = Window.partitionBy("length", "salt").orderBy("row")
    ranked = salted.withColumn("within", F.row_number().over(within) - 1).join(offsets.hint("merge"), ["length", "salt"])
    ranked = ranked.select(*names, (F.col("before") + F.col("within")).cast("bigint").alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = plan[:, 0] * (1 << 48) + plan[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            run_of = plan[np.searchsorted(starts, length * (1 << 48) + rank, side="right") - 1]
            ahead = rank - run_of[:, 1]
            places = [pa.array(run_of[:, 2] + ahead // run_of[:, 3]), pa.array(run_of[:, 4] + ahead % run_of[:, 3] * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *places], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields if f.name != "row")
    return full.unionByName(ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long"))


def unpacked(out: DataFrame) -> DataFrame:
    """The rows of out with ids as plain numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in portions(batches, "ids", 4 << 20):
            ids = pa.array([unpack(x) for x in batch.column("ids").to_pylist()], pa.binary())
            yield batch.set_column(batch.schema.get_field_index("ids"), "ids", ids)

    return out.mapInArrow(run, out.schema)


def pack_documents(docs: DataFrame, path: str | None = None, end: int = 1, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset): every document of docs in a sequence.

    ids: the piece's tokens as little-endian unsigned 32-bit numbers; without them only their CRC is carried along. Null
    and empty texts are the end id alone. A null doc_id is carried along. Repeated rows are packed each. Extra columns are
    dropped. An empty table gives none. A very long text is tokenised whole, in one task. Runs jobs while it is built.
    """
    numbered = pieces(docs, path, end, capacity, with_ids=with_ids).withColumn("row", F.monotonically_increasing_id())
    out = packed(spill(numbered), capacity)
    return unpacked(out) if with_ids else out


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)


def pack_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the packed pieces of all docs, null and empty texts as in `pack_documents`."""
    return pack_documents(docs, with_ids=False)
