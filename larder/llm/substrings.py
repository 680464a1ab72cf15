"""Substring dedup by recompression: removes words of every window of 35 words that starts anywhere else too.

Rounds of recompression shorten each text: runs of one symbol become one symbol, then, with symbols dealt into left and
right by a hash, each left-right pair becomes one. Names are hashes of what they replace, so they are global: equal texts
get equal symbols wherever they stand, but for a margin. For every symbol the words that decided it are tracked (its
reach). A symbol whose reach lies within a window is in each equal window, at the same place. So a window's anchor, the one of
least name among such symbols of the highest round that has any, depends on its words alone, and equal windows have equal
anchors. Consecutive windows of one anchor form a group, about one for twelve words, and only groups are shuffled:

1. Groups are counted by their anchor's reach. What occurs once holds no repeated window.
2. Groups of a repeated anchor are counted by all their words too. Equal groups are repeated as a whole.
3. Only where an anchor has unequal groups, at the ends of repeats, are single windows compared, one for equal groups.

Counts are combined on the map side before they are shuffled, and joined back to rows whose hot keys adaptive execution can
split. Words are compared by 128 bits of hash. Any text works: where no symbol fits into a window, the window is its own anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import spill
from .words import portions, texts

WINDOW = 35
ROUNDS = 3
#: Bytes of text that a task takes at a time.
PORTION = 2 << 20
MEMORY = 600_000
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
BACKS = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in BASES)


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """Hashes of any span of a sequence of word hashes, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, words: np.ndarray, which: int):
        values = mix(words, 3 + which)
        n = len(values)
        powers, self.back = (np.cumprod(np.append(np.uint64(1), np.full(n, x[which]))) for x in (BASES, BACKS))
        self.sums = np.append(np.uint64(0), np.cumsum(values * powers[:-1]))
        self.which = which

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64), 11 + self.which)


_known: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    try:
        return np.array([_known[w] for w in words], dtype=np.uint64)
    except KeyError:
        if len(_known) > MEMORY:
            _known.clear()
        digest = xxhash.xxh64_intdigest
        for w in words:
            if w not in _known:
                _known[w] = digest(w, 1)
        return np.array([_known[w] for w in words], dtype=np.uint64)


class Round:
    """Symbols of all texts after some rounds: names, and the words [low, high) that decided each; of which text."""

    def __init__(self, name, low, high, text):
        self.name, self.low, self.high, self.text = name, low, high, text


def shorten(s: Round, number: int, begin: np.ndarray, end: np.ndarray) -> Round:
    """One round. A decision at the edge of a text reaches over the edge, where no window does."""
    for pairing in (False, True):
        n = len(s.name)
        same_text = s.text[1:] == s.text[:-1]
        before = np.where(np.append(False, same_text), np.append(0, s.low[:-1]), begin[s.text] - 1)  # reach of what stands left
        after = np.where(np.append(same_text, False), np.append(s.high[1:], 0), end[s.text] + 1)
        if pairing:
            left = (mix(s.name, 101 + number) & np.uint64(1)) == 0
            joins = np.append(left[:-1] & ~left[1:] & same_text, False)
            second = np.append(False, joins[:-1])
            keep = ~second
            name = s.name.copy()
            at = np.flatnonzero(joins)
            name[at] = mix(s.name[at] * np.uint64(0xD6E8FEB86659FD93) + mix(s.name[at + 1], 57), 201 + number)
            low = np.where(left, s.low, before)
            high = np.where(left, after, s.high)
            low[at], high[at] = s.low[at], s.high[at + 1]
            s = Round(name[keep], low[keep], high[keep], s.text[keep])
        else:
            starts = np.append(True, ~((s.name[1:] == s.name[:-1]) & same_text)) if n else np.empty(0, bool)
            first = np.flatnonzero(starts)
            last = np.append(first[1:], n) - 1
            length = last - first + 1
            name = np.where(length > 1, mix(s.name[first] + length.astype(np.uint64) * np.uint64(0xA24BAED4963EE407), 301 + number), s.name[first])
            s = Round(name, before[first], after[last], s.text[first])
    return s


class Texts:
    """Concatenated texts: their words, and where each text begins and ends."""

    def __init__(self, words: list[list[bytes]]):
        self.words = words
        self.counts = np.array([len(w) for w in words], dtype=np.int64)
        self.end = np.cumsum(self.counts)
        self.begin = self.end - self.counts
        self.hashes = word_hashes([w for x in words for w in x])
        with np.errstate(over="ignore"):
            self.one, self.two = Spans(self.hashes, 0), Spans(self.hashes, 1)

    def window_keys(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            return self.one(start, start + WINDOW), self.two(start, start + WINDOW)


def least_in(names: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The place of the least name in each of the ranges first..last, the leftmost of equal ones."""
    best = [np.arange(len(names))]
    widest = int((last - first).max()) + 1
    while 2 << (len(best) - 1) <= widest:
        step, old = 1 << (len(best) - 1), best[-1]
        left, right = old[:-step], old[step:]
        best.append(np.where(names[left] <= names[right], left, right))
    power = np.log2(last - first + 1).astype(np.int64)
    out = np.empty(len(first), dtype=np.int64)
    for k, place in enumerate(best):
        mine = np.flatnonzero(power == k)
        left, right = place[first[mine]], place[last[mine] - (1 << k) + 1]
        out[mine] = np.where(names[left] <= names[right], left, right)
    return out


class Groups:
    """The groups of all windows of some texts: of which text, the first start, how many, and the two keys."""

    def __init__(self, texts: Texts):
        with np.errstate(over="ignore"):
            self._parse(texts)

    def _parse(self, t: Texts) -> None:
        n = len(t.hashes)
        text, place = np.repeat(np.arange(len(t.counts)), t.counts), np.arange(n)
        start = place[place + WINDOW <= t.end[text]] if n else place
        level, anchor = np.zeros(len(start), dtype=np.int64), start.copy()
        low, high = start.copy(), start + WINDOW  # a window without a symbol is its own anchor
        rounds = [Round(t.hashes, place, place + 1, text)]
        for i in range(ROUNDS):
            rounds.append(shorten(rounds[-1], i, t.begin, t.end))
        todo = np.arange(len(start))
        for i in range(ROUNDS, 0, -1):
            s = rounds[i]
            if not len(todo) or not len(s.low):
                break
            # Reaches begin and end in order, so the symbols within a window are neighbours.
            first = np.searchsorted(s.low, start[todo])
            last = np.searchsorted(s.high, start[todo] + WINDOW, side="right") - 1
            fits = first <= last
            if fits.any():
                mine, j = todo[fits], least_in(mix(s.name, 501), first[fits], last[fits])
                level[mine], anchor[mine], low[mine], high[mine] = i, j, s.low[j], s.high[j]
            todo = todo[~fits]
        opens = np.append(True, (np.diff(level) != 0) | (np.diff(anchor) != 0) | (np.diff(start) != 1)) if len(start) else np.empty(0, bool)
        first = np.flatnonzero(opens)
        last = np.append(first[1:], len(start)) - 1 if len(first) else first
        self.start, self.size = start[first], start[last] - start[first] + 1
        self.owner = text[self.start] if n else self.start
        self.local = self.start - t.begin[self.owner] if n else self.start
        self.anchor_key = mix(t.one(low[first], high[first]) + level[first].astype(np.uint64), 401)
        shape = (self.start - low[first] + WINDOW).astype(np.uint64) * np.uint64(1 << 20) + self.size.astype(np.uint64)
        self.group_key = mix(t.two(self.start, self.start + self.size - 1 + WINDOW) + shape * np.uint64(0xA24BAED4963EE407), 402)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, "text", PORTION):
        g = Groups(Texts([t.split() for t in texts(batch.column("text"))]))
        columns = [batch.column(c).take(pa.array(g.owner)) for c in ("id", "hash")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(g.local.astype(np.int32)), pa.array(g.size.astype(np.int32)), _signed(g.anchor_key), _signed(g.group_key)], ["id", "hash", "start", "size", "k1", "k2"])


def _cover(n: int, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Which of n words lie in the windows that begin at start, start + 1, ... (size of them)."""
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, start, 1)
    np.add.at(edges, start + size - 1 + WINDOW, -1)
    return np.cumsum(edges)[:n] > 0


def _result(words: list[bytes], gone: np.ndarray) -> tuple[int, int, str, bytes]:
    kept = b" ".join([words[i] for i in np.flatnonzero(~gone)]) if gone.any() else b" ".join(words)
    return len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept


def _apply(with_text: bool):
    """Removes the windows of full groups; a text with groups still open goes on with the keys of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in portions(batches, "text", PORTION):
            words = [t.split() for t in texts(batch.column("text"))]
            marks = batch.column("marks")
            if isinstance(marks, pa.ChunkedArray):
                marks = marks.combine_chunks()
            ends = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(marks), 0).to_numpy(zero_copy_only=False))
            flat = marks.flatten()
            start, size, full, is_open = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("start", "size", "full", "open"))
            rows, open_starts = [], []
            for i, split in enumerate(words):
                mine = slice(ends[i - 1] if i else 0, ends[i])
                whole, more = full[mine].astype(bool), is_open[mine].astype(bool)
                gone = _cover(len(split), start[mine][whole], size[mine][whole])
                starts = np.unique(np.concatenate([np.arange(a, a + n) for a, n in zip(start[mine][more], size[mine][more], strict=True)])) if more.any() else np.empty(0, np.int64)
                open_starts.append(starts)
                n, removed, digest, kept = _result(split, gone)
                rows.append((n, removed, digest, kept.decode("utf-8", "replace") if with_text else None, pack(b" ".join(split)) if len(starts) else None, np.packbits(gone).tobytes() if len(starts) else None))
            sizes = np.array([len(x) for x in open_starts])
            waiting = np.flatnonzero(sizes)
            local = np.concatenate(open_starts).astype(np.int64)
            h1 = h2 = np.empty(0, np.uint64)
            if len(waiting):
                t = Texts([words[i] for i in waiting])
                h1, h2 = t.window_keys(local + np.repeat(t.begin, sizes[waiting]))
            windows = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(local.astype(np.int32)), _signed(h1), _signed(h2)], ["start", "h1", "h2"]))
            n, removed, digest, kept, blob, bits = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("hash"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest), pa.array(kept, pa.string()), pa.array(blob, pa.binary()), pa.array(bits, pa.binary()), windows],
                ["id", "hash", "n_words", "n_removed", "kept_sha256", "kept", "blob", "gone", "windows"],
            )

    return run


def _finish(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in portions(batches, "blob", PORTION // 2):
            rows = []
            for blob, bits, starts in zip(*(batch.column(c).to_pylist() for c in ("blob", "gone", "starts")), strict=True):
                words = unpack(blob).split()
                gone = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=len(words)).astype(bool)
                rows.append(_result(words, gone | _cover(len(words), np.array(starts or [], dtype=np.int64), 1)))
            n, removed, digest, kept = zip(*rows, strict=True)
            kept = [k.decode("utf-8", "replace") if with_text else None for k in kept]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def dedup_substrings(docs: DataFrame, key: str = "doc_id", with_text: bool = True) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256, kept) of every row of docs(key, text); kept: the text that is left.

    Null and empty texts have no words; texts of under 35 words lose none. Repeated rows are documents of their own: each
    is a copy of the other. A null key is carried along. Extra columns don't matter. An empty table gives none. Kept words
    are joined by one space; bytes that aren't UTF-8 don't occur in Spark strings. A very long text is worked through
    whole, in one task that holds its words' hashes and symbols (some 200 bytes a word). Runs jobs while it is built.
    """
    kind = docs.schema[key].dataType.simpleString()
    on: list[str] = ["id", "hash"]
    same = F.coalesce("id", F.lit(0)) if kind in ("bigint", "int") else F.coalesce(F.col("id").cast("string"), F.lit(""))  # the hash tells nulls from these
    base = docs.select(F.col(key).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.select("id", F.xxhash64("id", "text", F.col("id").isNull()).alias("hash"), "text")  # with it a null id can be joined
    groups = base.mapInArrow(_groups, f"id {kind}, hash long, start int, size int, k1 long, k2 long")
    groups = groups.select("hash", "start", "size", "k1", "k2", same.alias("id"))
    groups = spill(groups)  # read twice, and texts are parsed once
    repeated = spill(groups.groupBy("k1").agg(F.count("*").alias("n")).where("n > 1").select("k1"))
    rows = spill(groups.join(repeated, "k1", "left_semi"))
    equal = spill(rows.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(F.struct("id", "hash", "start")).alias("one")))
    kinds = spill(equal.groupBy("k1").agg(F.count("*").alias("kinds")))
    judged = spill(equal.join(kinds, "k1").where("n > 1 or kinds > 1"))
    here: Column = F.struct("id", "hash", "start")
    marks = rows.join(judged, ["k1", "k2"]).select(*on, F.struct("start", "size", (F.col("n") > 1).alias("full"), ((F.col("kinds") > 1) & (F.col("one") == here)).alias("open")).alias("mark"))
    # Equal rows share their marks: as a set these are as many as one text has, however often it is repeated.
    marks = marks.where("mark.full or mark.open").groupBy(*on).agg(F.collect_set("mark").alias("marks")).withColumnRenamed("id", "same")
    marked = base.withColumn("same", same).join(marks, ["same", "hash"], "left").select("id", "hash", "text", "marks")
    part = "id {0}, {1}n_words long, n_removed long, kept_sha256 string, kept string"
    window = "array<struct<start:int,h1:bigint,h2:bigint>>"
    tried = spill(marked.mapInArrow(_apply(with_text), part.format(kind, "hash long, ") + f", blob binary, gone binary, windows {window}"))
    waiting = tried.where("blob is not null")
    windows = waiting.select(same.alias("same"), "hash", F.explode("windows").alias("w")).select("same", "hash", "w.*")
    twice = spill(windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"))
    found = windows.join(twice, ["h1", "h2"], "left_semi").groupBy("same", "hash").agg(F.collect_set("start").alias("starts"))
    last = waiting.withColumn("same", same).select("id", "same", "hash", "blob", "gone").join(found, ["same", "hash"], "left").select("id", "blob", "gone", "starts")
    out = tried.where("blob is null").select("id", "n_words", "n_removed", "kept_sha256", "kept").unionByName(last.mapInArrow(_finish(with_text), part.format(kind, "")))
    return out.withColumnRenamed("id", key)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP1_SQL = r"""
WITH docs AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM docs)
), repeated AS (
  SELECT s FROM windows GROUP BY s HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS pos FROM windows JOIN repeated USING (s) CROSS JOIN (SELECT unnest(range(0, 35)) AS k)
), words AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM docs
), kept AS (
  SELECT w.doc_id, count(*) AS n_words, count(g.pos) AS n_removed, string_agg(CASE WHEN g.pos IS NULL THEN word END, ' ' ORDER BY w.pos) AS body
  FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.pos = g.pos GROUP BY w.doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
