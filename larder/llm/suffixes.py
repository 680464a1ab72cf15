"""Substring dedup by sorted suffixes: removes every byte of each 50-byte string that also starts in a document of a smaller id.

A suffix is a row of tokens, and only suffixes at sampled places are sorted. Of the 20-byte strings in a window of 50 bytes,
the one of least hash is the window's anchor; equal windows have equal anchors at the same place. Consecutive windows of one
anchor, some sixteen, are one suffix: its leading token names the anchor, its second one all the windows' bytes.

1. A sample of suffixes gives splitters, and suffixes are partitioned by their range. A bucket sorts its suffixes by multikey
   quicksort and goes through them: suffixes equal in both tokens are removed but for the least id's, and where suffixes
   share their leading token alone, their windows stay open. A token at a splitter may go on in the next bucket; its
   suffixes are compared across that boundary by leaving them open too, so a token may fill any number of buckets.
2. The windows of open suffixes are suffixes of their own, of one byte each: their tokens name 50 bytes. They are
   partitioned, sorted and compared in the same way. Now equal ones are removed but for the least id's, and none stay open.

Before suffixes leave a task, those equal to one of a smaller id in the same task are known to go, and only the least is
compared further; so what many documents share is sent once a task. Suffixes travel in sorted blocks, byte by byte in planes,
compressed: some 15 bytes each. Bytes are compared by 112 bits of hash.

A task holds about a million suffixes of 33 bytes. They are joined, sorted and filtered one column after the other, received
block by block and sent in small batches, so that neither this process nor the JVM holds a second copy of all.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import spill
from .substrings import BACKS, BASES, mix
from .words import portions, texts

WINDOW = 50
ANCHOR = 20
#: Anchors that a window may have.
PLACES = WINDOW - ANCHOR + 1
#: Bytes of text worked on at a time; longer texts are cut, and a cut only ends a suffix early.
PORTION = 1 << 18
#: Suffixes that a task gathers before it sends them, and that a bucket holds, about.
FLUSH = BUCKET = 1 << 20
MOST_BUCKETS = 1 << 16
#: Suffixes in a block, and bytes of blocks and marks in a batch that leaves a task, at most or little more.
BLOCK, SENT = 1 << 16, 1 << 20
#: Sampled suffixes for each bucket, about and at most.
SAMPLE, MOST_SAMPLE = 64, 256
#: Of a sampled document one suffix in so many is taken, so that a few documents don't decide. Even points for each bucket beside them.
THIN, EVEN = 32, 16
SMALL = 4096
SECOND = np.uint64((1 << 48) - 1)
LETTERS = tuple(mix(np.arange(256, dtype=np.uint64), 21 + which) for which in (0, 1))


class Hashes:
    """Hashes of any span of some bytes, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray, which: int):
        n = len(data)
        powers, self.back = (np.cumprod(np.append(np.uint64(1), np.full(n, x[which]))) for x in (BASES, BACKS))
        self.sums = np.append(np.uint64(0), np.cumsum(LETTERS[which][data] * powers[:-1]))
        self.which = which

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64), 31 + self.which)


def multikey(tokens: list[np.ndarray]) -> np.ndarray:
    """The order of rows of tokens, by multikey quicksort: three parts around a pivot, and the equal part goes on by the next token."""
    order, todo = np.arange(len(tokens[0]), dtype=np.int32), [(0, len(tokens[0]), 0)]
    while todo:
        low, high, depth = todo.pop()
        if high - low < 2 or depth == len(tokens):
            continue
        rows = order[low:high]
        if high - low <= SMALL:
            order[low:high] = rows[np.lexsort([t[rows] for t in reversed(tokens[depth:])])]
            continue
        key = tokens[depth][rows]
        pivot = np.sort(key[:: len(key) // 9])[4]
        less, more = key < pivot, key > pivot
        same = ~(less | more)
        del key
        order[low:high] = np.concatenate([rows[less], rows[same], rows[more]])
        a, b = low + int(less.sum()), high - int(more.sum())
        todo += [(low, a, depth), (a, b, depth + 1), (b, high, depth)]
    return order


def _sliding(x: np.ndarray, width: int, of: Callable) -> np.ndarray:
    """of() of each `width` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        x, span = of(x[:-span], x[span:]), 2 * span
    return of(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


class Suffixes:
    """Sampled suffixes of some pieces of text: of which piece, the first start, how many windows, and two tokens."""

    def __init__(self, pieces: list[bytes]):
        counts = np.array([len(p) for p in pieces], dtype=np.int64)
        end = np.cumsum(counts)
        begin = end - counts
        windows = np.maximum(counts - WINDOW + 1, 0)
        total = int(windows.sum())
        # Where each piece's windows begin, among all bytes.
        start = np.arange(total) + np.repeat(begin - (np.cumsum(windows) - windows), windows)
        if not total:
            self.piece = self.start = self.size = np.empty(0, dtype=np.int64)
            self.first = self.second = np.empty(0, dtype=np.uint64)
            return
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        n = len(data)
        with np.errstate(over="ignore"):
            one, two = Hashes(data, 0), Hashes(data, 1)
            places = np.arange(n - ANCHOR + 1)
            names = one(places, places + ANCHOR)
            least = _sliding(names, PLACES, np.minimum)
            reached = np.zeros(len(least) + 2 * (PLACES - 1), dtype=np.uint64)
            reached[start + PLACES - 1] = least[start]
            chosen = names == _sliding(reached, PLACES, np.maximum)  # the least of some window
            candidates = np.flatnonzero(chosen)
            which = (np.cumsum(chosen) - chosen)[start]  # the first that isn't left of the window
            wrong = np.flatnonzero(names[candidates[which]] != least[start])
            while len(wrong):
                which[wrong] += 1
                wrong = wrong[names[candidates[which[wrong]]] != least[start[wrong]]]
            opens = np.append(True, (np.diff(which) != 0) | (np.diff(start) != 1))
            heads = np.flatnonzero(opens)
            first, self.size = start[heads], np.diff(np.append(heads, total))
            anchor = candidates[which[heads]]
            self.first = mix(names[anchor], 41)
            shape = ((anchor - first) * 64 + self.size).astype(np.uint64)
            self.second = mix(two(first, first + self.size - 1 + WINDOW) + shape * np.uint64(0xA24BAED4963EE407), 42) & SECOND
        self.piece = np.repeat(np.arange(len(pieces)), windows)[heads]
        self.start = first - begin[self.piece]


def _pieces(column) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(rows, offsets, bytes) of pieces whose windows are all of the column's, each once; about PORTION bytes at a time."""
    rows, offsets, found, total = [], [], [], 0
    for row, text in enumerate(texts(column)):
        for at in range(0, max(1, len(text) - WINDOW + 1), PORTION):
            piece = text[at : at + PORTION + WINDOW - 1]
            rows.append(row)
            offsets.append(at)
            found.append(piece)
            total += len(piece)
            if total >= PORTION:
                yield rows, offsets, found
                rows, offsets, found, total = [], [], [], 0
    if found:
        yield rows, offsets, found


Records = tuple[np.ndarray, ...]  # id, check, start, size, first, second
NARROW = (np.int64, np.int32, np.int32, np.int8, np.uint64, np.uint64)


def sampled_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[Records]:
    """The sampled suffixes of rows (id, check, text)."""
    for batch in portions(batches, "text", 8 << 20):
        ids, checks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "check"))
        for rows, offsets, pieces in _pieces(batch.column("text")):
            s = Suffixes(pieces)
            row = np.array(rows)[s.piece]
            yield ids[row], checks[row], s.start + np.array(offsets)[s.piece], s.size, s.first, s.second


def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Records]:
    """The windows of open suffixes of rows (id, check, blob, opens), each a suffix of its own."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in portions(batches, "blob", 2 << 20):
        ids, checks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "check"))
        column = pa.array([unpack(x) for x in batch.column("blob").to_pylist()], pa.large_binary())
        starts = [np.unique(_spread(*_decoded(np.frombuffer(x, dtype=np.int64))[:2])) for x in batch.column("opens").to_pylist()]
        for rows, offsets, pieces in _pieces(column):
            counts = np.array([len(p) for p in pieces], dtype=np.int64)
            begin = np.cumsum(counts) - counts
            mine = [starts[r][np.searchsorted(starts[r], at) : np.searchsorted(starts[r], at + PORTION)] for r, at in zip(rows, offsets)]
            row = np.repeat(np.array(rows), [len(m) for m in mine])
            at = np.concatenate(mine)
            here = at + np.repeat(begin - np.array(offsets), [len(m) for m in mine])
            data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
            with np.errstate(over="ignore"):
                first, second = (Hashes(data, which)(here, here + WINDOW) for which in (0, 1))
            yield ids[row], checks[row], at, np.ones(len(at), dtype=np.int64), first, second & SECOND


def _codes(start: np.ndarray, size: np.ndarray, is_open: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << 7) | (size.astype(np.int64) << 1) | is_open


def _decoded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return x >> 7, (x >> 1) & 63, (x & 1).astype(bool)


def _lists(column) -> Iterator[np.ndarray]:
    """The numbers of each row of a list column, null as none."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    values = column.flatten().to_numpy(zero_copy_only=False)
    for low, high in zip(np.append(0, ends[:-1]), ends):
        yield values[low:high]


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All starts of some suffixes' windows."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def _by_document(ids: np.ndarray, checks: np.ndarray, codes: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """One row for each document that has codes; equal ones count once."""
    order = np.lexsort((codes, checks, ids))
    ids, checks, codes = ids[order], checks[order], codes[order]
    new = np.append(True, (np.diff(ids) != 0) | (np.diff(checks) != 0)) if len(ids) else np.empty(0, bool)
    once = new | np.append(True, np.diff(codes) != 0) if len(ids) else new
    ids, checks, codes, new = ids[once], checks[once], codes[once], new[once]
    heads = np.flatnonzero(new)
    offsets = (np.append(heads, len(ids)) * 8).astype(np.int64)
    return pa.array(ids[heads], pa.int64()), pa.array(checks[heads], pa.int32()), pa.Array.from_buffers(pa.large_binary(), len(heads), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(codes))]).cast(pa.binary())


PLANES = (8, 6, 4, 5, 1)  # bytes of: first token less the one before, second, document, start, size


def _pack(r: Records) -> bytes:
    """A block of suffixes sorted by their first token."""
    ids, checks, start, size, first, second = r
    order = np.lexsort((checks, ids))
    new = np.append(True, (np.diff(ids[order]) != 0) | (np.diff(checks[order]) != 0))
    which = np.empty(len(ids), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    documents = order[new]
    columns = [np.diff(first, prepend=np.uint64(0)), second, which, start, size]
    planes = [np.ascontiguousarray(c.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :w].T).tobytes() for c, w in zip(columns, PLANES)]
    head = np.array([len(ids), len(documents)], dtype=np.int64).tobytes() + ids[documents].astype(np.int64).tobytes() + checks[documents].astype(np.int32).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def _unpack(block: bytes) -> Records:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, documents = np.frombuffer(raw, dtype=np.int64, count=2)
    at, columns = 16, []
    ids, at = np.frombuffer(raw, dtype=np.int64, count=documents, offset=at), at + 8 * documents
    checks, at = np.frombuffer(raw, dtype=np.int32, count=documents, offset=at), at + 4 * documents
    for w in PLANES:
        wide = np.zeros((n, 8), dtype=np.uint8)
        wide[:, :w] = np.frombuffer(raw, dtype=np.uint8, count=n * w, offset=at).reshape(w, n).T
        columns.append(wide.view(np.uint64).ravel())
        at += n * w
    first, second, which, start, size = columns
    return ids[which.astype(np.int64)], checks[which.astype(np.int64)], start.astype(np.int64), size.astype(np.int64), np.cumsum(first), second


def _narrow(r: Records) -> Records:
    return tuple(c.astype(kind) for c, kind in zip(r, NARROW))


def _joined(parts: list[Records]) -> list[np.ndarray]:
    """The columns of all parts as one; the list is emptied, and each column's parts go once it is joined."""
    columns = [list(c) for c in zip(*parts)]
    parts.clear()
    return [np.concatenate(columns.pop(0)) for _ in NARROW]


def _take(r: list[np.ndarray], which: np.ndarray) -> None:
    """Replaces each column by some of its rows, one after the other."""
    for i in range(len(r)):
        r[i] = r[i][which]


def _changes(column: np.ndarray) -> np.ndarray:
    return np.append(True, column[1:] != column[:-1])


def _sorted(r: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Puts records in the order of tokens, then ids; where first tokens and pairs of tokens are new."""
    _take(r, multikey([r[4], r[5], r[0]]))
    new_first = _changes(r[4])
    return new_first, new_first | _changes(r[5])


def _firsts(new: np.ndarray) -> np.ndarray:
    """The place of the first record of each one's run."""
    first = np.arange(len(new), dtype=np.int32)
    first[~new] = 0
    return np.maximum.accumulate(first, out=first)


BLOCKS = "bucket long, id long, check int, block binary"


def _blocks(make: Callable, splitters: np.ndarray, second: np.ndarray, buckets: int) -> Callable:
    """Blocks for each bucket; and, with a negative bucket, codes of suffixes that are known to go."""

    def batch(bucket, ids, checks, blocks) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), ids.cast(pa.int64()), checks.cast(pa.int32()), blocks], ["bucket", "id", "check", "block"])

    def send(parts: list[Records]) -> Iterator[pa.RecordBatch]:
        r = _joined(parts)
        _, new = _sorted(r)
        known = r[0] > r[0][_firsts(new)]
        if known.any():
            ids, checks, codes = _by_document(*(c[known] for c in r[:2]), _codes(r[2][known], r[3][known], 0))
            yield from portions(iter([batch(-1 - ids.to_numpy() % buckets, ids, checks, codes)]), "block", SENT)
            del ids, checks, codes
            _take(r, ~known)
        ends = np.array([np.searchsorted(r[4], s) for s in splitters], dtype=np.int64)
        for i, s in enumerate(splitters):  # a splitter within a token's suffixes parts them by the second one
            high = np.searchsorted(r[4], s, side="right")
            ends[i] += np.searchsorted(r[5][ends[i] : high], second[i])
        edges = np.concatenate([[0], ends, [len(r[0])]])
        full, blocks = [], []
        for i in np.flatnonzero(np.diff(edges)):
            for low in range(edges[i], edges[i + 1], BLOCK):
                full.append(i)
                blocks.append(_pack(tuple(c[low : min(low + BLOCK, edges[i + 1])] for c in r)))
                if sum(map(len, blocks)) >= SENT:
                    yield batch(full, pa.nulls(len(full)), pa.nulls(len(full)), pa.array(blocks, pa.binary()))
                    full, blocks = [], []
        if full:
            yield batch(full, pa.nulls(len(full)), pa.nulls(len(full)), pa.array(blocks, pa.binary()))

    most = FLUSH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for r in make(batches):
            parts.append(_narrow(r))
            n += len(r[0])
            if n >= most:
                yield from send(parts)
                parts, n = [], 0
        if n:
            yield from send(parts)

    return run


def _received(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    """The records of all blocks; none of the batches is held any more."""
    return _joined([_narrow(_unpack(x.as_buffer())) for batch in batches for x in batch.column("block")])


def _settled(splitters: np.ndarray, leave_open: bool) -> Callable:
    names = ["id", "check", "code"]

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key[0].as_py() < 0:
            for batch in (y for x in batches for y in portions(iter([x]), "block", SENT)):
                packed = batch.column("block").to_pylist()
                times = [len(x) // 8 for x in packed]
                ids, checks = (np.repeat(batch.column(c).to_numpy(), times) for c in names[:2])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(checks), pa.array(np.frombuffer(b"".join(packed), dtype=np.int64))], names)
            return
        r = _received(batches)
        new_first, new = _sorted(r)
        goes = r[0] > r[0][_firsts(new)]
        is_open = np.zeros(len(goes), dtype=bool)
        if leave_open:
            first = _firsts(new_first)
            several, mixed = np.zeros_like(goes), np.zeros_like(goes)  # of a token's first record: whether it has several windows, and ids
            several[first[new & ~new_first]] = True
            mixed[first[r[0] != r[0][first]]] = True
            opens = several & mixed
            at = np.searchsorted(r[4], splitters)
            inside = at < len(goes)
            opens[at[inside][r[4][at[inside]] == splitters[inside]]] = True
            is_open = ~goes & opens[first]
            del first
        del r[4:]
        some = np.flatnonzero(goes | is_open)
        for low in range(0, len(some), SENT // 16):
            x = some[low : low + SENT // 16]
            yield pa.RecordBatch.from_arrays([pa.array(r[0][x]), pa.array(r[1][x]), pa.array(_codes(r[2][x], r[3][x], is_open[x]))], names)

    return run


def compared(rows: DataFrame, make: Callable, suffixes: int, leave_open: bool) -> DataFrame:
    """(id, check, marks): codes of the suffixes of each document that go or stay open. Samples splitters while it is built."""
    buckets = min(MOST_BUCKETS, max(1, math.ceil(suffixes / BUCKET)))
    splitters = second = np.empty(0, dtype=np.uint64)
    if buckets > 1:

        def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rng = np.random.default_rng(7)
            for r in make(batches):
                some = rng.random(len(r[0])) < 1 / THIN
                yield pa.RecordBatch.from_arrays([pa.array(c[some].view(np.int64)) for c in r[4:]], ["first", "second"])

        sample = rows.sample(min(1.0, THIN * SAMPLE * buckets / suffixes), seed=7).mapInArrow(tokens, "first long, second long").limit(MOST_SAMPLE * buckets).toPandas()
        # Tokens are hashes: even points stand for all but the frequent ones, even where no document was sampled.
        even = np.arange(EVEN * buckets, dtype=np.uint64) * np.uint64((1 << 64) // (EVEN * buckets))
        found = [np.append(sample[c].to_numpy(np.int64).view(np.uint64), x) for c, x in zip(sample, (even, np.zeros_like(even)))]
        pairs = np.sort(np.rec.fromarrays(found, names="first,second"))
        at = np.unique(np.linspace(0, len(pairs), buckets + 1).astype(np.int64)[1:-1])
        splitters, second = pairs.first[at], pairs.second[at]
    blocks = rows.mapInArrow(_blocks(make, splitters, second, buckets), BLOCKS)
    marks = blocks.groupBy("bucket").applyInArrow(_settled(splitters, leave_open), "id long, check int, code long")
    return marks.groupBy("id", "check").agg(F.collect_set("code").alias("marks"))


def _cover(n: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of n bytes lie in the windows of some suffixes."""
    edges = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edges, start, 1)
    np.add.at(edges, start + size - 1 + WINDOW, -1)
    return np.cumsum(edges[:-1]) > 0


def _result(text: bytes, gone: np.ndarray, with_text: bool) -> tuple:
    removed = int(gone.sum())
    spans = int((gone & ~np.append(False, gone[:-1])).sum()) if removed else 0
    kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes() if removed else text
    return len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None


RESULT = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
SCHEMA = "id {0}, {1}n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _apply(with_text: bool):
    """Removes suffixes that go; a text with open ones goes on, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in portions(batches, "text", 4 << 20):
            rows = []
            for text, marks in zip(texts(batch.column("text")), _lists(batch.column("marks"))):
                start, size, is_open = _decoded(marks)
                gone = _cover(len(text), start[~is_open], size[~is_open])
                opens = np.unique(_codes(start[is_open], size[is_open], 1))
                waits = len(opens) > 0
                rows.append((*_result(text, gone, with_text), pack(text) if waits else None, pack(np.packbits(gone).tobytes()) if waits else None, opens.tobytes() if waits else None, int(((opens >> 1) & 63).sum())))
            made = [pa.array(list(v), k) for v, k in zip(zip(*rows), [*KINDS, pa.binary(), pa.binary(), pa.binary(), pa.int64()])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("check"), *made], ["id", "check", *RESULT, "blob", "gone", "opens", "n_open"])

    return run


def _finish(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in portions(batches, "blob", 2 << 20):
            rows = []
            for blob, bits, marks in zip(*(batch.column(c).to_pylist() for c in ("blob", "gone")), _lists(batch.column("marks"))):
                text = unpack(blob)
                gone = np.unpackbits(np.frombuffer(unpack(bits), dtype=np.uint8), count=len(text)).astype(bool)
                rows.append(_result(text, gone | _cover(len(text), *_decoded(marks)[:2]), with_text))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(list(v), k) for v, k in zip(zip(*rows), KINDS))], ["id", *RESULT])

    return run


def dedup_suffixes(docs: DataFrame, key: str = "doc_id", with_text: bool = True) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row of docs(key, text); kept: the bytes that are left.

    key: whole numbers. Rows of one key are no copies of each other, whatever their texts; repeated rows all lose what one
    loses. A null key is neither smaller nor larger than another, so its row keeps all and takes nothing from others. Null
    and empty texts have no bytes; texts under 50 bytes lose none. What is left may begin or end within a character. Extra
    columns don't matter. An empty table gives none. A very long text is hashed in parts; its bytes must fit into a task.
    Runs jobs while it is built.
    """
    kind = docs.schema[key].dataType.simpleString()
    base = docs.select(F.col(key).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.select("id", F.hash("text").alias("check"), "text")
    rows = base.where("id is not null and octet_length(text) >= 50").withColumn("id", F.col("id").cast("long"))
    windows = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    marks = compared(rows, sampled_suffixes, 2 * windows // (PLACES + 1), True)
    marked = base.join(marks.withColumnRenamed("id", "of"), (F.col("id") == F.col("of")) & (base["check"] == marks["check"]), "left").select("id", base["check"], "text", "marks")
    tried = spill(marked.mapInArrow(_apply(with_text), SCHEMA.format(kind, "check int, ") + ", blob binary, gone binary, opens binary, n_open long"))
    waiting = tried.where("blob is not null").select("id", "check", "blob", "gone", "opens", "n_open")
    left = waiting.agg(F.sum("n_open")).first()[0] or 0
    found = compared(waiting.select(F.col("id").cast("long").alias("id"), "check", "blob", "opens"), windows_of, left, False)
    last = waiting.join(found.withColumnRenamed("id", "of"), (F.col("id") == F.col("of")) & (waiting["check"] == found["check"]), "left").select("id", "blob", "gone", "marks")
    out = tried.where("blob is null").select("id", *RESULT).unionByName(last.mapInArrow(_finish(with_text), SCHEMA.format(kind, "")))
    return out.withColumnRenamed("id", key)


def op12_suffixes(spark, sf_dir: str) -> DataFrame:
    return dedup_suffixes(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False).drop("kept")


OP12_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), windows AS (
  SELECT doc_id, i, md5(substr(x, 2 * i - 1, 100)) AS s FROM (SELECT doc_id, x, unnest(range(1, length(x) // 2 - 48)) AS i FROM d)
), least AS (
  SELECT s, min(doc_id) AS id FROM windows GROUP BY s HAVING min(doc_id) <> max(doc_id)
), hits AS (
  SELECT doc_id, i FROM windows JOIN least USING (s) WHERE id < doc_id
), bytes AS (
  SELECT d.doc_id, b.i, substr(x, 2 * b.i - 1, 2) AS c FROM d, unnest(range(1, length(x) // 2 + 1)) AS b(i)
), marked AS (
  SELECT b.*, coalesce(max(h.i) OVER (PARTITION BY b.doc_id ORDER BY b.i) > b.i - 50, false) AS gone FROM bytes b LEFT JOIN hits h ON h.doc_id = b.doc_id AND h.i = b.i
), edges AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM marked
), kept AS (
  SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(c, '' ORDER BY i) FILTER (NOT gone) AS body FROM edges GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(body, ''))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
