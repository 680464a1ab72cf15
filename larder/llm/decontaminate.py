"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders; windows of the templates are hash-joined, documents against benchmark
items. The benchmark's windows are the build side, in slices of a bounded number, so that any benchmark fits; documents
are streamed against each slice and are never shuffled. Windows on one diagonal of a document and an item are then compared
token by token: literal tokens must be equal, and what fills the slots of a window must be a consistent renaming, so that a
question with other numbers or names is caught, and a chance meeting of placeholders is not. Names must be renamed alike on
all of a diagonal, unless two separate windows of it are verbatim. The windows of a diagonal count together: they must hold
EVIDENCE literal tokens, or all of the item.

Items alike but for what fills their slots are one template: documents meet it once, not each of its items, so that results
grow with documents and items, not with their product. Which item of a template a document holds word for word, if any, is
looked up by hashes of whole windows. item_templates gives the items of each template.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .words import portions, texts

WINDOW = 10
#: Of a window's tokens so many must be literal, as bare slots meet any table of numbers; shorter items are one window,
#: from LEAST tokens on. On a diagonal so many literal tokens must meet, if the item isn't met as a whole.
LITERAL, LEAST, EVIDENCE = 2, 5, 6
#: Windows of benchmark items in a slice (about 100 bytes each on an executor).
SLICE = 500_000
#: Entries of a worker's memory of words.
MEMORY = 600_000
LITERAL_TYPE, NUMBER, NAME, UNIT = range(4)
#: Words for numbers and for units.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million billion".split()
UNIT_WORDS = (
    "mm cm m km inch inches foot feet mile miles metre metres meter meters kilometre kilometres kilometer kilometers g kg mg gram grams kilogram kilograms "
    "pound pounds ton tons l ml litre litres liter liters s sec second seconds min minute minutes hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent degree degrees celsius fahrenheit watt watts volt volts hz khz mhz kb mb gb"
).split()
NUMBERISH = re.compile(rb"[+\-$(]*[0-9][0-9.,:/%\-]*")
EDGES = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_BACK = np.uint64(pow(int(BASE), -1, 1 << 64))


class Templates:
    """Template codes of words, each word classified once.

    A code's low four bits: ends a sentence; may be a name; and two of the type. The rest is a hash of the literal.
    """

    def __init__(self):
        self.words: dict[bytes, int] = {}
        self.numbers, self.units = {w.encode() for w in NUMBER_WORDS}, {w.encode() for w in UNIT_WORDS}

    def code(self, word: bytes) -> int:
        core = word.strip(EDGES)
        lower = core.decode("utf-8", "replace").lower().encode()
        ends = word.rstrip(b"\"')]").endswith((b".", b"!", b"?", b":"))
        if not core and not any(b in b"0123456789" for b in word):
            return int(ends)  # a mark only: no token
        kind = NUMBER if NUMBERISH.fullmatch(word.strip(b"\"')];!?")) or lower in self.numbers else UNIT if lower in self.units else LITERAL_TYPE
        text = core.decode("utf-8", "replace")
        name = kind == LITERAL_TYPE and text[:1].isupper() and not (len(text) > 1 and text.isupper())
        literal = xxhash.xxh64_intdigest(lower if kind == LITERAL_TYPE else b"\0%d" % kind, 7) | 16
        return literal & ~15 | kind << 2 | name << 1 | ends

    def codes(self, words: list[bytes]) -> np.ndarray:
        known = self.words
        try:
            return np.array([known[w] for w in words], dtype=np.uint64)
        except KeyError:
            if len(known) > MEMORY:
                known.clear()
            for w in set(words):
                if w not in known:
                    known[w] = self.code(w)
            return np.array([known[w] for w in words], dtype=np.uint64)


def template(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, type, word number) of the tokens of concatenated texts; first: the first word of each text."""
    ends = (codes & np.uint64(1)).astype(bool)
    opens = np.append(True, ends[:-1])
    opens[first[first < len(codes)]] = True
    kind = ((codes >> np.uint64(2)) & np.uint64(3)).astype(np.int8)
    kind[((codes & np.uint64(2)) != 0) & ~opens] = NAME
    value = codes & ~np.uint64(15)
    value[kind == NAME] = np.uint64(xxhash.xxh64_intdigest(b"\0name", 7) & ~15)
    token = np.flatnonzero(value != 0)
    return value[token], kind[token], token


def window_hashes(value: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of so many tokens: a polynomial modulo 2**64 over mixed values."""
    if len(value) < size:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        mixed = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        powers = np.cumprod(np.append(np.uint64(1), np.full(len(value) - 1, BASE)))
        back = np.cumprod(np.append(np.uint64(1), np.full(len(value) - size, BASE_BACK)))
        sums = np.append(np.uint64(0), np.cumsum(mixed * powers))
        found = (sums[size:] - sums[:-size]) * back
        found = (found ^ (found >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return found ^ (found >> np.uint64(30))


def benchmark_windows(items: list[tuple]) -> list[tuple[int, int, int, int]]:
    """(size, hash, item number, position) of the windows of items with enough literal tokens."""
    found, maker = [], Templates()
    for number, (_, text) in enumerate(items):
        value, kind, _ = template(maker.codes((text or "").encode().split()), np.array([0]))
        size = min(WINDOW, len(value))
        if size < LEAST:
            continue
        literal = np.convolve(kind == LITERAL_TYPE, np.ones(size, dtype=int), "valid")
        found += [(size, int(h), number, at) for at, (h, n) in enumerate(zip(window_hashes(value, size), literal, strict=True)) if n >= min(LITERAL, size)]
    return found


def item_template(value: np.ndarray, kind: np.ndarray, cores: list[bytes]) -> int:
    """A hash of an item's tokens and of which of its slots are filled alike: items of one hash are renamings of each other."""
    first: dict[tuple, int] = {}
    alike = [first.setdefault((int(k), c), i) for i, (k, c) in enumerate(zip(kind, cores)) if k != LITERAL_TYPE]
    return xxhash.xxh64_intdigest(value.tobytes() + b"|" + np.array(alike, dtype=np.int64).tobytes(), 11) - (1 << 63)


class Slice:
    """Benchmark items by template, and the windows of one item of each template by hash."""

    _loaded: dict[str, Slice] = {}

    @classmethod
    def of(cls, name: str, items) -> Slice:
        """The slice of a broadcast's items, made once by a worker, which keeps the last two."""
        if name not in cls._loaded:
            while len(cls._loaded) > 1:
                cls._loaded.pop(next(iter(cls._loaded)))
            cls._loaded[name] = cls(items.value)
        return cls._loaded[name]

    def __init__(self, items: list[tuple]):
        self.ids = [i for i, _ in items]
        self.maker = Templates()
        self.words = [(t or "").encode().split() for _, t in items]
        self.parsed: dict[int, tuple] = {}  # of the first item of each template: value, kind, cores, template
        self.members: dict[int, list[int]] = {}
        by_template: dict[int, int] = {}
        for number, words in enumerate(self.words):
            value, kind, token = template(self.maker.codes(words), np.array([0]))
            cores = [words[t].strip(EDGES).lower() for t in token]
            name = item_template(value, kind, cores)
            if name not in by_template:
                by_template[name] = number
                self.parsed[number] = (value, kind, cores, name)
            self.members.setdefault(by_template[name], []).append(number)
        self.at: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        #: Of templates of several items: (template's first item, position, hash of a window's words) -> items that have them.
        self.verbatim: dict[tuple[int, int, int], list[int]] = defaultdict(list)
        firsts = list(self.parsed)
        for size, h, number, position in benchmark_windows([items[n] for n in firsts]):
            first = firsts[number]
            self.at[size][h].append((first, position))
            if len(self.members[first]) > 1 and (self.parsed[first][1][position : position + size] != LITERAL_TYPE).any():
                for m in self.members[first]:
                    self.verbatim[first, position, self._hash(self._cores(m)[position : position + size])].append(m)
        self.sorted = {size: np.array(sorted(x), dtype=np.uint64) for size, x in self.at.items()}
        self.sieve = {size: np.bincount((x >> np.uint64(42)).astype(np.int64), minlength=1 << 22).astype(bool) for size, x in self.sorted.items()}

    def _cores(self, number: int) -> list[bytes]:
        if number in self.parsed:
            return self.parsed[number][2]
        words = self.words[number]
        return [words[t].strip(EDGES).lower() for t in template(self.maker.codes(words), np.array([0]))[2]]

    @staticmethod
    def _hash(cores: list[bytes]) -> int:
        return xxhash.xxh64_intdigest(b" ".join(cores), 3)

    def _word_for_word(self, first: int, windows: list[tuple[int, int]], pairs: dict[int, tuple[int, bytes, bytes]]) -> dict[int, list[tuple[int, int]]]:
        """Items of a template, each with the windows that a document has word for word."""
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        everyone = []
        for w in windows:
            part = [pairs[p] for p in range(w[0], w[0] + w[1])]
            if all(kind == LITERAL_TYPE for kind, _, _ in part):
                everyone.append(w)
            elif len(self.members[first]) > 1:
                for m in self.verbatim.get((first, w[0], self._hash([theirs for _, _, theirs in part])), ()):
                    found[m].append(w)
            elif all(ours == theirs for _, ours, theirs in part):
                found[first].append(w)
        if everyone and not found:
            found[first] = []
        return {m: sorted(ws + everyone) for m, ws in found.items()}

    def matches(self, all_texts: list[bytes], first_only: bool = False) -> dict[int, list[tuple]]:
        """text number -> [(item number, template, first word, last word, windows, exact)]; first_only: one each at most."""
        words = [t.split() for t in all_texts]
        flat = [w for x in words for w in x]
        if not flat:
            return {}
        first = np.cumsum([0, *(len(x) for x in words)])
        value, kind, token = template(self.maker.codes(flat), first[:-1])
        owner = np.searchsorted(first, token, side="right") - 1
        met: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for size, hashes in self.sorted.items():
            found = window_hashes(value, size)
            hit = np.flatnonzero(self.sieve[size][(found >> np.uint64(42)).astype(np.int64)])
            hit = hit[owner[hit] == owner[hit + size - 1]]
            hit = hit[hashes[np.minimum(np.searchsorted(hashes, found[hit]), len(hashes) - 1)] == found[hit]]
            for at in hit.tolist():
                for number, position in self.at[size][int(found[at])]:
                    met[int(owner[at]), number, at - position].append((position, size))
        out: dict[int, list[tuple]] = defaultdict(list)
        for (doc, number, shift), windows in met.items():
            if first_only and doc in out:
                continue
            item_value, item_kind, item_cores, name = self.parsed[number]
            pairs = {}
            for p in sorted({p for position, size in windows for p in range(position, position + size)}):
                pairs[p] = (int(item_kind[p]), item_cores[p], flat[token[p + shift]].strip(EDGES).lower())
            literally = None
            if not consistent(list(pairs.values())):
                kept = [w for w in windows if consistent([pairs[p] for p in range(w[0], w[0] + w[1])])]
                literally = self._word_for_word(number, kept, pairs)
                windows = _kept_windows(kept, pairs, literally)
            places = sorted({p for position, size in windows for p in range(position, position + size)})
            literal = sum(pairs[p][0] == LITERAL_TYPE for p in places)
            if windows and (literal >= EVIDENCE or len(places) == len(item_value)):
                literally = self._word_for_word(number, windows, pairs) if literally is None else literally
                exact = min((m for m, ws in literally.items() if set(windows) <= set(ws)), default=None)
                begin = int(token[places[0] + shift] - first[doc])
                out[doc].append((number if exact is None else exact, name, begin, int(token[places[-1] + shift] - first[doc]), len(windows), exact is not None))
        return out


def _kept_windows(kept: list[tuple[int, int]], pairs: dict[int, tuple[int, bytes, bytes]], literally: dict[int, list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """Of the windows (position, size) of a diagonal that are consistent one by one, but not together, those that count.

    Numbers and units may be renamed otherwise in each window, as equal ones may be so by chance. Names may not; where
    they are, windows that one item has word for word still count if two of them have no token in common.
    """
    places = sorted({p for position, size in kept for p in range(position, position + size)})
    if consistent([pairs[p] for p in places if pairs[p][0] == NAME]):
        return kept
    return next((ws for _, ws in sorted(literally.items()) if ws and ws[0][0] + ws[0][1] <= ws[-1][0]), [])


def consistent(pairs: list[tuple[int, bytes, bytes]]) -> bool:
    """Whether literals are equal, and each slot value has one counterpart of its type, names one in either direction."""
    to: dict[tuple, bytes] = {}
    back: dict[tuple, bytes] = {}
    for kind, ours, theirs in pairs:
        if kind == LITERAL_TYPE:
            if ours.decode("utf-8", "replace").lower() != theirs.decode("utf-8", "replace").lower():
                return False
        elif to.setdefault((kind, ours), theirs) != theirs or kind == NAME and back.setdefault((kind, theirs), ours) != ours:
            return False
    return True


def slices(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """Items in lists of about SLICE windows, streamed through the driver one partition at a time."""
    held: list[tuple] = []
    size = 0
    for row in benchmark.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        held.append((row["item_id"], row["text"]))
        size += len((row["text"] or "").split())
        if size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _runner(spark, items: list[tuple], clean_only: bool, names: list[str], id_type: pa.DataType):
    """Items are broadcast: at most SLICE windows of them, and the item that crosses that bound."""
    shared, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text", 4 << 20):
            here = Slice.of(name, shared)
            found = here.matches(list(texts(batch.column("text"))), clean_only)
            if clean_only:
                yield batch.filter(pa.array([i not in found for i in range(len(batch))]))
            else:
                rows = [(i, *x) for i, listed in sorted(found.items()) for x in listed]
                at, number, template_of, begin, end, windows, exact = zip(*rows, strict=True) if rows else [()] * 7
                ids = pa.array([here.ids[n] for n in number], id_type)
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int32())), ids, *(pa.array(x, pa.int64()) for x in (template_of, begin, end, windows)), pa.array(exact, pa.bool_())], names)

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, item_id, template, first_word, last_word, n_windows, exact): one row per document, template and place where they meet.

    item_id is an item of the template: the one that the document has word for word, else any, and exact is false. A
    template whose items are in several slices has a row for each. Words are numbered from 0 over the document's white-space words. Null and
    empty texts meet nothing, nor do items of under five tokens, nor such of which no window has two literal tokens.
    Repeated rows, of either table, each give their rows. Keys may be of any type; a null key or item_id is carried along.
    Extra columns don't matter. An empty table of either kind gives none. A very long text is worked through whole.
    """
    kind, item = docs.schema[key].dataType.simpleString(), benchmark.schema["item_id"].dataType
    names = ["key", "item_id", "template", "first_word", "last_word", "n_windows", "exact"]
    schema = f"key {kind}, item_id {item.simpleString()}, template long, first_word long, last_word long, n_windows long, exact boolean"
    rows = docs.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for items in slices(benchmark):
        out = out.unionByName(rows.mapInArrow(_runner(docs.sparkSession, items, False, names, to_arrow_type(item)), schema))
    return out.withColumnRenamed("key", key)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs(text, ...) that meet no benchmark item, all columns as they are; see `leaks`."""
    for items in slices(benchmark):
        docs = docs.mapInArrow(_runner(docs.sparkSession, items, True, [], pa.null()), docs.schema)
    return docs


def item_templates(benchmark: DataFrame) -> DataFrame:
    """(item_id, template): which template each item of benchmark(item_id, text) is of; repeated rows have one each."""
    item = benchmark.schema["item_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Templates()
        for batch in batches:
            names = []
            for text in texts(batch.column("text")):
                words = text.split()
                value, kind, token = template(maker.codes(words), np.array([0]))
                names.append(item_template(value, kind, [words[t].strip(EDGES).lower() for t in token]))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(names, pa.int64())], ["item_id", "template"])

    return benchmark.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"item_id {item.simpleString()}, template long")


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    found = leaks(read("documents"), read("benchmark"))
    met = found.groupBy("doc_id", "template").agg(
        F.coalesce(F.min(F.when(F.col("exact"), F.col("item_id"))), F.min("item_id")).alias("item_id"), F.count("*").alias("n_places"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.sum("n_windows").alias("n_windows"), F.max("exact").alias("exact")
    )
    items = item_templates(read("benchmark")).groupBy("template").agg(F.count("*").alias("n_items"))
    return met.join(items, "template").select("doc_id", "item_id", "template", "n_items", "n_places", "first_word", "last_word", "n_windows", "exact")


def decontaminate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that leak a benchmark item go; null and empty texts, and repeated rows, stay."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
