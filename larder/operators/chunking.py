"""Chunkers: fixed windows as an expression; separators, sentences and code lines as table functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    size: int = 500
    overlap: int = 50
    least: int = 50


#: Separators from coarse to fine, and abbreviations whose dot ends no sentence.
SEPARATORS = ["\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " "]
ABBREVIATIONS = r"(Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St|vs|etc|Inc|Ltd|Corp)\."


def fixed(texts: DataFrame, key: str, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """(key, chunk_index, char_offset, chunk): windows of `size` every size - overlap characters, stripped; short ones drop out.

    All within the row: nothing is shuffled.
    """
    step = limits.size - limits.overlap
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    stripped = lambda at: F.regexp_replace(F.substring(F.col(text), at + 1, F.lit(limits.size)), r"(?U)^\s+|\s+$", "")
    pieces = F.transform(starts, lambda at: F.struct(at.cast("long").alias("char_offset"), stripped(at).alias("chunk")))
    kept = texts.select(key, F.posexplode(F.filter(pieces, lambda p: F.length(p["chunk"]) >= limits.least)).alias("chunk_index", "p"))
    return kept.select(key, F.col("chunk_index").cast("long").alias("chunk_index"), "p.char_offset", "p.chunk")


def _grouped(parts: list[str], gap: int, limits: Limits, counts_gap: bool) -> Iterator[tuple[list[str], int]]:
    """(parts, offset) of each group: filled until the next part would exceed the size, then begun anew with what of
    the old group's end fits into the overlap. The last group comes too."""
    group: list[str] = []
    used = offset = 0
    for part in parts:
        if group and used + len(part) + gap * counts_gap > limits.size:
            yield group, offset
            again, kept = 0, 0
            while again < len(group) and kept + len(group[-1 - again]) <= limits.overlap:
                kept += len(group[-1 - again]) + gap
                again += 1
            offset += used - kept
            group, used = group[len(group) - again :], kept
        group = [*group, part]
        used += len(part) + gap
    if group:
        yield group, offset


def recursive(text: str, limits: Limits = Limits()) -> list[tuple[int, int, str]]:
    """(index, offset, chunk). Only the tail of a level is split by finer separators, and its indices skip."""
    whole = text.strip()
    if len(text) <= limits.size:
        return [(0, 0, whole)] if len(whole) >= max(1, limits.least) else []

    def level(part: str, depth: int) -> list[tuple[int, int, str]]:
        if depth == len(SEPARATORS):
            step = limits.size - limits.overlap
            cut = [(at, part[at : at + limits.size].strip()) for at in range(0, len(part), step)]
            return [(i, at, c) for i, (at, c) in enumerate((at, c) for at, c in cut if len(c) >= limits.least)]
        separator = SEPARATORS[depth]
        groups = list(_grouped(part.split(separator), len(separator), limits, True))
        found: list[tuple[int, int, str]] = []
        for n, (group, offset) in enumerate(groups, 1):
            chunk = separator.join(group).strip()
            if n == len(groups) and len(chunk) > limits.size and depth + 1 < len(SEPARATORS):
                for index, at, sub in level(chunk, depth + 1):
                    found.append((len(found) + index, offset + at, sub))
            elif len(chunk) >= limits.least:
                found.append((len(found), offset, chunk))
        return found

    return level(text, 0)


def sentences(text: str) -> list[str]:
    marked = re.sub(ABBREVIATIONS, "\\1<DOT>", text)
    return [s.replace("<DOT>", ".") for s in re.split(r"(?<=[.!?])\s+", marked) if s.strip()]


def semantic(text: str, limits: Limits = Limits()) -> list[tuple[int, int, str]]:
    """(index, offset, chunk): whole sentences up to the size."""
    groups = _grouped([s.strip() for s in sentences(text)], 1, limits, False)
    kept = [(offset, " ".join(g)) for g, offset in groups]
    return [(i, at, c) for i, (at, c) in enumerate((at, c) for at, c in kept if len(c) >= limits.least)]


#: What opens a symbol, by language.
SYMBOLS = {
    "python": r"^\s*(?:async\s+)?(?:def|class)\s+(\w+)",
    "javascript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class)\s+(\w+)",
    "typescript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class|interface|type|enum)\s+(\w+)",
    "go": r"^\s*(?:func(?:\s*\([^)]*\))?|type)\s+(\w+)",
    "rust": r"^\s*(?:pub\s+)?(?:fn|struct|enum|trait|impl)\s+(\w+)",
    "java": r"^\s*(?:public|private|protected)?\s*(?:static\s+)?(?:class|interface|enum)\s+(\w+)",
    "ruby": r"^\s*(?:def|class|module)\s+(\w+)",
    "php": r"^\s*(?:public|private|protected)?\s*(?:static\s+)?(?:function|class)\s+(\w+)",
}


def code(text: str, language: str, lines: int = 60, overlap: int = 10) -> list[tuple[int, int, int, str | None, str]]:
    """(index, first line, last line, symbol, chunk): breaks fall on a symbol near the end of a window, if there is one."""
    rows = text.split("\n")
    pattern = SYMBOLS.get(language)
    symbols = [(i, m[1]) for i, row in enumerate(rows) if pattern and (m := re.match(pattern, row))]
    out: list[tuple[int, int, int, str | None, str]] = []
    at = 0
    while at < len(rows):
        end = min(at + lines, len(rows))
        if end < len(rows):
            end = next((i for i, _ in symbols if max(end - 15, at + 20) <= i < min(end + 15, len(rows))), end)
        chunk = "\n".join(rows[at:end])
        if chunk.strip():
            out.append((len(out), at + 1, end, next((name for i, name in symbols if at <= i < end), None), chunk))
        if end >= len(rows):
            break
        at = max(end - overlap, at + 1)
    return out


def table_function(rows: DataFrame, key: str, columns: list[str], f: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """(key, ...): f of the columns of each row, one row out for each tuple; streamed, nothing is shuffled."""
    names = [c.split()[0] for c in schema.split(", ")]
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                found = [(i, x) for i, values in enumerate(zip(*(part.column(c).to_pylist() for c in columns), strict=True)) for x in f(*values)]
                ids = part.column(key).take(pa.array([i for i, _ in found], pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([x[n] for _, x in found], types[n]) for n in range(len(names)))], [key, *names])

    arrow = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    types = [arrow[c.split()[1]] for c in schema.split(", ")]
    return rows.select(key, *columns).mapInArrow(run, f"{key} {kind}, {schema}")
