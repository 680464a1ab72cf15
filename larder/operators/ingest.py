"""Ingestion as a whole: files by suffix into sections, and a re-ingest as changes and the next snapshot."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.chunking import table_function
from larder.operators.project import json_groups
from larder.sources import parsers as P

MOST_CSV_ROWS, CSV_GROUP = 100_000, 50
MOST_JSON_BYTES = 10 * 1024 * 1024
SECTION = "section long, title string, body string"


def _csv(text: str | None) -> list[tuple[int, str, str]]:
    """Groups of 50 rows as `k: v | k: v` lines, empty values left out, from the first 100 000 rows: the format's own limit."""
    out: list[tuple[int, str, str]] = []
    held: list[str] = []
    first = 1
    for n, row in enumerate(csv.DictReader(io.StringIO(text or "")), 1):
        if n > MOST_CSV_ROWS:
            break
        held.append(" | ".join(f"{k}: {v}" for k, v in row.items() if k and v))
        if len(held) == CSV_GROUP:
            out.append((len(out) + 1, f"Rows {first}-{n}", "\n".join(held)))
            held, first = [], n + 1
    return [*out, (len(out) + 1, f"Rows {first}-{first + len(held) - 1}", "\n".join(held))] if held else out


def parse(files: DataFrame) -> DataFrame:
    """(path, section, title, body) of files(path, format, length, content): each by the parser of its format.

    Files without a parser's library (PDF) and JSON over 10 MB give none.
    """
    named = files.withColumn("text", F.decode("content", "UTF-8"))
    of = lambda kind: named.where(F.col("format") == kind)
    parts = [
        P.paragraph_sections(of("text").select("path", "text"), "path"),
        P.markdown_sections(of("markdown").select("path", "text"), "path").select("path", "section", "title", "body"),
        P.html_sections(of("html").select("path", F.col("text").alias("html")), "path"),
        table_function(of("csv").select("path", "text"), "path", ["text"], _csv, SECTION),
        table_function(of("json").where(F.col("length") <= MOST_JSON_BYTES).select("path", "text"), "path", ["text"], json_groups, SECTION),
        P.docx_sections(of("docx").select("path", "content")),
    ]
    if P.has_pdf():
        parts.append(P.pdf_sections(of("pdf").select("path", "content")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def ingest_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(path, section, title, body, version_hash) of every supported file under a folder."""
    return parse(P.files(spark, folder)).withColumn("version_hash", F.sha2("body", 256))


def matched(stored: DataFrame, parsed: DataFrame) -> DataFrame:
    """(section_id, parsed_id, change, old_hash, new_hash) of a document's sections before and after.

    stored(document, section_id, section_number, title, version_hash), parsed(document, parsed_id, section_number, title,
    version_hash). A parsed section is that stored one of its number, else of its title. change: new, updated, unchanged, removed.
    """
    old = stored.select("document", "section_id", F.col("section_number").alias("number"), "title", F.col("version_hash").alias("old_hash"))
    new = parsed.select("document", "parsed_id", F.col("section_number").alias("number"), "title", F.col("version_hash").alias("new_hash"))
    keep = ["section_id", "parsed_id", "old_hash", "new_hash"]
    by_number = new.join(old.drop("title"), ["document", "number"]).select(*keep)
    old_left = old.join(by_number.select("section_id"), "section_id", "left_anti").drop("number")
    new_left = new.join(by_number.select("parsed_id"), "parsed_id", "left_anti").drop("number")
    by_title = new_left.join(old_left, ["document", "title"], "full").select(*keep)
    change = F.when(F.col("section_id").isNull(), "new").when(F.col("parsed_id").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "updated").otherwise("unchanged")
    return by_number.unionByName(by_title).withColumn("change", change)


def snapshot(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """(section_id, version_hash, is_current) after a re-ingest: new versions are added, replaced and removed ones aren't current.

    A new section takes its parsed id, negative, until an id is given.
    """
    gone = changes.where("change in ('updated', 'removed')").select("section_id", F.lit(True).alias("_gone"))
    before = stored.join(gone, "section_id", "left").select("section_id", "version_hash", F.col("_gone").isNull().alias("is_current"))
    added = changes.where("change in ('updated', 'new')").select(F.coalesce("section_id", -F.col("parsed_id")).alias("section_id"), F.col("new_hash").alias("version_hash"), F.lit(True).alias("is_current"))
    return before.unionByName(added)
