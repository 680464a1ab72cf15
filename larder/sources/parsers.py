"""Parsers of tables of files: each turns rows of text into rows of sections."""

from __future__ import annotations

import io
import os
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.operators.chunking import table_function

#: What may be ingested, by suffix, and how large it may be.
FORMATS = {"pdf": "pdf", "docx": "docx", "doc": "docx", "html": "html", "htm": "html", "md": "markdown", "markdown": "markdown", "csv": "csv", "json": "json", "txt": "text", "text": "text", "log": "text", "rst": "text"}
MOST_BYTES = 50 * 1024 * 1024


def files(spark: SparkSession, folder: str, allowed: tuple[str, ...] = ()) -> DataFrame:
    """(path, format, length, content) of all files under a folder that may be ingested; the rest are pruned by name and size, and empty files.

    With `allowed` the folder must lie within one of these, once both are resolved; else it is refused.
    """
    if allowed and not any(_within(folder, a) for a in allowed):
        raise PermissionError(f"{folder} is in no allowed folder")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.create_map(*(F.lit(x) for pair in FORMATS.items() for x in pair))[suffix]
    return found.where((F.col("length") <= MOST_BYTES) & suffix.isin(list(FORMATS))).select("path", kind.alias("format"), "length", "content")


def _within(path: str, folder: str) -> bool:
    """Whether a path is a folder or in it; dots and, of local paths, links are resolved."""
    resolve = lambda p: os.path.realpath(p.removeprefix("file://")) if "://" not in p.removeprefix("file://") else posixpath.normpath(p)
    inner, outer = resolve(path), resolve(folder)
    return inner == outer or inner.startswith(outer.rstrip("/") + "/")


def csv_sections(rows: DataFrame, by: list[str], order: str, columns: list[str], size: int = 50) -> DataFrame:
    """(by, part, title, body): groups of 50 rows as `k: v | k: v` lines; empty values are left out."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    shown = [F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns]
    lines = rows.select(*by, at.alias("at"), F.concat_ws(" | ", *shown).alias("line"))
    groups = lines.groupBy(*by, F.floor(F.col("at") / size).alias("part")).agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.sort_array(F.collect_list(F.struct("at", "line"))).alias("l"))
    title = F.concat(F.lit("Rows "), F.col("lo") + 1, F.lit("-"), F.col("hi") + 1)
    return groups.select(*by, F.col("part").cast("long").alias("part"), title.alias("title"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("body"))


#: Before a heading line: one to six `#`, white space, and something after it.
HEADING = r"(?:\A|(?<=\n))(?=#{1,6}[^\S\n]+[^\n]+)"


def markdown_sections(rows: DataFrame, key: str, text: str = "text", title: str | None = None) -> DataFrame:
    """(key, section, title, hierarchy, body): a text cut at its headings, within the row, so that nothing is shuffled.

    section counts from 1. What comes before the first heading has the document's title, a column of rows, or `Content`;
    hierarchy is that title and the heading. A heading without lines before the next one gives no section, one with blank
    lines only gives an empty one, but not at the end. A text without any section, a null or empty one too, is one section
    0 under the document's title, without hierarchy.
    """
    name = F.coalesce(F.col(title).cast("string"), F.lit("Content")) if title else F.lit("Content")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    element = "struct<section:bigint,title:string,hierarchy:array<string>,body:string>"

    def sections(parts: Column) -> Column:
        def split(part: Column, at: Column) -> Column:
            heading = F.regexp_extract(part, r"\A#{1,6}[^\S\n]+([^\n]+)", 1)
            lines = F.when(heading == "", part).otherwise(F.regexp_replace(part, r"\A[^\n]*\n?", ""))
            return F.struct(strip(heading).alias("heading"), strip(lines).alias("body"), (lines != "").alias("any"), (at == F.size(parts) - 1).alias("last"))

        kept = F.filter(F.transform(parts, split), lambda x: F.when(x["last"], x["body"] != "").otherwise(x["any"]))
        title = lambda x: F.when(x["heading"] == "", F.col("_name")).otherwise(x["heading"])
        return F.transform(kept, lambda x, at: F.struct((at + 1).cast("long").alias("section"), title(x).alias("title"), F.array(F.col("_name"), title(x)).alias("hierarchy"), x["body"].alias("body")).cast(element))

    def whole(text: Column) -> Column:
        return F.array(F.struct(F.lit(0).cast("long").alias("section"), F.col("_name").alias("title"), F.array().cast("array<string>").alias("hierarchy"), strip(text).alias("body")).cast(element))

    # The text, its parts and its sections are bound to variables, and no filter is put on them: each is found once for a
    # text, and not once for each part of it.
    found = lambda text: F.transform(F.array(F.split(text, HEADING)), lambda parts: sections(parts))[0]
    listed = F.transform(F.array(body), lambda text: F.transform(F.array(found(text)), lambda s: F.when(F.size(s) > 0, s).otherwise(whole(text)))[0])[0]
    cut = rows.select(key, name.alias("_name"), F.col(text)).select(key, listed.alias("_found"))
    return cut.select(key, F.explode_outer("_found").alias("_s")).select(key, "_s.*")


def _paragraphs(text: str | None) -> list[tuple[int, str, str]]:
    held: list[str] = []
    out: list[tuple[int, str, str]] = []
    whole = (text or "").strip()
    for part in [*filter(None, map(str.strip, re.split(r"\n\s*\n", whole))), None]:
        if part is not None:
            held.append(part)
        if held and (part is None or sum(map(len, held)) > 2000):
            out.append((len(out) + 1, f"Section {len(out) + 1}", "\n\n".join(held)))
            held = []
    return out or [(0, "Content", whole)]


def paragraph_sections(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, section, title, body): paragraphs gathered until they exceed 2000 characters."""
    return table_function(rows, key, [text], _paragraphs, "section long, title string, body string")


def json_sections(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, key, value): a section for each member of an object."""
    exploded = rows.select(F.col(key), F.explode(F.from_json(column, "map<string,string>")).alias("key", "value"))
    return exploded


class _Sections(HTMLParser):
    """Headings open sections; paragraphs, items, cells, quotes and preformatted text of over ten characters fill them."""

    SKIPPED, HEADINGS, TEXT = {"script", "style", "iframe", "object", "embed", "applet"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"p", "li", "td", "pre", "blockquote"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip = self.in_title = 0
        self.title, self.now, self.kind = "", [], ""
        self.out: list[list] = []
        self.every: list[str] = []

    def flush(self):
        text = " ".join("".join(self.now).split())
        if self.kind == "heading" and text:
            self.out.append([text, []])
        elif self.kind == "text" and len(text) > 10:
            if not self.out:
                self.out.append(["", []])
            self.out[-1][1].append(text)
        self.now, self.kind = [], ""

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIPPED:
            self.skip += 1
        elif tag == "title":
            self.in_title = 1
        elif tag in self.HEADINGS or tag in self.TEXT:
            self.flush()
            self.kind = "heading" if tag in self.HEADINGS else "text"

    def handle_endtag(self, tag):
        if tag in self.SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = 0
        elif tag in self.HEADINGS or tag in self.TEXT:
            self.flush()

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.every.append(data)
            if self.kind:
                self.now.append(data)


def _html(source: str | None) -> list[tuple[int, str, str]]:
    parser = _Sections()
    parser.feed(source or "")
    parser.close()
    parser.flush()
    found = [(heading or parser.title.strip() or "Content", "\n\n".join(body)) for heading, body in parser.out if body]
    found = found or [(parser.title.strip() or "Content", " ".join("".join(parser.every).split()))]
    return [(i, *x) for i, x in enumerate(found, 1)]


def html_sections(rows: DataFrame, key: str, column: str = "html") -> DataFrame:
    """(key, section, title, body)."""
    return table_function(rows, key, [column], _html, "section long, title string, body string")


def _docx(content: bytes | None) -> list[tuple[int, str, str]]:
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
        root = ET.fromstring(archive.read("word/document.xml"))
    out: list[list] = []
    for p in root.iter(f"{space}p"):
        text = "".join(t.text or "" for t in p.iter(f"{space}t")).strip()
        style = p.find(f"{space}pPr/{space}pStyle")
        if text and style is not None and style.get(f"{space}val", "").startswith("Heading"):
            out.append([text, []])
        elif text:
            if not out:
                out.append(["Content", []])
            out[-1][1].append(text)
    return [(i, title, "\n\n".join(body)) for i, (title, body) in enumerate(out, 1)]


def docx_sections(rows: DataFrame, key: str = "path", column: str = "content") -> DataFrame:
    """(key, section, title, body): paragraphs under their headings."""
    return table_function(rows, key, [column], _docx, "section long, title string, body string")


def has_pdf() -> bool:
    try:
        import pypdf  # noqa: F401
    except ImportError:
        return False
    return True


def pdf_sections(rows: DataFrame, key: str = "path", column: str = "content") -> DataFrame:
    """(key, section, title, body): one for each page with text. Needs a PDF library on the executors."""

    def pages(content: bytes | None) -> list[tuple[int, str, str]]:
        from pypdf import PdfReader

        texts = [page.extract_text() or "" for page in PdfReader(io.BytesIO(content or b"")).pages]
        return [(i, f"Page {i}", t) for i, t in enumerate(texts, 1) if t.strip()]

    return table_function(rows, key, [column], pages, "section long, title string, body string")


def json_values(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, position, name, kind, value) of JSON texts of any form: a row for each member of an object or item of a list.

    Members come in order of their names, items in theirs, without a name; a scalar is one row without name. kind: object, list,
    text, number, truth or null. value: texts as they are, everything else as JSON, nested values whole. Texts that aren't
    JSON, and nulls, have no row; an empty object or list has none either.
    """
    kind_of = lambda v: F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    parsed = rows.select(key, F.try_parse_json(column).alias("_v")).where("_v is not null").withColumn("_kind", kind_of(F.col("_v")))
    listed = F.col("_kind").isin("OBJECT", "ARRAY")
    many = parsed.where(listed).lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_v").outer()).toDF("position", "name", "_part")).select(key, "position", "name", "_part")
    one = parsed.where(~listed).select(key, F.lit(0).alias("position"), F.lit(None).cast("string").alias("name"), F.col("_v").alias("_part"))
    kind = F.when(kind_of(F.col("_part")) == "OBJECT", "object").when(kind_of(F.col("_part")) == "ARRAY", "list").when(kind_of(F.col("_part")) == "STRING", "text")
    kind = kind.when(kind_of(F.col("_part")) == "BOOLEAN", "truth").when(kind_of(F.col("_part")) == "VOID", "null").otherwise("number")
    value = F.when(kind_of(F.col("_part")) == "STRING", F.variant_get("_part", "$", "string")).otherwise(F.to_json("_part"))
    return many.unionByName(one).select(key, F.col("position").cast("long").alias("position"), "name", kind.alias("kind"), value.alias("value"))
