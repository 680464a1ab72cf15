"""Table functions for SQL: `SELECT * FROM docs, LATERAL chunk_recursive(text)`."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from larder.operators import chunking as K
from larder.operators import project as P
from larder.sources import parsers


def _of(rows_of, schema: str):
    """A table function whose rows are those of a plain function of its arguments."""

    class Rows:
        def eval(self, *values):
            yield from rows_of(*values)

    return udtf(Rows, returnType=schema)


FUNCTIONS = {
    "chunk_recursive": (lambda text: K.recursive(text or ""), "chunk_index bigint, char_offset bigint, chunk string"),
    "chunk_semantic": (lambda text: K.semantic(text or ""), "chunk_index bigint, char_offset bigint, chunk string"),
    "chunk_code": (lambda text, language: K.code(text or "", language), "chunk_index bigint, first_line bigint, last_line bigint, symbol string, chunk string"),
    "parse_html": (parsers._html, "section bigint, title string, body string"),
    "paragraphs": (parsers._paragraphs, "section bigint, title string, body string"),
    "json_groups": (P.json_groups, "section bigint, title string, body string"),
}


def register(spark: SparkSession) -> None:
    for name, (rows_of, schema) in FUNCTIONS.items():
        spark.udtf.register(name, _of(rows_of, schema))
