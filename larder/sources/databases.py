"""Databases as sources and sinks: SQLite through a data source of its own, others through JDBC."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

#: Spark types of SQLite's column affinities.
AFFINITIES = [("INT", "bigint"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double")]


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


COMPARED = {EqualTo: "=", EqualNullSafe: "IS", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
PLAIN = (bool, int, float, str)


def predicate(wanted: Filter, kinds: dict[str, str]) -> tuple[str, list] | None:
    """A filter as SQLite's condition with its values, if both decide alike; kinds: the columns' declared affinities.

    Values must be of the column's kind, as SQLite compares a text with a number by their kinds. Texts compare by their
    bytes, if the column keeps the usual collation, as Spark's do. A prefix is a range, not LIKE, which ignores case.
    """
    if isinstance(wanted, Not):
        inner = predicate(wanted.child, kinds)
        return None if inner is None else (f"NOT ({inner[0]})", inner[1])
    name = wanted.attribute[0] if hasattr(wanted, "attribute") and len(wanted.attribute) == 1 else None
    if name not in kinds:
        return None
    fits = lambda v: isinstance(v, PLAIN) and ((kinds[name] == "string") == isinstance(v, str)) and kinds[name] in ("string", "bigint", "double")
    column = quoted(name)
    if isinstance(wanted, IsNull):
        return f"{column} IS NULL", []
    if isinstance(wanted, IsNotNull):
        return f"{column} IS NOT NULL", []
    if type(wanted) in COMPARED and fits(wanted.value):
        return f"{column} {COMPARED[type(wanted)]} ?", [wanted.value]
    if isinstance(wanted, In) and wanted.value and all(map(fits, wanted.value)):
        return f"{column} IN ({', '.join('?' * len(wanted.value))})", list(wanted.value)
    if isinstance(wanted, StringStartsWith) and kinds[name] == "string" and wanted.value:
        return f"substr({column}, 1, {len(wanted.value)}) = ?", [wanted.value]
    return None


class SqliteReader(DataSourceReader):
    """Ranges of rowids, read side by side; only the schema's columns are selected, and rows that pass the filters that SQLite can decide.

    Spark hands filters over where spark.sql.python.filterPushdown.enabled is set.
    """

    def __init__(self, schema: StructType, path: str, table: str, parts: int):
        self.columns, self.path, self.table, self.parts = schema.names, path, table, parts
        self.kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for wanted in filters:
            found = predicate(wanted, self.kinds)
            if found is None:
                yield wanted
            else:
                self.where.append(f"({found[0]})")
                self.values += found[1]

    def statement(self) -> str:
        return f"SELECT {', '.join(map(quoted, self.columns))} FROM {quoted(self.table)} WHERE {' AND '.join(['rowid >= ? AND rowid < ?', *self.where])}"

    def partitions(self) -> list[Range]:
        with sqlite3.connect(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        if low is None:
            return [Range(0, 0)]
        step = -(-(high - low + 1) // self.parts)
        return [Range(at, min(at + step, high + 1)) for at in range(low, high + 1, step)]

    def read(self, part: Range) -> Iterator[tuple]:
        with sqlite3.connect(self.path) as db:
            yield from db.execute(self.statement(), (part.low, part.high, *self.values))


class Written(WriterCommitMessage):
    pass


class SqliteWriter(DataSourceWriter):
    """Each task inserts its rows in one transaction; SQLite lets one write at a time. Rows of one key replace each other."""

    def __init__(self, schema: StructType, path: str, table: str):
        self.names, self.path, self.table = schema.names, path, table

    def write(self, rows: Iterator) -> Written:
        marks = ", ".join("?" * len(self.names))
        with sqlite3.connect(self.path, timeout=600) as db:
            db.executemany(f"INSERT OR REPLACE INTO {quoted(self.table)} ({', '.join(map(quoted, self.names))}) VALUES ({marks})", (tuple(r) for r in rows))
        return Written()


class SqliteSource(DataSource):
    """Format `sqlite`, with options path, table and partitions. The file must be in a folder that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with sqlite3.connect(self.options["path"]) as db:
            found = db.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        kind = lambda declared: next((t for word, t in AFFINITIES if word in declared.upper()), "double" if declared else "binary")
        return ", ".join(f"`{row[1]}` {kind(row[2])}" for row in found)

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, self.options["path"], self.options["table"], int(self.options.get("partitions", "8")))

    def writer(self, schema: StructType, overwrite: bool) -> SqliteWriter:
        if overwrite:
            with sqlite3.connect(self.options["path"]) as db:
                db.execute(f"DELETE FROM {quoted(self.options['table'])}")
        return SqliteWriter(schema, self.options["path"], self.options["table"])


def sqlite_table(spark: SparkSession, path: str, table: str, partitions: int = 8) -> DataFrame:
    """A table of a SQLite file; filters on it go to SQLite."""
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("sqlite").option("path", path).option("table", table).option("partitions", partitions).load()


def write_sqlite(rows: DataFrame, path: str, table: str, mode: str = "append") -> None:
    """Into a table that exists, by the names of its columns."""
    rows.sparkSession.dataSource.register(SqliteSource)
    rows.write.format("sqlite").mode(mode).option("path", path).option("table", table).save()


def jdbc_options(url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, batch: int = 10_000) -> dict[str, str]:
    """Options of Spark's JDBC source for PostgreSQL, MySQL and others; with a whole-number key it reads ranges side by side."""
    options = {"url": url, "dbtable": table, "fetchsize": str(batch), "batchsize": str(batch)}
    if key and bounds:
        options |= {"partitionColumn": key, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    return options


def jdbc_table(spark: SparkSession, url: str, table: str, key: str | None = None, partitions: int = 8, **more: str) -> DataFrame:
    """A table by JDBC; the driver's jar must be on the cluster. The key's bounds are asked for first."""
    bounds = None
    if key:
        row = spark.read.format("jdbc").options(**jdbc_options(url, f"(SELECT min({key}) AS a, max({key}) AS z FROM {table}) AS bounds"), **more).load().first()
        bounds = (row["a"], row["z"]) if row and row["a"] is not None else None
    return spark.read.format("jdbc").options(**jdbc_options(url, table, key, bounds, partitions), **more).load()


def write_jdbc(rows: DataFrame, url: str, table: str, mode: str = "append", **more: str) -> None:
    rows.write.format("jdbc").mode(mode).options(**jdbc_options(url, table), **more).save()
