"""Merged facts, counters in flight, filters that reach the database, and JSON of any form."""

import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import counters, facts
from larder.sources import databases, parsers


def loop(rows, near):
    """Facts stored one after another."""
    stored, serves, into = [], {}, {}
    for i, _, text, vector in sorted(rows, key=lambda r: r[1]):
        unit = np.zeros(4) if vector is None else np.array(vector)
        unit = unit / np.linalg.norm(unit) if np.linalg.norm(unit) > 1e-10 else unit
        sims = [(round(1.0 if text == t else float(unit @ u), 6), -n) for n, (j, t, u) in enumerate(stored)]
        best = max(sims, default=(0, 0))
        if best[0] > near:
            j = stored[-best[1]][0]
            serves[j] += 1
            into[i] = j
        else:
            stored.append((i, text, unit))
            serves[i] = 0
    return serves, into


@pytest.mark.parametrize("first", [8, 50, 4096])
def test_merged_facts(spark, first, monkeypatch):
    monkeypatch.setattr(facts, "FIRST", first)
    rng = np.random.default_rng(first)
    rows = []
    for i in range(260):
        if i and rng.random() < 0.3:
            _, _, text, vector = rows[int(rng.integers(len(rows)))]
        else:
            centre = np.eye(4)[int(rng.integers(3))]
            text, vector = f"text {i}", (centre + 0.35 * rng.normal(size=4)).tolist()
        rows.append((i + 1000, int(i * 7), text, vector))
    rows += [(1, 5000, "none", None), (2, 5001, "none", None), (3, 5002, "zero", [0.0] * 4)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "fact_id long, ord long, text string, vector array<double>").repartition(4)
    stored, merges = facts.merged(df, 0.9, cells_of=4)
    serves, into = loop(rows, 0.9)
    assert {r["fact_id"]: r["serve_count"] for r in stored.collect()} == serves
    assert {r["fact_id"]: r["into"] for r in merges.collect()} == into and len(into) > 100


def test_no_facts(spark):
    stored, merges = facts.merged(spark.createDataFrame([], "fact_id long, ord long, text string, vector array<double>"))
    assert stored.collect() == merges.collect() == []


def test_counters_are_a_grouping(spark):
    rows = [("a", True, 0.5, 1.0), ("a", False, 7.0, 0.0), ("b", True, None, None), (None, True, 3.0, 2.0), ("z", None, 9000.0, 0.5)]
    df = spark.createDataFrame(rows, "layer string, cached boolean, latency_ms double, saved double")
    passed, seen = counters.observed(df, counters.counters(["a", "b", "c"]))
    passed.write.format("noop").mode("overwrite").save()
    got = {(r["metric"], r["layer"], r["bound"]): r["value"] for r in counters.series(spark, seen).collect()}
    assert got["hits_total", "a", None] == got["misses_total", "a", None] == 1 and got["latency_bucket", "a", 5.0] == 1 and got["latency_bucket", "a", 10.0] == 2
    assert got["hits_total", "b", None] == 1 and got["latency_count", "b", None] == 0 and got["hits_total", "c", None] == 0
    assert got["latency_count", "other", None] == 2 and got["latency_sum", "other", None] == 9003.0 and got["cost_saved_total", "other", None] == 2.5


@pytest.fixture
def base(tmp_path):
    path = str(tmp_path / "base.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT, size REAL, blob BLOB)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(i, None if i % 7 == 0 else f"{'Ab' if i % 2 else 'ab'}{i:03}", None if i % 5 == 0 else i / 4, b"x") for i in range(200)])
    return path


@pytest.mark.parametrize("condition", ["id = 7", "id in (3, 4, 500)", "name = 'Ab011'", "name like 'ab%'", "name is null", "name is not null and size > 20.25", "size <= 3", "not (id >= 100)", "name <=> 'ab012'", "name < 'B'", "length(name) = 5 and id < 50", "id = 1.5", "name not in ('Ab011', 'ab012')"])
def test_filters_give_the_rows_of_spark(spark, base, condition):
    df = databases.sqlite_table(spark, base, "t", partitions=3)
    got = sorted(r["id"] for r in df.where(condition).select("id").collect())
    with sqlite3.connect(base) as db:
        everything = db.execute("SELECT id, name, size FROM t").fetchall()
    plain = spark.createDataFrame(everything, "id long, name string, size double")
    assert got == sorted(r["id"] for r in plain.where(condition).collect())


def test_filters_are_in_the_statement(spark, base, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThan, Not, StringStartsWith

    reader = databases.SqliteReader(databases.sqlite_table(spark, base, "t").schema, base, "t", 2)
    kept = list(reader.pushFilters([EqualTo(("name",), "ab012"), GreaterThan(("size",), 2.5), Not(EqualTo(("id",), 3)), EqualTo(("blob",), b"x"), EqualTo(("name",), 5), StringStartsWith(("name",), "a")]))
    assert kept == [EqualTo(("blob",), b"x"), EqualTo(("name",), 5)]
    assert reader.statement().endswith('AND ("name" = ?) AND ("size" > ?) AND (NOT ("id" = ?)) AND (substr("name", 1, 1) = ?)') and reader.values == ["ab012", 2.5, 3, "a"]
    assert [r[0] for p in reader.partitions() for r in reader.read(p)] == [12]
    plan = databases.sqlite_table(spark, base, "t").where("name = 'ab012'")._jdf.queryExecution().executedPlan().toString()
    assert "ab012" not in plan.split("BatchScan")[0] or "PushedFilters" in plan


def test_json_values(spark):
    texts = ['{"b": 1, "a": "x"}', "[1.5, null, {\"c\": [2]}]", '"word"', "12", "true", "null", "{}", "[]", "not json", None, ""]
    got = parsers.json_values(spark.createDataFrame(list(enumerate(texts)), "id long, body string").withColumn("name", F.lit("x")), "id", "body").collect()
    assert sorted((r["id"], r["position"], r["name"], r["kind"], r["value"]) for r in got) == [
        (0, 0, "a", "text", "x"), (0, 1, "b", "number", "1"), (1, 0, None, "number", "1.5"), (1, 1, None, "null", "null"), (1, 2, None, "object", '{"c":[2]}'),
        (2, 0, None, "text", "word"), (3, 0, None, "number", "12"), (4, 0, None, "truth", "true"), (5, 0, None, "null", "null"),
    ]
