"""Sources, ingestion, table functions and the library's verbs."""

import asyncio
import json
import os
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder import api, udtfs
from larder.functions import vectors as V
from larder.operators import analytics as A
from larder.operators import ingest
from larder.operators import project as P
from larder.operators.ranking import keep_most_valuable
from larder.sources import databases, parsers


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    files = {
        "a.txt": "one paragraph\n\nanother " + "x" * 2000 + "\n\nlast",
        "sub/b.md": "# Head\nsome lines\n## Next\nmore",
        "c.html": "<title>T</title><h1>Part</h1><p>A paragraph that is long enough</p><p>short</p>",
        "d.csv": "k,v\n" + "\n".join(f"{i},{'' if i % 2 else i}" for i in range(120)),
        "e.json": json.dumps({"x": {"y": 1}, "z": "text"}),
        "f.log": "",
        "g.exe": "no",
        "h.xml": "<no/>",
    }
    for name, text in files.items():
        (tmp_path / "in" / name).write_text(text)
    return str(tmp_path / "in")


def test_ingest_by_suffix(spark, folder):
    rows = [r.asDict() for r in ingest.ingest_folder(spark, folder).collect()]
    by = {}
    for r in sorted(rows, key=lambda r: (r["path"], r["section"])):
        by.setdefault(os.path.basename(r["path"]), []).append((r["title"], r["body"]))
    assert sorted(by) == ["a.txt", "b.md", "c.html", "d.csv", "e.json"]
    assert [t for t, _ in by["a.txt"]] == ["Section 1", "Section 2"] and by["a.txt"][1][1] == "last"
    assert by["b.md"] == [("Head", "some lines"), ("Next", "more")] and by["c.html"] == [("Part", "A paragraph that is long enough")]
    assert [t for t, _ in by["d.csv"]] == ["Rows 1-50", "Rows 51-100", "Rows 101-120"] and by["d.csv"][0][1].split("\n")[:3] == ["k: 0 | v: 0", "k: 1", "k: 2 | v: 2"]
    assert by["e.json"] == [("x", '{\n  "y": 1\n}'), ("z", "text")]
    assert len({r["version_hash"] for r in rows}) == len({r["body"] for r in rows})


def test_allowed_folders(spark, folder):
    assert parsers.files(spark, folder, (os.path.dirname(folder),)).count() == 5
    for path in (folder, folder + "/../in"):
        with pytest.raises(PermissionError):
            parsers.files(spark, path, (folder + "/sub",))


def test_sqlite_round_trip(spark, tmp_path):
    path = f"{tmp_path}/x.db"
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE "odd name" (id INTEGER PRIMARY KEY, text TEXT, score REAL, "a b" BLOB)')
        db.executemany('INSERT INTO "odd name" VALUES (?, ?, ?, ?)', [(i * 7, f"t{i}" if i % 3 else None, i / 2, bytes([i % 256])) for i in range(1000)])
        db.execute("CREATE TABLE none (id INTEGER, text TEXT)")
    rows = databases.sqlite_table(spark, path, "odd name", 5)
    assert rows.dtypes == [("id", "bigint"), ("text", "string"), ("score", "double"), ("a b", "binary")] and rows.rdd.getNumPartitions() == 5
    assert rows.agg(F.count("*"), F.sum("id"), F.count("text"), F.sum("score")).first() == (1000, sum(range(0, 7000, 7)), 666, sum(range(1000)) / 2)
    assert databases.sqlite_table(spark, path, "none").count() == 0
    databases.write_sqlite(rows.where("id < 70").select("id", F.lit("new").alias("text")), path, "odd name")
    assert databases.sqlite_table(spark, path, "odd name").where("text = 'new'").count() == 10
    databases.write_sqlite(rows.limit(3).select("id", "text"), path, "none", "overwrite")
    assert databases.sqlite_table(spark, path, "none").count() == 3


def test_jdbc_options():
    assert databases.jdbc_options("jdbc:x", "t", "id", (1, 9), 4)["numPartitions"] == "4" and "partitionColumn" not in databases.jdbc_options("jdbc:x", "t")


def test_table_functions(spark):
    udtfs.register(spark)
    text = "A sentence of some length. " * 60
    assert spark.sql(f"SELECT count(*) FROM chunk_recursive('{text}')").first()[0] == len(udtfs.K.recursive(text))
    found = spark.sql("SELECT id, s.title FROM range(2), LATERAL json_groups('{\"a\": 1, \"b\": [2]}') AS s ORDER BY 1, 2").collect()
    assert [tuple(r) for r in found] == [(0, "a"), (0, "b"), (1, "a"), (1, "b")]


def test_verbs(spark):
    docs = spark.createDataFrame([(1, "s", "alpha beta gamma"), (2, "s", "beta delta"), (3, "t", "epsilon")], "doc_id long, source string, text string")
    engine = api.Engine(spark).ingest(docs).remember(spark.createDataFrame([(7, "What is alpha?", "first"), (8, "alpha", "later")], "cache_id long, question string, answer string"))
    assert sorted(tuple(r) for r in engine.admin_metrics().collect()) == [("answers", 1), ("chars", 5), ("chars", 33), ("documents", 3), ("sections", 3)]
    asked = spark.createDataFrame([(1, "the ALPHA!"), (2, "unknown")], "question_id long, question string")
    assert sorted((r["question_id"], r["answer"], r["needs_generation"]) for r in asyncio.run(engine.aquery(asked))) == [(1, "first", False), (2, None, True)]
    assert [r["doc_id"] for r in engine.search_data("delta beta").orderBy("rank").collect()] == [2, 1] and engine.get_section(3).count() == 1
    chunks = spark.createDataFrame([(1, 10, "def alpha"), (2, 11, "def omega")], "chunk_id long, file_id long, text string")
    files = spark.createDataFrame([(10, "a.py"), (11, "b.py")], "file_id long, path string")
    assert [r["path"] for r in engine.search_project(chunks, files, "omega").collect()] == ["b.py"]


def test_price_file(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"m": {"input": 1.5, "output": 2}, "_default": {"input": 0.5, "output": 1}}')
    assert sorted(tuple(r) for r in A.read_prices(spark, f"{tmp_path}/p.json").collect()) == [("_default", 0.5, 1.0), ("m", 1.5, 2.0)]


def test_hashed_embedding(spark):
    rows = spark.createDataFrame([("a b c",), ("c  B, a",), ("x y",), ("",)], "t string").select(V.hashed_embedding(F.col("t"), 16).alias("v")).collect()
    one, two, other, none = (np.array(r["v"]) for r in rows)
    assert np.allclose(one, two) and abs(np.linalg.norm(one) - 1) < 1e-9 and not np.allclose(one, other) and not none.any()


@pytest.mark.parametrize("most", [0, 1, 7, 500, 999, 1000, 5000])
def test_keep_by_ranges(spark, most):
    rows = spark.range(1000).select("id", (F.col("id") % 10).alias("v"))
    kept = {r["id"] for r in keep_most_valuable(rows, most, F.desc("v"), F.asc("id"), top=0).collect()}
    assert kept == {i for i in sorted(range(1000), key=lambda i: (-(i % 10), i))[:most]}


def test_file_rules(spark):
    cases = {"src/a.py": True, "a/package-lock.json": False, ".DS_Store": False, "x/Thumbs.db": False, "lib.egg-info/a.py": False, "b/.env.local": False, "c.pem": False, "d.cfg": True, "notes": False, "Dockerfile": True, "e.PNG": False, "poetry.lock": False}
    rows = spark.createDataFrame([(p,) for p in cases], "path string").select("path", P.may_index(F.col("path"), F.lit(10)).alias("ok")).collect()
    assert {r["path"]: r["ok"] for r in rows} == cases
