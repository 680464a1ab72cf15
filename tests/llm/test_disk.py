"""What near duplicates leave on disk: no copy of the documents, and no shuffle files of queries that have ended."""

import time

from larder import storage
from larder.llm import quality_rules, simhash

ROWS = [(1, "a b c d e f g"), (2, "h i j k l m n"), (3, "a b c d e f g"), (4, None), (5, "o p q r s t u"), (6, "h i j k l m n")]


def _shuffled(spark):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    return {b for b in env.blockManager().diskBlockManager().getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}


def test_shuffles_go_with_their_query(spark):
    before = _shuffled(spark)
    found = storage.spill(spark.range(1000).groupBy("id").count())
    for _ in range(50):
        if not _shuffled(spark) - before:
            break
        time.sleep(0.1)
    assert not _shuffled(spark) - before and found.count() == 1000
    assert spark.conf.get(storage.FREES, "false") == "false"


def test_documents_are_not_copied(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(ROWS, "_path long, text string").repartition(3)
    docs.write.parquet(f"{tmp_path}/a b%20")
    written = []
    monkeypatch.setattr(simhash, "spill", lambda df, outer=False: written.append(df.columns) or storage.spill(df, outer))
    kept = simhash.keep_one_of_each(spark, spark.read.parquet(f"{tmp_path}/a b%20"), "")
    assert written and not any("text" in c for c in written)
    got = sorted(r["text"] or "" for r in kept.collect())
    assert got == sorted({t or "" for _, t in ROWS}) and kept.columns == docs.columns


def test_other_rows_are_numbered_too(spark, tmp_path):
    """A table read with each row twice, and one with its own column _metadata."""
    spark.createDataFrame(ROWS, "_metadata long, text string").write.parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t")
    for rows in (docs, docs.unionByName(docs), docs.crossJoin(spark.range(2).withColumnRenamed("id", "twice"))):
        every = simhash.numbered(rows, "n")
        assert every.select("n").distinct().count() == rows.count() == every.count()
        assert sorted(r["text"] or "" for r in simhash.keep_one_of_each(spark, rows, "").collect()) == sorted({t or "" for _, t in ROWS})


def test_quality_rules_copy_no_text(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    wanted = {r[0] for r in quality_rules.judge(docs, ["doc_id"]).where("kept").select("row.doc_id").collect()}
    written = []
    monkeypatch.setattr(quality_rules, "spill", lambda df, outer=False, spill=quality_rules.spill: written.append(df.schema.simpleString()) or spill(df, outer))
    kept = quality_rules.keep_good(spark, docs, small)
    assert written and not any("text" in s for s in written)
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(wanted) and wanted and kept.columns == docs.columns
