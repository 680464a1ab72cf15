"""Corpus pipeline: documents in, packed training sequences out, in five written stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.llm.decontaminate import decontaminate_stage
from larder.llm.packing import pack_stage
from larder.llm.pii import redact_stage
from larder.llm.quality_rules import keep_good
from larder.llm.scratch import cleared, delete, fresh
from larder.llm.simhash import keep_one_of_each

#: (name, function of (spark, docs, sf_dir)); each works on all that the one before kept.
STAGES = [
    ("quality rules", keep_good),
    ("near duplicates", keep_one_of_each),
    ("benchmark decontamination", decontaminate_stage),
    ("personal data", redact_stage),
    ("best-fit packing", pack_stage),
]

#: Tokenising, SimHash and bin packing have no SQL form; tests compare with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written to the shared folder and read again.

    Once it is written, what the stage has put aside and the result before go.
    """
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), fresh(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        with cleared(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            delete(spark, f"{folder}/{i - 1}")
    return docs
