"""The library's verbs over batches: ingest, remember, query, status and cache statistics."""

from __future__ import annotations

import asyncio
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import text as T
from larder.operators import cache as C
from larder.operators import chunking as K
from larder.operators import postings as P
from larder.operators import search as S


@dataclass(frozen=True)
class Engine:
    """Tables of one engine; every verb that changes something gives a new engine, nothing is changed in place."""

    spark: SparkSession
    sections: DataFrame | None = None
    answers: DataFrame | None = None

    def ingest(self, documents: DataFrame) -> Engine:
        """documents(doc_id, source, text) as current sections with version hashes; those of the same doc_id are replaced."""
        new = documents.select("doc_id", "source", "text", F.sha2("text", 256).alias("version_hash"))
        kept = self.sections.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new) if self.sections is not None else new
        return replace(self, sections=kept)

    def remember(self, answers: DataFrame) -> Engine:
        """answers(cache_id, question, answer): one for each key, the first by cache_id."""
        keyed = answers.select("cache_id", "answer", T.answer_key(F.col("question")).alias("key"))
        first = keyed.groupBy("key").agg(F.min_by("answer", "cache_id").alias("answer"), F.min("cache_id").alias("cache_id"))
        return replace(self, answers=first if self.answers is None else C.upsert(self.answers, first, "key", "cache_id"))

    def query(self, questions: DataFrame) -> DataFrame:
        """questions(question_id, question) with answer, cache_id, and whether a model must be asked."""
        keyed = questions.withColumn("key", T.answer_key(F.col("question")))
        found = keyed.join(self.answers, "key", "left") if self.answers is not None else keyed.withColumns({"answer": F.lit(None).cast("string"), "cache_id": F.lit(None).cast("long")})
        return found.withColumn("needs_generation", F.col("cache_id").isNull()).drop("key")

    def chunks(self, limits: K.Limits = K.Limits()) -> DataFrame:
        return K.table_function(self.sections, "doc_id", ["text"], lambda t: K.recursive(t or "", limits), "chunk_index long, char_offset long, chunk string")

    def search(self, questions: DataFrame, k: int = 10) -> DataFrame:
        """The k best sections for each of questions(query_id, text)."""
        return P.top(P.build(self.sections), questions, k=k)

    def status(self) -> DataFrame:
        return self.sections.agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("sections"), F.sum(F.length("text")).alias("chars"))

    def cache_stats(self) -> DataFrame:
        """(answers, chars): what the cache holds."""
        return self.answers.agg(F.count("*").alias("answers"), F.sum(F.length("answer")).alias("chars"))

    def admin_metrics(self) -> DataFrame:
        """(metric, value): status and cache in one table."""
        parts = [x for x in (self.status() if self.sections is not None else None, self.cache_stats() if self.answers is not None else None) if x is not None]
        out = self.spark.createDataFrame([], "metric string, value long")
        for x in parts:
            out = out.unionByName(x.select(F.explode(F.create_map(*(c for name in x.columns for c in (F.lit(name), F.col(name).cast("long"))))).alias("metric", "value")))
        return out

    async def aquery(self, questions: DataFrame) -> list:
        """The rows of query, collected in a thread; for small batches of questions that someone waits for."""
        return await asyncio.to_thread(lambda: self.query(questions).collect())

    # What a model may call, each as a table.

    def search_data(self, text: str, k: int = 10) -> DataFrame:
        """(doc_id, score, rank, snippet) of the best sections for one question."""
        asked = self.spark.createDataFrame([(0, text)], "query_id long, text string")
        return self.search(asked, k).join(self.sections.select("doc_id", S.snippet(F.col("text")).alias("snippet")), "doc_id").select("doc_id", "score", "rank", "snippet")

    def get_section(self, doc_id: int) -> DataFrame:
        return self.sections.where(F.col("doc_id") == doc_id)

    def search_project(self, chunks: DataFrame, files: DataFrame, text: str, k: int = 10) -> DataFrame:
        """(chunk_id, path, score, rank) of chunks(chunk_id, file_id, text), with the paths of files(file_id, path)."""
        asked = self.spark.createDataFrame([(0, text)], "query_id long, text string")
        found = P.top(P.build(chunks, key="chunk_id"), asked, k=k, key="chunk_id").join(chunks.select("chunk_id", "file_id"), "chunk_id")
        return found.join(files, "file_id").select("chunk_id", "path", "score", "rank")
