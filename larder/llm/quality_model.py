"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

Terms are word buckets, word shapes, and how a word follows the one before. A bounded sample of labelled rows gives the
inverse document frequencies and, by a truncated singular value decomposition, the latent axes; its vectors are
broadcast. Every document's exact cosine to each of them is computed in blocks, and the nearest vote for their labels,
weighted by similarity.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import portions, texts

#: Labelled rows that the model is fitted on, those of the least hash; all if there are fewer. 1.5 MB of vectors.
SAMPLE = 6000
AXES, NEIGHBOURS, POWER = 48, 25, 4
BUCKETS, SHAPES = 1024, 256
TERMS = BUCKETS + 2 * SHAPES
MEMORY = 600_000
LIKELY = 0.7
RUNS = re.compile(rb"[a-z]+|[A-Z]+|[0-9]+|[\x80-\xff]+")


class Terms:
    """Counts of terms of a text, each word looked at once."""

    def __init__(self):
        self.words: dict[bytes, tuple[int, int]] = {}

    def look(self, word: bytes) -> tuple[int, int]:
        kinds = RUNS.sub(lambda m: b"a" if m[0][:1].islower() or m[0][0] >= 128 else b"A" if m[0][:1].isupper() else b"9", word)
        shape = re.sub(rb"(a)+|(A)(?=A)", lambda m: b"a" if m[1] else b"", kinds)[:6]
        if len(word) > 1 and word.isupper():
            shape = b"UP" + shape
        digest = xxhash.xxh32_intdigest
        return digest(word.lower().strip(b".,;:!?"), 3) % BUCKETS, digest(shape, 5) % SHAPES

    def counts(self, text: bytes) -> np.ndarray:
        words = text.split()
        out = np.zeros(TERMS, dtype=np.float32)
        if not words:
            return out
        known = self.words
        try:
            pairs = [known[w] for w in words]
        except KeyError:
            if len(known) > MEMORY:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = self.look(w)
            pairs = [known[w] for w in words]
        found = np.array(pairs, dtype=np.int64)
        out[:BUCKETS] = np.bincount(found[:, 0], minlength=BUCKETS)
        out[BUCKETS : BUCKETS + SHAPES] = np.bincount(found[:, 1], minlength=SHAPES)
        same = found[1:, 0] == found[:-1, 0]
        follow = np.where(same, 0, 1 + (found[1:, 1] * 31 + found[:-1, 1]) % (SHAPES - 1))
        out[BUCKETS + SHAPES :] = np.bincount(follow, minlength=SHAPES)
        return out


def weighted(counts: np.ndarray) -> np.ndarray:
    """Square roots of each family's shares, so that a text's length doesn't count."""
    out = np.empty_like(counts)
    for part in (slice(0, BUCKETS), slice(BUCKETS, BUCKETS + SHAPES), slice(BUCKETS + SHAPES, TERMS)):
        total = counts[:, part].sum(axis=1, keepdims=True)
        out[:, part] = np.sqrt(counts[:, part] / np.maximum(total, 1))
    return out


class Model:
    """Axes and labelled vectors."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray):
        seen = (counts > 0).sum(axis=0)
        self.idf = (np.log((1 + len(counts)) / (1 + seen)) + 1).astype(np.float32)
        self.labels = labels.astype(np.float32)
        rows = weighted(counts) * self.idf
        values, vectors = np.linalg.eigh((rows.T @ rows).astype(np.float64))
        order = np.argsort(values)[::-1][:AXES]
        self.axes = np.ascontiguousarray(vectors[:, order], dtype=np.float32)
        self.vectors = self.project(counts)

    def project(self, counts: np.ndarray) -> np.ndarray:
        latent = (weighted(counts) * self.idf) @ self.axes
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """The share of label 1 among the nearest, weighted by similarity; of equally near ones the first of the sample count.

        Cosines count to a millionth, so that the order in which they are summed doesn't. A text without terms has no
        direction: it gets the share among all labels.
        """
        near = np.rint((self.project(counts) @ self.vectors.T) * 1e6).astype(np.int64)
        k = min(NEIGHBOURS, near.shape[1])
        ranked = near * len(self.labels) - np.arange(len(self.labels))
        best = np.sort(np.argpartition(ranked, -k, axis=1)[:, -k:], axis=1)
        weight = np.maximum(np.take_along_axis(near, best, axis=1) / 1e6, 0.0) ** POWER + 1e-9
        voted = (weight * self.labels[best]).sum(axis=1) / weight.sum(axis=1)
        return np.where(counts.any(axis=1), voted, self.labels.mean(dtype=np.float64))


def sample(docs: DataFrame, labels: DataFrame, label: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Term counts and labels of at most `size` labelled documents, in order of a hash of the id: a few MB for the driver.

    A document labelled both ways counts as 1. Of rows of one id the least text counts. Null ids and labels, and labels
    of documents that aren't there, don't. Without any label there is one row without terms, labelled 1.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in portions(batches, "text", 4 << 20):
            rows = [terms.counts(t) for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("y"), pa.array([r.astype("<f4").tobytes() for r in rows], pa.binary())], ["at", "y", "counts"])

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most `size` ids
    rows = rows.groupBy("doc_id").agg(F.first("y").alias("y"), F.min("text").alias("text"))
    rows = rows.select(F.struct(F.xxhash64("doc_id").alias("h"), F.col("doc_id").cast("string").alias("id")).alias("at"), "y", "text")
    found = rows.mapInArrow(run, "at struct<h:long,id:string>, y int, counts binary").toArrow()
    if not found.num_rows:
        return np.zeros((1, TERMS), dtype=np.float32), np.array([1])
    at, y, counts = (found.column(c).to_pylist() for c in ("at", "y", "counts"))
    order = sorted(range(len(at)), key=lambda i: (at[i]["h"], at[i]["id"]))
    return np.array([np.frombuffer(counts[i], dtype="<f4") for i in order]), np.array([y[i] for i in order])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row: the weighted share of label 1 among the nearest labelled documents, 0 to 1.

    Null and empty texts have no terms and get the share of label 1 in the sample. Repeated rows score alike, as do texts
    of any length (shares of terms count). An empty table gives none. A null key is carried along; other columns, whatever
    their names, are dropped. Ties are stated at `Model.scores`, conflicting labels at `sample`.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in portions(batches, "text", 2 << 20):
            out = np.empty(len(batch))
            held: list[np.ndarray] = []
            for i, t in enumerate(texts(batch.column("text"))):
                held.append(terms.counts(t))
                if len(held) == 256 or i == len(batch) - 1:
                    out[i + 1 - len(held) : i + 1] = model.scores(np.array(held))
                    held = []
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.clip(out, 0, 1))], ["key", "score"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % 4 == 2
    model = Model(*sample(docs, labels.where(~held_out("doc_id")), "quality", SAMPLE))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= LIKELY).cast("int").alias("predicted"))
