"""Words counted within their text, over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Texts counted at once.
ROWS = 1024


def _places(listed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row of each item of a list column, and its place in it."""
    sizes = pa.compute.fill_null(pa.compute.list_value_length(listed), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    return rows, np.arange(len(rows)) - (np.cumsum(sizes) - sizes)[rows]


def _counts(listed: pa.Array, ends: np.ndarray | None, weights: np.ndarray | None) -> pa.ListArray:
    rows, places = _places(listed)
    coded = listed.flatten().dictionary_encode()
    width = max(len(coded.dictionary), 1)
    pairs, first, which, tf = np.unique(rows * width + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_index=True, return_inverse=True, return_counts=True)
    if weights is not None:
        tf = np.bincount(which, weights[(places[:, None] >= ends[rows]).sum(axis=1)], len(pairs))
    held = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(pairs % width)), pa.array(places[first]), pa.array(tf)], ["term", "at", "tf"])
    offsets = np.append(0, np.cumsum(np.bincount(rows[first], minlength=len(listed))))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), held)


def counted(texts: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """texts(..., words) with counts instead of words: an array of (term, at, tf) for each row, with a text's distinct words in
    no order, where each first stands and how often. Nothing is shuffled for it. No words, or null: an empty array.

    With weights, tf is the sum of the weights of a word's places; texts has a column `ends` then, of as many places as there
    are weights: each weight holds up to its own end.
    """
    kept = [c for c in texts.columns if c not in ("words", "ends")]
    item = T.StructType([T.StructField("term", T.StringType()), T.StructField("at", T.LongType()), T.StructField("tf", T.DoubleType() if weights else T.LongType())])
    schema = T.StructType([*(texts.schema[c] for c in kept), T.StructField("counts", T.ArrayType(item))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                ends = np.array(part.column("ends").to_pylist(), dtype=np.int64) if weights else None
                found = _counts(part.column("words"), ends, np.array(weights) if weights else None)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), found], [*kept, "counts"])

    return texts.mapInArrow(run, schema)
