"""Words as the operators' contracts define them: maximal runs of characters other than U+0020 and U+0009 to U+000D."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute

#: bytes.split() without arguments splits at exactly these six bytes; str.split() splits at more.
LOWER_ASCII = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def utf8(value) -> bytes:
    """The UTF-8 bytes of an Arrow string scalar; null gives none."""
    buffer = value.as_buffer()
    return buffer.to_pybytes() if buffer is not None else b""


def texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each value of a string column, null as empty, without decoding them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def portions(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches between rows so that each holds about most_bytes of the column, or one longer row."""
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(lengths):
            if total and total + n > most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(lengths):
            yield batch.slice(start)
