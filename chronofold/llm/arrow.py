"""Plumbing for operators that run numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that an operator works on at once; a longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20


def text_bytes(column: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each text (null: 0)."""
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of ``text`` each, or one row."""
    ends = np.cumsum(text_bytes(batch.column(text)))
    lo = 0
    while lo < batch.num_rows:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def map_batches(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow; ``fn`` sees the record batches of one partition."""
    return df.mapInArrow(fn, schema)


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array with a line feed after each, and where each begins (one more: the end)."""
    ended = pc.binary_join_element_wise(pc.fill_null(column, ""), pa.scalar("\n", column.type), pa.scalar("", column.type))
    if isinstance(ended, pa.ChunkedArray):
        ended = ended.combine_chunks()
    wide = pa.types.is_large_string(ended.type)
    _, offsets, data = ended.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[ended.offset : ended.offset + len(ended) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]
