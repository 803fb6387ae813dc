"""Chunks: rows that hold many documents' tokens as packed arrays, so that a key met often in a chunk is shuffled once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers in the narrowest width that holds them, compressed; the first byte is the width."""
    top = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + pa.compress(values.astype(f"<u{width}").tobytes(), codec="zstd", asbytes=True) + len(values).to_bytes(8, "little")


def unpack(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[-8:], "little")
    return np.frombuffer(pa.decompress(data[1:-8], n * width, codec="zstd", asbytes=True), f"<u{width}").astype(np.int64)


def new_ids() -> Iterator[int]:
    """Numbers that no other task of the same stage gives out; they hold once the stage's rows are written."""
    first = TaskContext.get().partitionId() << 32
    yield from range(first, first + (1 << 32))


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each of the consecutive runs of values that counts tells the lengths of."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
