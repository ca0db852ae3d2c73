"""What the operators of this subpackage share: shared scratch tables and Arrow text helpers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracklens import scratch
from tracklens.scratch import scratch_path  # noqa: F401

#: The bytes of white space, 0x20 and 0x09 to 0x0D.
WHITE_SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes of text that one vectorised step handles, so that its arrays stay in a task's memory.
SLICE_BYTES = 1 << 20


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """df written to the run's folder and read back, with small batches on the way."""
    bound_batches(df.sparkSession)
    return scratch.stage_table(df, name)


def bound_batches(spark: SparkSession) -> None:
    """Keep batches between the JVM and Python small: texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    buffers = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], kind, n + 1, column.offset * kind().itemsize).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (two rounds of shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E6C63D0876A9A47)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC6A4A7935BD1E995)
    return x ^ (x >> np.uint64(32))


def _seeded(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(WHITE_SPACE)] = True
_BYTE_CODES = _seeded(11, 256)
_BYTE_CODES[list(WHITE_SPACE)] = 0
_BYTE_CODES = _BYTE_CODES[_LOWER]
_BASE = np.uint64(0xD6E8FEB86659FD93)


def cuts(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES) -> list[int]:
    """Places that cut data into parts of about limit bytes, at white space or between rows; a longer word stays whole."""
    places, n = [0], len(data)
    while n - places[-1] > limit:
        at = places[-1] + limit
        edge = int(offsets[np.searchsorted(offsets, at)])
        while at < edge:
            spaces = np.flatnonzero(IS_SPACE[data[at : min(at + 4096, edge)]])
            if len(spaces):
                at += int(spaces[0])
                break
            at = min(at + 4096, edge)
        places.append(at)
    if n > places[-1]:
        places.append(n)
    return places


def _hashed(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of one part, and where they begin; edges are where rows begin in it."""
    nothing = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(data) == 0:
        return nothing
    space = IS_SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    first[edges] = ~space[edges]
    starts = np.flatnonzero(first)
    if len(starts) == 0:
        return nothing
    place = np.arange(len(data), dtype=np.int64)
    place[: starts[0]] = 0
    place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(data))))
    powers = np.full(int(place.max()) + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    return mix64(np.add.reduceat(_BYTE_CODES[data] * powers[place], starts)), starts


def word_hashes(data: np.ndarray, offsets: np.ndarray, places: bool = False) -> tuple[np.ndarray, ...]:
    """64-bit hashes of the lower-cased (A-Z) words of the rows, each row's number of words, and with places where words begin.

    A word is a run of bytes without white space, within one row. Rows of any length are
    read in parts, so that what is held beside the result doesn't grow with a row.
    """
    hashes, begins = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    edges = offsets[:-1][np.diff(offsets) > 0]
    parts = cuts(data, offsets)
    for lo, hi in zip(parts[:-1], parts[1:], strict=True):
        inner = edges[np.searchsorted(edges, lo) : np.searchsorted(edges, hi)] - lo
        found, starts = _hashed(data[lo:hi], inner)
        hashes.append(found)
        begins.append(starts + lo)
    starts = np.concatenate(begins)
    counts = np.diff(np.searchsorted(starts, offsets))
    return (np.concatenate(hashes), counts, starts)[: 2 + places]
