"""PCM of files as windows: a file of fixed-length frames is cut into ranges, and any task reads some.

What a decoder writes, little-endian signed words with interleaved channels and no
header, has its format from the file's header table. Ranges begin at multiples of whole
windows, so that where a file is cut never shows in its windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .files import Ranged, dealt, resolve

#: Bytes of a range, and of windows that a task holds at once.
RANGE_BYTES, HELD_BYTES = 16 << 20, 4 << 20
#: Ranges that a task reads, about, and tasks at most.
RANGES_PER_TASK, MOST_TASKS = 16, 100_000
FORMAT = ("sample_rate", "bits_per_sample", "channels")


def _cut(batches: Iterator[pa.RecordBatch], length: int, stride: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Windows of (key, pcm_path, format..., offset, first, last) rows: every stride-th from first to last."""
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for key, path, rate, bits, channels, offset, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            size = bits // 8 * channels * length
            try:
                with Ranged(path) as f:
                    for window in range(first, last + 1, stride):
                        raw = f.at(offset + window * size, size)
                        rows.append((key, window, rate, bits, channels, raw, None))
                        held += len(raw)
                        if held >= HELD_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, held = [], 0
            except OSError as e:
                rows.append((key, None, rate, bits, channels, None, f"unreadable: {e}"))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def cut_windows(files: DataFrame, length: int, stride: int = 1, key: str = "path", seconds: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(key, window_idx, sample_rate, bits_per_sample, channels, raw, error): every stride-th window of each file.

    files have key, pcm_path, pcm_size, the columns of FORMAT and, where samples don't
    begin at once, pcm_offset. The last window of a file may be short; nothing but the
    windows wanted is read, and with seconds only those that begin within these. A file
    that can't be opened has one row with an error and no window; one whose format has no
    rate, channels or whole bytes has none at all.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    offset = F.coalesce(F.col("pcm_offset").cast("long"), F.lit(0)) if "pcm_offset" in files.columns else F.lit(0).cast("long")
    sound = files.where((F.col("sample_rate") > 0) & (F.col("channels") > 0) & (F.col("bits_per_sample") >= 8))
    size = F.floor(F.col("bits_per_sample") / 8) * F.col("channels") * length
    last = F.ceil(F.greatest(F.coalesce(F.col("pcm_size").cast("long"), F.lit(1)) - offset, F.lit(0)) / size) - 1
    if seconds is not None:
        last = F.least(last, F.ceil(F.col("sample_rate").cast("long") * seconds / F.lit(length)) - 1)
    step = F.greatest(F.floor(F.lit(range_bytes) / size / stride), F.lit(1)) * stride
    ranges = sound.withColumns({"_offset": offset, "_last": last.cast("long"), "_step": step.cast("long")}).where("_last >= 0")
    count = ranges.agg(F.sum(F.ceil((F.col("_last") + 1) / F.col("_step")))).first()[0] or 0
    ranges = ranges.withColumn("_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"), F.col("_step"))))
    ranges = ranges.select(key, "pcm_path", *[F.col(c).cast("int") for c in FORMAT], "_offset", "_first", F.least("_last", F.col("_first") + F.col("_step") - 1).alias("_end"))
    tasks = min(max(int(count) // RANGES_PER_TASK, files.sparkSession.sparkContext.defaultParallelism), MOST_TASKS)
    spread = ranges.repartition(tasks, key, "_first")
    schema = StructType.fromDDL(f"`{key}` {ranges.schema[key].dataType.simpleString()}, window_idx long, sample_rate int, bits_per_sample int, channels int, raw binary, error string")
    arrow = to_arrow_schema(schema)
    return spread.mapInArrow(lambda batches: _cut(batches, length, stride, arrow), schema)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, path, offset, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            md5, size = hashlib.md5(), 0
            try:
                system, inner = resolve(path)
                with system.open_input_file(inner) as f:
                    f.seek(offset)
                    while data := f.read(HELD_BYTES):
                        md5.update(data)
                        size += len(data)
                rows.append((key, size // frame if frame else 0, md5.hexdigest(), None))
            except OSError as e:
                rows.append((key, None, None, f"unreadable: {e}"))
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "samples", "md5_hex", "error"])


def file_digests(files: DataFrame, tasks: int) -> DataFrame:
    """(path, samples, md5_hex, error) of the audio of files (path, pcm_path, pcm_size and format).

    A digest goes through a file from end to end, so that files are placed in tasks by
    their bytes; each is read as a stream and nothing of it is shuffled.
    """
    offset = F.coalesce(F.col("pcm_offset").cast("long"), F.lit(0)) if "pcm_offset" in files.columns else F.lit(0).cast("long")
    frame = F.coalesce(F.col("channels"), F.lit(0)) * F.floor(F.coalesce(F.col("bits_per_sample"), F.lit(0)) / 8)
    placed = dealt(files.where("pcm_path is not null").withColumns({"_offset": offset, "_frame": frame.cast("long")}), tasks, "pcm_size")
    return placed.select("path", "pcm_path", "_offset", "_frame").mapInArrow(_hash, "path string, samples long, md5_hex string, error string")
