"""Spectra from PCM: sampled windows, energies of bands, true bit depth, levels, digests.

Windows are rows keyed by file and number, so that a long file is many rows. Energies
are partial sums per batch that one aggregation adds up; no file is gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spectrum_rules import COARSE_FROM, COARSE_STEP, FINE_FROM, FINE_STEP, FINE_TO, LADDER, PASSBAND, TOP_SHARE

#: A window's samples, how many windows one stands for, the step that moves coarse bands, the reference.
WINDOW, STRIDE, GOLDEN, REFERENCE_HZ, LEVEL_SECONDS = 4096, 8, 0.6180339887498949, 1000, 60
#: Fine bands that a file needs at least, and the rate from which on there are coarse ones.
FINE_BANDS, HIGH_RATE = 3, 48000
#: The terms of the window function.
TERMS = (0.35875, -0.48829, 0.14128, -0.01168)


def window_function(n: int) -> np.ndarray:
    at = 2 * np.pi * np.arange(n) / max(n - 1, 1)
    return sum(a * np.cos(k * at) for k, a in enumerate(TERMS))


def decode_pcm(raw: bytes, bits: int, channels: int) -> np.ndarray:
    """Samples of little-endian signed words, (frames, channels), from -1 to 1."""
    width = bits // 8
    data = np.frombuffer(raw, np.uint8)
    data = data[: len(data) // (width * channels) * width * channels].reshape(-1, width).astype(np.int64)
    value = (data << (8 * np.arange(width))).sum(axis=1)
    value -= (value >> (8 * width - 1)) << (8 * width)
    return value.reshape(-1, channels) / float(1 << (bits - 1))


def band_energy(samples: np.ndarray, rate: int, hz: np.ndarray) -> np.ndarray:
    """|sum x e^(-iwn)|^2 of windows (n, length) at frequencies hz: one product for all of them."""
    angle = 2 * np.pi * np.outer(np.arange(samples.shape[1]), hz) / rate
    return (samples @ np.cos(angle)) ** 2 + (samples @ np.sin(angle)) ** 2


def sample_windows(windows: DataFrame, length: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """Every stride-th window that is complete."""
    frame = F.floor(F.col("bits_per_sample") / 8).cast("int") * F.col("channels")
    return windows.where((F.col("window_idx") % stride == 0) & (F.length("raw") == frame * length))


def grid_of(rate: int) -> list[tuple[int, int]]:
    """(hz, width of its cell) of a rate's bands: fine, refined and coarse; a refined band takes a coarse one's place."""
    top = rate / 2 * TOP_SHARE
    fine = [f for f in range(FINE_FROM, FINE_TO + 1, FINE_STEP) if f < top]
    coarse = list(range(COARSE_FROM, int(top) + 1, COARSE_STEP)) if rate > HIGH_RATE else []
    rungs = LADDER[11025 if rate % 11025 == 0 else 8000] if coarse else ()
    around = (round(rung * PASSBAND / FINE_STEP) * FINE_STEP + k * FINE_STEP for rung in rungs if rung < rate for k in range(-2, 3))
    edges = list(dict.fromkeys(f for f in around if FINE_TO < f < top))
    return [(f, 0) for f in fine] + [(f, FINE_STEP) for f in edges] + [(f, COARSE_STEP) for f in coarse if f not in edges]


def bands_of(rate: int, given: list[tuple[int, int]] | None) -> list[tuple[int, int]] | None:
    """The given bands that a rate has, or its own grid; None if that has too few fine bands."""
    if given is not None:
        return [(hz, cell) for hz, cell in given if hz < rate / 2 * TOP_SHARE]
    grid = grid_of(rate)
    return grid if sum(cell == 0 for _, cell in grid) >= FINE_BANDS else None


_MEASURED = "sample_rate long, hz long, energy double, dead int, windows long"


def _measure(batches: Iterator[pa.RecordBatch], given: list[tuple[int, int]] | None, length: int, stride: int) -> Iterator[pa.RecordBatch]:
    """Energies of a batch's windows: those of one format together, and with one move those of one turn."""
    shape, grids = window_function(length), {}
    for batch in batches:
        keys = batch.column(0).dictionary_encode()
        owner = keys.indices.to_numpy(zero_copy_only=False)
        turn = batch.column(1).to_numpy() // stride + 1
        rates, depths, channels = (batch.column(k).to_numpy() for k in (2, 3, 4))
        raws, parts = batch.column(5), []
        for rate, bits, n in sorted(set(zip(rates.tolist(), depths.tolist(), channels.tolist(), strict=True))):
            if rate not in grids:
                grids[rate] = bands_of(rate, given)
            bands = grids[rate]
            if bands is None:
                continue
            rows = np.flatnonzero((rates == rate) & (depths == bits) & (channels == n))
            data = b"".join(raws[k].as_py() for k in rows.tolist())
            samples = decode_pcm(data, bits, n).mean(axis=1).reshape(len(rows), length) * shape
            still, moving = [hz for hz, cell in bands if not cell], [(hz, cell) for hz, cell in bands if cell]
            energy = np.zeros((len(rows), 1 + len(bands)))
            energy[:, : 1 + len(still)] = band_energy(samples, rate, np.array([REFERENCE_HZ, *still], float))
            for t in np.unique(turn[rows]) if moving else ():
                own = turn[rows] == t
                moved = np.array([hz + ((t * GOLDEN) % 1 - 0.5) * cell for hz, cell in moving])
                energy[own, 1 + len(still) :] = band_energy(samples[own], rate, moved)
            files, place = np.unique(owner[rows], return_inverse=True)
            sums = np.zeros((len(files), energy.shape[1]))
            np.add.at(sums, place, energy)
            width = bits // 8
            used = (np.frombuffer(data, np.uint8).reshape(len(rows), length * n, width) != 0).any(axis=1)
            used[:, width - 1] = True
            dead = np.full(len(files), width, np.int64)
            np.minimum.at(dead, place, used.argmax(axis=1))
            hz = np.array([0, *still, *[hz for hz, _ in moving]], np.int64)
            parts.append((rate, np.repeat(files, len(hz)), np.tile(hz, len(files)), sums.ravel(), None, None))
            parts.append((rate, files, np.full(len(files), -1), np.zeros(len(files)), dead, np.bincount(place)))
        for rate, files, hz, energies, dead, windows in parts:
            columns = [
                keys.dictionary.take(pa.array(files)), pa.array(np.full(len(hz), rate, np.int64)), pa.array(hz, pa.int64()), pa.array(energies),
                pa.nulls(len(hz), pa.int32()) if dead is None else pa.array(dead, pa.int32()), pa.nulls(len(hz), pa.int64()) if windows is None else pa.array(windows, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "sample_rate", "hz", "energy", "dead", "windows"])


def measure(windows: DataFrame, bands: list[tuple[int, int]] | None = None, length: int = WINDOW, stride: int = STRIDE, key: str = "file_id") -> DataFrame:
    """(key, hz, energy, dead, windows, sample_rate): sums of energies, hz 0 the reference; hz -1 the depth.

    bands are (hz, width of the cell that jitter moves it in), fine ones with width 0;
    without them every rate has its own grid, which tasks work out. windows have key,
    window_idx, sample_rate, bits_per_sample, channels and raw. Formats without a rate,
    channels or whole bytes, and grids with too few fine bands, can't be measured and
    have no rows.
    """
    sound = windows.where((F.col("sample_rate") > 0) & (F.col("channels") > 0) & (F.col("bits_per_sample") >= 8))
    taken = sample_windows(sound, length, stride).select(F.col(key).alias("key"), *[F.col(c).cast("long") for c in ("window_idx", "sample_rate", "bits_per_sample", "channels")], "raw")
    part = taken.mapInArrow(lambda batches: _measure(batches, bands, length, stride), f"key {taken.schema['key'].dataType.simpleString()}, {_MEASURED}")
    summed = part.groupBy("key", "sample_rate", "hz").agg(F.sum("energy").alias("energy"), F.min("dead").alias("dead"), F.sum("windows").alias("windows"))
    return summed.withColumnRenamed("key", key)


def gather_levels(measured: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, sample_rate, bands, dead, error) of each file: its levels against the reference as one sorted array.

    Fewer than two windows or a silent reference is an error, and the levels are null.
    """
    at = lambda hz, c: F.max(F.when(F.col("hz") == hz, F.col(c)))
    bands = F.sort_array(F.collect_list(F.when(F.col("hz") > 0, F.struct("hz", "energy"))))
    one = measured.groupBy(key).agg(F.max("sample_rate").cast("int").alias("sample_rate"), bands.alias("_b"), at(0, "energy").alias("_ref"), at(-1, "windows").alias("_n"), at(-1, "dead").alias("dead"))
    bad = F.coalesce((F.col("_n") < 2) | (F.col("_ref") <= 0), F.lit(True))
    level = F.transform("_b", lambda b: F.struct(b["hz"].alias("hz"), F.when(~bad, 10 * F.log10(b["energy"] / F.col("_ref") + 1e-30)).alias("db")))
    return one.select(key, "sample_rate", level.alias("bands"), "dead", F.when(bad, F.lit("fake_unusable")).alias("error"))


def band_levels(measured: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, hz, db, error): levels against the reference; fewer than two windows or silence is an error."""
    levels = gather_levels(measured, key).select(key, "error", F.explode("bands").alias("b"))
    return levels.select(key, "b.hz", "b.db", "error")


def depth_without(dead: Column) -> Column:
    """Bits of samples without their dead bytes; 0 if there are none."""
    return F.when(dead > 0, F.col("bits_per_sample") - 8 * dead).otherwise(0).cast("int")


def real_bits(measured: DataFrame, headers: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, real_bits): depth without the low bytes that are always zero; 0 if there are none."""
    dead = measured.where("hz = -1").select(key, "dead")
    return dead.join(headers.select(key, "bits_per_sample"), key).select(key, depth_without(F.col("dead")).alias("real_bits"))


def _levels(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, peaks, squares, counts = [], [], [], []
        for key, bits, channels, raw, left in zip(*(batch.column(k) for k in range(5)), strict=True):
            x = decode_pcm(raw.as_py() or b"", bits.as_py(), channels.as_py())[: left.as_py()]
            keys.append(key.as_py())
            peaks.append(float(np.abs(x).max()) if x.size else 0.0)
            squares.append(float((x**2).sum()))
            counts.append(x.size)
        columns = [pa.array(keys, kind), pa.array(peaks, pa.float64()), pa.array(squares, pa.float64()), pa.array(counts, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["key", "peak", "squares", "n"])


def signal_levels(windows: DataFrame, length: int = WINDOW, seconds: int = LEVEL_SECONDS, key: str = "file_id") -> DataFrame:
    """(key, peak_db, rms_db) of the first seconds; silence has none."""
    from pyspark.sql.pandas.types import to_arrow_type

    left = F.col("sample_rate").cast("long") * seconds - F.col("window_idx") * length
    first = windows.where((left > 0) & (F.col("channels") > 0) & (F.col("bits_per_sample") >= 8)).select(F.col(key).alias("key"), "bits_per_sample", "channels", "raw", left.alias("left"))
    kind = first.schema["key"].dataType
    arrow = to_arrow_type(kind)
    part = first.mapInArrow(lambda batches: _levels(batches, arrow), f"key {kind.simpleString()}, peak double, squares double, n long")
    part = part.groupBy("key").agg(F.max("peak").alias("peak"), F.sum("squares").alias("squares"), F.sum("n").alias("n"))
    rms = F.sqrt(F.col("squares") / F.nullif(F.col("n"), F.lit(0)))
    level = lambda x: F.when(x > 0, 20 * F.log10(x))
    return part.select(F.col("key").alias(key), level(F.col("peak")).alias("peak_db"), level(rms).alias("rms_db"))


def _digest(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Digests of files whose chunks come one behind the other."""
    names, kinds = ["key", "samples", "md5_hex"], [kind, pa.int64(), pa.string()]
    held, md5, size, frame, done = None, hashlib.md5(), 0, 0, []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * 3
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    begun = False
    for batch in batches:
        for own, channels, bits, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
            if begun and own != held:
                done.append((held, size // frame if frame else 0, md5.hexdigest()))
                md5, size = hashlib.md5(), 0
            held, begun, frame, data = own, True, (channels or 0) * ((bits or 0) // 8), raw.as_py() or b""
            md5.update(data)
            size += len(data)
        yield flush()
    if begun:
        done.append((held, size // frame if frame else 0, md5.hexdigest()))
        yield flush()


def audio_digest(windows: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, samples, md5_hex) of a file's audio.

    A digest can't be merged, so that a file's chunks go by one task in order; they are
    read as a stream, of which one batch is held.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    chunks = windows.select(F.col(key).alias("key"), "channels", "bits_per_sample", "raw", "window_idx").repartition("key").sortWithinPartitions("key", "window_idx").drop("window_idx")
    kind = chunks.schema["key"].dataType
    arrow = to_arrow_type(kind)
    return chunks.mapInArrow(lambda batches: _digest(batches, arrow), f"key {kind.simpleString()}, samples long, md5_hex string").withColumnRenamed("key", key)


def _grids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(rate, hz, cell) for rate in batch.column(0).to_pylist() for hz, cell in grid_of(rate)]
        columns = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int32()), strict=True)], ["sample_rate", "hz", "cell"])


def band_grid(rates: DataFrame) -> DataFrame:
    """(sample_rate, hz, cell): the bands of each rate."""
    return rates.select(F.col("sample_rate").cast("int")).where("sample_rate > 0").distinct().mapInArrow(_grids, "sample_rate int, hz long, cell int")
