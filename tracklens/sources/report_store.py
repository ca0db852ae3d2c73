"""Reports kept between runs: snapshots, of which a manifest names the one that counts.

A run writes its rows to a folder of their own and then, in one step, a manifest with the
next number. Until then, and if the run fails, readers see the report before; a report
can be read and its successor written to one place. What isn't stored is left out, damage
and inspections are nested, and a field that an older snapshot lacks takes its default.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tracklens.operators.rules import NOTE
from tracklens.scratch import hadoop_path

VERSION = 1
#: What a missing field of an older report counts as.
DEFAULTS = {"is_partial": 0, "inspected": 0, "has_deep": 0, "severity": 0, "damaged": False, "harmless": False, "truncated": False, "whole_frames_only": False, "suspicious": False}
#: Fields that are read from disk again, or are far bigger than what was concluded from them.
NOT_STORED = ("streaminfo_offset", "bytes_read", "blocks", "bands", "reused", "dead")
#: Fields of a report's row, of its damage and of its inspection.
ROW = (
    "path string, file_size long, mtime_us long, audio_size long, sample_rate int, channels int, bits_per_sample int, min_blocksize int, max_blocksize int, total_samples long, md5_hex string, vendor string,"
    " error string, damaged boolean, is_partial int, has_deep int, frames long, subframes long, lpc long, constant long, max_lpc_order int, avg_lpc_order double, max_partition_order int, lpc_share double,"
    f" stereo_mode string, severity int, reasons array<{NOTE}>, fixable array<{NOTE}>, inherent array<{NOTE}>, inspected int"
)
DAMAGE = "lost_samples long, truncated boolean, whole_frames_only boolean, harmless boolean, error_positions array<long>"
INSPECTION = (
    "cliff_db double, cutoff_hz long, gap_db double, spread_db double, source_rate long, content_why string, content_hz long, ultra_level_db double, ultra_peak_hz long, enough_rate long, real_bits int,"
    " inspect_error string,"
    " lossy_source boolean, upsampled boolean, padded_depth boolean, wasteful boolean, suspicious boolean"
)
REPORT = f"{ROW}, {DAMAGE}, {INSPECTION}"
_NESTED = {"damage": [c.split()[0] for c in DAMAGE.split(", ")], "inspection": [c.split()[0] for c in INSPECTION.split(", ")]}


def nest(report: DataFrame) -> DataFrame:
    """report as it is stored: without NOT_STORED, damage null where there is none, inspection null where none was made."""
    held = {"damage": F.col("damaged") if "damaged" in report.columns else F.lit(True), "inspection": F.col("inspected") == 1 if "inspected" in report.columns else F.lit(True)}
    parts = []
    for name, fields in _NESTED.items():
        own = [c for c in fields if c in report.columns]
        if own:
            parts.append(F.when(held[name], F.struct(*own)).alias(name))
    inner = [c for fields in _NESTED.values() for c in fields]
    return report.select(*[c for c in report.columns if c not in inner and c not in NOT_STORED], *parts)


def _nested_schema(flat: StructType) -> StructType:
    outer = [f for f in flat if not any(f.name in fields for fields in _NESTED.values())]
    return StructType([*outer, *[StructField(name, StructType([f for f in flat if f.name in fields])) for name, fields in _NESTED.items() if any(f.name in fields for f in flat)]])


def _folder(path: str, library: str) -> str:
    return f"{path.rstrip('/')}/{hashlib.sha256(library.encode()).hexdigest()[:32]}"


def _manifests(spark: SparkSession, folder: str) -> list[str]:
    """Numbers of a library's manifests, the last first."""
    fs, where = hadoop_path(spark, folder)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted((n.removeprefix("manifest-").removesuffix(".json") for n in names if n.startswith("manifest-") and n.endswith(".json")), reverse=True)


def _manifest(spark: SparkSession, folder: str, number: str) -> dict | None:
    """What a manifest says; None if its writing broke off."""
    fs, where = hadoop_path(spark, f"{folder}/manifest-{number}.json")
    stream = fs.open(where)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        return json.loads(text)
    except ValueError:
        return None


def _latest(spark: SparkSession, folder: str) -> tuple[int, dict | None]:
    """(the highest number in use, the manifest that counts)."""
    numbers = _manifests(spark, folder)
    for number in numbers:
        found = _manifest(spark, folder, number)
        if found is not None:
            return int(numbers[0]), found
    return (int(numbers[0]) if numbers else 0), None


def write_report(report: DataFrame, path: str, library: str) -> int:
    """Store report as the library's next snapshot and return its number.

    report may read the snapshot before. Where another run has committed meanwhile this
    one fails, and its rows count for nothing.
    """
    spark, folder = report.sparkSession, _folder(path, library)
    number = _latest(spark, folder)[0] + 1
    snapshot = f"snapshot-{uuid.uuid4().hex}"
    nest(report).write.parquet(f"{folder}/{snapshot}")
    fs, where = hadoop_path(spark, f"{folder}/manifest-{number:012d}.json")
    try:
        stream = fs.create(where, False)
    except Py4JJavaError as e:
        raise RuntimeError(f"another run has written {library} meanwhile") from e
    try:
        stream.write(bytearray(json.dumps({"version": VERSION, "library": library, "snapshot": snapshot}).encode()))
    finally:
        stream.close()
    return number


def read_report(spark: SparkSession, path: str, library: str, schema: str = REPORT) -> DataFrame:
    """The last report of a library, flat; empty if there is none.

    Fields it lacks take their defaults. A report of another version is an error: taken
    for empty, it would make all files new and lose every inspection.
    """
    flat = StructType.fromDDL(schema)
    folder = _folder(path, library)
    manifest = _latest(spark, folder)[1]
    if manifest is None:
        return spark.createDataFrame([], flat)
    if manifest.get("version") != VERSION:
        raise ValueError(f"the report of {library} has version {manifest.get('version')}, not {VERSION}")
    stored = spark.read.schema(_nested_schema(flat)).parquet(f"{folder}/{manifest['snapshot']}")
    inner = {f: F.col(f"{name}.{f}").alias(f) for name, fields in _NESTED.items() for f in fields}
    rows = stored.select(*[inner.get(f.name, F.col(f.name)) for f in flat])
    return rows.na.fill({c: v for c, v in DEFAULTS.items() if c in rows.columns})


def expire(spark: SparkSession, path: str, library: str, keep: int = 2) -> int:
    """Drop a library's snapshots but the last keep, and those that no manifest names; returns how many went.

    To be run while no other run writes.
    """
    folder = _folder(path, library)
    numbers = _manifests(spark, folder)
    kept = [m for m in (_manifest(spark, folder, n) for n in numbers) if m is not None][: max(keep, 1)]
    names = {m["snapshot"] for m in kept}
    fs, where = hadoop_path(spark, folder)
    gone = 0
    for status in fs.listStatus(where) if numbers else ():
        if status.getPath().getName().startswith("snapshot-") and status.getPath().getName() not in names:
            fs.delete(status.getPath(), True)
            gone += 1
    for number in numbers:
        found = _manifest(spark, folder, number)
        if found is not None and found["snapshot"] not in names:
            fs.delete(hadoop_path(spark, f"{folder}/manifest-{number}.json")[1], False)
    return gone
