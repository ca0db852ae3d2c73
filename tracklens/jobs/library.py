"""The audit of a folder: listed, read, analysed, inspected, and stored as the next report.

Decoders and analysers run outside. What they print or write is read here: logs as lines
by path, PCM as files beside the library. Every step takes only the files that the last
report doesn't cover.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracklens.operators import incremental, rules, spectrum
from tracklens.scratch import stage_table
from tracklens.sources import headers as flac
from tracklens.sources import pcm, report_store
from tracklens.sources.files import list_files, list_tree
from tracklens.streaming.new_files import adopt

from .analyze import analyze_library, todo_files
from .inspect import inspect_library

#: What a decoder's output is called: the library's path below another root, with this behind it.
PCM_SUFFIX = ".pcm"
#: Files that one task reads the heads of, about.
FILES_PER_TASK = 2000


def last_report(spark: SparkSession, store: str, library: str) -> DataFrame:
    """The library's last report; an unusable one counts as none, as its files are simply analysed again."""
    try:
        return report_store.read_report(spark, store, library)
    except ValueError:
        return spark.createDataFrame([], StructType.fromDDL(report_store.REPORT))


def read_heads(files: DataFrame) -> DataFrame:
    """Headers of files (path, file_size, mtime_us), each task reading about FILES_PER_TASK of them."""
    count = files.count()
    return flac.read_headers(files.repartition(max(count // FILES_PER_TASK, min(count, files.sparkSession.sparkContext.defaultParallelism), 1), "path"))


def folder_todo(spark: SparkSession, root: str, store: str, force: bool = False) -> DataFrame:
    """(path, file_size, mtime_us) of the files under root whose logs the next analysis needs."""
    return todo_files(list_files(spark, root), last_report(spark, store, root), force)


def analyze_folder(spark: SparkSession, root: str, store: str, frames: DataFrame, subframes: DataFrame, analyses: DataFrame, decodes: DataFrame, force: bool = False) -> DataFrame:
    """The report of the files under root, stored as the next snapshot of library root.

    frames, subframes, analyses and decodes are as analyze_library takes them, by path;
    they need only cover folder_todo's files. Heads are read from the files that aren't
    reused.
    """
    listing = stage_table(list_files(spark, root), "listing")
    previous = last_report(spark, store, root)
    heads = stage_table(read_heads(todo_files(listing, previous, force)), "heads")
    report = analyze_library(listing, previous, heads, frames, subframes, analyses, decodes, force)
    report_store.write_report(report.select(*[c for c in report.columns if c in _FIELDS or c == "reused"]), store, root)
    return rules.analysis_flags(report_store.read_report(spark, store, root))


_TYPES = dict(c.split(" ", 1) for c in report_store.REPORT.split(", "))
_FIELDS = tuple(_TYPES)
_INSPECTED = tuple(c.split()[0] for c in report_store.INSPECTION.split(", "))


def _as_report(rows: DataFrame) -> DataFrame:
    """rows with the fields of a stored report, null where they lack one."""
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in _TYPES.items()])


def pcm_files(spark: SparkSession, files: DataFrame, root: str, pcm_root: str) -> DataFrame:
    """files with pcm_path and pcm_size of their decoded audio under pcm_root; null where there is none."""
    found = list_tree(spark, pcm_root).where(F.col("path").endswith(PCM_SUFFIX))
    inner = F.substring("path", F.lit(len(pcm_root.rstrip("/")) + 1), F.length("path") - len(pcm_root.rstrip("/")) - len(PCM_SUFFIX))
    named = found.select(F.concat(F.lit(root.rstrip("/")), inner).alias("path"), F.col("path").alias("pcm_path"), F.col("file_size").alias("pcm_size"))
    return files.join(named, "path", "left")


def inspect_folder(spark: SparkSession, root: str, store: str, pcm_root: str, force: bool = False) -> DataFrame:
    """The report of the files under root with their spectra's verdicts, stored as the next snapshot.

    Files that appeared since the last analysis are taken in by header alone, those that
    are gone leave. A file is measured if it never was, has changed since, or with force;
    one whose header can't be read has nothing to measure. A measured file without
    decoded audio has the error fake_unusable.
    """
    listing = stage_table(list_files(spark, root), "listing")
    report = report_store.read_report(spark, store, root)
    new = _as_report(adopt(read_heads(incremental.new_files(listing, report))).withColumns({"damaged": F.lit(False), "inspected": F.lit(0), "has_deep": F.lit(0)}))
    known = stage_table(incremental.drop_vanished(report, listing).unionByName(new), "known")
    readable = known.where(F.col("error").isNull() | F.coalesce("damaged", F.lit(False)))
    todo = incremental.inspection_todo(readable, listing, force).select("path", "sample_rate", "bits_per_sample", "channels")
    todo = stage_table(pcm_files(spark, todo, root, pcm_root), "todo")
    windows = pcm.cut_windows(todo.where("pcm_path is not null"), spectrum.WINDOW, spectrum.STRIDE)
    verdicts = inspect_library(todo.select("path", "bits_per_sample"), windows, key="path")
    verdicts = verdicts.select(F.col("path").alias("_path"), F.struct(*[F.col(c).cast(_TYPES[c]).alias(c) for c in _INSPECTED if c in verdicts.columns]).alias("_new"))
    merged = known.join(verdicts, known["path"] == verdicts["_path"], "left")
    fresh = F.col("_new").isNotNull()
    own = {c: F.when(fresh, F.col("_new")[c]).otherwise(F.col(c)).alias(c) for c in _INSPECTED if c in verdicts.schema["_new"].dataType.names}
    own["inspected"] = F.when(fresh, 1).otherwise(F.coalesce("inspected", F.lit(0))).alias("inspected")
    report_store.write_report(merged.select(*[own.get(c, F.col(c)) for c in _FIELDS]), store, root)
    return rules.analysis_flags(report_store.read_report(spark, store, root))


def folder_digests(spark: SparkSession, files: DataFrame, root: str, pcm_root: str, tasks: int) -> DataFrame:
    """(path, samples, md5_hex, error) of the decoded audio of files (path and format), in tasks of near equal bytes."""
    return pcm.file_digests(stage_table(pcm_files(spark, files, root, pcm_root), "pcm"), tasks)
