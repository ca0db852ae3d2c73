"""The analysis job: a listing and the last report to the next report, one row per file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.operators import damage, deep, incremental, rules

#: What damage_measures finds; null for files that aren't damaged.
LOSSES = {"lost_samples": "long", "truncated": "boolean", "whole_frames_only": "boolean", "harmless": "boolean", "error_positions": "array<long>"}


def todo_files(listing: DataFrame, previous: DataFrame, force: bool = False) -> DataFrame:
    """The listed files that must be read again; bytes and logs of all others needn't be read."""
    return incremental.incremental_split(listing, previous, force).where("plan = 'todo'").drop("plan")


def analyze_library(
    listing: DataFrame, previous: DataFrame, headers: DataFrame, frames: DataFrame, subframes: DataFrame, analyses: DataFrame, decodes: DataFrame, force: bool = False
) -> DataFrame:
    """The report of the files in listing, with reused and the analysis flags.

    listing (path, file_size, mtime_us); previous is the stored report of the last run,
    empty at first; headers (path, error, fields of STREAMINFO); frames and subframes are
    parsed logs by path; analyses (path, exit_code, log) tells how their tool ended;
    decodes (path, decoded_samples, stderr) are the runs that go on past errors.

    A file that hasn't changed since a whole entry keeps that entry, with its inspection.
    All others are classified anew: a file whose header can't be read has its error, one
    whose log tells of a failure or has no frames is damaged, with an error and no
    statistics; losses are measured for these only. A listed file without a header row
    has the error unreadable. Files that are gone leave the report.

    Frames and subframes become a row a file, map-side, before anything is joined; then
    all tables meet in one chain of joins by path, of one row a file each.
    """
    entry = previous.select("path", F.struct(*previous.columns).alias("_entry"))
    known = headers.drop("file_size", "mtime_us").withColumn("_header", F.lit(True))
    stats = deep.deep_stats(subframes, frames, "path")
    ends = analyses.select("path", F.col("exit_code").alias("_exit"), damage.log_error(F.col("log")).alias("_message"))
    runs = decodes.select("path", "decoded_samples", damage.error_positions(F.col("stderr")).alias("error_positions"), F.lit(True).alias("_run"))
    rows = listing.select("path", "file_size", "mtime_us")
    for other in (entry, known, stats, ends, runs):
        rows = rows.join(other, "path", "left")
    rows = rows.withColumn("_reuse", incremental.reusable(F.col("_entry"), force))

    header = F.coalesce("error", F.when(F.col("_header").isNull(), F.lit("unreadable")))
    failure = F.when(header.isNull(), damage.deep_error(F.coalesce("_exit", F.lit(0)), F.col("frames"), F.col("_message")))
    rows = rows.withColumns({"error": F.coalesce(header, failure), "damaged": failure.isNotNull()})
    measures = [c for c in stats.columns if c != "path"]
    whole = F.col("error").isNull()
    rows = rows.withColumns({c: F.when(whole, F.col(c)) for c in measures} | {"has_deep": F.when(whole, 1).otherwise(0)})
    lost = F.col("damaged") & F.coalesce("_run", F.lit(False))
    rows = damage.damage_measures(rows)
    rows = rows.withColumns({c: F.when(lost, F.col(c)).cast(t) for c, t in LOSSES.items()}).drop("decoded_samples")
    fresh = rules.classify(rows).withColumns({"is_partial": F.lit(0), "inspected": F.lit(0), "suspicious": F.lit(False)})
    own = [c for c in fresh.columns if not c.startswith("_")]
    old = {c: F.col("_entry")[c] for c in previous.columns}
    none = F.lit(None)
    merged = [F.when(F.col("_reuse"), old.get(c, none)).otherwise(F.col(c)).alias(c) for c in own] + [F.when(F.col("_reuse"), old[c]).alias(c) for c in old if c not in own and c != "reused"]
    return rules.analysis_flags(fresh.select(*merged, F.col("_reuse").alias("reused")))
