"""What a new run measures again: joins of a listing with the last report, all on path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _prefixed(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("path", *[F.col(c).alias(f"prev_{c}") for c in columns], F.lit(True).alias("prev_known"))


def same_on_disk() -> Column:
    return F.col("file_size").eqNullSafe(F.col("prev_file_size")) & F.col("mtime_us").eqNullSafe(F.col("prev_mtime_us"))


def reusable(entry: Column, force: bool = False) -> Column:
    """Whether entry, a file's struct in the last report or null, still tells all of the listed file."""
    same = F.col("file_size").eqNullSafe(entry["file_size"]) & F.col("mtime_us").eqNullSafe(entry["mtime_us"])
    whole = (entry["is_partial"] == 0) & ((entry["has_deep"] == 1) | entry["error"].isNotNull())
    return F.coalesce(entry.isNotNull() & same & whole, F.lit(False)) & F.lit(not force)


def incremental_split(listing: DataFrame, previous: DataFrame, force: bool = False) -> DataFrame:
    """listing with plan: reuse if the last report measured just this file, else todo."""
    entry = F.struct(*[F.col(c) for c in ("file_size", "mtime_us", "is_partial", "has_deep", "error")])
    joined = listing.join(previous.select("path", entry.alias("_entry")), "path", "left")
    return joined.select(*listing.columns, F.when(reusable(F.col("_entry"), force), "reuse").otherwise("todo").alias("plan"))


def new_files(listing: DataFrame, previous: DataFrame) -> DataFrame:
    return listing.join(previous.select("path"), "path", "left_anti")


def drop_vanished(report: DataFrame, listing: DataFrame) -> DataFrame:
    return report.join(listing.select("path"), "path", "left_semi")


def live_targets(targets: DataFrame, listing: DataFrame) -> DataFrame:
    """targets with state: gone (not listed), stale (size or time changed) or fresh."""
    joined = targets.join(_prefixed(listing, ["file_size", "mtime_us"]), "path", "left")
    state = F.when(F.col("prev_known").isNull(), "gone").when(same_on_disk(), "fresh").otherwise("stale")
    return joined.select(*targets.columns, state.alias("state"))


def inspection_todo(report: DataFrame, listing: DataFrame, force: bool = False) -> DataFrame:
    """Listed rows of report to inspect: never inspected, changed on disk, or all."""
    joined = report.join(_prefixed(listing, ["file_size", "mtime_us"]), "path")
    todo = F.lit(force) | F.coalesce(F.col("inspected") == 0, F.lit(True)) | ~same_on_disk()
    return joined.where(todo).select(*report.columns)


def refresh_entries(report: DataFrame, new_headers: DataFrame, outcomes: DataFrame) -> DataFrame:
    """report after files were written: new headers put in place of old ones.

    outcomes (path, kind) tells what was written. A written row is partial and no longer
    damaged; its inspection stays unless the audio moved (salvage, convert). If its new
    header can't be read, only error is set and damaged cleared.
    """
    fields = [c for c in new_headers.columns if c not in ("path", "error")]
    new = new_headers.select("path", *[F.col(c).alias(f"new_{c}") for c in fields], F.col("error").alias("new_error"), F.lit(True).alias("read"))
    joined = report.join(outcomes.select("path", F.col("kind").alias("done_kind")), "path", "left").join(new, "path", "left")
    written = F.col("done_kind").isNotNull()
    good = written & F.coalesce(F.col("read"), F.lit(False)) & F.col("new_error").isNull()
    moved = F.coalesce(F.col("done_kind").isin("salvage", "convert"), F.lit(False))
    out = {c: F.when(good, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in fields}
    out["error"] = F.when(good, F.lit(None)).when(written, F.coalesce("new_error", F.lit("unreadable"))).otherwise(F.col("error")).alias("error")
    out["damaged"] = F.when(written, F.lit(False)).otherwise(F.col("damaged")).alias("damaged")
    out["is_partial"] = F.when(good, 1).otherwise(F.col("is_partial")).alias("is_partial")
    out["inspected"] = F.when(good & moved, 0).otherwise(F.col("inspected")).alias("inspected")
    return joined.select(*[out.get(c, F.col(c)) for c in report.columns])
