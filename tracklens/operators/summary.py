"""Counts, advice and sections of a report, each from one pass over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import BAD, WARN, false_if_null

#: Megabytes a second that a job decodes, encodes and inspects.
DECODE_RATE, ENCODE_RATE, INSPECT_RATE = 25, 12, 5


def eta_seconds(total_bytes: Column, rate: int, jobs: int = 1) -> Column:
    return total_bytes / 1048576 / (rate * max(1, jobs))


def _unpivot(row: DataFrame, names: list[str], always: tuple[str, ...] = ()) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(n).alias("name"), F.col(n).cast("long").alias("n")) for k, n in enumerate(names)])
    return row.select(F.explode(entries).alias("e")).select("e.*").where((F.col("n") > 0) | F.col("name").isin(*always))


def library_summary(report: DataFrame) -> DataFrame:
    """(place, name, n): total, bad and warn always, the others where there are any."""
    tests = {
        "sum_total": F.lit(True), "sev_bad": F.col("severity") == BAD, "sev_warn": F.col("severity") == WARN, "sum_damaged": F.col("really_damaged"), "sum_harmless": F.col("harmless"),
        "sum_unreadable": F.col("unreadable"), "sum_no_md5": F.col("no_md5"), "sum_subset_fix": F.size("fixable") > 0, "sum_subset_keep": F.size("inherent") > 0,
        "sum_fake": F.col("suspicious"), "sum_waste": F.col("wasteful"),
    }
    row = report.agg(*[F.count_if(false_if_null(c)).alias(n) for n, c in tests.items()])
    return _unpivot(row, list(tests), ("sum_total", "sev_bad", "sev_warn"))


def advice(report: DataFrame, jobs: int = 1) -> DataFrame:
    """(place, name, n, eta_s): what to do next, in order; groups without files are left out.

    report has a present flag, false where the file is no longer listed.
    """
    good = F.col("error").isNull()
    tests = {
        "adv_stale": (~F.col("present"), None), "adv_repair": (F.col("really_damaged") | F.col("harmless") | ((F.size("fixable") > 0) & good), None),
        "adv_reencode": (good & F.col("weak"), ENCODE_RATE), "adv_partial": ((F.col("is_partial") == 1) & good, None), "adv_no_md5": (F.col("no_md5"), None),
        "adv_subset_keep": (F.size("inherent") > 0, None), "adv_fake": (false_if_null(F.col("suspicious")), None),
        "adv_inspect": (~F.col("unreadable") & (F.col("inspected") == 0), INSPECT_RATE),
    }
    aggregates = [F.count_if(c).alias(n) for n, (c, _) in tests.items()]
    aggregates += [F.sum(F.when(c, F.col("file_size"))).alias(f"{n}_size") for n, (c, r) in tests.items() if r]
    row = report.agg(*aggregates)
    entries = F.array(*[
        F.struct(F.lit(k).alias("place"), F.lit(n).alias("name"), F.col(n).alias("n"), (F.round(eta_seconds(F.col(f"{n}_size"), r, jobs), 6) if r else F.lit(None).cast("double")).alias("eta_s"))
        for k, (n, (_, r)) in enumerate(tests.items())
    ])
    return row.select(F.explode(entries).alias("e")).select("e.*").where("n > 0")


def has_findings(report: DataFrame) -> DataFrame:
    found = F.col("needs_attention") | (F.col("is_partial") == 1) | F.col("no_md5")
    return report.agg(F.coalesce(F.bool_or(found), F.lit(False)).alias("has_findings"))


def findings(report: DataFrame, everything: bool = False) -> DataFrame:
    """Readable rows that need attention (or all), worst first, then by path."""
    return report.where(F.col("error").isNull() & (F.lit(everything) | F.col("needs_attention"))).orderBy(F.desc("severity"), "path")


def finding_sections(report: DataFrame) -> DataFrame:
    """(section, path): a row per section that a file belongs to."""
    tests = {"damaged": F.col("really_damaged"), "harmless": F.col("harmless"), "unreadable": F.col("unreadable"), "no_md5": F.col("no_md5"), "lying": false_if_null(F.col("suspicious"))}
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]))
    return report.select(F.explode(names).alias("section"), "path")


def inspect_sections(inspected: DataFrame) -> DataFrame:
    """(section, path): lying, wasteful, honest, skipped; a file may be in two."""
    failed = F.col("inspect_error").isNotNull()
    tests = {"lying": F.col("suspicious"), "wasteful": F.col("wasteful") & ~failed, "honest": ~F.col("suspicious") & ~failed, "skipped": failed}
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]))
    return inspected.select(F.explode(names).alias("section"), "path")
