"""Whole jobs from what is on disk to the next report, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.fixtures import fixture
from tracklens.operators import rules
from tracklens.sources import headers as flac
from tracklens.sources import logs

from .analyze import analyze_library, todo_files
from .audit_queries import FULL, LOG_ERROR, LOGS, full_report
from .media_queries import NO_MD5, analysis_lines, head_bytes
from .registry import registry
from .rewrite import rewritten_report, written_outcomes

QUERIES, ORACLE, query = registry()


def last_report(spark: SparkSession, d: str) -> DataFrame:
    """The report of a run before: the fixture's entries with a verdict by number and no findings."""
    n, none = F.col("file_id"), F.array().cast(f"array<{rules.NOTE}>")
    return fixture(spark, d, "fx_previous").select(
        "path", "file_size", "mtime_us", "is_partial", "has_deep", "error", (n % 3).cast("int").alias("severity"), none.alias("reasons"), none.alias("fixable"), none.alias("inherent"),
        F.lit(False).alias("damaged"), F.lit(False).alias("harmless"), (n % 2).cast("int").alias("inspected"), (n % 6 == 1).alias("suspicious"), F.lit(None).cast("string").alias("md5_hex"),
    )


ANALYSIS = f"""{FULL}, {LOGS}, pr AS (SELECT *, true AS there FROM fx_previous),
pl AS (SELECT l.file_id, l.path, coalesce(p.there AND p.is_partial = 0 AND p.file_size = l.file_size AND p.mtime_us = l.mtime_us AND (p.has_deep = 1 OR p.error IS NOT NULL), false) AS reused
  FROM fx_listing l LEFT JOIN pr p ON p.path = l.path),
an AS (SELECT file_id, CASE WHEN file_id % 4 <> 0 THEN {LOG_ERROR} END AS failure FROM logs),
fr AS (SELECT file_id, count(*) AS frames FROM fx_frames GROUP BY file_id),
fresh AS (SELECT pl.path, false AS reused, r.error AS header_error, CASE WHEN r.error IS NULL THEN CASE WHEN an.failure IS NOT NULL THEN an.failure WHEN fr.frames IS NULL THEN 'no_frames' END END AS failure,
  r.severity, r.reasons, r.fixable, r.inherent, dmg.lost, dmg.harmless, r.md5_hex FROM pl JOIN report r USING (file_id) LEFT JOIN an USING (file_id) LEFT JOIN fr USING (file_id) LEFT JOIN dmg USING (file_id) WHERE NOT pl.reused),
merged AS (SELECT path, reused, coalesce(header_error, failure) AS error, CASE WHEN coalesce(header_error, failure) IS NULL THEN severity ELSE 0 END AS severity,
  CASE WHEN failure IS NULL THEN reasons ELSE '' END AS reasons, CASE WHEN failure IS NULL THEN fixable ELSE '' END AS fixable, CASE WHEN failure IS NULL THEN inherent ELSE '' END AS inherent,
  failure IS NOT NULL AS damaged, failure IS NOT NULL AND coalesce(harmless, false) AS harmless, CASE WHEN failure IS NOT NULL THEN lost END AS lost_samples, 0 AS inspected, false AS susp, header_error IS NULL AND md5_hex = {NO_MD5} AS no_md5 FROM fresh
  UNION ALL SELECT p.path, true, p.error, p.file_id % 3, '', '', '', false, false, NULL, p.file_id % 2, p.file_id % 6 = 1, false FROM fx_previous p JOIN pl USING (path) WHERE pl.reused)"""


@query("analyze_library", f"""WITH {ANALYSIS} SELECT path, reused, error, severity, reasons, fixable, inherent, harmless, damaged AND NOT harmless AS really_damaged, error IS NOT NULL AND NOT damaged AS unreadable, no_md5, lost_samples, inspected,
  severity > 0 OR fixable <> '' OR inherent <> '' OR error IS NOT NULL OR susp AS needs_attention FROM merged""")  # fmt: skip
def analyze(spark, d):
    """From header bytes, printed logs and the last report to the next one."""
    listing, previous = fixture(spark, d, "fx_listing").drop("file_id"), last_report(spark, d)
    todo = todo_files(listing, previous).select("path")
    paths = fixture(spark, d, "fx_headers").select("file_id", "path").join(todo, "path")
    lines = analysis_lines(spark, d)
    frames, subframes = (df.join(paths, "file_id").drop("file_id") for df in logs.parse_analysis(lines))
    headers = flac.unpack_headers(flac.read_blocks(head_bytes(spark, d).join(todo, "path"))).drop("blocks")
    runs = fixture(spark, d, "fx_decode_runs")
    ends = runs.select("path", F.when(F.col("file_id") % 4 != 0, F.col("exit_code")).otherwise(0).alias("exit_code"), F.col("stderr").alias("log"))
    found = analyze_library(listing, previous, headers, frames, subframes, ends, runs)
    keys = [rules.note_keys(c).alias(c) for c in ("reasons", "fixable", "inherent")]
    return found.select("path", "reused", "error", "severity", *keys, "harmless", "really_damaged", "unreadable", "no_md5", "lost_samples", "inspected", "needs_attention")


REWRITE = f"""{FULL}, t AS (SELECT f.*, CASE f.file_id % 5 WHEN 0 THEN 'reencode' WHEN 1 THEN 'convert' WHEN 2 THEN 'subset' WHEN 3 THEN 'header' ELSE 'salvage' END AS kind FROM full1 f WHERE file_id % 3 <> 1 AND error IS NULL),
live AS (SELECT t.*, CASE WHEN l.path IS NULL THEN 'gone' WHEN l.file_size = t.file_size AND l.mtime_us = t.mtime_us THEN 'fresh' ELSE 'stale' END AS state FROM t LEFT JOIN fx_listing l ON l.path = t.path),
x AS (SELECT o.*, n.path IS NOT NULL AS there, n.sample_rate AS nr, n.bits_per_sample AS nb, n.channels AS nc, n.total_samples AS ns, n.md5_hex AS nm FROM live o LEFT JOIN fx_new_headers n ON n.path = o.path),
oc AS (SELECT *, CASE WHEN state <> 'fresh' THEN state WHEN NOT there THEN 'missing'
  WHEN kind IN ('reencode', 'subset') THEN CASE WHEN nr <> sample_rate THEN 'sample_rate' WHEN nb <> bits_per_sample THEN 'bits_per_sample' WHEN ns <> total_samples THEN 'total_samples' WHEN nm = {NO_MD5} THEN 'md5_unset'
    WHEN nm <> CASE WHEN md5_hex = {NO_MD5} THEN md5(vendor) ELSE md5_hex END THEN 'md5_differs' END
  WHEN kind = 'convert' THEN CASE WHEN nr <> sample_rate THEN 'sample_rate' WHEN nb <> bits_per_sample THEN 'bits_per_sample' WHEN abs(ns - total_samples) > greatest(8, total_samples // 1000) THEN 'samples' WHEN nm = {NO_MD5} THEN 'md5_unset'
    WHEN file_id % 6 > 3 THEN 'level' END END AS problem FROM x),
oc2 AS (SELECT *, CASE WHEN state <> 'fresh' THEN 'skipped' WHEN problem IS NULL THEN 'done' ELSE 'failed' END AS status FROM oc)"""


@query("rewrite_library", f"""WITH {REWRITE} SELECT f.path, o.kind, o.status, o.problem, CASE WHEN o.status = 'done' THEN o.nr ELSE f.sample_rate END AS sample_rate, coalesce(o.status, '') <> 'done' AND f.really_damaged AS really_damaged,
  CASE WHEN o.status = 'done' THEN 1 ELSE f.is_partial END AS is_partial, CASE WHEN o.status = 'done' AND o.kind IN ('salvage', 'convert') THEN 0 ELSE f.inspected END AS inspected, f.error FROM full1 f LEFT JOIN oc2 o USING (path)""")  # fmt: skip
def rewrite(spark, d):
    """From targets and what was written to checked outcomes and the report put right."""
    report = full_report(spark, d).withColumn("damaged", rules.false_if_null(F.col("damaged")))
    n = F.col("file_id")
    kinds = F.element_at(F.array(*map(F.lit, ("reencode", "convert", "subset", "header", "salvage"))), (n % 5 + 1).cast("int"))
    checks = {"kind": kinds, "audio_md5": F.md5(F.col("vendor").cast("binary")), "target_rate": F.col("sample_rate"), "target_bits": F.col("bits_per_sample"), "old_peak": F.lit(0.0), "old_rms": F.lit(0.0)}
    targets = report.where((n % 3 != 1) & F.col("error").isNull()).withColumns(checks)
    new = fixture(spark, d, "fx_new_headers")
    drift = fixture(spark, d, "fx_headers").select("path", (n % 6).cast("double").alias("new_peak"), F.lit(0.0).alias("new_rms"))
    written = new.join(drift, "path").withColumn("audio_md5", F.col("md5_hex"))
    outcomes = written_outcomes(targets, fixture(spark, d, "fx_listing"), written)
    after = rewritten_report(report, outcomes, new.withColumn("error", F.lit(None).cast("string")))
    told = outcomes.select("path", "kind", "status", "problem")
    return after.join(told, "path", "left").select("path", "kind", "status", "problem", "sample_rate", "really_damaged", "is_partial", "inspected", "error")
