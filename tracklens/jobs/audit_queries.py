"""Queries over derived fixtures for the rules, aggregations and joins of a report, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.fixtures import fixture
from tracklens.operators import damage, deep, incremental, rules, summary

from .registry import registry
from .report import classified_report

QUERIES, ORACLE, query = registry()


DEEP = """
s AS (SELECT file_id, count(*) AS subframes, sum(CASE WHEN type = 'LPC' THEN 1 ELSE 0 END) AS lpc, sum(CASE WHEN type = 'CONSTANT' THEN 1 ELSE 0 END) AS constant,
  max(CASE WHEN type = 'LPC' THEN lpc_order END) AS max_lpc_order, avg(CASE WHEN type = 'LPC' THEN lpc_order END) AS avg_lpc_order, max(CASE WHEN type IS NOT NULL THEN partition_order END) AS max_partition_order
  FROM fx_subframes GROUP BY file_id),
f AS (SELECT file_id, count(*) AS frames, CASE WHEN count(channel_assignment) = 0 THEN '?' WHEN bool_or(channel_assignment IN ('LEFT_SIDE', 'RIGHT_SIDE')) THEN '-m'
  WHEN bool_or(channel_assignment = 'MID_SIDE') THEN '-M' ELSE 'INDEPENDENT' END AS stereo_mode FROM fx_frames GROUP BY file_id),
deep AS (SELECT *, CASE WHEN subframes = constant THEN 1.0 ELSE lpc / CAST(subframes - constant AS DOUBLE) END AS lpc_share FROM s JOIN f USING (file_id))
"""
REPORT = f"""{DEEP},
h AS (SELECT fx_headers.*, subframes, lpc_share, max_lpc_order, avg_lpc_order, max_partition_order, stereo_mode,
  CASE WHEN sample_rate <= 48000 THEN max_blocksize = 1152 WHEN sample_rate <= 96000 THEN max_blocksize IN (1152, 2304) ELSE max_blocksize IN (1152, 4608) END OR max_blocksize < 1152 AS low,
  CASE WHEN sample_rate <= 48000 THEN max_blocksize NOT IN (4096, 4608) WHEN sample_rate <= 96000 THEN max_blocksize NOT IN (4096, 8192) ELSE max_blocksize NOT IN (4096, 16384) END AS strange
  FROM fx_headers LEFT JOIN deep USING (file_id)),
c0 AS (SELECT *, CASE WHEN low OR coalesce(lpc_share = 0, false) THEN 2 WHEN coalesce(lpc_share < 0.5, false) THEN 1 ELSE 0 END AS sev0,
  coalesce(channels > 1 AND stereo_mode = 'INDEPENDENT', false) AS plain FROM h),
report AS (SELECT *, CASE WHEN error IS NOT NULL THEN 0 WHEN plain THEN greatest(sev0, 1) ELSE sev0 END AS severity,
  CASE WHEN error IS NOT NULL THEN '' ELSE concat_ws(',', CASE WHEN low THEN 'why_blocksize_low' END, CASE WHEN NOT low AND strange THEN 'why_blocksize_odd' END,
    CASE WHEN lpc_share = 0 THEN 'why_no_lpc' END, CASE WHEN lpc_share > 0 AND lpc_share < 0.5 THEN 'why_low_lpc' END,
    CASE WHEN max_lpc_order <= 6 AND sev0 > 0 THEN 'why_low_order' END, CASE WHEN plain THEN 'why_no_stereo' END) END AS reasons,
  CASE WHEN error IS NOT NULL THEN '' ELSE concat_ws(',', CASE WHEN max_blocksize > CASE WHEN sample_rate > 48000 THEN 16384 ELSE 4608 END THEN 'sub_blocksize' END,
    CASE WHEN sample_rate <= 48000 AND max_lpc_order > 12 THEN 'sub_lpc' END, CASE WHEN max_partition_order > 8 THEN 'sub_partition' END) END AS fixable,
  CASE WHEN error IS NOT NULL THEN '' ELSE concat_ws(',', CASE WHEN bits_per_sample NOT IN (8, 12, 16, 20, 24, 32) THEN 'sub_bps' END,
    CASE WHEN NOT (sample_rate IN (8000, 16000, 22050, 24000, 32000, 44100, 48000, 88200, 96000, 176400, 192000) OR (sample_rate % 1000 = 0 AND sample_rate <= 255000)
      OR sample_rate <= 65535 OR (sample_rate % 10 = 0 AND sample_rate <= 655350)) THEN 'sub_rate' END) END AS inherent
  FROM c0)
"""


def report(spark: SparkSession, d: str) -> DataFrame:
    return classified_report(fixture(spark, d, "fx_headers"), fixture(spark, d, "fx_subframes"), fixture(spark, d, "fx_frames"))


@query("a1_subframe_stats", f"WITH {DEEP} SELECT file_id, frames, subframes, max_lpc_order, round(avg_lpc_order, 6) AS avg_lpc_order, max_partition_order FROM deep")
def a1(spark, d):
    found = deep.deep_stats(fixture(spark, d, "fx_subframes"), fixture(spark, d, "fx_frames"))
    return found.select("file_id", "frames", "subframes", "max_lpc_order", F.round("avg_lpc_order", 6).alias("avg_lpc_order"), "max_partition_order")


@query("a2_subframe_types", "WITH t AS (SELECT file_id, type, count(*) AS n FROM fx_subframes WHERE type IS NOT NULL GROUP BY ALL) SELECT file_id, string_agg(type || ':' || n, ',' ORDER BY type) AS types FROM t GROUP BY file_id")
def a2(spark, d):
    found = deep.type_histogram(fixture(spark, d, "fx_subframes"))
    return found.select("file_id", F.array_join(F.transform(F.map_entries("types"), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("types"))


@query("a3_lpc_share", f"WITH {DEEP} SELECT file_id, round(lpc_share, 9) AS lpc_share FROM deep")
def a3(spark, d):
    return deep.subframe_stats(fixture(spark, d, "fx_subframes")).select("file_id", F.round(deep.lpc_share(), 9).alias("lpc_share"))


@query("a4_stereo_mode", f"WITH {DEEP} SELECT file_id, stereo_mode FROM f")
def a4(spark, d):
    return deep.frame_stats(fixture(spark, d, "fx_frames")).select("file_id", "stereo_mode")


@query("p4_compression_ratio", "SELECT file_id, CASE WHEN audio_size > 0 AND total_samples * channels * bits_per_sample > 0 THEN round(audio_size / (total_samples * channels * bits_per_sample / 8.0), 9) END AS ratio FROM fx_headers")
def p4(spark, d):
    ratio = rules.compression_ratio(F.col("audio_size"), F.col("total_samples"), F.col("channels"), F.col("bits_per_sample"))
    return fixture(spark, d, "fx_headers").select("file_id", F.round(ratio, 9).alias("ratio"))


@query("p6_blocksizes_for_rate", """SELECT file_id, sample_rate > 48000 AS hi_rate, CASE WHEN sample_rate <= 48000 THEN '1152' WHEN sample_rate <= 96000 THEN '1152,2304' ELSE '1152,4608' END AS weak,
  CASE WHEN sample_rate <= 48000 THEN '4096,4608' WHEN sample_rate <= 96000 THEN '4096,8192' ELSE '4096,16384' END AS normal FROM fx_headers""")  # fmt: skip
def p6(spark, d):
    rate = F.col("sample_rate")
    join = lambda c: F.array_join(c, ",")
    return fixture(spark, d, "fx_headers").select("file_id", rules.hi_rate(rate).alias("hi_rate"), join(rules.weak_sizes(rate)).alias("weak"), join(rules.normal_sizes(rate)).alias("normal"))


@query("p7_rate_is_codable", """SELECT file_id, rate, rate IN (8000, 16000, 22050, 24000, 32000, 44100, 48000, 88200, 96000, 176400, 192000) OR (rate % 1000 = 0 AND rate // 1000 <= 255) OR rate <= 65535
  OR (rate % 10 = 0 AND rate // 10 <= 65535) AS codable FROM (SELECT file_id, sample_rate + file_id % 7 AS rate FROM fx_headers)""")  # fmt: skip
def p7(spark, d):
    rows = fixture(spark, d, "fx_headers").select("file_id", (F.col("sample_rate") + F.col("file_id") % 7).alias("rate"))
    return rows.select("file_id", "rate", rules.rate_is_codable(F.col("rate")).alias("codable"))


@query("p8_subset_violations", f"WITH {REPORT} SELECT file_id, fixable, inherent FROM report")
def p8(spark, d):
    return report(spark, d).select("file_id", rules.note_keys("fixable").alias("fixable"), rules.note_keys("inherent").alias("inherent"))


@query("p9_classify", f"WITH {REPORT} SELECT file_id, severity, reasons FROM report")
def p9(spark, d):
    return report(spark, d).select("file_id", "severity", rules.note_keys("reasons").alias("reasons"))


RUNS = """
m AS (SELECT file_id, regexp_extract_all(stderr, 'after processing ([0-9]+) samples', 1) AS found FROM fx_decode_runs),
runs AS (SELECT r.*, total_samples, max_blocksize, sample_rate, greatest(0, total_samples - decoded_samples) AS lost,
  list_filter(found, lambda x, i: list_position(found, x) = i) AS positions
  FROM fx_decode_runs r JOIN m USING (file_id) JOIN fx_headers h USING (file_id)),
dmg AS (SELECT *, lost > 0 AS truncated, lost > 0 AND max_blocksize > 0 AND decoded_samples % max_blocksize = 0 AND lost < max_blocksize AS whole_frames_only,
  lost > 0 AND max_blocksize > 0 AND decoded_samples % max_blocksize = 0 AND lost < max_blocksize AND len(positions) = 0 AS harmless FROM runs)
"""


def damage_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = fixture(spark, d, "fx_decode_runs").withColumn("error_positions", damage.error_positions(F.col("stderr")))
    headers = fixture(spark, d, "fx_headers").select("file_id", "total_samples", "max_blocksize", "sample_rate")
    return damage.damage_measures(runs.join(headers, "file_id"))


@query("a19_error_positions", f"WITH {RUNS} SELECT file_id, array_to_string(positions, ',') AS positions FROM runs")
def a19(spark, d):
    return damage_runs(spark, d).select("file_id", F.array_join(F.col("error_positions").cast("array<string>"), ",").alias("positions"))


@query("p14_damage_measures", f"WITH {RUNS} SELECT file_id, lost AS lost_samples, truncated, whole_frames_only, harmless FROM dmg")
def p14(spark, d):
    return damage_runs(spark, d).select("file_id", "lost_samples", "truncated", "whole_frames_only", "harmless")


@query("p15_damage_position", f"""WITH {RUNS} SELECT file_id, round(decoded_samples / CAST(sample_rate AS DOUBLE), 6) AS seconds, round(decoded_samples / CAST(total_samples AS DOUBLE) * 100, 6) AS pct,
  CASE WHEN decoded_samples / CAST(total_samples AS DOUBLE) * 100 < 10 THEN 'start' WHEN decoded_samples / CAST(total_samples AS DOUBLE) * 100 > 90 THEN 'end' ELSE 'middle' END AS zone FROM runs""")  # fmt: skip
def p15(spark, d):
    seconds, pct, zone = damage.damage_position(F.col("decoded_samples"), F.col("sample_rate"), F.col("total_samples"))
    return damage_runs(spark, d).select("file_id", F.round(seconds, 6).alias("seconds"), F.round(pct, 6).alias("pct"), zone.alias("zone"))


LOG_ERROR = """CASE WHEN len(ls) = 0 THEN 'no_output' WHEN len(es) > 0 THEN ltrim(substr(es[1], position('ERROR' IN es[1]) + 5), ' ,:') ELSE ls[len(ls)] END"""
LOGS = """
l0 AS (SELECT file_id, exit_code, list_filter(list_transform(string_split(stderr, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM fx_decode_runs),
logs AS (SELECT *, list_filter(ls, lambda x: contains(x, 'ERROR')) AS es FROM l0)
"""


@query("p19_log_error", f"WITH {LOGS} SELECT file_id, {LOG_ERROR} AS message FROM logs")
def p19(spark, d):
    return fixture(spark, d, "fx_decode_runs").select("file_id", damage.log_error(F.col("stderr")).alias("message"))


@query("p20_deep_error", f"""WITH {LOGS}, fr AS (SELECT file_id, count(*) AS frames FROM fx_frames GROUP BY file_id)
  SELECT file_id, CASE WHEN code <> 0 THEN {LOG_ERROR} WHEN coalesce(frames, 0) = 0 THEN 'no_frames' END AS error,
  code <> 0 OR coalesce(frames, 0) = 0 AS damaged FROM (SELECT *, file_id % 2 AS code FROM logs) LEFT JOIN fr USING (file_id)""")  # fmt: skip
def p20(spark, d):
    frames = deep.frame_stats(fixture(spark, d, "fx_frames"))
    runs = fixture(spark, d, "fx_decode_runs").join(frames, "file_id", "left")
    error = damage.deep_error(F.col("file_id") % 2, F.col("frames"), damage.log_error(F.col("stderr")))
    return runs.select("file_id", error.alias("error")).withColumn("damaged", F.col("error").isNotNull())


#: A report with flags: damage from decode runs, inspections derived from the file's number.
FULL = f"""{REPORT}, {RUNS},
full0 AS (SELECT report.*, truncated IS NOT NULL AND (truncated OR len(positions) > 0) AS dam, coalesce(harmless, false) AND truncated AS harm,
  report.file_id % 6 = 1 AND report.error IS NULL AS susp, report.file_id % 6 = 2 AND report.error IS NULL AS waste,
  CASE WHEN report.file_id % 4 = 0 THEN 0 ELSE 1 END AS inspected, CASE WHEN report.file_id % 29 = 7 THEN 1 ELSE 0 END AS is_partial
  FROM report LEFT JOIN dmg USING (file_id)),
full1 AS (SELECT *, severity > 0 AS weak, dam AND NOT harm AS really_damaged, error IS NOT NULL AND NOT dam AS unreadable, coalesce(md5_hex = repeat('0', 32), false) AS no_md5,
  severity > 0 OR fixable <> '' OR inherent <> '' OR error IS NOT NULL OR susp AS needs_attention FROM full0)
"""


def full_report(spark: SparkSession, d: str) -> DataFrame:
    runs = damage_runs(spark, d).select("file_id", (F.col("truncated") | (F.size("error_positions") > 0)).alias("damaged"), "harmless")
    found = report(spark, d).join(runs, "file_id", "left")
    good, n = F.col("error").isNull(), F.col("file_id")
    found = found.withColumns({
        "suspicious": (n % 6 == 1) & good, "wasteful": (n % 6 == 2) & good, "inspected": F.when(n % 4 == 0, 0).otherwise(1), "is_partial": F.when(n % 29 == 7, 1).otherwise(0),
    })
    return rules.analysis_flags(found)


@query("p10_analysis_flags", f"WITH {FULL} SELECT file_id, weak, harm AS harmless, really_damaged, unreadable, no_md5, needs_attention FROM full1")
def p10(spark, d):
    return full_report(spark, d).select("file_id", "weak", "harmless", "really_damaged", "unreadable", "no_md5", "needs_attention")


SUMMARY = ["sum_total:true", "sev_bad:severity = 2", "sev_warn:severity = 1", "sum_damaged:really_damaged", "sum_harmless:harm", "sum_unreadable:unreadable", "sum_no_md5:no_md5",
           "sum_subset_fix:fixable <> ''", "sum_subset_keep:inherent <> ''", "sum_fake:susp", "sum_waste:waste"]


@query("a8_library_summary", f"WITH {FULL} SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT {k} AS place, '{x.partition(':')[0]}' AS name, count(*) FILTER ({x.partition(':')[2]}) AS n FROM full1" for k, x in enumerate(SUMMARY)
) + ") WHERE place < 3 OR n > 0")
def a8(spark, d):
    return summary.library_summary(full_report(spark, d))


ADVICE = ["adv_stale:file_id % 17 = 3:0", "adv_repair:really_damaged OR harm OR (fixable <> '' AND error IS NULL):0", "adv_reencode:error IS NULL AND weak:12", "adv_partial:is_partial = 1 AND error IS NULL:0",
          "adv_no_md5:no_md5:0", "adv_subset_keep:inherent <> '':0", "adv_fake:susp:0", "adv_inspect:NOT unreadable AND inspected = 0:5"]


@query("a9_advice", f"WITH {FULL} SELECT * FROM (" + " UNION ALL ".join(
    (lambda n, c, r: f"SELECT {k} AS place, '{n}' AS name, count(*) FILTER ({c}) AS n, " + (f"round(sum(file_size) FILTER ({c}) / 1048576.0 / {r}, 6)" if r != "0" else "CAST(NULL AS DOUBLE)") + " AS eta_s FROM full1")(*x.split(":")) for k, x in enumerate(ADVICE)
) + ") WHERE n > 0")
def a9(spark, d):
    listed = fixture(spark, d, "fx_listing").select("path", F.lit(True).alias("present"))
    found = full_report(spark, d).join(listed, "path", "left").withColumn("present", F.coalesce("present", F.lit(False)))
    return summary.advice(found)


@query("a10_has_findings", f"WITH {FULL} SELECT bool_or(needs_attention OR is_partial = 1 OR no_md5) AS has_findings FROM full1")
def a10(spark, d):
    return summary.has_findings(full_report(spark, d))


@query("o1_findings", f"WITH {FULL} SELECT path, severity, reasons, fixable, inherent FROM full1 WHERE error IS NULL AND needs_attention ORDER BY severity DESC, path")
def o1(spark, d):
    keys = [rules.note_keys(c).alias(c) for c in ("reasons", "fixable", "inherent")]
    return summary.findings(full_report(spark, d)).select("path", "severity", *keys)


@query("o2_finding_sections", f"WITH {FULL} " + " UNION ALL ".join(f"SELECT '{n}' AS section, path FROM full1 WHERE {c}" for n, c in (("damaged", "really_damaged"), ("harmless", "harm"), ("unreadable", "unreadable"), ("no_md5", "no_md5"), ("lying", "susp"))))
def o2(spark, d):
    return summary.finding_sections(full_report(spark, d))


@query("j1_incremental_split", """SELECT l.path, CASE WHEN p.path IS NOT NULL AND p.is_partial = 0 AND p.file_size = l.file_size AND p.mtime_us = l.mtime_us AND (p.has_deep = 1 OR p.error IS NOT NULL) THEN 'reuse' ELSE 'todo' END AS plan
  FROM fx_listing l LEFT JOIN fx_previous p ON l.path = p.path""")  # fmt: skip
def j1(spark, d):
    return incremental.incremental_split(fixture(spark, d, "fx_listing"), fixture(spark, d, "fx_previous")).select("path", "plan")


@query("j2_new_files", f"WITH {REPORT.strip().replace('deep AS', 'deep0 AS', 1).replace('LEFT JOIN deep USING', 'LEFT JOIN (SELECT * FROM deep0 WHERE false) USING', 1)} SELECT l.path, severity, reasons, 1 AS is_partial FROM fx_listing l JOIN report USING (path) WHERE NOT EXISTS (SELECT 1 FROM fx_previous p WHERE p.path = l.path)")
def j2(spark, d):
    fresh = incremental.new_files(fixture(spark, d, "fx_listing"), fixture(spark, d, "fx_previous")).select("path")
    empty = {"lpc_share": "double", "max_lpc_order": "int", "max_partition_order": "int", "stereo_mode": "string"}
    headers = fresh.join(fixture(spark, d, "fx_headers"), "path").withColumns({c: F.lit(None).cast(t) for c, t in empty.items()})
    return rules.classify(headers).select("path", "severity", rules.note_keys("reasons").alias("reasons"), F.lit(1).alias("is_partial"))


@query("j3_drop_vanished", "SELECT file_id, path FROM fx_previous p WHERE EXISTS (SELECT 1 FROM fx_listing l WHERE l.path = p.path)")
def j3(spark, d):
    return incremental.drop_vanished(fixture(spark, d, "fx_previous"), fixture(spark, d, "fx_listing")).select("file_id", "path")


@query("j4_live_targets", """SELECT p.path, CASE WHEN l.path IS NULL THEN 'gone' WHEN p.file_size = l.file_size AND p.mtime_us = l.mtime_us THEN 'fresh' ELSE 'stale' END AS state
  FROM fx_previous p LEFT JOIN fx_listing l ON l.path = p.path""")  # fmt: skip
def j4(spark, d):
    return incremental.live_targets(fixture(spark, d, "fx_previous"), fixture(spark, d, "fx_listing")).select("path", "state")


@query("j5_inspection_todo", """SELECT p.path FROM fx_previous p JOIN fx_listing l USING (path) WHERE p.file_id % 4 = 0 OR p.file_size <> l.file_size OR p.mtime_us <> l.mtime_us""")
def j5(spark, d):
    previous = fixture(spark, d, "fx_previous").withColumn("inspected", F.when(F.col("file_id") % 4 == 0, 0).otherwise(1))
    return incremental.inspection_todo(previous, fixture(spark, d, "fx_listing")).select("path")


@query("j6_refresh_entries", f"""WITH {FULL}, w AS (SELECT path, CASE file_id % 5 WHEN 0 THEN 'reencode' WHEN 1 THEN 'convert' WHEN 2 THEN 'subset' WHEN 3 THEN 'header' ELSE 'salvage' END AS kind FROM fx_headers WHERE file_id % 3 = 0 AND error IS NULL)
  SELECT f.path, CASE WHEN n.path IS NOT NULL AND w.path IS NOT NULL THEN n.sample_rate ELSE f.sample_rate END AS sample_rate,
  CASE WHEN w.path IS NULL THEN f.error WHEN n.path IS NULL THEN 'unreadable' END AS error, CASE WHEN w.path IS NOT NULL THEN false ELSE dam END AS damaged,
  CASE WHEN w.path IS NOT NULL AND n.path IS NOT NULL THEN 1 ELSE is_partial END AS is_partial,
  CASE WHEN w.path IS NOT NULL AND n.path IS NOT NULL AND kind IN ('salvage', 'convert') THEN 0 ELSE inspected END AS inspected
  FROM full1 f LEFT JOIN w ON w.path = f.path LEFT JOIN fx_new_headers n ON n.path = f.path""")  # fmt: skip
def j6(spark, d):
    headers = fixture(spark, d, "fx_headers").where("file_id % 3 = 0 and error is null")
    kinds = F.element_at(F.array(*map(F.lit, ("reencode", "convert", "subset", "header", "salvage"))), (F.col("file_id") % 5 + 1).cast("int"))
    new = fixture(spark, d, "fx_new_headers").withColumn("error", F.lit(None).cast("string"))
    found = full_report(spark, d).withColumn("damaged", rules.false_if_null(F.col("damaged")))
    return incremental.refresh_entries(found, new, headers.select("path", kinds.alias("kind"))).select("path", "sample_rate", "error", "damaged", "is_partial", "inspected")


@query("o8_known_and_present", """SELECT path, 'vanished' AS side FROM fx_previous WHERE path NOT IN (SELECT path FROM fx_listing) UNION ALL SELECT path, 'new' FROM fx_listing WHERE path NOT IN (SELECT path FROM fx_previous)""")
def o8(spark, d):
    listing, previous = fixture(spark, d, "fx_listing"), fixture(spark, d, "fx_previous")
    vanished = incremental.new_files(previous, listing).select("path", F.lit("vanished").alias("side"))
    return vanished.unionByName(incremental.new_files(listing, previous).select("path", F.lit("new").alias("side")))
