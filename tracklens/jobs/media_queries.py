"""Queries for plans, checks, originals, formats, logs, headers and spectra from PCM, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.fixtures import fixture
from tracklens.functions import fmt
from tracklens.operators import plan, rules, spectrum, summary
from tracklens.sources import headers as flac
from tracklens.sources import logs

from . import inspect
from .audit_queries import FULL, full_report
from .registry import registry
from .spectrum_queries import READ

QUERIES, ORACLE, query = registry()


NO_MD5 = "repeat('0', 32)"
#: The request of the conversion queries: 48 kHz, 16 bit, nothing raised.
PLAN = f"""{FULL}, pl AS (SELECT *, least(48000, sample_rate) AS target_rate, least(16, bits_per_sample) AS target_bits, 48000 > sample_rate OR 16 > bits_per_sample AS would_raise,
  least(48000, sample_rate) <> sample_rate OR least(16, bits_per_sample) <> bits_per_sample AS needs FROM full1)"""


def planned(spark: SparkSession, d: str) -> DataFrame:
    return plan.conversion_plan(full_report(spark, d), 48000, 16, downgrade=True)


@query("p16_target_format", f"WITH {PLAN} SELECT file_id, target_rate, target_bits, would_raise, needs AS needs_conversion FROM pl")
def p16(spark, d):
    return planned(spark, d).select("file_id", "target_rate", "target_bits", "would_raise", "needs_conversion")


@query("p17_conversion_up", "SELECT file_id, 96000 > sample_rate OR 24 > bits_per_sample AS would_raise, 96000 <> sample_rate OR 24 <> bits_per_sample AS needs_conversion FROM fx_headers")
def p17(spark, d):
    return plan.conversion_plan(fixture(spark, d, "fx_headers"), 96000, 24).select("file_id", "would_raise", "needs_conversion")


@query("p18_rate_family", "SELECT file_id, CASE WHEN sample_rate % 11025 = 0 THEN 11025 WHEN sample_rate % 8000 = 0 THEN 8000 ELSE 0 END AS family FROM fx_headers")
def p18(spark, d):
    return fixture(spark, d, "fx_headers").select("file_id", rules.rate_family(F.col("sample_rate")).alias("family"))


OUT = "SELECT o.*, total_samples, sample_rate FROM fx_outcomes o JOIN fx_headers USING (file_id)"


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    facts = fixture(spark, d, "fx_headers").select("file_id", "total_samples", "sample_rate", "path")
    return fixture(spark, d, "fx_outcomes").join(facts, "file_id")


@query("p13_outcome_measures", f"""WITH x AS ({OUT}) SELECT res_id, old_size - new_size AS saved, CASE WHEN old_size = 0 THEN 0 ELSE round((old_size - new_size) / CAST(old_size AS DOUBLE) * 100, 6) END AS saved_pct,
  greatest(0, total_samples - recovered_samples) AS lost_samples, round(greatest(0, total_samples - recovered_samples) / CAST(sample_rate AS DOUBLE), 6) AS lost_seconds,
  CASE WHEN total_samples = 0 THEN 0 ELSE round(recovered_samples / CAST(total_samples AS DOUBLE) * 100, 6) END AS recovered_pct FROM x""")  # fmt: skip
def p13(spark, d):
    found = plan.outcome_measures(outcomes(spark, d))
    return found.select("res_id", "saved", F.round("saved_pct", 6).alias("saved_pct"), "lost_samples", F.round("lost_seconds", 6).alias("lost_seconds"), F.round("recovered_pct", 6).alias("recovered_pct"))


@query("o4_outcomes_by_path", f"WITH x AS ({OUT.replace('sample_rate', 'path')}) SELECT path, res_id, kind, status FROM x ORDER BY path, res_id")
def o4(spark, d):
    return outcomes(spark, d).select("path", "res_id", "kind", "status").orderBy("path", "res_id")


@query("a11_reencode_summary", """WITH x AS (SELECT count(*) FILTER (status <> 'failed' AND kind = 'convert') AS converted, count(*) FILTER (status <> 'failed' AND kind <> 'convert') AS reencoded, count(*) FILTER (status = 'failed') AS failed,
  CAST(coalesce(sum(old_size - new_size) FILTER (status <> 'failed'), 0) AS BIGINT) AS b FROM fx_outcomes WHERE kind IN ('reencode', 'convert')) SELECT converted, reencoded, failed, abs(b) AS bytes, CASE WHEN b < 0 THEN 'grew' ELSE 'saved' END AS label FROM x""")  # fmt: skip
def a11(spark, d):
    return plan.reencode_summary(fixture(spark, d, "fx_outcomes").where(F.col("kind").isin("reencode", "convert")))


@query("a12_repair_summary", "SELECT kind, count(*) FILTER (status <> 'failed') AS settled, count(*) FILTER (status = 'failed') AS failed FROM fx_outcomes WHERE kind IN ('subset', 'header', 'salvage') GROUP BY kind")
def a12(spark, d):
    return plan.repair_summary(fixture(spark, d, "fx_outcomes").where(F.col("kind").isin("subset", "header", "salvage")))


@query("a13_conversion_warnings", """SELECT count(*) FILTER (96000 > sample_rate) AS up, count(*) FILTER (sample_rate <> 96000 AND sample_rate % 11025 = 0) AS across, count(*) FILTER (24 > bits_per_sample) AS deeper
  FROM fx_headers WHERE 96000 <> sample_rate OR 24 <> bits_per_sample""")  # fmt: skip
def a13(spark, d):
    return plan.conversion_warnings(plan.conversion_plan(fixture(spark, d, "fx_headers"), 96000, 24))


@query("a14_conversion_intro", f"WITH {PLAN} SELECT count(*) FILTER (needs) AS to_convert, bool_or(needs AND target_bits = 16 AND bits_per_sample > 16) AS dither, count(*) FILTER (would_raise AND NOT needs) AS spared, CAST(coalesce(sum(file_size) FILTER (needs), 0) AS BIGINT) AS bytes FROM pl")
def a14(spark, d):
    return plan.conversion_intro(planned(spark, d))


@query("o6_reencode_targets", f"WITH {PLAN} SELECT path, 'weak' AS ask FROM pl WHERE error IS NULL AND weak UNION ALL SELECT path, 'convert' FROM pl WHERE error IS NULL AND (weak OR needs) UNION ALL SELECT path, 'all' FROM pl WHERE error IS NULL")
def o6(spark, d):
    found = planned(spark, d)
    parts = [plan.reencode_targets(found, **how).select("path", F.lit(ask).alias("ask")) for ask, how in (("weak", {}), ("convert", {"convert": True}), ("all", {"everything": True}))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


REPAIR = f"{FULL}, rep AS (SELECT path, CASE WHEN really_damaged THEN 'salvage' WHEN harm THEN 'header' WHEN fixable <> '' AND error IS NULL THEN 'subset' END AS kind FROM full1)"


@query("o7_repair_targets", f"WITH {REPAIR} SELECT * FROM rep WHERE kind IS NOT NULL")
def o7(spark, d):
    return plan.repair_targets(full_report(spark, d)).select("path", "kind")


@query("a15_repair_group_counts", f"WITH {REPAIR} SELECT kind, count(*) AS n FROM rep WHERE kind IS NOT NULL GROUP BY kind")
def a15(spark, d):
    return plan.repair_targets(full_report(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


@query("j9_verify_lossless", f"""SELECT o.path, CASE WHEN o.sample_rate <> n.sample_rate THEN 'sample_rate' WHEN o.channels <> n.channels THEN 'channels' WHEN o.bits_per_sample <> n.bits_per_sample THEN 'bits_per_sample'
  WHEN o.total_samples <> n.total_samples THEN 'total_samples' WHEN n.md5_hex = {NO_MD5} THEN 'md5_unset' WHEN n.md5_hex <> CASE WHEN o.md5_hex = {NO_MD5} THEN md5(o.vendor) ELSE o.md5_hex END THEN 'md5_differs' END AS problem
  FROM fx_headers o JOIN fx_new_headers n USING (path)""")  # fmt: skip
def j9(spark, d):
    return plan.verify_lossless(fixture(spark, d, "fx_headers").withColumn("audio_md5", F.md5(F.col("vendor").cast("binary"))), fixture(spark, d, "fx_new_headers"))


@query("j10_verify_converted", f"""WITH x AS (SELECT o.path, least(48000, o.sample_rate) AS tr, least(16, o.bits_per_sample) AS tb, o.channels, n.sample_rate AS nr, CASE WHEN o.file_id % 4 = 0 THEN 16 ELSE n.bits_per_sample END AS nb, n.channels AS nc,
   CAST(round_even(o.total_samples * least(48000, o.sample_rate) / CAST(o.sample_rate AS DOUBLE), 0) AS BIGINT) AS expected, n.total_samples AS ns, n.md5_hex AS nm, CASE WHEN o.file_id % 10 = 8 THEN 'x' ELSE n.md5_hex END AS am,
   o.file_id % 6 * 1.0 AS drift, o.file_id % 12 = 0 AS unknown FROM fx_headers o JOIN fx_new_headers n USING (path))
  SELECT path, CASE WHEN nr <> tr THEN 'sample_rate' WHEN nb <> tb THEN 'bits_per_sample' WHEN nc <> channels THEN 'channels' WHEN abs(ns - expected) > greatest(8, expected // 1000) THEN 'samples'
   WHEN nm = {NO_MD5} THEN 'md5_unset' WHEN nm <> am THEN 'md5_content' WHEN NOT unknown AND drift > 3.0 THEN 'level' END AS problem FROM x""")  # fmt: skip
def j10(spark, d):
    n = F.col("file_id")
    old = plan.conversion_plan(fixture(spark, d, "fx_headers"), 48000, 16, downgrade=True).withColumns({"old_peak": F.when(n % 12 != 0, F.lit(-3.0)), "old_rms": F.lit(-20.0)})
    facts = fixture(spark, d, "fx_headers").select("path", "file_id")
    new = fixture(spark, d, "fx_new_headers").join(facts, "path").withColumns({
        "bits_per_sample": F.when(n % 4 == 0, 16).otherwise(F.col("bits_per_sample")), "audio_md5": F.when(n % 10 == 8, F.lit("x")).otherwise(F.col("md5_hex")),
        "new_peak": F.lit(-3.0) + n % 6, "new_rms": F.lit(-20.0),
    })
    return plan.verify_converted(old, new)


TARGET = "substr(o.path, 1, length(o.path) - 10) || '.flac'"


@query("j7_pair_originals", f"SELECT o.path, {TARGET} AS target, h.file_size AS target_size FROM fx_originals o LEFT JOIN fx_listing h ON h.path = {TARGET}")
def j7(spark, d):
    return plan.pair_originals(fixture(spark, d, "fx_originals"), fixture(spark, d, "fx_listing")).select("path", "target", "target_size")


@query("j7a_droppable_orphans", f"SELECT o.path, h.path IS NOT NULL AS droppable FROM fx_originals o LEFT JOIN fx_listing h ON h.path = {TARGET}")
def j7a(spark, d):
    paired = plan.pair_originals(fixture(spark, d, "fx_originals"), fixture(spark, d, "fx_listing"))
    return paired.select("path", F.col("target_size").isNotNull().alias("droppable"))


@query("j7b_revert_plan", f"SELECT count(*) AS originals, count(*) FILTER (h.path IS NULL) AS gone, CAST(coalesce(sum(o.file_size - coalesce(h.file_size, 0)), 0) AS BIGINT) AS delta FROM fx_originals o LEFT JOIN fx_listing h ON h.path = {TARGET}")
def j7b(spark, d):
    return plan.revert_delta(plan.pair_originals(fixture(spark, d, "fx_originals"), fixture(spark, d, "fx_listing")))


@query("a16_reclaimable_bytes", f"SELECT count(*) AS droppable, CAST(coalesce(sum(o.file_size), 0) AS BIGINT) AS bytes FROM fx_originals o JOIN fx_listing h ON h.path = {TARGET}")
def a16(spark, d):
    return plan.reclaimable(plan.pair_originals(fixture(spark, d, "fx_originals"), fixture(spark, d, "fx_listing")))


@query("j11_backup_conflicts", "SELECT h.path FROM fx_headers h WHERE regexp_replace(h.path, '[.][^./]*$', '') || '.orig.flac' IN (SELECT path FROM fx_originals)")
def j11(spark, d):
    return plan.backup_conflicts(fixture(spark, d, "fx_headers"), fixture(spark, d, "fx_originals")).select("path")


@query("s2_list_originals", "SELECT path FROM fx_originals WHERE lower(path) LIKE '%.orig.flac'")
def s2(spark, d):
    both = fixture(spark, d, "fx_originals").select("path").unionByName(fixture(spark, d, "fx_listing").select("path"))
    return both.where(fmt.is_original(F.col("path")))


SIZED = "SELECT res_id, CAST(abs(old_size - new_size) * (res_id % 7) * (res_id % 1000) AS BIGINT) AS n FROM fx_outcomes"


def sized(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "fx_outcomes").select("res_id", (F.abs(F.col("old_size") - F.col("new_size")) * (F.col("res_id") % 7) * (F.col("res_id") % 1000)).cast("long").alias("n"))


@query("f1_human_size", f"WITH x AS ({SIZED}) SELECT res_id, CASE WHEN n < 1024 THEN printf('%.0f B', CAST(n AS DOUBLE)) WHEN n < 1048576 THEN printf('%.1f kB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f GB', n / 1073741824.0) END AS size FROM x")
def f1(spark, d):
    return sized(spark, d).select("res_id", fmt.human_size(F.col("n")).alias("size"))


@query("f2_format_size", f"WITH x AS ({SIZED}) SELECT res_id, CASE WHEN n < 1024 THEN printf('%.2f B', CAST(n AS DOUBLE)) WHEN n < 1048576 THEN printf('%.2f KiB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.2f MiB', n / 1048576.0) WHEN n < 1099511627776 THEN printf('%.2f GiB', n / 1073741824.0) ELSE printf('%.2f TiB', n / 1099511627776.0) END AS size FROM x")
def f2(spark, d):
    return sized(spark, d).select("res_id", fmt.format_size(F.col("n")).alias("size"))


@query("f3_format_hms", "SELECT file_id, lpad(CAST(s // 3600 AS VARCHAR), CAST(greatest(2, length(CAST(s // 3600 AS VARCHAR))) AS INT), '0') || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS hms FROM (SELECT file_id, total_samples // 44 AS s FROM fx_headers)")
def f3(spark, d):
    return fixture(spark, d, "fx_headers").select("file_id", fmt.format_hms(F.floor(F.col("total_samples") / 44)).alias("hms"))


@query("f4_short_duration", "SELECT file_id, CASE WHEN s < 90 THEN CAST(greatest(1, CAST(round_even(s, 0) AS BIGINT)) AS VARCHAR) || ' s' WHEN s < 5400 THEN CAST(CAST(round_even(s / 60, 0) AS BIGINT) AS VARCHAR) || ' min' ELSE printf('%.1f h', s / 3600) END AS eta FROM (SELECT file_id, total_samples / 1001.0 AS s FROM fx_headers)")
def f4(spark, d):
    return fixture(spark, d, "fx_headers").select("file_id", fmt.short_duration(F.col("total_samples") / 1001.0).alias("eta"))


@query("f5_eta_seconds", "SELECT file_id, round(file_size / 1048576.0 / 48, 9) AS eta FROM fx_headers")
def f5(spark, d):
    return fixture(spark, d, "fx_headers").select("file_id", F.round(summary.eta_seconds(F.col("file_size"), summary.ENCODE_RATE, 4), 9).alias("eta"))


@query("f6_audio_format", "SELECT file_id, printf('%g kHz/%d bit', sample_rate / 1000.0, bits_per_sample) AS format FROM fx_headers")
def f6(spark, d):
    return fixture(spark, d, "fx_headers").select("file_id", fmt.audio_format(F.col("sample_rate"), F.col("bits_per_sample")).alias("format"))


@query("p21_transcode_plan", """SELECT file_id, qp BETWEEN 1 AND 51 AND encoder <> 'vp9' AS valid, CASE WHEN qp BETWEEN 1 AND 51 AND encoder <> 'vp9' THEN '-hwaccel vaapi -i ' || path || ' -map 0:v -map 0:a? -map 0:s? -vf scale_vaapi=1280:720,format=nv12,hwupload -c:v ' || encoder || '_vaapi -qp ' || qp || ' -c:s copy -c:a '
  || CASE WHEN audio = 'copy' THEN 'copy' ELSE audio || ' -b:a 192k' END || ' -map_metadata 0 -y ' || path || '.mkv' END AS command
  FROM (SELECT file_id, path, file_id % 53 AS qp, CASE file_id % 4 WHEN 0 THEN 'h264' WHEN 1 THEN 'hevc' WHEN 2 THEN 'av1' ELSE 'vp9' END AS encoder, CASE WHEN file_id % 3 = 0 THEN 'copy' ELSE 'aac' END AS audio FROM fx_headers)""")  # fmt: skip
def p21(spark, d):
    n = F.col("file_id")
    videos = fixture(spark, d, "fx_headers").select(
        "file_id", F.col("path").alias("input"), F.concat("path", F.lit(".mkv")).alias("output"), (n % 53).alias("qp"),
        F.element_at(F.array(*map(F.lit, ("h264", "hevc", "av1", "vp9"))), (n % 4 + 1).cast("int")).alias("encoder"), F.when(n % 3 == 0, "copy").otherwise("aac").alias("audio"),
    )
    return plan.transcode_plan(videos, scale="1280:720").select("file_id", "valid", F.array_join("command", " ").alias("command"))


@query("p22_scan_plan", "SELECT file_id, file_id % 103 BETWEEN 1 AND 100 AND file_id % 7 >= 1 AS valid, substr(path, 1, length(path) - 5) || '_scan.pdf' AS output FROM fx_headers")
def p22(spark, d):
    docs = fixture(spark, d, "fx_headers").select("file_id", "path", (F.col("file_id") % 103).alias("quality"), (F.col("file_id") % 7).alias("dpi"))
    return plan.scan_plan(docs).select("file_id", "valid", "output")


@query("p23_size_ratio", "SELECT res_id, CASE WHEN o = 0 THEN 0.0 ELSE round(new_size * 100 / CAST(o AS DOUBLE), 6) END AS ratio FROM (SELECT *, CASE WHEN res_id % 9 = 0 THEN 0 ELSE old_size END AS o FROM fx_outcomes)")
def p23(spark, d):
    old = F.when(F.col("res_id") % 9 == 0, 0).otherwise(F.col("old_size"))
    return fixture(spark, d, "fx_outcomes").select("res_id", F.round(plan.size_ratio(F.col("new_size"), old), 6).alias("ratio"))


PAGES = "WITH docs AS (SELECT DISTINCT doc FROM fx_page_images UNION ALL SELECT -1), m AS (SELECT docs.doc, string_agg(file_name, ',' ORDER BY file_name) AS pages, count(file_name) AS n_pages FROM docs LEFT JOIN fx_page_images p ON p.doc = docs.doc GROUP BY docs.doc)"


def manifest(spark: SparkSession, d: str) -> DataFrame:
    pages = fixture(spark, d, "fx_page_images")
    return plan.page_manifest(pages, pages.select("doc").distinct().unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("doc"))))


@query("a20_page_manifest", f"{PAGES} SELECT doc, coalesce(pages, '') AS pages, n_pages, n_pages = 0 AS failed FROM m")
def a20(spark, d):
    return manifest(spark, d).select("doc", F.array_join("pages", ",").alias("pages"), "n_pages", "failed")


@query("a21_scan_summary", f"{PAGES} SELECT count(*) FILTER (n_pages > 0) AS ok, count(*) FILTER (n_pages = 0) AS failed FROM m")
def a21(spark, d):
    return plan.scan_summary(manifest(spark, d))


def analysis_lines(spark: SparkSession, d: str) -> DataFrame:
    """The log an analysis would print, from the fixture's rows: built here, parsed by the operator."""
    frames = fixture(spark, d, "fx_frames").select("file_id", F.concat(F.lit("frame="), F.col("frame"), F.lit("\toffset=0\tchannel_assignment="), F.col("channel_assignment")).alias("value"))
    kind = F.coalesce(F.concat(F.lit("\ttype="), F.col("type"), F.when(F.col("file_id") % 3 == 0, ",").otherwise("")), F.lit(""))
    order = F.when(F.col("type").isin("LPC", "FIXED"), F.concat(F.lit("\torder="), F.col("lpc_order"))).otherwise("")
    sub = F.concat(F.lit("\tsubframe="), F.col("subframe"), F.lit("\twasted_bits=0"), kind, order, F.lit("\tresidual_type=RICE"), F.lit("\tpartition_order="), F.col("partition_order"))
    other = frames.select("file_id", F.lit("    residual[0]=3").alias("value"))
    return frames.unionByName(fixture(spark, d, "fx_subframes").select("file_id", sub.alias("value"))).unionByName(other)


@query("s5_read_analysis_log", "SELECT file_id, 'frame' AS line, frame AS number, channel_assignment AS word, CAST(NULL AS INT) AS lpc_order, CAST(NULL AS INT) AS partition_order FROM fx_frames UNION ALL SELECT file_id, 'subframe', subframe, type, CASE WHEN type IN ('LPC', 'FIXED') THEN lpc_order END, partition_order FROM fx_subframes")
def s5(spark, d):
    frames, subframes = logs.parse_analysis(analysis_lines(spark, d))
    none = F.lit(None).cast("int")
    left = frames.select("file_id", F.lit("frame").alias("line"), F.col("frame").alias("number"), F.col("channel_assignment").alias("word"), none.alias("lpc_order"), none.alias("partition_order"))
    return left.unionByName(subframes.select("file_id", F.lit("subframe").alias("line"), F.col("subframe").cast("long").alias("number"), F.col("type").alias("word"), "lpc_order", "partition_order"))


def probe_documents(spark: SparkSession, d: str) -> DataFrame:
    streams = fixture(spark, d, "fx_probe_streams")
    order = F.sort_array(F.collect_list(F.struct("stream_idx", "codec_type", "width", "height")))
    docs = streams.groupBy("file_id").agg(order.alias("s"))
    body = F.to_json(F.struct(F.struct((F.col("file_id") / 4).cast("string").alias("duration")).alias("format"), F.transform("s", lambda s: F.struct(s["codec_type"].alias("codec_type"), s["width"].alias("width"), s["height"].alias("height"))).alias("streams")))
    return docs.select("file_id", F.when(F.col("file_id") % 50 == 3, "{broken").otherwise(body).alias("probe"))


PROBED = """WITH g AS (SELECT file_id, file_id % 50 = 3 AS broken, CAST(floor(file_id / 4.0) AS BIGINT) AS s, arg_min(width, stream_idx) FILTER (codec_type = 'video') AS w, arg_min(height, stream_idx) FILTER (codec_type = 'video') AS h,
  count(*) FILTER (codec_type = 'video') AS v, count(*) FILTER (codec_type = 'audio') AS a, count(*) FILTER (codec_type = 'subtitle') AS t FROM fx_probe_streams GROUP BY file_id)"""


@query("s6_read_probe_json", f"{PROBED} SELECT file_id, CASE WHEN broken THEN '??:??:??' ELSE lpad(CAST(s // 3600 AS VARCHAR), CAST(greatest(2, length(CAST(s // 3600 AS VARCHAR))) AS INT), '0') || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END AS duration, CASE WHEN NOT broken THEN w END AS video_width, CASE WHEN NOT broken THEN h END AS video_height FROM g")
def s6(spark, d):
    return logs.parse_probes(probe_documents(spark, d)).select("file_id", "duration", "video_width", "video_height")


@query("a22_stream_counts", f"{PROBED} SELECT file_id, CASE WHEN broken THEN 0 ELSE v END AS video_count, CASE WHEN broken THEN 0 ELSE a END AS audio_count, CASE WHEN broken THEN 0 ELSE t END AS subtitle_count FROM g")
def a22(spark, d):
    return logs.parse_probes(probe_documents(spark, d)).select("file_id", "video_count", "audio_count", "subtitle_count")


@query("s7_progress_lines", "SELECT file_id, 'frame=' || frame || ' fps=25' AS value FROM fx_frames")
def s7(spark, d):
    frames = fixture(spark, d, "fx_frames")
    lines = frames.select("file_id", F.concat(F.lit("  frame="), F.col("frame"), F.lit(" fps=25  ")).alias("value")).unionByName(frames.select("file_id", F.lit("size= 12kB").alias("value")))
    return logs.progress_lines(lines)


def head_bytes(spark: SparkSession, d: str) -> DataFrame:
    """The first bytes of each file, from the fixture's fields: an ID3 prefix for some, wrong magic for those with an error."""
    h = fixture(spark, d, "fx_headers")
    width = lambda x, n: F.unhex(F.lpad(F.hex(x), 2 * n, "0"))
    sizes = F.concat(width(F.col("max_blocksize"), 2), width(F.col("max_blocksize"), 2), F.unhex(F.lit("000000000000")))
    info = F.concat(sizes, flac.stream_field(F.col("sample_rate"), F.col("channels"), F.col("bits_per_sample"), F.col("total_samples")), F.unhex("md5_hex"))
    n = F.octet_length("vendor")
    comment = F.concat(F.unhex(F.concat(*[F.substring(F.lpad(F.hex(n), 8, "0"), k, 2) for k in (7, 5, 3, 1)])), F.encode("vendor", "UTF-8"), F.unhex(F.lit("00000000")))
    blocks = F.concat(F.unhex(F.lit("00000022")), info, F.unhex(F.lit("04")), width(F.length(comment), 3), comment, F.unhex(F.lit("8100000400000000")))
    prefix = F.when(F.col("file_id") % 4 == 1, F.unhex(F.lit("49443304000000000105" + "00" * 133))).otherwise(F.unhex(F.lit("")))
    magic = F.when(F.col("error").isNull(), F.unhex(F.lit("664C6143"))).otherwise(F.unhex(F.lit("4F676753")))
    return h.select("file_id", "path", F.concat(prefix, magic, blocks).alias("head"))


@query("s4_read_headers", "SELECT path, error, CASE WHEN error IS NULL THEN sample_rate END AS sample_rate, CASE WHEN error IS NULL THEN channels END AS channels, CASE WHEN error IS NULL THEN bits_per_sample END AS bits_per_sample, CASE WHEN error IS NULL THEN max_blocksize END AS max_blocksize, CASE WHEN error IS NULL THEN total_samples END AS total_samples, CASE WHEN error IS NULL THEN md5_hex END AS md5_hex, CASE WHEN error IS NULL THEN vendor END AS vendor FROM fx_headers")
def s4(spark, d):
    found = flac.unpack_headers(flac.read_blocks(head_bytes(spark, d)))
    return found.select("path", "error", "sample_rate", "channels", "bits_per_sample", "max_blocksize", "total_samples", "md5_hex", "vendor")


@query("p0_walk_blocks", "SELECT path, i AS block_idx, CASE i WHEN 0 THEN 0 WHEN 1 THEN 4 ELSE 1 END AS block_type, CASE i WHEN 0 THEN 34 WHEN 1 THEN 8 + strlen(vendor) ELSE 4 END AS size FROM fx_headers, (SELECT unnest([0, 1, 2]) AS i) WHERE error IS NULL")
def p0(spark, d):
    blocks = flac.read_blocks(head_bytes(spark, d)).select("path", F.explode("blocks").alias("b"))
    return blocks.select("path", "b.block_idx", "b.block_type", F.length("b.data").alias("size"))


@query("s10_patch_header", "SELECT path, sample_rate, channels, bits_per_sample, total_samples + 5 AS total_samples, md5(path) AS md5_hex FROM fx_headers WHERE error IS NULL")
def s10(spark, d):
    facts = fixture(spark, d, "fx_headers").where("error is null")
    files = facts.join(head_bytes(spark, d), "path").withColumns({"content": F.col("head"), "streaminfo_offset": flac.streaminfo_offset(F.col("head")), "total_samples": F.col("total_samples") + 5, "md5_hex": F.md5(F.col("path").cast("binary"))})
    patched = flac.patch_header(files).select("path", F.col("patched").alias("head"))
    return flac.unpack_headers(flac.read_blocks(patched)).select("path", "sample_rate", "channels", "bits_per_sample", "total_samples", "md5_hex")


@query("s9_rebuild_metadata", "SELECT path, total_samples, 'rebuilt' AS vendor, '0,4' AS types FROM fx_headers WHERE error IS NULL")
def s9(spark, d):
    blocks = flac.read_blocks(head_bytes(spark, d)).where("error is null").select("path", F.explode("blocks").alias("b")).select("path", "b.*")
    targets = blocks.where("block_type = 0").select("path", F.col("data").alias("streaminfo"), F.lit("rebuilt").alias("vendor"))
    again = flac.unpack_headers(flac.read_blocks(flac.rebuild_metadata(blocks, targets).select("path", F.col("metadata").alias("head"))))
    return again.select("path", "total_samples", "vendor", F.array_join(F.transform("blocks", lambda b: b["block_type"].cast("string")), ",").alias("types"))


#: Bands of the PCM queries: (hz, cell); windows of 64 samples.
BANDS, LENGTH = [(14000, 0), (15000, 0), (18000, 0), (26000, 2000), (30000, 2000)], 64


def pcm(spark: SparkSession, d: str) -> DataFrame:
    """PCM windows from vectors: 16 bit words, or 24 bit words with a zero low byte."""
    v = fixture(spark, d, "fx_vectors")
    word = lambda x: F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(0.999), x.cast("double"))) * 32768).cast("int")
    two = lambda x: F.concat(F.substring(F.lpad(F.hex(F.pmod(word(x), F.lit(65536))), 4, "0"), 3, 2), F.substring(F.lpad(F.hex(F.pmod(word(x), F.lit(65536))), 4, "0"), 1, 2))
    raw = F.unhex(F.array_join(F.transform("samples", lambda x: F.when(F.col("bits_per_sample") == 24, F.concat(F.lit("00"), two(x))).otherwise(two(x))), ""))
    return v.select(F.col("file_id").cast("long").alias("file_id"), F.col("window_idx").cast("long").alias("window_idx"), "sample_rate", "bits_per_sample", F.lit(1).alias("channels"), raw.alias("raw"))


PCM = """WITH w AS (SELECT file_id, window_idx, sample_rate, bits_per_sample, generate_subscripts(samples, 1) - 1 AS i, floor(greatest(-1.0, least(0.999, CAST(unnest(samples) AS DOUBLE))) * 32768) / 32768.0 AS x FROM fx_vectors)"""
ENERGY = f"""{PCM}, s AS (SELECT *, x * (0.35875 - 0.48829 * cos(2 * pi() * i / 63) + 0.14128 * cos(4 * pi() * i / 63) - 0.01168 * cos(6 * pi() * i / 63)) AS y, ((window_idx // 8 + 1) * 0.6180339887498949) % 1 - 0.5 AS move FROM w WHERE window_idx % 8 = 0),
b AS (SELECT unnest([0, 14000, 15000, 18000, 26000, 30000]) AS hz, unnest([0, 0, 0, 0, 2000, 2000]) AS cell),
e AS (SELECT file_id, window_idx, hz, pow(sum(y * cos(2 * pi() * i * f / sample_rate)), 2) + pow(sum(y * sin(2 * pi() * i * f / sample_rate)), 2) AS e
  FROM (SELECT s.*, hz, CASE WHEN hz = 0 THEN 1000 ELSE hz + move * cell END AS f FROM s JOIN b ON hz < sample_rate / 2 * 0.95) GROUP BY file_id, window_idx, hz),
t AS (SELECT file_id, hz, sum(e) AS energy, count(*) AS n FROM e GROUP BY file_id, hz)
"""


@query("a6_band_energy", f"{ENERGY} SELECT t.file_id, t.hz, round(10 * log10(t.energy / r.energy + 1e-30), 3) AS db FROM t JOIN t r ON r.file_id = t.file_id AND r.hz = 0 WHERE t.hz > 0")
def a6(spark, d):
    levels = spectrum.band_levels(spectrum.measure(pcm(spark, d), BANDS, LENGTH))
    return levels.select("file_id", "hz", F.round("db", 3).alias("db"))


@query("a5_real_bits", "SELECT DISTINCT CAST(file_id AS BIGINT) AS file_id, CASE WHEN bits_per_sample = 24 THEN 16 ELSE 0 END AS real_bits FROM fx_vectors")
def a5(spark, d):
    windows = pcm(spark, d)
    return spectrum.real_bits(spectrum.measure(windows, BANDS, LENGTH), windows.select("file_id", "bits_per_sample").distinct())


@query("w1_sample_windows", "SELECT CAST(file_id AS BIGINT) AS file_id, window_idx FROM fx_vectors WHERE window_idx % 8 = 0")
def w1(spark, d):
    return spectrum.sample_windows(pcm(spark, d), LENGTH).select("file_id", "window_idx")


@query("a17_signal_levels", f"{PCM} SELECT CAST(file_id AS BIGINT) AS file_id, round(20 * log10(max(abs(x))), 6) AS peak_db, round(20 * log10(sqrt(avg(x * x))), 6) AS rms_db FROM w WHERE window_idx * 64 < sample_rate * 60 GROUP BY file_id")
def a17(spark, d):
    return spectrum.signal_levels(pcm(spark, d), LENGTH).select("file_id", F.round("peak_db", 6).alias("peak_db"), F.round("rms_db", 6).alias("rms_db"))


@query("a18_audio_digest", f"""{PCM}, h AS (SELECT *, CAST(x * 32768 AS BIGINT) & 65535 AS word FROM w)
  SELECT CAST(file_id AS BIGINT) AS file_id, count(*) AS samples, md5(unhex(string_agg(CASE WHEN bits_per_sample = 24 THEN '00' ELSE '' END || printf('%02x%02x', word & 255, word >> 8), '' ORDER BY window_idx, i))) AS md5_hex FROM h GROUP BY file_id""")  # fmt: skip
def a18(spark, d):
    return spectrum.audio_digest(pcm(spark, d)).select("file_id", "samples", "md5_hex")


#: Two windows a file of 4,096 samples in two channels, from a vector's values over and over.
STEREO = """WITH v AS (SELECT file_id, window_idx, sample_rate, [floor(greatest(-1.0, least(0.999, CAST(x AS DOUBLE))) * 32768) / 32768.0 FOR x IN samples] AS s FROM fx_vectors WHERE window_idx % 8 = 0 AND window_idx < 16),
w AS (SELECT file_id, window_idx, sample_rate, j, s[(j * 7 + j // 64) % 64 + 1] AS x FROM v, (SELECT unnest(range(0, 8192)) AS j)),
m AS (SELECT file_id, window_idx, sample_rate, j // 2 AS i, avg(x) AS x FROM w GROUP BY ALL)"""


def stereo(spark: SparkSession, d: str) -> DataFrame:
    v = fixture(spark, d, "fx_vectors").where("window_idx % 8 = 0 and window_idx < 16")
    word = lambda x: F.pmod(F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(0.999), x.cast("double"))) * 32768).cast("int"), F.lit(65536))
    turned = F.transform("samples", lambda x: F.concat(F.lpad(F.hex(word(x) % 256), 2, "0"), F.lpad(F.hex(F.floor(word(x) / 256)), 2, "0")))
    words = F.transform(F.sequence(F.lit(0), F.lit(8191)), lambda j: F.get("words", (j * 7 + F.floor(j / 64).cast("int")) % 64))
    rows = v.select(F.col("file_id").cast("long").alias("file_id"), F.col("window_idx").cast("long").alias("window_idx"), "sample_rate", turned.alias("words"))
    return rows.select("file_id", "window_idx", "sample_rate", F.lit(16).alias("bits_per_sample"), F.lit(2).alias("channels"), F.unhex(F.array_join(words, "")).alias("raw"))


@query("a6_stereo_windows", f"""{STEREO}, s AS (SELECT *, x * (0.35875 - 0.48829 * cos(2 * pi() * i / 4095) + 0.14128 * cos(4 * pi() * i / 4095) - 0.01168 * cos(6 * pi() * i / 4095)) AS y, ((window_idx // 8 + 1) * 0.6180339887498949) % 1 - 0.5 AS move FROM m),
  b AS (SELECT unnest([0, 14000, 15000, 18000, 26000, 30000]) AS hz, unnest([0, 0, 0, 0, 2000, 2000]) AS cell),
  e AS (SELECT file_id, window_idx, hz, pow(sum(y * cos(2 * pi() * i * f / sample_rate)), 2) + pow(sum(y * sin(2 * pi() * i * f / sample_rate)), 2) AS e
    FROM (SELECT s.*, hz, CASE WHEN hz = 0 THEN 1000 ELSE hz + move * cell END AS f FROM s JOIN b ON hz < sample_rate / 2 * 0.95) GROUP BY file_id, window_idx, hz),
  t AS (SELECT file_id, hz, sum(e) AS energy FROM e GROUP BY file_id, hz)
  SELECT CAST(t.file_id AS BIGINT) AS file_id, t.hz, round(10 * log10(t.energy / r.energy + 1e-30), 3) AS db FROM t JOIN t r ON r.file_id = t.file_id AND r.hz = 0 WHERE t.hz > 0""")  # fmt: skip
def a6_stereo(spark, d):
    levels = spectrum.band_levels(spectrum.measure(stereo(spark, d), BANDS))
    return levels.select("file_id", "hz", F.round("db", 3).alias("db"))


@query("a17_stereo_levels", f"{STEREO} SELECT CAST(file_id AS BIGINT) AS file_id, round(20 * log10(max(abs(x))), 6) AS peak_db, round(20 * log10(sqrt(avg(x * x))), 6) AS rms_db FROM w WHERE window_idx * 4096 < sample_rate * 60 GROUP BY file_id")
def a17_stereo(spark, d):
    return spectrum.signal_levels(stereo(spark, d)).select("file_id", F.round("peak_db", 6).alias("peak_db"), F.round("rms_db", 6).alias("rms_db"))


@query("w2_band_grid", """WITH r AS (SELECT DISTINCT sample_rate, sample_rate * 0.475 AS top FROM fx_headers), n AS (SELECT unnest(range(0, 200)) AS n),
  edge AS (SELECT DISTINCT sample_rate, hz FROM (SELECT sample_rate, top, CAST(round_even(rung * 0.49 / 500, 0) * 500 AS BIGINT) + k * 500 AS hz FROM r, (SELECT unnest([44100, 88200, 176400, 48000, 96000, 192000]) AS rung, unnest([1, 1, 1, 0, 0, 0]) AS fam), (SELECT unnest([-2, -1, 0, 1, 2]) AS k)
    WHERE rung < sample_rate AND fam = CASE WHEN sample_rate % 11025 = 0 THEN 1 ELSE 0 END AND sample_rate > 48000) WHERE hz > 25000 AND hz < top)
  SELECT sample_rate, 14000 + 500 * n AS hz, 0 AS cell FROM r, n WHERE n <= 22 AND 14000 + 500 * n < top UNION ALL SELECT sample_rate, hz, 500 FROM edge
  UNION ALL SELECT sample_rate, 26000 + 2000 * n, 2000 FROM r, n WHERE sample_rate > 48000 AND 26000 + 2000 * n <= floor(top) AND NOT EXISTS (SELECT 1 FROM edge WHERE edge.sample_rate = r.sample_rate AND edge.hz = 26000 + 2000 * n)""")  # fmt: skip
def w2(spark, d):
    return spectrum.band_grid(fixture(spark, d, "fx_headers"))


def unpacked(spark: SparkSession, d: str) -> DataFrame:
    return flac.unpack_headers(flac.read_blocks(head_bytes(spark, d)))


@query("p1_unpack_streaminfo", "SELECT path, sample_rate, channels, bits_per_sample, max_blocksize, total_samples, md5_hex FROM fx_headers WHERE error IS NULL")
def p1(spark, d):
    return unpacked(spark, d).where("error is null").select("path", "sample_rate", "channels", "bits_per_sample", "max_blocksize", "total_samples", "md5_hex")


@query("p2_header_error", """SELECT path, CASE file_id % 6 WHEN 0 THEN 'eof' WHEN 1 THEN 'not_flac' WHEN 2 THEN 'first_block' WHEN 3 THEN 'short_streaminfo' WHEN 4 THEN 'no_streaminfo' END AS error FROM fx_headers""")
def p2(spark, d):
    info = F.concat(F.unhex(F.lit("10001000000000000000")), flac.stream_field(F.lit(44100), F.lit(2), F.lit(16), F.lit(1)), F.unhex(F.lit("00" * 16)))
    zero = F.unhex(F.lit("00" * 34))
    whole = lambda data: F.concat(F.unhex(F.lit("664C614380000022")), data)
    n = F.col("file_id") % 6
    head = (
        F.when(n == 0, F.substring(whole(info), 1, 20)).when(n == 1, F.unhex(F.lit("4F67675300000000"))).when(n == 2, F.unhex(F.lit("664C614384000000")))
        .when(n == 3, F.unhex(F.lit("664C61438000000400000000"))).when(n == 4, whole(zero)).otherwise(whole(info))
    )
    return flac.unpack_headers(flac.read_blocks(fixture(spark, d, "fx_headers").select("path", head.alias("head")))).select("path", "error")


@query("p3_vendor", "SELECT path, vendor FROM fx_headers WHERE error IS NULL")
def p3(spark, d):
    return unpacked(spark, d).where("error is null").select("path", "vendor")


@query("p5_hi_rate", "SELECT file_id, sample_rate > 48000 AS hi_rate FROM fx_headers")
def p5(spark, d):
    return fixture(spark, d, "fx_headers").select("file_id", rules.hi_rate(F.col("sample_rate")).alias("hi_rate"))


@query("f7_original_names", f"SELECT o.path, lower(o.path) LIKE '%.orig.flac' AS is_original, {TARGET} AS replacement, regexp_replace({TARGET}, '[.][^./]*$', '') || '.orig.flac' AS backup FROM fx_originals o")
def f7(spark, d):
    path = F.col("path")
    return fixture(spark, d, "fx_originals").select("path", fmt.is_original(path).alias("is_original"), fmt.replacement_path(path).alias("replacement"), fmt.backup_path(fmt.replacement_path(path)).alias("backup"))


#: From PCM to verdicts: energies on each rate's own grid, levels, then the readings of the band table.
INSPECT = f"""{PCM}, r AS (SELECT DISTINCT sample_rate, sample_rate * 0.475 AS top FROM fx_vectors), n AS (SELECT unnest(range(0, 64)) AS n),
  cells AS (SELECT DISTINCT sample_rate, hz FROM (SELECT sample_rate, top, CAST(round_even(rung * 0.49 / 500, 0) * 500 AS BIGINT) + k * 500 AS hz FROM r, (SELECT unnest([44100, 88200, 176400, 48000, 96000, 192000]) AS rung, unnest([1, 1, 1, 0, 0, 0]) AS fam), (SELECT unnest([-2, -1, 0, 1, 2]) AS k)
    WHERE rung < sample_rate AND fam = CASE WHEN sample_rate % 11025 = 0 THEN 1 ELSE 0 END AND sample_rate > 48000) WHERE hz > 25000 AND hz < top),
  grid AS (SELECT sample_rate, 14000 + 500 * n AS hz, 0 AS cell FROM r, n WHERE n <= 22 AND 14000 + 500 * n < top UNION ALL SELECT sample_rate, hz, 500 FROM cells UNION ALL SELECT sample_rate, 0, 0 FROM r
    UNION ALL SELECT sample_rate, 26000 + 2000 * n, 2000 FROM r, n WHERE sample_rate > 48000 AND 26000 + 2000 * n <= floor(top) AND NOT EXISTS (SELECT 1 FROM cells WHERE cells.sample_rate = r.sample_rate AND cells.hz = 26000 + 2000 * n)),
  s AS (SELECT *, x * (0.35875 - 0.48829 * cos(2 * pi() * i / 63) + 0.14128 * cos(4 * pi() * i / 63) - 0.01168 * cos(6 * pi() * i / 63)) AS y, ((window_idx // 8 + 1) * 0.6180339887498949) % 1 - 0.5 AS move FROM w WHERE window_idx % 8 = 0),
  e AS (SELECT file_id, sample_rate, window_idx, hz, pow(sum(y * cos(2 * pi() * i * f / sample_rate)), 2) + pow(sum(y * sin(2 * pi() * i * f / sample_rate)), 2) AS e
    FROM (SELECT s.*, hz, CASE WHEN hz = 0 THEN 1000 ELSE hz + move * cell END AS f FROM s JOIN grid USING (sample_rate)) GROUP BY ALL),
  t AS (SELECT file_id, sample_rate, hz, sum(e) AS energy, count(*) AS taken FROM e GROUP BY ALL),
  pcm_bands AS (SELECT CAST(t.file_id AS BIGINT) AS file_id, t.sample_rate, t.hz, 10 * log10(t.energy / z.energy + 1e-30) AS db FROM t JOIN t z ON z.file_id = t.file_id AND z.hz = 0 WHERE t.hz > 0 AND z.energy > 0 AND z.taken >= 2),
  {READ.replace("fx_bands", "pcm_bands")},
  facts AS (SELECT DISTINCT CAST(file_id AS BIGINT) AS file_id, CASE WHEN bits_per_sample = 24 THEN 16 ELSE 0 END AS real_bits, bits_per_sample FROM fx_vectors)
"""


@query("inspect_library", f"""{INSPECT} SELECT facts.file_id, CASE WHEN v.file_id IS NULL THEN 'fake_unusable' END AS inspect_error, CASE WHEN explained THEN 0 ELSE cut0 END AS cutoff_hz, src AS source_rate, why AS content_why, content AS content_hz,
  enough AS enough_rate, CASE WHEN v.file_id IS NULL THEN 0 ELSE real_bits END AS real_bits, v.file_id IS NOT NULL AND real_bits > 0 AS padded_depth FROM facts LEFT JOIN verdict v USING (file_id)""")  # fmt: skip
def inspect_library(spark, d):
    windows = pcm(spark, d)
    found = inspect.inspect_library(windows.select("file_id", "bits_per_sample").distinct(), windows, LENGTH)
    return found.select("file_id", "inspect_error", "cutoff_hz", "source_rate", "content_why", "content_hz", "enough_rate", "real_bits", "padded_depth")
