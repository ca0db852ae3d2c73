"""Queries over spectra: verdicts from bands, bands from PCM windows, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.fixtures import fixture
from tracklens.operators import asof, rules, spectrum_rules, summary

from .registry import registry

QUERIES, ORACLE, query = registry()


def files(spark: SparkSession, d: str) -> DataFrame:
    return spectrum_rules.gather_bands(fixture(spark, d, "fx_bands"), "file_id", "sample_rate")


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    return spectrum_rules.inspect_verdicts(files(spark, d))


#: Verdict step by step in SQL, by windows and joins of the band table with itself.
CLIFF = """
fine AS (SELECT *, least(lead(db, 1) OVER w, coalesce(lead(db, 2) OVER w, lead(db, 1) OVER w)) AS after FROM fx_bands WHERE hz <= 25000 WINDOW w AS (PARTITION BY file_id ORDER BY hz)),
falls AS (SELECT file_id, hz, db - after AS fall FROM fine WHERE after IS NOT NULL AND db >= -100 AND hz <= least(22500.0, 20000.0 * sample_rate / 44100)),
ids AS (SELECT DISTINCT file_id, sample_rate FROM fx_bands),
best AS (SELECT file_id, fall, hz FROM falls WHERE fall > 0 QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY fall DESC, hz) = 1),
cliff AS (SELECT ids.file_id, sample_rate, coalesce(fall, 0.0) AS cliff0, CASE WHEN fall >= 40 THEN hz ELSE 0 END AS cut0 FROM ids LEFT JOIN best USING (file_id))
"""
UP = f"""{CLIFF},
med AS (SELECT file_id, median(db) FILTER (hz BETWEEN 15000 AND 20000) AS ref, median(db) FILTER (hz >= 26000) AS flo, max(db) FILTER (hz >= 26000) - min(db) FILTER (hz >= 26000) AS spread FROM fx_bands GROUP BY file_id),
edge AS (SELECT b.file_id, max(hz) AS edge FROM fx_bands b JOIN med USING (file_id) WHERE hz <= 25000 AND db > flo + 20 GROUP BY b.file_id),
ups AS (SELECT cliff.*, ref, flo, spread, ref - flo AS gap, CASE WHEN sample_rate > 48000 AND ref - flo >= 70 AND spread <= 30 THEN
  CASE WHEN coalesce(edge, 0) <= 22600 THEN 44100 WHEN edge <= 24600 THEN 48000 ELSE CAST(floor(edge * 2 / 1000.0) * 1000 AS BIGINT) END ELSE 0 END AS src
  FROM cliff JOIN med USING (file_id) LEFT JOIN edge USING (file_id)),
blamed AS (SELECT *, cut0 > 0 AND src > 0 AND cut0 >= src / 2.0 * 0.88 AS explained FROM ups)
"""
READ = f"""{UP},
up AS (SELECT b.file_id, hz, db, ref, row_number() OVER w AS i, count(*) OVER (PARTITION BY b.file_id) AS n, max(hz) OVER (PARTITION BY b.file_id) AS top, lag(hz) OVER w AS phz, lag(db) OVER w AS pdb,
  min(db) OVER (PARTITION BY b.file_id ORDER BY hz ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low
  FROM fx_bands b JOIN med USING (file_id) WHERE hz >= 20000 AND flo IS NOT NULL AND ref IS NOT NULL WINDOW w AS (PARTITION BY b.file_id ORDER BY hz)),
over AS (SELECT file_id, min(hz) AS over_hz FROM up WHERE db > low + 6 GROUP BY file_id),
turn AS (SELECT up.file_id, arg_min(hz, struct_pack(d := db, h := hz)) AS turn, min(db) AS low FROM up JOIN over USING (file_id) WHERE hz < over_hz GROUP BY up.file_id),
shaping AS (SELECT up.file_id, any_value(turn) AS edge, 0 AS place, max(db) AS level FROM up JOIN turn USING (file_id) WHERE hz > turn
  GROUP BY up.file_id HAVING count(*) FILTER (db > turn.low) >= count(*) * 0.5),
flat AS (SELECT a.file_id, a.hz, median(b.db) AS level FROM up a JOIN up b ON a.file_id = b.file_id AND b.hz BETWEEN a.hz AND a.hz + 8000 WHERE a.top >= a.hz + 8000
  GROUP BY a.file_id, a.hz, a.ref HAVING max(b.db) - min(b.db) < 4 AND median(b.db) < a.ref - 20),
flat1 AS (SELECT file_id, min(hz) AS hz, arg_min(level, hz) AS level FROM flat GROUP BY file_id),
floors AS (SELECT f.file_id, coalesce(max(u.hz), f.hz) AS edge, 1 AS place, f.level FROM flat1 f LEFT JOIN up u ON u.file_id = f.file_id AND u.hz < f.hz AND u.db > f.level + 6 GROUP BY f.file_id, f.hz, f.level),
stp AS (SELECT a.file_id, a.i, a.phz AS edge, median(b.db) AS level FROM up a JOIN up b ON a.file_id = b.file_id AND b.hz >= a.hz WHERE a.i > 1 AND a.i < a.n AND a.hz - a.phz <= 500 AND a.pdb - a.db >= 10
  GROUP BY a.file_id, a.i, a.phz, a.db HAVING max(b.db) <= a.db + 6),
steps AS (SELECT file_id, arg_min(edge, i) AS edge, 2 AS place, arg_min(level, i) AS level FROM stp GROUP BY file_id),
quiet AS (SELECT file_id, min(hz) AS edge, 3 AS place, any_value(ref) - 50 AS level FROM up WHERE db < ref - 50 GROUP BY file_id),
hits AS (SELECT * FROM shaping UNION ALL SELECT * FROM floors UNION ALL SELECT * FROM steps UNION ALL SELECT * FROM quiet),
won AS (SELECT file_id, edge, place, level FROM hits JOIN (SELECT DISTINCT file_id FROM up WHERE n >= 4) USING (file_id) QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY edge, place) = 1),
loud AS (SELECT u.file_id, max(u.hz) AS loud FROM up u JOIN won USING (file_id) LEFT JOIN shaping s ON s.file_id = u.file_id WHERE u.hz <= coalesce(s.edge, u.top) AND u.db > won.level + 20 AND u.db > u.ref - 50 GROUP BY u.file_id),
tops AS (SELECT DISTINCT file_id, top FROM up WHERE n >= 4),
content AS (SELECT blamed.*, CASE place WHEN 0 THEN 'shaping' WHEN 1 THEN 'floor' WHEN 2 THEN 'step' WHEN 3 THEN 'quiet' END AS why, won.level AS level, place,
  CASE WHEN top IS NULL THEN 0 WHEN place IS NULL THEN top ELSE greatest(won.edge, coalesce(loud, 0)) END AS content
  FROM blamed LEFT JOIN won USING (file_id) LEFT JOIN loud USING (file_id) LEFT JOIN tops USING (file_id)),
verdict AS (SELECT *, CASE WHEN place IS NULL THEN 0 WHEN sample_rate % 11025 = 0 THEN
   CASE WHEN 44100 * 0.49 >= content AND 44100 < sample_rate THEN 44100 WHEN 88200 * 0.49 >= content AND 88200 < sample_rate THEN 88200 WHEN 176400 * 0.49 >= content AND 176400 < sample_rate THEN 176400 ELSE 0 END
   ELSE CASE WHEN 48000 * 0.49 >= content AND 48000 < sample_rate THEN 48000 WHEN 96000 * 0.49 >= content AND 96000 < sample_rate THEN 96000 WHEN 192000 * 0.49 >= content AND 192000 < sample_rate THEN 192000 ELSE 0 END END AS enough
  FROM content)
"""


@query("w4_find_cliff", f"WITH {CLIFF} SELECT file_id, round(cliff0, 6) AS cliff_db, cut0 AS cutoff_hz FROM cliff")
def w4(spark, d):
    return spectrum_rules.find_cliff(files(spark, d)).select("file_id", F.round("cliff_db", 6).alias("cliff_db"), "cutoff_hz")


@query("w5_find_upsampling", f"WITH {UP} SELECT file_id, round(gap, 6) AS gap_db, round(spread, 6) AS spread_db, src AS source_rate FROM ups")
def w5(spark, d):
    gap, spread, source = spectrum_rules.find_upsampling(F.col("bands"), F.col("sample_rate"))
    return files(spark, d).select("file_id", F.round(gap, 6).alias("gap_db"), F.round(spread, 6).alias("spread_db"), source.alias("source_rate"))


@query("w6_blame_resampler", f"WITH {UP} SELECT file_id, CASE WHEN explained THEN 0 ELSE cut0 END AS cutoff_hz, round(CASE WHEN explained THEN 0 ELSE cliff0 END, 6) AS cliff_db FROM blamed")
def w6(spark, d):
    return verdicts(spark, d).select("file_id", "cutoff_hz", F.round("cliff_db", 6).alias("cliff_db"))


for _place, _name, _table in ((0, "w7_shaping", "shaping"), (1, "w8_floor", "floors"), (2, "w9_step", "steps"), (3, "w10_quiet", "quiet")):

    @query(_name, f"WITH {READ} SELECT file_id, edge, round(level, 6) AS level FROM {_table}")
    def _reading(spark, d, place=_place):
        hits = spectrum_rules.readings(files(spark, d)).select("file_id", F.explode_outer("hits").alias("h"))
        return hits.where(F.col("h.place") == place).select("file_id", F.col("h.edge").alias("edge"), F.round("h.level", 6).alias("level"))


@query("w11_bandwidth", f"WITH {READ} SELECT file_id, why AS content_why, content AS content_hz, round(level - ref, 6) AS ultra_level_db, enough AS enough_rate FROM verdict")
def w11(spark, d):
    return verdicts(spark, d).select("file_id", "content_why", "content_hz", F.round("ultra_level_db", 6).alias("ultra_level_db"), "enough_rate")


INSPECTED = f"""{READ},
inspected AS (SELECT v.file_id, path, bits_per_sample, CASE WHEN explained THEN 0 ELSE cut0 END AS cutoff, src, enough, CASE WHEN v.file_id % 11 = 5 THEN 8 ELSE 0 END AS real_bits,
  CASE WHEN v.file_id % 13 = 6 THEN 'fake_unusable' END AS failed FROM verdict v JOIN fx_headers USING (file_id)),
flags AS (SELECT *, cutoff > 0 AS lossy_source, src > 0 AS upsampled, real_bits > 0 AND real_bits < bits_per_sample AS padded_depth, enough > 0 AS wasteful,
  failed IS NULL AND (cutoff > 0 OR src > 0 OR (real_bits > 0 AND real_bits < bits_per_sample)) AS suspicious FROM inspected)
"""


def inspected(spark: SparkSession, d: str) -> DataFrame:
    headers = fixture(spark, d, "fx_headers").select("file_id", "path", "bits_per_sample")
    n = F.col("file_id")
    found = verdicts(spark, d).join(headers, "file_id")
    found = found.withColumns({"real_bits": F.when(n % 11 == 5, 8).otherwise(0), "inspect_error": F.when(n % 13 == 6, F.lit("fake_unusable"))})
    return rules.inspection_flags(found)


@query("w12_inspect_verdict", f"WITH {INSPECTED} SELECT path, cutoff AS cutoff_hz, src AS source_rate, enough AS enough_rate, suspicious FROM flags")
def w12(spark, d):
    return inspected(spark, d).select("path", "cutoff_hz", "source_rate", "enough_rate", "suspicious")


@query("p11_inspection_flags", f"WITH {INSPECTED} SELECT file_id, lossy_source, upsampled, padded_depth, wasteful, suspicious FROM flags")
def p11(spark, d):
    return inspected(spark, d).select("file_id", "lossy_source", "upsampled", "padded_depth", "wasteful", "suspicious")


@query("o3_inspect_sections", f"WITH {INSPECTED} SELECT 'lying' AS section, path FROM flags WHERE suspicious UNION ALL SELECT 'wasteful', path FROM flags WHERE wasteful AND failed IS NULL UNION ALL SELECT 'honest', path FROM flags WHERE NOT suspicious AND failed IS NULL UNION ALL SELECT 'skipped', path FROM flags WHERE failed IS NOT NULL")
def o3(spark, d):
    return summary.inspect_sections(inspected(spark, d))


@query("p12_lossy_hint", "SELECT file_id, hz, CASE WHEN hz <= 17000 THEN 'MP3/AAC ~128 kbps' WHEN hz <= 19000 THEN 'MP3 160-192 kbps' WHEN hz <= 20500 THEN 'MP3 256-320 kbps' ELSE 'MP3 320 kbps' END AS hint FROM fx_bands WHERE hz <= 25000")
def p12(spark, d):
    return fixture(spark, d, "fx_bands").where("hz <= 25000").select("file_id", "hz", rules.lossy_hint(F.col("hz")).alias("hint"))


@query("j8_first_limit", "SELECT file_id, hz, CASE WHEN hz <= 22600 THEN 44100 WHEN hz <= 24600 THEN 48000 END AS entry FROM fx_bands")
def j8(spark, d):
    limits = spark.createDataFrame(list(spectrum_rules.SOURCES), "limit long, entry int")
    return asof.first_limit_join(fixture(spark, d, "fx_bands").select("file_id", "hz"), "hz", limits)


@query("j8_many_limits", """WITH l AS (SELECT DISTINCT floor(p_retailprice * 10) * 3 AS lim FROM part), t AS (SELECT lim, cast(lim % 1000 AS INT) AS entry FROM l)
  SELECT h.file_id, h.total_samples, t.entry FROM fx_headers h ASOF LEFT JOIN t ON h.total_samples % 100000 <= t.lim""")
def j8_many(spark, d):
    limits = spark.read.parquet(f"{d}/part.parquet").select((F.floor(F.col("p_retailprice") * 10) * 3).alias("limit")).distinct().withColumn("entry", (F.col("limit") % 1000).cast("int"))
    rows = fixture(spark, d, "fx_headers").select("file_id", "total_samples", (F.col("total_samples") % 100000).alias("at"))
    return asof.first_limit_join(rows, "at", limits).drop("at")


@query("a7_band_medians", "SELECT file_id, median(db) FILTER (hz BETWEEN 15000 AND 20000) AS audible, median(db) FILTER (hz >= 26000) AS ultra FROM fx_bands GROUP BY file_id")
def a7(spark, d):
    pick = lambda test: spectrum_rules.median(F.transform(F.filter("bands", test), lambda b: b["db"]))
    return files(spark, d).select("file_id", pick(lambda b: b["hz"].between(15000, 20000)).alias("audible"), pick(lambda b: b["hz"] >= 26000).alias("ultra"))
