"""Rules at their thresholds, hostile bytes, and properties of splits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklens.fixtures import fixture
from tracklens.functions import fmt
from tracklens.operators import damage, incremental, plan, rules, spectrum, spectrum_rules
from tracklens.sources.headers import walk

SF = "/root/testdata/sf0.001"


def classify(spark, **over):
    row = dict(sample_rate=44100, channels=2, bits_per_sample=16, max_blocksize=4096, error=None, lpc_share=1.0, max_lpc_order=8, max_partition_order=5, stereo_mode="-m") | over
    schema = "sample_rate int, channels int, bits_per_sample int, max_blocksize int, error string, lpc_share double, max_lpc_order int, max_partition_order int, stereo_mode string"
    r = rules.classify(spark.createDataFrame([tuple(row.values())], schema)).first()
    return r["severity"], [x["key"] for x in r["reasons"]], [x["key"] for x in r["fixable"]], [x["key"] for x in r["inherent"]]


@pytest.mark.parametrize(
    "over, severity, reasons, fixable, inherent",
    [
        ({}, 0, [], [], []),
        ({"max_blocksize": 1151}, 2, ["why_blocksize_low"], [], []),
        ({"max_blocksize": 1152}, 2, ["why_blocksize_low"], [], []),
        ({"max_blocksize": 1153}, 0, ["why_blocksize_odd"], [], []),
        ({"lpc_share": 0.0}, 2, ["why_no_lpc"], [], []),
        ({"lpc_share": 0.499}, 1, ["why_low_lpc"], [], []),
        ({"lpc_share": 0.5}, 0, [], [], []),
        ({"max_lpc_order": 6}, 0, [], [], []),
        ({"max_lpc_order": 6, "lpc_share": 0.4}, 1, ["why_low_lpc", "why_low_order"], [], []),
        ({"max_lpc_order": 6, "stereo_mode": "INDEPENDENT"}, 1, ["why_no_stereo"], [], []),
        ({"max_lpc_order": 13}, 0, [], ["sub_lpc"], []),
        ({"max_partition_order": 9}, 0, [], ["sub_partition"], []),
        ({"bits_per_sample": 18}, 0, [], [], ["sub_bps"]),
        ({"sample_rate": 655351, "max_blocksize": 4096}, 0, [], [], ["sub_rate"]),
        ({"sample_rate": 655350, "max_blocksize": 4096}, 0, [], [], []),
        ({"error": "eof", "max_blocksize": 1}, 0, [], [], []),
    ],
)
def test_classify(spark, over, severity, reasons, fixable, inherent):
    assert classify(spark, **over) == (severity, reasons, fixable, inherent)


def verdict(spark, rate, bands):
    rows = spark.createDataFrame([(1, rate, hz, float(db)) for hz, db in bands], "file_id long, sample_rate int, hz long, db double")
    return spectrum_rules.inspect_verdicts(spectrum_rules.gather_bands(rows, "file_id", "sample_rate")).first()


@pytest.mark.parametrize("fall, cutoff", [(39.9, 0), (40.0, 15500)])
def test_cliff_threshold(spark, fall, cutoff):
    bands = [(hz, -20.0 if hz <= 16000 else -20.0 - fall) for hz in range(14000, 21000, 500)]
    assert verdict(spark, 44100, bands)["cutoff_hz"] == cutoff


@pytest.mark.parametrize("level, spread, source", [(-90.0, 30.0, 44100), (-89.9, 0.0, 0), (-95.0, 30.1, 0)])
def test_upsampling_thresholds(spark, level, spread, source):
    fine = [(hz, -20.0 if hz <= 22000 else level) for hz in range(14000, 25500, 500)]
    coarse = [(hz, level) for hz in range(26000, 45000, 2000)]
    coarse[0] = (26000, level - spread)
    assert verdict(spark, 96000, fine + coarse)["source_rate"] == source


@pytest.mark.parametrize("shape, rate, expected", [(0, 96000, (0, 0, None, 44000, 0)), (2, 96000, (0, 44100, "floor", 22000, 48000)), (3, 192000, (0, 0, "shaping", 24000, 96000)), (5, 88200, (0, 0, "step", 20500, 44100)), (6, 176400, (0, 0, "quiet", 28000, 88200)), (7, 96000, (21500, 0, "floor", 30000, 0)), (8, 192000, (0, 44100, "floor", 21000, 48000))])
def test_golden_spectra(spark, shape, rate, expected):
    files = spectrum_rules.gather_bands(fixture(spark, "/root/testdata/sf0.01", "fx_bands").where((F.col("file_id") % 9 == shape) & (F.col("sample_rate") == rate)), "file_id", "sample_rate")
    found = {tuple(r) for r in spectrum_rules.inspect_verdicts(files).select("cutoff_hz", "source_rate", "content_why", "content_hz", "enough_rate").collect()}
    assert found == {expected}


@pytest.mark.parametrize("head, error", [(None, "eof"), (b"", "eof"), (b"fL", "eof"), (b"OggS0000", "not_flac"), (b"fLaC\x84\x00\x00\x00", "first_block"), (b"fLaC\x80\x00\x00\x04abcd", "short_streaminfo"), (b"fLaC\x00\x00\x00\x22" + bytes(34), "eof"), (b"ID3\x04\x00\x00\x00\x00\x00\x02xxfLaC\x80\x00\x00\x22" + bytes(34), None), (b"ID3\x04\x00\x00\xff\xff\xff\xff", "eof")])
def test_hostile_headers(head, error):
    assert walk(head)[1] == error


def test_splits_cover_and_are_disjoint(spark):
    listing, previous = fixture(spark, SF, "fx_listing"), fixture(spark, SF, "fx_previous")
    plans = incremental.incremental_split(listing, previous)
    assert plans.count() == listing.count() and {r[0] for r in plans.select("plan").distinct().collect()} <= {"reuse", "todo"}
    assert incremental.incremental_split(listing, previous, force=True).where("plan = 'reuse'").isEmpty()
    assert incremental.live_targets(previous, listing).count() == previous.count()


def test_energy_does_not_depend_on_partitions(spark):
    from tracklens.jobs.media_queries import BANDS, LENGTH, pcm

    one = {(r[0], r[1]): r[2] for r in spectrum.band_levels(spectrum.measure(pcm(spark, SF).coalesce(1), BANDS, LENGTH)).select("file_id", "hz", F.round("db", 6)).collect()}
    many = {(r[0], r[1]): r[2] for r in spectrum.band_levels(spectrum.measure(pcm(spark, SF).repartition(7), BANDS, LENGTH)).select("file_id", "hz", F.round("db", 6)).collect()}
    assert one == many and one


def test_formats_round_half_even(spark):
    row = spark.range(1).select(fmt.human_size(F.lit(1280)), fmt.human_size(F.lit(1792)), fmt.short_duration(F.lit(0.2)), fmt.audio_format(F.lit(44100), F.lit(16)), fmt.format_hms(F.lit(366100.9))).first()
    assert tuple(row) == ("1.2 kB", "1.8 kB", "1 s", "44.1 kHz/16 bit", "101:41:40")


def test_log_errors(spark):
    rows = spark.createDataFrame([("a\n\n x: ERROR , : bad\nmore",), ("one\ntwo \n",), ("",), (" \n ",)], "log string").select(damage.log_error(F.col("log")))
    assert [r[0] for r in rows.collect()] == ["bad", "two", "no_output", "no_output"]


def test_an_error_without_text_is_the_whole_line(spark):
    logs = spark.createDataFrame([("first\n a.flac: ERROR \nlast",), ("x ERROR ,: \n",), ("a.flac: ERROR, lost sync",)], "log string")
    found = [r[0] for r in logs.select(damage.log_error(F.col("log"))).collect()]
    assert found == ["a.flac: ERROR", "x ERROR ,:", "lost sync"]


def test_partition_orders_count_for_known_types_only(spark):
    from tracklens.operators.deep import subframe_stats
    from tracklens.sources.logs import parse_analysis

    lines = ["\tsubframe=0\twasted_bits=0\tpartition_order=7", "\tsubframe=1\twasted_bits=0\ttype=LPC, order=8\tresidual_type=RICE\tpartition_order=3", "\tsubframe=2\ttype=CONSTANT"]
    stats = subframe_stats(parse_analysis(spark.createDataFrame([(1, x) for x in lines], "file_id long, value string"))[1]).first()
    assert (stats["subframes"], stats["lpc"], stats["constant"], stats["max_lpc_order"], stats["max_partition_order"]) == (3, 1, 1, 8, 3)


@pytest.mark.parametrize("qp, valid", [(0, False), (1, True), (51, True), (52, False)])
def test_transcode_limits(spark, qp, valid):
    videos = spark.createDataFrame([("a", "b", "h264", qp, "copy")], "input string, output string, encoder string, qp int, audio string")
    assert plan.transcode_plan(videos).first()["valid"] is valid


def test_report_round_trip(spark, tmp_path):
    from tracklens.sources.report_store import read_report, write_report

    report = fixture(spark, SF, "fx_previous").select("path", "file_size", "is_partial")
    write_report(report, str(tmp_path / "r"), "one")
    write_report(report.limit(2), str(tmp_path / "r"), "two")
    again = read_report(spark, str(tmp_path / "r"), "one", "path string, file_size long, is_partial int, damaged boolean")
    assert again.count() == report.count() and again.where("damaged").isEmpty()


def test_listing(spark, tmp_path):
    from tracklens.sources.files import list_documents, list_files

    for name in ("a.flac", "b.FLAC", "c.orig.flac", "d.ORIG.Flac", "e.mp3", "f.pdf", "g.PDF", "h.Pdf"):
        (tmp_path / name).write_bytes(b"x")
    names = lambda df: sorted(r["path"].rsplit("/", 1)[1] for r in df.collect())
    assert names(list_files(spark, str(tmp_path))) == ["a.flac", "b.FLAC"]
    assert names(list_files(spark, str(tmp_path), originals=True)) == ["c.orig.flac", "d.ORIG.Flac"]
    assert names(list_documents(spark, str(tmp_path))) == ["f.pdf", "g.PDF"]


def test_subframe_without_type(spark):
    """A residual's type isn't the subframe's."""
    from tracklens.sources.logs import parse_analysis

    lines = spark.createDataFrame([(1, "\tsubframe=0\twasted_bits=0\tresidual_type=RICE\tpartition_order=3"), (1, "\tsubframe=1\ttype=LPC\torder=8\tresidual_type=RICE")], "file_id long, value string")
    assert [(r["type"], r["lpc_order"]) for r in parse_analysis(lines)[1].orderBy("subframe").collect()] == [(None, None), ("LPC", 8)]


def test_digest_streams_files_in_order(spark):
    import hashlib

    from tracklens.operators.spectrum import audio_digest

    rows = [(f, w, 44100, 16, 2, bytearray(bytes([f, w]) * (4 * (w + 1)))) for f in range(5) for w in range(f * 7)] + [(9, 0, 44100, 0, 0, bytearray(b"xy"))]
    df = spark.createDataFrame(rows, "file_id long, window_idx long, sample_rate int, bits_per_sample int, channels int, raw binary").repartition(7)
    want = {f: hashlib.md5(b"".join(bytes(r[5]) for r in rows if r[0] == f)).hexdigest() for f in {r[0] for r in rows}}
    found = {r["file_id"]: r for r in audio_digest(df).collect()}
    assert {f: r["md5_hex"] for f, r in found.items()} == want and found[9]["samples"] == 0


def test_unusable_files(spark):
    """Without a rate, channels or whole bytes, with few fine bands or one window a file has an error and no verdict."""
    from tracklens.jobs.inspect import inspect_library

    formats = [(1, 44100, 16, 1), (2, 0, 16, 1), (3, 44100, 16, 0), (4, 44100, 4, 1), (5, 29000, 16, 1), (6, 44100, 16, 1)]
    rows = [(f, 8 * w, rate, bits, channels, bytearray(bytes(range(1, 129)))) for f, rate, bits, channels in formats for w in range(1 if f == 6 else 3)]
    windows = spark.createDataFrame(rows, "file_id long, window_idx long, sample_rate int, bits_per_sample int, channels int, raw binary")
    found = inspect_library(spark.createDataFrame([f[:1] + f[2:3] for f in formats], "file_id long, bits_per_sample int"), windows, 64)
    assert {r["file_id"]: r["inspect_error"] for r in found.collect()} == {1: None} | {k: "fake_unusable" for k in (2, 3, 4, 5, 6)}


def test_analysis_job(spark):
    """A first run takes all files, a second only what changed; a failed log is damage, a lost header an error."""
    from tracklens.jobs.analyze import analyze_library

    listing = spark.createDataFrame([(p, 10, 1) for p in "abcd"], "path string, file_size long, mtime_us long")
    headers = spark.createDataFrame(
        [(p, None, 44100, 2, 16, 4096, 10000, "ab") for p in "ab"] + [("c", "not_flac", None, None, None, None, None, None)],
        "path string, error string, sample_rate int, channels int, bits_per_sample int, max_blocksize int, total_samples long, md5_hex string",
    )
    frames = spark.createDataFrame([(p, k, "MID_SIDE") for p in "ab" for k in range(3)], "path string, frame long, channel_assignment string")
    subframes = spark.createDataFrame([(p, k, "LPC", 8, 3) for p in "ab" for k in range(6)], "path string, subframe int, type string, lpc_order int, partition_order int")
    ends = spark.createDataFrame([("b", 1, "b: ERROR: lost sync")], "path string, exit_code int, log string")
    runs = spark.createDataFrame([("a", 10000, ""), ("b", 8192, "")], "path string, decoded_samples long, stderr string")
    none = spark.createDataFrame([], "path string, file_size long, mtime_us long, is_partial int, has_deep int, error string")
    first = analyze_library(listing, none, headers, frames, subframes, ends, runs)
    rows = {r["path"]: r for r in first.collect()}
    assert {p: (r["error"], r["damaged"], r["harmless"], r["lost_samples"], r["frames"], r["reused"]) for p, r in rows.items()} == {
        "a": (None, False, False, None, 3, False), "b": ("lost sync", True, True, 1808, None, False), "c": ("not_flac", False, False, None, None, False), "d": ("unreadable", False, False, None, None, False),
    }
    changed = spark.createDataFrame([("a", 10, 1), ("b", 10, 1), ("c", 11, 1)], listing.schema)
    again = analyze_library(changed, first.drop("reused"), headers, frames, subframes, ends, runs)
    assert {r["path"]: (r["reused"], r["error"], r["really_damaged"]) for r in again.collect()} == {"a": (True, None, False), "b": (True, "lost sync", False), "c": (False, "not_flac", False)}
    assert analyze_library(changed, first.drop("reused"), headers, frames, subframes, ends, runs, force=True).where("reused").isEmpty()


def test_rewritten_files_are_judged_by_header(spark):
    from tracklens.jobs.rewrite import rewritten_report
    from tracklens.operators import rules

    schema = "path string, error string, sample_rate int, channels int, bits_per_sample int, max_blocksize int, md5_hex string, lpc_share double, max_lpc_order int, max_partition_order int, stereo_mode string, damaged boolean, harmless boolean, suspicious boolean, inspected int, is_partial int"
    report = rules.classify(spark.createDataFrame([(p, None, 44100, 2, 16, 4096, "ab", 0.0, 4, 3, "-m", False, False, False, 1, 0) for p in "abc"], schema))
    outcomes = spark.createDataFrame([("a", "reencode", "done"), ("b", "reencode", "failed"), ("c", "reencode", "done")], "path string, kind string, status string")
    new = spark.createDataFrame([("a", None, 4096), ("c", "eof", None)], "path string, error string, max_blocksize int")
    found = {r["path"]: (r["severity"], r["lpc_share"], r["is_partial"], r["error"]) for r in rewritten_report(report, outcomes, new).collect()}
    assert found == {"a": (0, None, 1, None), "b": (2, 0.0, 0, None), "c": (2, 0.0, 0, "eof")}


def test_numbers_are_rounded_by_their_exact_value(spark):
    r = np.random.default_rng(3)
    hours = [(657143 * 9973 + 1) / 1001.0, (1017503 * 9973 + 1) / 1001.0, 5400.0, 2.25 * 3600, 1e9, 3600 * (2.0**53 + 2)] + [float(x) for x in r.uniform(5400, 1e8, 2000)] + [k / 20 * 3600 for k in range(31, 2000)]
    found = [x["t"] for x in spark.createDataFrame([(k, x) for k, x in enumerate(hours)], "k int, x double").select("k", fmt.short_duration(F.col("x")).alias("t")).orderBy("k").collect()]
    assert found == [f"{x / 3600:.1f} h" for x in hours]
    values = [0.0, 0.05, 0.15, 0.35, 0.125, 0.005, 1.005, 2.675, -2.675, 0.995, 9.999, 0.045 * 2**-6] + [k / 1000 for k in range(5, 3000, 10)]
    row = spark.createDataFrame([(k, x) for k, x in enumerate(values)], "k int, x double").select("k", fmt._fixed(F.col("x"), 2).alias("t"), fmt._fixed(F.col("x"), 1).alias("u")).orderBy("k").collect()
    assert [(x["t"], x["u"]) for x in row] == [(f"{x:.2f}", f"{x:.1f}") for x in values]
    assert spark.range(1).select(fmt.format_size(F.lit(int(1.005 * 2**50)))).first()[0] == f"{int(1.005 * 2**50) / 2**50:.2f} PiB"
