"""Folders from end to end: PCM in windows, stored reports, logs in order, limits of any number."""

import gzip
import hashlib
import json
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_files import block, comment, info

from tracklens.jobs import library
from tracklens.operators import asof, spectrum
from tracklens.sources import files, logs, pcm, report_store

FORMATS = {"mono16": (44100, 16, 1), "stereo16": (44100, 16, 2), "stereo24": (96000, 24, 2), "six24": (48000, 24, 6)}


def sound(frames, rate, bits, channels, seed, quiet_low=False):
    """Interleaved little-endian samples of noise and a tone."""
    r = np.random.default_rng(seed)
    t = np.arange(frames) / rate
    x = 0.3 * np.sin(2 * np.pi * 1000 * t)[:, None] + r.normal(size=(frames, channels)) * 0.02
    whole = np.clip(np.round(x * (1 << (bits - 1))), -(1 << (bits - 1)), (1 << (bits - 1)) - 1).astype(np.int64)
    if quiet_low:
        whole = whole >> 8 << 8
    return b"".join(int(v).to_bytes(bits // 8, "little", signed=True) for v in whole.ravel())


@pytest.fixture(scope="module")
def audio(tmp_path_factory):
    root = tmp_path_factory.mktemp("pcm")
    held = {}
    for k, (name, (rate, bits, channels)) in enumerate(FORMATS.items()):
        held[name] = sound(4096 * 17 + 1000 + k, rate, bits, channels, k)[: -1 if k == 1 else None]
        (root / f"{name}.pcm").write_bytes(held[name])
    (root / "empty.pcm").write_bytes(b"")
    return root, held


def rows_of(spark, root, **more):
    rows = [(n, str(root / f"{n}.pcm"), os.path.getsize(root / f"{n}.pcm"), *FORMATS.get(n, (44100, 16, 1))) for n in (*FORMATS, "empty")]
    rows += [("gone", str(root / "gone.pcm"), 10_000, 44100, 16, 1), ("odd", str(root / "mono16.pcm"), 10, 0, 16, 1)]
    return spark.createDataFrame(rows, "path string, pcm_path string, pcm_size long, sample_rate int, bits_per_sample int, channels int")


@pytest.mark.parametrize(("length", "stride", "range_bytes"), [(4096, 8, 16 << 20), (4096, 1, 100_000), (4096, 8, 1), (64, 3, 5000)])
def test_windows_are_those_of_a_plain_reader(spark, audio, length, stride, range_bytes):
    root, held = audio
    found = pcm.cut_windows(rows_of(spark, root), length, stride, range_bytes=range_bytes).collect()
    got = {(r["path"], r["window_idx"]): bytes(r["raw"]) for r in found if r["raw"] is not None}
    want = {}
    for name, (_, bits, channels) in FORMATS.items():
        size = bits // 8 * channels * length
        for k in range(0, -(-len(held[name]) // size), stride):
            want[name, k] = held[name][k * size : (k + 1) * size]
    assert got == want and len(found) == len(want) + sum(r["raw"] is None for r in found)
    assert {r["path"] for r in found if r["error"]} == {"gone"}
    if range_bytes == 100_000:
        placed = pcm.cut_windows(rows_of(spark, root), length, stride, range_bytes=range_bytes).withColumn("p", F.spark_partition_id())
        assert placed.where("path = 'six24'").select("p").distinct().count() > 1


def test_spectra_of_stereo_files_and_whole_windows(spark, audio):
    """Energies, depths, levels and digests against plain sums over the mean of the channels."""
    root, held = audio
    table = rows_of(spark, root)
    windows = pcm.cut_windows(table, spectrum.WINDOW, spectrum.STRIDE)
    found = {(r["path"], r["hz"]): r for r in spectrum.measure(windows, key="path").collect()}
    shape = spectrum.window_function(4096)
    for name, (rate, bits, channels) in FORMATS.items():
        size = bits // 8 * channels
        x = spectrum.decode_pcm(held[name][: len(held[name]) // size * size], bits, channels).mean(axis=1)
        grid = [(0, 0), *spectrum.grid_of(rate)]
        assert {hz for n, hz in found if n == name} == {hz for hz, _ in grid} | {-1}
        assert found[name, -1]["windows"] == 3 and found[name, -1]["dead"] == 0
        for hz, cell in grid[::7]:
            total = 0.0
            for turn, start in enumerate((0, 8, 16), 1):
                y = x[start * 4096 : (start + 1) * 4096] * shape
                f = (hz or 1000) + ((turn * spectrum.GOLDEN) % 1 - 0.5) * cell
                total += abs(np.exp(-2j * np.pi * f * np.arange(4096) / rate) @ y) ** 2
            assert found[name, hz]["energy"] == pytest.approx(total, rel=1e-6)
    levels = {r["path"]: r for r in spectrum.signal_levels(pcm.cut_windows(table, spectrum.WINDOW, seconds=1), spectrum.WINDOW, 1, "path").collect()}
    x = spectrum.decode_pcm(held["stereo24"][: 6 * 96000 // 6 * 6], 24, 2)[:96000]
    assert levels["stereo24"]["peak_db"] == pytest.approx(20 * np.log10(np.abs(x).max())) and levels["stereo24"]["rms_db"] == pytest.approx(10 * np.log10((x**2).mean()))
    want = {n: (len(d) // (FORMATS[n][1] // 8 * FORMATS[n][2]), hashlib.md5(d).hexdigest()) for n, d in held.items()}
    digests = {r["path"]: (r["samples"], r["md5_hex"]) for r in spectrum.audio_digest(pcm.cut_windows(table, 4096), "path").collect()}
    streamed = {r["path"]: (r["samples"], r["md5_hex"]) for r in pcm.file_digests(table, 3).collect() if r["error"] is None}
    assert {n: digests[n] for n in want} == want == {n: streamed[n] for n in want}
    assert streamed["empty"] == (0, hashlib.md5(b"").hexdigest()) and "gone" not in streamed


def test_store_keeps_the_old_report_until_the_new_one_is_whole(spark, tmp_path):
    store = str(tmp_path / "store")
    assert report_store.read_report(spark, store, "/lib").count() == 0
    schema = "path string, file_size long, damaged boolean, lost_samples long, error_positions array<long>, inspected int, cutoff_hz long, content_why string, streaminfo_offset long, extra string"
    rows = [("a", 1, False, None, None, 0, None, None, 8, "x"), ("b", 2, True, 7, [1, 2], 1, 16000, "step", 8, "y"), ("c", 3, False, 5, [1], 1, 0, None, 8, None)]
    report = spark.createDataFrame(rows, schema)
    assert report_store.write_report(report, store, "/lib") == 1 and report_store.write_report(report.limit(1), store, "/other") == 1
    first = report_store.read_report(spark, store, "/lib")
    got = {r["path"]: r for r in first.collect()}
    assert got["a"]["cutoff_hz"] is None and got["a"]["is_partial"] == 0 and got["b"]["error_positions"] == [1, 2] and got["b"]["cutoff_hz"] == 16000 and got["c"]["lost_samples"] is None
    #: What is written may be what was read, and goes to the same place.
    assert report_store.write_report(first.withColumn("file_size", F.col("file_size") + 10), store, "/lib") == 2
    broken = report_store.read_report(spark, store, "/lib").withColumn("file_size", F.raise_error(F.lit("disk full")).cast("long"))
    with pytest.raises(Exception, match="disk full"):
        report_store.write_report(broken, store, "/lib")
    assert sorted(r["file_size"] for r in report_store.read_report(spark, store, "/lib").collect()) == [11, 12, 13]
    #: A manifest whose writing broke off doesn't count, and its number isn't used again.
    folder = report_store._folder(store, "/lib")
    with open(f"{folder}/manifest-000000000003.json", "w") as f:
        f.write('{"versi')
    assert report_store.read_report(spark, store, "/lib").count() == 3
    assert report_store.write_report(first.limit(2), store, "/lib") == 4 and report_store.read_report(spark, store, "/lib").count() == 2
    snapshots = lambda: [n for n in os.listdir(folder) if n.startswith("snapshot-")]
    assert len(snapshots()) == 4 and report_store.expire(spark, store, "/lib", keep=1) == 3 and len(snapshots()) == 1
    assert report_store.read_report(spark, store, "/lib").count() == 2 and report_store.read_report(spark, store, "/other").count() == 1


def test_a_report_of_another_version_is_an_error(spark, tmp_path):
    store = str(tmp_path)
    report_store.write_report(spark.createDataFrame([("a", 1)], "path string, is_partial int"), store, "/lib")
    manifest = f"{report_store._folder(store, '/lib')}/manifest-000000000001.json"
    with open(manifest) as f:
        said = json.load(f)
    os.remove(manifest)
    with open(f"{report_store._folder(store, '/lib')}/manifest-000000000002.json", "w") as f:
        json.dump(said | {"version": 9}, f)
    with pytest.raises(ValueError, match="version 9"):
        report_store.read_report(spark, store, "/lib")
    assert library.last_report(spark, store, "/lib").count() == 0


def test_two_runs_do_not_both_commit(spark, tmp_path, monkeypatch):
    report = spark.createDataFrame([("a", 1)], "path string, is_partial int")
    report_store.write_report(report, str(tmp_path), "/lib")
    monkeypatch.setattr(report_store, "_latest", lambda *_: (0, None))
    with pytest.raises(RuntimeError, match="meanwhile"):
        report_store.write_report(report.limit(0), str(tmp_path), "/lib")
    monkeypatch.undo()
    assert report_store.read_report(spark, str(tmp_path), "/lib").count() == 1


def test_subframes_find_their_frame_across_parts(spark, tmp_path):
    lines, want = [], []
    r = np.random.default_rng(2)
    for k in range(3):
        text = []
        for frame in range(60):
            text.append(f"frame={frame}\toffset={frame * 99}\tchannel_assignment=MID_SIDE")
            for s in range(int(r.integers(0, 40 if frame % 10 else 200))):
                text.append(f"\tsubframe={s}\twasted_bits=0\ttype=LPC\torder={s % 9}\tresidual_type=RICE\tpartition_order=2")
                want.append((f"{k}.ana", frame, s))
            text.append("    noise=3")
        (tmp_path / f"{k}.ana").write_text("\n".join(text))
        lines.append(len("\n".join(text)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(max(lines) // 10))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = logs.read_log(spark, str(tmp_path))
        frames, subframes = logs.parse_analysis(read, "path")
        assert read.select("path", "start").distinct().count() > 20
        got = [(os.path.basename(x["path"]), x["frame"], x["subframe"]) for x in subframes.collect()]
        assert sorted(got) == sorted(want) and frames.count() == 180
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("read", [1, 3, 1 << 20])
def test_lines_of_parts_are_those_of_the_file(tmp_path, monkeypatch, read):
    monkeypatch.setattr(logs, "READ", read)
    r = np.random.default_rng(6)
    for k, text in enumerate([b"", b"a", b"\n", b"\r\n", b"a\r\nb", b"\r\r\n\n", b"abcdef\n", *(bytes(r.choice(list(b"ab\r\n"), 40).tolist()) for _ in range(30))]):
        path = tmp_path / f"{k}.ana"
        path.write_bytes(text)
        want = [x.decode() for x in text.splitlines()]
        for step in (1, 2, 3, 7, 100):
            parts = [(str(path), at, min(at + step, len(text))) for at in range(0, max(len(text), 1), step)]
            rows = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*parts, strict=True)], ["path", "start", "end"])
            assert [x for b in logs._lines(iter([rows])) for x in b.column("value").to_pylist()] == want
    packed = tmp_path / "x.ana.gz"
    packed.write_bytes(gzip.compress(b"one\ntwo"))
    rows = pa.RecordBatch.from_arrays([pa.array([str(packed)]), pa.array([0]), pa.array([None], pa.int64())], ["path", "start", "end"])
    assert [x for b in logs._lines(iter([rows])) for x in b.column("value").to_pylist()] == ["one", "two"]


def test_no_listing_of_logs_passes_through_the_driver(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.ana").write_text(f"frame={k}\toffset=0\n\tsubframe=1\ttype=LPC\n")
    (tmp_path / "_hidden.ana").write_text("frame=9\toffset=0\n")
    parts = logs.log_parts(spark, str(tmp_path))
    assert not any(p.endswith(".ana") for p in parts.inputFiles()) and parts.count() == 3
    for path, count in ((str(tmp_path), 3), (f"{tmp_path}/[01].ana", 2), (f"file://{tmp_path}/2.ana", 1)):
        found = logs.read_log(spark, path).where("value like '%subframe%'").collect()
        assert len(found) == count and all(os.path.basename(x["path"]) == f"{x['frame']}.ana" for x in found)
    with pytest.raises(FileNotFoundError):
        logs.read_log(spark, str(tmp_path / "nothing"))


@pytest.mark.parametrize("few", [0, 1000])
def test_limits_of_any_number(spark, monkeypatch, few):
    monkeypatch.setattr(asof, "FEW", few)
    r = np.random.default_rng(4)
    limits = [(int(x), int(k)) for k, x in enumerate(r.integers(0, 3000, 400))] + [(7, 5), (7, 3)]
    values = [*map(int, r.integers(-10, 3100, 2000)), *[1500] * 900, None]
    rows = spark.createDataFrame([(k, v, {"m": "x"}, k) for k, v in enumerate(values)], "id long, v long, m map<string,string>, `a.b` long").repartition(5)
    found = asof.first_limit_join(rows, "v", spark.createDataFrame([*limits, (None, 1)], "limit long, entry int").repartition(3))
    assert found.columns == ["id", "v", "m", "a.b", "entry"]
    order = sorted(limits)
    first = lambda v: next((e for lim, e in order if v is not None and lim >= v), None)
    assert {x["id"]: x["entry"] for x in found.collect()} == {k: first(v) for k, v in enumerate(values)}
    assert asof.first_limit_join(rows.limit(3), "v", spark.createDataFrame([], "limit long, entry int")).where("entry is null").count() == 3
    assert asof.first_limit_join(rows.limit(0), "v", spark.createDataFrame(limits, "limit long, entry int")).count() == 0


def head(rate, bits, channels, samples):
    return b"fLaC" + block(0, info(rate=rate, bits=bits, channels=channels, samples=samples)) + block(4, comment(), True) + b"\xff\xf8" * 50


def test_a_folder_is_analysed_inspected_and_only_what_changed_again(spark, tmp_path):
    root, decoded, store = tmp_path / "lib", tmp_path / "decoded", str(tmp_path / "store")
    wide = {"a": (44100, 24, 2), "deep/b": (96000, 24, 1), "deep/c": (44100, 16, 2)}
    for k, (name, form) in enumerate(wide.items()):
        for top, suffix, data in ((root, ".flac", head(*form, 4096 * 17)), (decoded, ".flac.pcm", sound(4096 * 17, *form, k, quiet_low=name == "a"))):
            (top / name).parent.mkdir(parents=True, exist_ok=True)
            (top / f"{name}{suffix}").write_bytes(data)
    (root / "broken.flac").write_bytes(b"nothing")
    (root / "a.orig.flac").write_bytes(head(44100, 16, 2, 5))
    path = lambda n: str(root / f"{n}.flac")

    def run(names, **more):
        frames = spark.createDataFrame([(path(n), k, "MID_SIDE") for n in names for k in range(3)], "path string, frame long, channel_assignment string")
        subframes = spark.createDataFrame([(path(n), k, "LPC", 8, 3) for n in names for k in range(6)], "path string, subframe int, type string, lpc_order int, partition_order int")
        ends = spark.createDataFrame([(path(n), 1, "x: ERROR: lost sync") for n in names if n == "deep/c"], "path string, exit_code int, log string")
        runs = spark.createDataFrame([(path("deep/c"), 4096 * 16, "")], "path string, decoded_samples long, stderr string")
        return {r["path"]: r for r in library.analyze_folder(spark, str(root), store, frames, subframes, ends, runs, **more).collect()}

    assert sorted(r["path"] for r in library.folder_todo(spark, str(root), store).collect()) == sorted(path(n) for n in [*wide, "broken"])
    first = run(wide)
    assert {p: (r["error"], r["frames"], r["lost_samples"], r["really_damaged"]) for p, r in first.items()} == {
        path("a"): (None, 3, None, False), path("deep/b"): (None, 3, None, False), path("deep/c"): ("lost sync", None, 4096, True), path("broken"): ("not_flac", None, None, False),
    }
    seen = {r["path"]: r for r in library.inspect_folder(spark, str(root), store, str(decoded)).collect()}
    assert {p: (r["inspected"], r["inspect_error"], r["padded_depth"]) for p, r in seen.items()} == {
        path("a"): (1, None, True), path("deep/b"): (1, None, False), path("deep/c"): (1, None, False), path("broken"): (0, None, None),
    }
    assert seen[path("a")]["real_bits"] == 16 and seen[path("deep/b")]["content_hz"] is not None and seen[path("deep/c")]["lost_samples"] == 4096
    #: One file changes, one comes, one goes: only those are read, and verdicts stay.
    (root / "a.flac").write_bytes(head(44100, 24, 2, 4096 * 17) + b"more")
    os.utime(root / "a.flac", (1, 1))
    (root / "new.flac").write_bytes(head(48000, 16, 1, 9))
    os.remove(root / "deep/b.flac")
    assert sorted(r["path"] for r in library.folder_todo(spark, str(root), store).collect()) == [path("a"), path("new")]
    again = run(["a", "new"])
    assert {p: (r["inspected"], r["frames"]) for p, r in again.items()} == {path("a"): (0, 3), path("new"): (0, 3), path("deep/c"): (1, None), path("broken"): (0, None)}
    (root / "late.flac").write_bytes(head(48000, 16, 1, 9))
    seen = {r["path"]: r for r in library.inspect_folder(spark, str(root), store, str(decoded)).collect()}
    assert {p: (r["inspected"], r["is_partial"], r["inspect_error"]) for p, r in seen.items()} == {
        path("a"): (1, 0, None), path("new"): (1, 0, "fake_unusable"), path("deep/c"): (1, 0, None), path("broken"): (0, 0, None), path("late"): (1, 1, "fake_unusable"),
    }
    listing = files.list_files(spark, str(root)).withColumns({"channels": F.lit(2), "bits_per_sample": F.lit(24)})
    sums = {r["path"]: r["md5_hex"] for r in library.folder_digests(spark, listing, str(root), str(decoded), 3).collect()}
    assert sums == {path(n): hashlib.md5((decoded / f"{n}.flac.pcm").read_bytes()).hexdigest() for n in ("a", "deep/c")}
