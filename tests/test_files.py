"""Real files: walked, placed, read in ranges and written."""

import os

import numpy as np
import pytest

from tracklens.sources import files, headers


def block(kind, data, last=False):
    return bytes([kind | (0x80 if last else 0)]) + len(data).to_bytes(3, "big") + data


def info(rate=44100, channels=2, bits=16, samples=1000, block_size=4096, md5=b"\x01" * 16):
    return block_size.to_bytes(2, "big") * 2 + bytes(6) + (rate << 44 | (channels - 1) << 41 | (bits - 1) << 36 | samples).to_bytes(8, "big") + md5


def comment(vendor=b"reference encoder", rest=b"\0\0\0\0"):
    return len(vendor).to_bytes(4, "little") + vendor + rest


AUDIO = b"\xff\xf8" * 1000
PICTURE = b"\x89PNG" * 400_000
ID3 = b"ID3\x04\0\0" + bytes([0, 0, 2, 5]) + bytes(2 * 128 + 5)
CASES = {
    "plain.flac": b"fLaC" + block(0, info()) + block(4, comment(), True) + AUDIO,
    "tagged.flac": ID3 + b"fLaC" + block(0, info(rate=96000, bits=24)) + block(4, comment(b"tool \xff\xfe 1"), True) + AUDIO,
    "picture.FLAC": b"fLaC" + block(0, info()) + block(6, PICTURE) + block(4, comment(), True) + AUDIO,
    "cut.flac": b"fLaC" + block(0, info()) + block(6, PICTURE)[:50_000],
    "cut_last.flac": b"fLaC" + block(0, info()) + block(6, PICTURE, True)[:50_000],
    "cut_comment.flac": b"fLaC" + block(0, info()) + block(4, comment(), True)[:12],
    "empty.flac": b"",
    "id3_only.flac": b"ID3\x04\0",
    "other.flac": b"OggS" + bytes(100),
    "first.flac": b"fLaC" + block(4, comment()),
    "short.flac": b"fLaC" + block(0, bytes(20), True),
    "none.flac": b"fLaC" + block(0, bytes(34), True),
    "twice.flac": b"fLaC" + block(0, info()) + block(0, info(rate=48000), True) + AUDIO,
    "long_vendor.flac": b"fLaC" + block(0, info()) + block(4, b"\xff\xff\xff\xff" + b"abc", True) + AUDIO,
    "tiny_comment.flac": b"fLaC" + block(0, info()) + block(4, b"ab", True) + AUDIO,
}
#: error, rate, vendor, where the audio begins.
WANTED = {
    "plain.flac": (None, 44100, "reference encoder", 4 + 38 + 4 + 25),
    "tagged.flac": (None, 96000, "tool �� 1", len(ID3) + 4 + 38 + 4 + 17),
    "picture.FLAC": (None, 44100, "reference encoder", 4 + 38 + 4 + len(PICTURE) + 4 + 25),
    "cut.flac": ("eof", 44100, None, None), "cut_last.flac": (None, 44100, None, 4 + 38 + 4 + len(PICTURE)), "cut_comment.flac": ("eof", 44100, None, None),
    "empty.flac": ("eof", None, None, None), "id3_only.flac": ("eof", None, None, None), "other.flac": ("not_flac", None, None, None), "first.flac": ("first_block", None, None, None),
    "short.flac": ("short_streaminfo", None, None, None), "none.flac": ("no_streaminfo", 0, None, 4 + 38), "twice.flac": (None, 48000, None, 4 + 38 * 2),
    "long_vendor.flac": (None, 44100, "abc", 4 + 38 + 11), "tiny_comment.flac": (None, 44100, None, 4 + 38 + 6),
}


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    root = tmp_path_factory.mktemp("library")
    for k, (name, data) in enumerate(CASES.items()):
        folder = root / f"disc {k % 3}" / "é"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(data)
    return root


def test_headers_from_files(spark, library):
    listing = files.list_files(spark, str(library))
    assert listing.count() == len(CASES)
    found = {os.path.basename(r["path"]): r for r in headers.read_headers(listing).collect()}
    for name, (error, rate, vendor, audio) in WANTED.items():
        row = found[name]
        assert (row["error"], row["sample_rate"], row["vendor"]) == (error, rate, vendor), name
        assert row["file_size"] == len(CASES[name]) and row["audio_size"] == (None if audio is None else len(CASES[name]) - audio), name
        assert row["bytes_read"] <= 3 * files.CHUNK, name
    row = found["tagged.flac"]
    assert (row["bits_per_sample"], row["channels"], row["total_samples"], row["max_blocksize"], row["md5_hex"]) == (24, 2, 1000, 4096, "01" * 16)
    content = CASES["tagged.flac"]
    assert content[row["streaminfo_offset"] : row["streaminfo_offset"] + 34] == info(rate=96000, bits=24)


def test_kept_blocks_are_whole_and_missing_files_are_rows(spark, library):
    listing = files.list_files(spark, str(library)).select("path")
    gone = spark.createDataFrame([(str(library / "gone.flac"),), (str(library),)], "path string")
    found = {os.path.basename(r["path"]): r for r in headers.read_file_blocks(listing.unionByName(gone), (0, 2, 4, 6)).collect()}
    kept = found["picture.FLAC"]["blocks"]
    assert [(b["block_type"], b["data"]) for b in kept] == [(0, info()), (6, PICTURE), (4, comment())]
    assert found["cut_last.flac"]["error"] == "eof" and found["gone.flac"]["error"].startswith("unreadable")
    assert headers.read_headers(files.list_files(spark, str(library)).limit(0)).count() == 0


def test_tree_is_walked_as_it_lies(spark, tmp_path):
    names = ["a.flac", "b.FLAC", "c.orig.flac", "d.ORIG.Flac", "e.mp3", "x y%20z.flac"]
    for k, folder in enumerate(("", "one", "one/two", "three/four/five", "three/empty")):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        if folder != "three/empty":
            for name in names[: 6 - k % 2]:
                (tmp_path / folder / name).write_bytes(b"x" * (k + 1))
    os.symlink(tmp_path / "one", tmp_path / "three" / "linked")
    os.symlink(tmp_path / "one" / "a.flac", tmp_path / "three" / "linked.flac")
    os.symlink(tmp_path / "nothing", tmp_path / "broken.flac")
    walked = [os.path.join(d, n) for d, _, found in os.walk(tmp_path) for n in found]
    flac = [p for p in walked if p.lower().endswith(".flac") and not p.lower().endswith(".orig.flac")]
    found = files.list_files(spark, str(tmp_path)).collect()
    assert sorted(r["path"] for r in found) == sorted(flac)
    for r in found:
        stat = os.stat(r["path"]) if os.path.exists(r["path"]) else None
        assert (r["file_size"], r["mtime_us"]) == ((stat.st_size, stat.st_mtime_ns // 1000) if stat else (None, None))
    originals = [r["path"] for r in files.list_files(spark, f"file://{tmp_path}", originals=True).collect()]
    assert sorted(originals) == sorted(f"file://{p}" for p in walked if p.lower().endswith(".orig.flac"))
    assert files.list_files(spark, str(tmp_path / "no such folder")).count() == 0


def test_documents_by_either_spelling_once(spark, tmp_path):
    for name in ("a.pdf", "b.PDF", "c.Pdf"):
        (tmp_path / name).write_bytes(b"%PDF")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "d.pdf").write_bytes(b"%PDF")
    os.symlink(tmp_path / "a.pdf", tmp_path / "z.pdf")
    assert sorted(os.path.basename(r["path"]) for r in files.list_documents(spark, str(tmp_path)).collect()) == ["a.pdf", "b.PDF"]


@pytest.mark.parametrize("seed", range(4))
def test_tasks_are_near_equal_in_bytes(spark, seed):
    r = np.random.default_rng(seed)
    sizes = [int(x) for x in r.lognormal(10, [0.5, 2, 3, 0][seed], 500)] + ([10_000_000] * 2 if seed == 1 else []) + [0] * 5
    df = spark.createDataFrame([(f"/f{k}", n, k) for k, n in enumerate(sizes)], "path string, file_size long, other long").repartition(3)
    found = files.place_by_bytes(df, 7).collect()
    assert sorted((x["path"], x["file_size"], x["other"]) for x in found) == sorted((f"/f{k}", n, k) for k, n in enumerate(sizes))
    loads = [sum(x["file_size"] for x in found if x["task"] == k) for k in range(7)]
    mean = sum(sizes) / 7
    assert max(loads) <= max(4 / 3 * (mean + len(sizes)), max(sizes))
    parts = files.dealt(df, 7).rdd.glom().map(lambda rows: sum(x["file_size"] for x in rows)).collect()
    assert sorted(parts) == sorted(loads)


def test_places_of_few_or_no_files(spark):
    df = spark.createDataFrame([("/a", None), ("/b", 0)], "path string, file_size long")
    many = spark.createDataFrame([(f"/z{k}", None) for k in range(300)], df.schema)
    assert max(r["count"] for r in files.place_by_bytes(many, 3).groupBy("task").count().collect()) <= 110
    assert files.place_by_bytes(df, 3).count() == 2 and files.place_by_bytes(df.limit(0), 3).count() == 0


def test_files_are_written_whole_or_told_of(spark, tmp_path):
    (tmp_path / "taken").write_bytes(b"")
    rows = [(f"{tmp_path}/new/deep/a.flac", bytearray(b"abc")), (f"file://{tmp_path}/b.flac", None), (f"{tmp_path}/taken/c.flac", bytearray(b"x"))]
    found = {r["path"]: r for r in files.write_files(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert (tmp_path / "new/deep/a.flac").read_bytes() == b"abc" and (tmp_path / "b.flac").read_bytes() == b""
    assert [found[p]["written"] for p, _ in rows] == [3, 0, None] and found[rows[2][0]]["error"]


@pytest.mark.parametrize("partitions", [1, 3, 64])
def test_headers_as_a_data_source(spark, library, partitions):
    from tracklens.sources.readers import AudioHeaders

    spark.dataSource.register(AudioHeaders)
    loaded = spark.read.format("audio_headers").option("partitions", partitions).load(str(library))
    found = {os.path.basename(r["path"]): (r["error"], r["sample_rate"], r["vendor"], r["audio_offset"]) for r in headers.unpack_headers(loaded).collect()}
    assert {n: v[:3] for n, v in found.items()} == {n: v[:3] for n, v in WANTED.items()} and all(found[n][3] == WANTED[n][3] for n in WANTED)
    assert spark.read.format("audio_headers").option("originals", "true").load(str(library)).count() == 0
    assert spark.read.format("audio_headers").load(str(library / "nothing here")).count() == 0


@pytest.mark.parametrize("name", ["s1_walk_folder", "s4_headers_from_files", "s5_ordered_log"])
def test_files_of_slices_go_with_their_slice(spark, monkeypatch, name):
    import duckdb

    import __spark_entry__
    from tracklens import scratch
    from tracklens.jobs import file_queries

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(file_queries, "SLICE", 70)
    most, write = [], file_queries.write_all
    monkeypatch.setattr(file_queries, "write_all", lambda df: (write(df), most.append(df.count())))
    found = __spark_entry__.queries()[name](spark, sf).toArrow()
    with duckdb.connect() as con:
        for t in ("part", "lineitem"):
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        con.register("found", found)
        want = __spark_entry__.oracle_sql()[name]
        assert found.num_rows == con.execute(f"select count(*) from ({want})").fetchone()[0]
        assert con.execute(f"(select * from found except all ({want})) union all (({want}) except all select * from found)").fetchall() == []
    assert len(most) >= 3 and max(most) < 120
    left = [n for _, _, names in os.walk(scratch.run_folder(spark).removeprefix("file://")) for n in names if n.endswith((".flac", ".ana"))]
    assert left == []
