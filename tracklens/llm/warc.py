"""WARC archives compressed record by record with a Zstandard dictionary.

An archive begins with a skippable frame that holds a dictionary trained on records of
that archive; each record is a frame of its own, so that it can be read alone. A payload
that occurs several times is stored once; the others become revisit records.

Archives are written by the tasks to the folder given, under names that no second try
of a task repeats; a manifest that Spark commits names those of the tries that counted.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path

#: Fixed values of the formats: the magic number of the dictionary's skippable frame, and the revisit profile.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this size are never revisited.
REVISIT_BYTES = 1000
#: Parts in which pages meet the response of their payload.
SALTS = 16
#: Bytes of records in an archive, of a dictionary, and of the records it is trained on.
ARCHIVE_BYTES, DICTIONARY_BYTES, TRAINING_BYTES = 32 << 20, 64 << 10, 4 << 20
#: High halves of record ids, for pages with and without an id.
_WITH_ID, _WITHOUT_ID = 0x7061676500000000, 0x6E6F696400000000


def _record_id(page_id: int | None, digest: bytes, turn: int) -> str:
    if page_id is None:
        low = int.from_bytes(hashlib.sha1(digest + struct.pack("<q", turn)).digest()[:8], "big")
        return f"<urn:uuid:{uuid.UUID(int=_WITHOUT_ID << 64 | low)}>"
    return f"<urn:uuid:{uuid.UUID(int=_WITH_ID << 64 | page_id & (1 << 64) - 1)}>"


def _page_id(record_id: str) -> int | None:
    value = uuid.UUID(record_id[10:-1]).int
    if value >> 64 != _WITH_ID:
        return None
    low = value & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, turn: int) -> bytes:
    digest = hashlib.sha1(payload).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, digest, turn)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, b'', 0)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def compress_archive(records: list[bytes]) -> bytes:
    """The dictionary's frame, then one frame per record; few records go without a dictionary."""
    size = sum(map(len, records))
    step = max(1, -(-size // TRAINING_BYTES))
    out, dictionary = [], None
    try:
        dictionary = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(size // step // 8, 1024)), records[::step], k=256, d=8, level=3)
    except zstandard.ZstdError:
        pass  # too few or too short records to train on
    if dictionary is not None:
        packed = zstandard.ZstdCompressor(level=9).compress(dictionary.as_bytes())
        out.append(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
    compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary)
    return b"".join(out + [compressor.compress(r) for r in records])


def read_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record."""
    dictionary, start = None, 0
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", content, 4)[0]
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(content[8 : 8 + size]))
        start = 8 + size
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(io.BytesIO(content[start:]), read_across_frames=True), 1 << 16)
    while first := stream.readline():
        if first.strip() == b"":
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not the beginning of a record: {first[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


def _write(frames: Iterator[pd.DataFrame], folder: str) -> Iterator[pd.DataFrame]:
    system, path = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder else (pyarrow.fs.LocalFileSystem(), folder)
    task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
    system.create_dir(path, recursive=True)
    records: list[bytes] = []
    size = count = 0

    def close() -> pd.DataFrame:
        nonlocal size, count
        name = f"{task:05d}-{attempt}-{count:05d}.warc.zst"
        with system.open_output_stream(f"{path}/{name}", compression=None) as out:
            out.write(compress_archive(records))
        done = pd.DataFrame({"name": [name], "records": [len(records)]})
        records.clear()
        size, count = 0, count + 1
        return done

    turn = 0
    for frame in frames:
        for page_id, url, html, refers_to in zip(frame["page_id"].tolist(), frame["url"], frame["html"], frame["refers_to"].tolist(), strict=True):
            payload = html.encode() if isinstance(html, str) else b""
            record = _record(None if pd.isna(page_id) else int(page_id), url if isinstance(url, str) else None, payload, None if pd.isna(refers_to) else int(refers_to), turn)
            records.append(record)
            size, turn = size + len(record), turn + 1
            if size >= ARCHIVE_BYTES:
                yield close()
    if records:
        yield close()


def _ids(column: str) -> F.Column:
    """Ids as strings, so that pandas doesn't turn nullable ids into floats."""
    return F.col(column).cast("string").alias(column)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per row of pages (page_id, url, html) to archives in folder; (name, records) of each.

    Of rows with equal payloads of at least REVISIT_BYTES bytes, that with the largest
    page_id is the response and others revisit it; rows with a null page_id, and further
    rows with that same page_id, are responses. A null html is an empty payload.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.when(F.octet_length(payload) >= REVISIT_BYTES, F.sha1(payload)).alias("digest"))
    repeated = rows.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    #: A payload that very many pages have is met in SALTS parts.
    repeated = repeated.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    linked = rows.where("digest is not null").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(repeated, ["digest", "salt"], "left")
    linked = linked.select("page_id", "url", "html", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))
    #: Short payloads take no part in the join: they have no digest to meet by.
    linked = linked.unionByName(rows.where("digest is null").select("page_id", "url", "html", F.lit(None).cast(rows.schema["page_id"].dataType).alias("refers_to")))
    linked = linked.select(_ids("page_id"), "url", "html", _ids("refers_to"))
    manifest = folder + "-manifest"
    linked.mapInPandas(lambda frames: _write(frames, folder), "name string, records long").write.parquet(manifest)
    return pages.sparkSession.read.schema("name string, records long").parquet(manifest)


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
    for frame in frames:
        for content in frame["content"]:
            rows = []
            for headers, block in read_archive(bytes(content)):
                http, _, payload = block.partition(b"\r\n\r\n")
                digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:"))
                whole = headers["warc-type"] == "response"
                if whole and hashlib.sha1(payload).digest() != digest:
                    raise ValueError(f"{headers['warc-record-id']}: the payload doesn't fit its digest")
                size = int(re.search(rb"(?mi)^content-length: *(\d+)", http)[1])
                refers = _page_id(headers["warc-refers-to"]) if "warc-refers-to" in headers else None
                page_id = _page_id(headers["warc-record-id"])
                rows.append((None if page_id is None else str(page_id), headers.get("warc-target-uri"), headers["warc-type"], payload if whole else None, size, digest.hex(), None if refers is None else str(refers)))
                if len(rows) >= 500:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """A row per record of the archives that manifest names; payload is null for revisits."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    files = files.withColumn("name", F.substring_index("path", "/", -1)).join(manifest.select("name"), "name", "left_semi")
    schema = "page_id string, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to string"
    rows = files.select("content").mapInPandas(_read, schema)
    return rows.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    manifest = write_archives(pages, folder)
    if manifest.isEmpty():
        return spark.createDataFrame([], "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")
    return read_archives(spark, folder, manifest)
