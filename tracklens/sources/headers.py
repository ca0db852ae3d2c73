"""Headers of FLAC files: blocks from bytes or from files, STREAMINFO from blocks, and bytes anew.

Only the walk over a file's blocks is a helper in Python; fields are taken from the
blocks with built-in functions. From files the walk reads ranges: a block that tells
nothing of the audio, such as a picture, is passed over by its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .files import Ranged

#: Fixed values of the format: its magic, and the types of blocks that are kept with the audio.
MAGIC, STREAMINFO, COMMENT = b"fLaC", 0, 4
KEPT_TYPES = (2, 4, 6)


def syncsafe(data: bytes) -> int:
    """A number of seven bits a byte."""
    size = 0
    for byte in data:
        size = size << 7 | byte & 0x7F
    return size


def walk(head: bytes | None) -> tuple[list[tuple[int, int, bytes]], str | None]:
    """((index, type, data) of each block, error code) of the first bytes of a file."""
    at = 0
    if head is not None and head[:3] == b"ID3":
        at = 10 + syncsafe(head[6:10])
    if not head or len(head) < at + 4:
        return [], "eof"
    if head[at : at + 4] != MAGIC:
        return [], "not_flac"
    at += 4
    blocks: list[tuple[int, int, bytes]] = []
    last = False
    while not last:
        if len(head) < at + 4:
            return blocks, "eof"
        last, kind, size = bool(head[at] & 0x80), head[at] & 0x7F, int.from_bytes(head[at + 1 : at + 4], "big")
        if not blocks and kind != STREAMINFO:
            return blocks, "first_block"
        data = head[at + 4 : at + 4 + size]
        if len(data) < size:
            return blocks, "eof"
        if kind == STREAMINFO and size < 34:
            return blocks, "short_streaminfo"
        blocks.append((len(blocks), kind, data))
        at += 4 + size
    return blocks, None


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("block_idx", pa.int32()), ("block_type", pa.int32()), ("data", pa.binary())]))
    for batch in batches:
        found = [walk(x.as_py()) for x in batch.column(1)]
        lists = [[{"block_idx": i, "block_type": t, "data": d} for i, t, d in blocks] for blocks, _ in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, kind), pa.array([e for _, e in found], pa.string())], ["path", "blocks", "error"])


def read_blocks(files: DataFrame) -> DataFrame:
    """(path, blocks, error) of files (path, head); hostile bytes give an error, never a failure."""
    schema = "path string, blocks array<struct<block_idx:int,block_type:int,data:binary>>, error string"
    return files.select("path", "head").mapInArrow(_walk, schema)


#: What of a block is read: the fields of STREAMINFO, and of a comment its vendor; of other types the data only where asked for.
_INFO_BYTES = 34


def walk_file(path: str, kept: tuple[int, ...] = ()) -> tuple[list[dict], int | None, str | None, int]:
    """(blocks, where the audio begins, error code, bytes read) of a file.

    A block that isn't kept may end behind the file's end unless another should follow,
    as nothing of it is read. Blocks that are kept must be whole.
    """
    blocks: list[dict] = []
    with Ranged(path) as f:

        def give(audio: int | None, error: str | None) -> tuple[list[dict], int | None, str | None, int]:
            return blocks, audio, error, f.taken

        at = 0
        head = f.at(0, 10)
        if head[:3] == b"ID3":
            if len(head) < 10:
                return give(None, "eof")
            at = 10 + syncsafe(head[6:10])
        magic = f.at(at, 4)
        if len(magic) < 4:
            return give(None, "eof")
        if magic != MAGIC:
            return give(None, "not_flac")
        at, last = at + 4, False
        while not last:
            head = f.at(at, 4)
            if len(head) < 4:
                return give(None, "eof")
            last, kind, size = bool(head[0] & 0x80), head[0] & 0x7F, int.from_bytes(head[1:4], "big")
            if not blocks and kind != STREAMINFO:
                return give(None, "first_block")
            if kind == STREAMINFO and size < _INFO_BYTES:
                return give(None, "short_streaminfo")
            at += 4
            whole, data = at + size <= f.size, None
            if kind in kept:
                data = f.at(at, size) if whole else None
            elif kind == STREAMINFO:
                data = f.at(at, _INFO_BYTES)
                whole = len(data) == _INFO_BYTES
            elif kind == COMMENT and whole:
                data = f.at(at, min(size, 4))
                data = f.at(at, min(size, 4 + int.from_bytes(data, "little"))) if size >= 4 else data
            if not whole and (kind in kept or kind in (STREAMINFO, COMMENT)):
                return give(None, "eof")
            blocks.append({"block_idx": len(blocks), "block_type": kind, "offset": at, "size": size, "data": data})
            at += size
        return give(at, None)


FILE_BLOCKS = "path string, blocks array<struct<block_idx:int,block_type:int,offset:long,size:long,data:binary>>, audio_offset long, error string, bytes_read long"


def _walk_files(batches: Iterator[pa.RecordBatch], kept: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("block_idx", pa.int32()), ("block_type", pa.int32()), ("offset", pa.int64()), ("size", pa.int64()), ("data", pa.binary())]))
    for batch in batches:
        paths, found = batch.column(0).to_pylist(), []
        for path in paths:
            try:
                found.append(walk_file(path, kept))
            except OSError as e:
                found.append(([], None, f"unreadable: {e}", 0))
        columns = list(zip(*found, strict=True)) or [()] * 4
        kinds = (kind, pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], ["path", "blocks", "audio_offset", "error", "bytes_read"])


def read_file_blocks(files: DataFrame, kept: tuple[int, ...] = ()) -> DataFrame:
    """(path, blocks, audio_offset, error, bytes_read) of files (path); kept are types whose data is read whole.

    A file that can't be opened or read is a row with an error. Few bytes of a file are
    read, whatever its pictures weigh: a range at its head, and one where a block is passed over.
    """
    return files.select("path").mapInArrow(lambda batches: _walk_files(batches, kept), FILE_BLOCKS)


def read_headers(files: DataFrame) -> DataFrame:
    """files (path, file_size, mtime_us) with error, the fields of STREAMINFO, vendor, streaminfo_offset and audio_size."""
    schema = f"file_size long, mtime_us long, {FILE_BLOCKS}"

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in _walk_files(iter([batch]), ()):
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *found.columns], ["file_size", "mtime_us", *found.schema.names])

    found = unpack_headers(files.select("path", F.col("file_size").cast("long"), F.col("mtime_us").cast("long")).mapInArrow(walked, schema))
    info = F.try_element_at(F.filter("blocks", lambda b: b["block_type"] == STREAMINFO), F.lit(-1))
    return found.withColumns({"streaminfo_offset": info["offset"], "audio_size": F.col("file_size") - F.col("audio_offset")}).drop("blocks", "audio_offset")


def _number(data: Column, first: int, digits: int) -> Column:
    """Hexadecimal digits of data as a number; first counts from 1."""
    return F.conv(F.substring(F.hex(data), first, digits), 16, 10).cast("long")


def unpack_headers(blocks: DataFrame) -> DataFrame:
    """blocks with the fields of STREAMINFO and the vendor; where a type stands twice the last counts."""
    info = F.try_element_at(F.filter("blocks", lambda b: b["block_type"] == STREAMINFO), F.lit(-1))["data"]
    comment = F.try_element_at(F.filter("blocks", lambda b: b["block_type"] == COMMENT), F.lit(-1))["data"]
    out = blocks.withColumns({"_info": info, "_comment": comment})
    packed = _number(F.col("_info"), 26, 2)
    reversed_ = F.concat(*[F.substring(F.hex("_comment"), k, 2) for k in (7, 5, 3, 1)])
    size = F.least(F.conv(reversed_, 16, 10).cast("long"), F.length("_comment")).cast("int")
    out = out.withColumns({
        "min_blocksize": _number(F.col("_info"), 1, 4).cast("int"), "max_blocksize": _number(F.col("_info"), 5, 4).cast("int"), "sample_rate": _number(F.col("_info"), 21, 5).cast("int"),
        "channels": (F.floor(packed / 32) + 1).cast("int"),
    })
    low = F.floor(_number(F.col("_info"), 26, 2) % 32)
    out = out.withColumns({
        "bits_per_sample": (low + 1).cast("int"), "total_samples": _number(F.col("_info"), 28, 9),
        "md5_hex": F.lower(F.substring(F.hex("_info"), 37, 32)), "vendor": F.when(F.length("_comment") >= 4, F.make_valid_utf8(F.substring("_comment", F.lit(5), size).cast("string"))),
    })
    none = F.when(F.col("error").isNull() & (F.col("max_blocksize") == 0), F.lit("no_streaminfo"))
    return out.withColumn("error", F.coalesce("error", none)).drop("_info", "_comment")


def _bytes(number: Column, width: int) -> Column:
    return F.unhex(F.lpad(F.hex(number), 2 * width, "0"))


def stream_field(rate: Column, channels: Column, bits: Column, samples: Column) -> Column:
    """The eight bytes of rate (20 bits), channels - 1 (3), bits - 1 (5) and samples (36)."""
    packed = (channels - 1) * 32 + (bits - 1)
    return F.unhex(F.concat(F.lpad(F.hex(rate), 5, "0"), F.lpad(F.hex(packed), 2, "0"), F.lpad(F.hex(samples), 9, "0")))


def streaminfo_offset(head: Column) -> Column:
    """Where the data of STREAMINFO begins: behind an ID3 prefix, whose size has seven bits a byte, if there is one."""
    byte = lambda k: F.conv(F.hex(F.substring(head, k, 1)), 16, 10).cast("int") % 128
    size = ((byte(7) * 128 + byte(8)) * 128 + byte(9)) * 128 + byte(10)
    return F.when(F.hex(F.substring(head, 1, 3)) == "494433", size + 10).otherwise(0) + len(MAGIC) + 4


def patch_header(files: DataFrame) -> DataFrame:
    """files (content, streaminfo_offset and true fields) with the 24 bytes of format and digest overwritten.

    Files without decodable samples fail.
    """
    field = F.concat(stream_field(F.col("sample_rate"), F.col("channels"), F.col("bits_per_sample"), F.col("total_samples")), F.unhex("md5_hex"))
    patched = F.overlay("content", field, F.col("streaminfo_offset") + 11, F.lit(24))
    return files.withColumns({"patched": F.when(F.col("total_samples") > 0, patched), "status": F.when(F.col("total_samples") > 0, "done").otherwise("failed")})


def rebuild_metadata(blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """(path, metadata): a target's own STREAMINFO and the source's kept blocks, in order.

    blocks (path, block_idx, block_type, data) are the source's, targets (path,
    streaminfo, vendor) the new file's; the vendor of comment blocks is the target's.
    """
    size = F.conv(F.concat(*[F.substring(F.hex("data"), k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("int")
    length = F.octet_length("vendor")
    little = F.unhex(F.concat(*[F.substring(F.lpad(F.hex(length), 8, "0"), k, 2) for k in (7, 5, 3, 1)]))
    renamed = F.concat(little, F.encode("vendor", "UTF-8"), F.substring("data", F.lit(5) + size, F.length("data")))
    kept = blocks.where(F.col("block_type").isin(*KEPT_TYPES)).join(targets.select("path", "vendor"), "path")
    kept = kept.select("path", "block_idx", "block_type", F.when((F.col("block_type") == COMMENT) & (F.length("data") >= 4), renamed).otherwise(F.col("data")).alias("data"))
    own = targets.select("path", F.lit(-1).alias("block_idx"), F.lit(STREAMINFO).alias("block_type"), F.col("streaminfo").alias("data"))
    ends = Window.partitionBy("path").orderBy(F.desc("block_idx"))
    framed = own.unionByName(kept).withColumn("last", F.row_number().over(ends) == 1)
    framed = framed.withColumn("block", F.concat(_bytes(F.col("block_type") + F.when(F.col("last"), 128).otherwise(0), 1), _bytes(F.length("data"), 3), F.col("data")))
    joined = F.aggregate(F.sort_array(F.collect_list(F.struct("block_idx", "block"))), F.lit(MAGIC), lambda acc, b: F.concat(acc, b["block"]))
    return framed.groupBy("path").agg(joined.alias("metadata"))
