"""A data source for Spark: the headers of a folder's audio files, as a table that is loaded.

    spark.dataSource.register(AudioHeaders)
    unpack_headers(spark.read.format("audio_headers").load(root))

The driver looks at the upper folders only, until there are as many as partitions are
asked for; each partition walks what lies below its own. For libraries whose folders are
very unlike, list_files and read_headers deal folder by folder and file by file instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import entries
from .headers import FILE_BLOCKS, walk_file

#: Partitions that a load has unless it asks for others, and files of an Arrow batch.
PARTITIONS, BATCH_FILES = 64, 256
_SCHEMA = f"file_size long, mtime_us long, {FILE_BLOCKS}"


@dataclass
class Below(InputPartition):
    """Folders to walk, and files that were met on the way to them."""

    folders: tuple[str, ...]
    files: tuple[tuple[str, int | None, int | None], ...]


class AudioHeaders(DataSource):
    """Options: path, the folder; originals, "true" for files put aside; partitions."""

    @classmethod
    def name(cls) -> str:
        return "audio_headers"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(self.options)


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.originals = str(options.get("originals", "false")).lower() == "true"
        self.wanted = int(options.get("partitions", PARTITIONS))

    def asked(self, path: str) -> bool:
        name = path.lower()
        return name.endswith(".flac") and name.endswith(".orig.flac") == self.originals

    def partitions(self) -> list[Below]:
        """The folders of the first level that has enough of them, and what lies above that level."""
        level, files = [self.root], []
        while level and len(level) < self.wanted:
            below: list[str] = []
            for folder in level:
                for path, is_dir, size, mtime in held(folder):
                    if is_dir:
                        below.append(path)
                    elif self.asked(path):
                        files.append((path, size, mtime))
            level = below
        n = max(min(self.wanted, max(len(level), len(files))), 1)
        return [Below(tuple(level[k::n]), tuple(files[k::n])) for k in range(n)]

    def found(self, partition: Below) -> Iterator[tuple[str, int | None, int | None]]:
        yield from partition.files
        left = list(partition.folders)
        while left:
            for path, is_dir, size, mtime in held(left.pop()):
                if is_dir:
                    left.append(path)
                elif self.asked(path):
                    yield path, size, mtime

    def read(self, partition: Below) -> Iterator[pa.RecordBatch]:
        block = pa.struct([("block_idx", pa.int32()), ("block_type", pa.int32()), ("offset", pa.int64()), ("size", pa.int64()), ("data", pa.binary())])
        kinds = {"file_size": pa.int64(), "mtime_us": pa.int64(), "path": pa.string(), "blocks": pa.list_(block), "audio_offset": pa.int64(), "error": pa.string(), "bytes_read": pa.int64()}
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

        for path, size, mtime in self.found(partition):
            try:
                blocks, audio, error, taken = walk_file(path)
            except OSError as e:
                blocks, audio, error, taken = [], None, f"unreadable: {e}", 0
            rows.append((size, mtime, path, blocks, audio, error, taken))
            if len(rows) == BATCH_FILES:
                yield batch()
                rows.clear()
        if rows:
            yield batch()


def held(folder: str) -> Iterator[tuple[str, bool, int | None, int | None]]:
    """What a folder holds; nothing if it can't be read."""
    try:
        yield from entries(folder)
    except OSError:
        return
