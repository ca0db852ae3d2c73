"""New and changed files as a stream: each is taken into the report once.

What is known of a path, its size and time, is keyed state in the stream's state store,
so that a batch costs what arrives in it and nothing of the report is read again. The
state of very many paths belongs on disk: set the store's provider to Spark's RocksDB one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracklens.operators.rules import classify

LISTED = "path string, sample_rate int, channels int, bits_per_sample int, max_blocksize int, total_samples long, file_size long, mtime_us long, md5_hex string, error string"
_DEEP = {"lpc_share": "double", "max_lpc_order": "int", "max_partition_order": "int", "stereo_mode": "string"}
_STATE = "file_size long, mtime_us long"


def adopt(headers: DataFrame) -> DataFrame:
    """Headers classified on their own, as partial rows of a report."""
    return classify(headers.withColumns({c: F.lit(None).cast(t) for c, t in _DEEP.items()})).withColumn("is_partial", F.lit(1))


def _number(x: object) -> int | None:
    return None if pd.isna(x) else int(x)


def _arrived(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The last row of a path in a batch, if it is new or isn't what the state knows."""
    last = None
    for part in parts:
        #: Nearly all paths have one row, which needs no order.
        found = part if last is None else pd.concat([last, part])
        last = found if len(found) == 1 else found.sort_values(["mtime_us", "file_size"], na_position="first", kind="stable").tail(1)
    now = (_number(last["file_size"].iat[0]), _number(last["mtime_us"].iat[0]))
    known = tuple(state.get) if state.exists else None
    if known != now:
        state.update(now)
        yield last.assign(change="new" if known is None else "changed")


def changes(listed: DataFrame) -> DataFrame:
    """Rows of a stream of listings that are new or changed, with change; of one path in a batch the latest by time counts."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listed.schema)
    return listed.groupBy("path").applyInPandasWithState(_arrived, f"{schema}, change string", _STATE, "append", GroupStateTimeout.NoTimeout)


def adopt_new_files(spark: SparkSession, landing: str, report: str, checkpoint: str, available_now: bool = True, files_per_batch: int | None = None) -> StreamingQuery:
    """Put files of landing (parquet of LISTED) that are new or have changed into report, as partial rows of their batch.

    landing need not exist yet with files in it. A batch that is run again after a failure
    overwrites its own folder, so that no file is taken twice.
    """

    def batch(found: DataFrame, number: int) -> None:
        adopt(found).write.mode("overwrite").parquet(f"{report}/batch={number}")

    source = spark.readStream.schema(LISTED)
    source = source.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else source
    writer = changes(source.parquet(landing)).writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_report(spark: SparkSession, report: str) -> DataFrame:
    """The rows of a report that the stream writes, of each path the last batch's."""
    rows = spark.read.parquet(report)
    last = Window.partitionBy("path").orderBy(F.desc("batch"))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "batch")
