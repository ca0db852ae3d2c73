"""What the frames and subframes of a file say about its encoder.

Only counts, sums and extremes are kept, so that files of any length aggregate map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How the stereo modes of an encoder are named.
MID_SIDE, ADAPTIVE, INDEPENDENT, UNKNOWN = "-M", "-m", "INDEPENDENT", "?"


def stereo_mode(assignment: Column) -> Column:
    """Aggregate of frames' channel assignments: a decision per side beats mid/side beats none."""
    side = F.coalesce(F.bool_or(assignment.isin("LEFT_SIDE", "RIGHT_SIDE")), F.lit(False))
    mid = F.coalesce(F.bool_or(assignment == "MID_SIDE"), F.lit(False))
    return F.when(F.count(assignment) == 0, UNKNOWN).when(side, ADAPTIVE).when(mid, MID_SIDE).otherwise(INDEPENDENT)


def frame_stats(frames: DataFrame, key: str = "file_id") -> DataFrame:
    return frames.groupBy(key).agg(F.count("*").alias("frames"), stereo_mode(F.col("channel_assignment")).alias("stereo_mode"))


def subframe_stats(subframes: DataFrame, key: str = "file_id") -> DataFrame:
    """Counts and orders per file: LPC orders over LPC subframes, partition orders over those of a known type."""
    is_lpc = F.col("type") == "LPC"
    order = F.when(is_lpc, F.col("lpc_order"))
    return subframes.groupBy(key).agg(
        F.count("*").alias("subframes"), F.count_if(is_lpc).alias("lpc"), F.count_if(F.col("type") == "CONSTANT").alias("constant"),
        F.max(order).alias("max_lpc_order"), F.avg(order).alias("avg_lpc_order"), F.max(F.when(F.col("type").isNotNull(), F.col("partition_order"))).alias("max_partition_order"),
    )


def lpc_share() -> Column:
    """Share of LPC among subframes that aren't constant; 1 if there is none."""
    return F.coalesce(F.col("lpc") / F.nullif(F.col("subframes") - F.col("constant"), F.lit(0)), F.lit(1.0))


def type_histogram(subframes: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, types): how many subframes of each type, as a map with sorted keys."""
    counted = subframes.where(F.col("type").isNotNull()).groupBy(key, "type").agg(F.count("*").alias("n"))
    entries = F.sort_array(F.collect_list(F.struct("type", "n")))
    return counted.groupBy(key).agg(F.map_from_entries(entries).alias("types"))


def deep_stats(subframes: DataFrame, frames: DataFrame, key: str = "file_id") -> DataFrame:
    """One row per file that has either, with lpc_share and stereo_mode."""
    both = subframe_stats(subframes, key).join(frame_stats(frames, key), key, "full")
    return both.na.fill({"subframes": 0, "lpc": 0, "constant": 0, "frames": 0, "stereo_mode": UNKNOWN}).withColumn("lpc_share", lpc_share())
