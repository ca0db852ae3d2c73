"""Where and how a file is damaged, from what a decoder printed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shares of a track that count as its start and end.
HEAD_PCT, TAIL_PCT = 10, 90


def log_error(log: Column) -> Column:
    """The text after the first ERROR of the first line with one, or that line if nothing follows, else the last line; blank lines don't count."""
    lines = F.filter(F.transform(F.split(log, r"\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    hit = F.get(F.filter(lines, lambda x: x.contains("ERROR")), F.lit(0))
    text = F.regexp_replace(F.regexp_extract(hit, r"ERROR(.*)$", 1), r"^[ ,:]+", "")
    return F.when(hit.isNotNull(), F.coalesce(F.nullif(text, F.lit("")), hit)).when(F.size(lines) > 0, F.try_element_at(lines, F.lit(-1))).otherwise("no_output")


def error_positions(log: Column) -> Column:
    """Sample positions of decoding errors, distinct, in the order first seen."""
    found = F.regexp_extract_all(log, F.lit(r"after processing (\d+) samples"), F.lit(1))
    return F.transform(F.array_distinct(found), lambda x: x.cast("long"))


def damage_measures(runs: DataFrame) -> DataFrame:
    """runs (total_samples, decoded_samples, max_blocksize, error_positions) with what is lost."""
    lost = F.greatest(F.lit(0).cast("long"), F.col("total_samples") - F.col("decoded_samples"))
    block = F.col("max_blocksize")
    whole = (lost > 0) & (block > 0) & (F.col("decoded_samples") % F.nullif(block, F.lit(0)) == 0) & (lost < block)
    whole = F.coalesce(whole, F.lit(False))
    return runs.withColumns({"lost_samples": lost, "truncated": lost > 0, "whole_frames_only": whole, "harmless": whole & (F.size("error_positions") == 0)})


def damage_position(samples: Column, rate: Column, total: Column) -> tuple[Column, Column, Column]:
    """(seconds, pct, zone) of a sample; a rate or total of 0 counts as 1."""
    one = lambda x: F.coalesce(F.nullif(x, F.lit(0)), F.lit(1))
    pct = samples / one(total) * 100
    zone = F.when(pct < HEAD_PCT, "start").when(pct > TAIL_PCT, "end").otherwise("middle")
    return samples / one(rate), pct, zone


def deep_error(exit_code: Column, frames: Column, message: Column) -> Column:
    """Why a full read failed: the log's message, or no frames at all; null if it didn't."""
    return F.when(exit_code != 0, message).when(F.coalesce(frames, F.lit(0)) == 0, F.lit("no_frames"))
