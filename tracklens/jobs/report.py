"""The audit's main job: headers and frame statistics to a classified report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tracklens.operators import deep, rules


def classified_report(headers: DataFrame, subframes: DataFrame, frames: DataFrame) -> DataFrame:
    """Headers with their deep statistics, severity, reasons and violations, one row per file.

    The statistics aggregate to one row per file before the one join by file.
    """
    return rules.classify(headers.join(deep.deep_stats(subframes, frames), "file_id", "left"))
