"""The spectral job: PCM windows of a library to verdicts, one row per file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.operators import rules, spectrum, spectrum_rules


def inspect_library(headers: DataFrame, windows: DataFrame, length: int = spectrum.WINDOW, stride: int = spectrum.STRIDE, key: str = "file_id") -> DataFrame:
    """headers (key, bits_per_sample, ...) with their files' verdicts, depths and flags.

    Each rate has its own grid of bands. Files that can't be measured (no rate, channels
    or whole bytes, too few fine bands, fewer than two windows, a silent reference) have
    the error fake_unusable and no verdict. Windows are read once; energies add up
    map-side, and one shuffle gathers a file's bands, sixty at most.
    """
    levels = spectrum.gather_levels(spectrum.measure(windows, None, length, stride, key), key)
    good = levels.where("error is null")
    verdicts = spectrum_rules.inspect_verdicts(good.drop("error"))
    own = [c for c in headers.columns if c != key]
    found = headers.join(verdicts.drop("sample_rate", "bands"), key, "left").select(key, *own, *[c for c in verdicts.columns if c not in (key, "sample_rate", "bands")])
    failed = F.col("cliff_db").isNull()
    flagged = found.withColumns({"inspect_error": F.when(failed, F.lit("fake_unusable")), "real_bits": F.when(failed, 0).otherwise(spectrum.depth_without(F.col("dead")))}).drop("dead")
    return rules.inspection_flags(flagged)
