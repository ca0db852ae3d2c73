"""Rule columns of the audit: block sizes, subset limits, severity, and flags of a report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest rate, weak and normal block sizes.
BLOCK_SIZES = ((48000, (1152,), (4096, 4608)), (96000, (1152, 2304), (4096, 8192)), (None, (1152, 4608), (4096, 16384)))
SMALLEST_BLOCK, LEAST_LPC_SHARE, LOW_ORDER = 1152, 0.5, 6
#: Limits of the streamable subset.
HIGH_RATE, SUBSET_BLOCK, SUBSET_BLOCK_HIGH, SUBSET_ORDER, SUBSET_PARTITION = 48000, 4608, 16384, 12, 8
SUBSET_BITS = (8, 12, 16, 20, 24, 32)
CODED_RATES = (8000, 16000, 22050, 24000, 32000, 44100, 48000, 88200, 96000, 176400, 192000)
NO_MD5 = "0" * 32
#: Severities in order.
OK, WARN, BAD = 0, 1, 2

NOTE = "struct<key:string,params:map<string,string>>"


def hi_rate(rate: Column) -> Column:
    return rate > HIGH_RATE


def _by_rate(rate: Column, pick) -> Column:
    *limited, (_, weak, normal) = BLOCK_SIZES
    out = F.array(*map(F.lit, pick(weak, normal)))
    for limit, weak, normal in reversed(limited):
        out = F.when(rate <= limit, F.array(*map(F.lit, pick(weak, normal)))).otherwise(out)
    return out


def weak_sizes(rate: Column) -> Column:
    return _by_rate(rate, lambda weak, normal: weak)


def normal_sizes(rate: Column) -> Column:
    return _by_rate(rate, lambda weak, normal: normal)


def rate_is_codable(rate: Column) -> Column:
    """Can a frame header hold the rate: coded, whole kHz to 255, Hz to 65535, tens of Hz to 655350?"""
    return rate.isin(*CODED_RATES) | ((rate % 1000 == 0) & (rate <= 255_000)) | (rate <= 65_535) | ((rate % 10 == 0) & (rate <= 655_350))


def rate_family(rate: Column) -> Column:
    return F.when(rate % 11025 == 0, 11025).when(rate % 8000 == 0, 8000).otherwise(0)


def compression_ratio(audio_size: Column, samples: Column, channels: Column, bits: Column) -> Column:
    raw = samples * channels * bits / 8
    return F.when((audio_size > 0) & (raw > 0), audio_size / raw)


def note(condition: Column, key: str, **params: Column) -> Column:
    entries = [x for k, v in params.items() for x in (F.lit(k), v.cast("string"))]
    values = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
    return F.when(condition, F.struct(F.lit(key).alias("key"), values.alias("params")))


def notes(*found: Column) -> Column:
    """The notes whose condition holds, in order."""
    return F.filter(F.array(*found).cast(f"array<{NOTE}>"), lambda x: x.isNotNull())


def note_keys(column: str) -> Column:
    return F.array_join(F.transform(column, lambda x: x["key"]), ",")


def subset_violations() -> tuple[Column, Column]:
    """(fixable, inherent): what a new encoding mends, and what belongs to the audio."""
    rate, block, high = F.col("sample_rate"), F.col("max_blocksize"), hi_rate(F.col("sample_rate"))
    limit = F.when(high, SUBSET_BLOCK_HIGH).otherwise(SUBSET_BLOCK)
    fixable = notes(
        note(block > limit, "sub_blocksize", size=block, limit=limit, rate=rate),
        note(~high & (F.col("max_lpc_order") > SUBSET_ORDER), "sub_lpc", order=F.col("max_lpc_order"), limit=F.lit(SUBSET_ORDER), rate=rate),
        note(F.col("max_partition_order") > SUBSET_PARTITION, "sub_partition", order=F.col("max_partition_order"), limit=F.lit(SUBSET_PARTITION)),
    )
    inherent = notes(
        note(~F.col("bits_per_sample").isin(*SUBSET_BITS), "sub_bps", bps=F.col("bits_per_sample"), allowed=F.lit("/".join(map(str, SUBSET_BITS)))),
        note(~rate_is_codable(rate), "sub_rate", rate=rate),
    )
    return fixable, inherent


def classify(headers: DataFrame) -> DataFrame:
    """headers with severity, reasons, fixable and inherent.

    headers may hold deep statistics (lpc_share, max_lpc_order, max_partition_order,
    stereo_mode); null ones say nothing. A low order is only told of files already
    flagged by block size or LPC share. Rows with an error are not judged.
    """
    rate, block = F.col("sample_rate"), F.col("max_blocksize")
    low = F.array_contains(weak_sizes(rate), block) | (block < SMALLEST_BLOCK)
    odd = ~low & ~F.array_contains(normal_sizes(rate), block)
    none, few = F.col("lpc_share") == 0, (F.col("lpc_share") > 0) & (F.col("lpc_share") < LEAST_LPC_SHARE)
    plain = (F.col("channels") > 1) & (F.col("stereo_mode") == "INDEPENDENT")
    first = F.when(low | none, BAD).when(few, WARN).otherwise(OK)
    severity = F.when(plain, F.greatest(first, F.lit(WARN))).otherwise(first)
    low_order = (F.col("max_lpc_order") <= LOW_ORDER) & (first > OK)
    expected = F.array_join(F.sort_array(weak_sizes(rate)), "/")
    reasons = notes(
        note(low, "why_blocksize_low", size=block, rate=rate, expected=expected), note(odd, "why_blocksize_odd", size=block, rate=rate),
        note(none, "why_no_lpc"), note(few, "why_low_lpc", pct=F.col("lpc_share") * 100), note(low_order, "why_low_order", order=F.col("max_lpc_order")),
        note(plain, "why_no_stereo"),
    )
    fixable, inherent = subset_violations()
    good, empty = F.col("error").isNull(), F.array().cast(f"array<{NOTE}>")
    return headers.withColumns({
        "severity": F.when(good, severity).otherwise(OK), "reasons": F.when(good, reasons).otherwise(empty),
        "fixable": F.when(good, fixable).otherwise(empty), "inherent": F.when(good, inherent).otherwise(empty),
    })


def false_if_null(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def analysis_flags(report: DataFrame) -> DataFrame:
    """report with weak, really_damaged, unreadable, no_md5 and needs_attention.

    report has damaged and harmless booleans, and suspicious from the inspection; null
    means no. A file without any md5 isn't one with an unset md5.
    """
    damaged, harmless = false_if_null(F.col("damaged")), false_if_null(F.col("harmless"))
    weak = F.col("severity") > OK
    attention = [weak, F.size("fixable") > 0, F.size("inherent") > 0, F.col("error").isNotNull(), false_if_null(F.col("suspicious"))]
    return report.withColumns({
        "weak": weak, "harmless": harmless, "really_damaged": damaged & ~harmless, "unreadable": F.col("error").isNotNull() & ~damaged,
        "no_md5": false_if_null(F.col("md5_hex") == NO_MD5), "needs_attention": reduce(lambda a, b: a | b, attention),
    })


def inspection_flags(inspected: DataFrame) -> DataFrame:
    """inspected with lossy_source, upsampled, padded_depth, wasteful and suspicious."""
    lossy, up = F.col("cutoff_hz") > 0, F.col("source_rate") > 0
    padded = (F.col("real_bits") > 0) & (F.col("real_bits") < F.col("bits_per_sample"))
    return inspected.withColumns({
        "lossy_source": lossy, "upsampled": up, "padded_depth": padded, "wasteful": F.col("enough_rate") > 0,
        "suspicious": F.col("inspect_error").isNull() & (lossy | up | padded),
    })


#: Cutoffs up to which a format is likely.
HINTS = ((17000, "MP3/AAC ~128 kbps"), (19000, "MP3 160-192 kbps"), (20500, "MP3 256-320 kbps"), (24000, "MP3 320 kbps"))


def first_limit(value: Column, limits: tuple[tuple[int, object], ...], last: object = None) -> Column:
    """The entry of the smallest limit that value doesn't exceed; last beyond all."""
    out = None
    for limit, entry in limits:
        out = F.when(value <= limit, entry) if out is None else out.when(value <= limit, entry)
    return out.otherwise(last) if last is not None else out


def lossy_hint(cutoff: Column) -> Column:
    return first_limit(cutoff, HINTS, HINTS[-1][1])
