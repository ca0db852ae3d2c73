"""What to re-encode, convert or repair, and whether the outcome is what was asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklens.functions.fmt import backup_path, is_original, replacement_path

from .rules import NO_MD5, rate_family

#: Decibels that a conversion may move a level, and samples that its length may differ.
LEVEL_DRIFT, LENGTH_SLACK = 3.0, 8


def target_format(rate: int | None, bits: int | None, downgrade: bool = False) -> tuple[Column, Column]:
    """(rate, bits) a file is meant to end in; downgrade clamps each on its own."""
    own_rate, own_bits = F.col("sample_rate"), F.col("bits_per_sample")
    new_rate, new_bits = F.coalesce(F.lit(rate), own_rate), F.coalesce(F.lit(bits), own_bits)
    return (F.least(new_rate, own_rate), F.least(new_bits, own_bits)) if downgrade else (new_rate, new_bits)


def conversion_plan(report: DataFrame, rate: int | None = None, bits: int | None = None, downgrade: bool = False) -> DataFrame:
    """report with target_rate, target_bits, would_raise and needs_conversion."""
    new_rate, new_bits = target_format(rate, bits, downgrade)
    return report.withColumns({
        "target_rate": new_rate, "target_bits": new_bits,
        "would_raise": (F.lit(rate or 0) > F.col("sample_rate")) | (F.lit(bits or 0) > F.col("bits_per_sample")),
        "needs_conversion": (new_rate != F.col("sample_rate")) | (new_bits != F.col("bits_per_sample")),
    })


def conversion_warnings(plan: DataFrame) -> DataFrame:
    """One row: files whose rate goes up, that cross rate families, whose depth goes up."""
    old, new = rate_family(F.col("sample_rate")), rate_family(F.col("target_rate"))
    across = (F.col("target_rate") != F.col("sample_rate")) & (old != 0) & (new != 0) & (old != new)
    todo = F.col("needs_conversion")
    return plan.agg(F.count_if(todo & (F.col("target_rate") > F.col("sample_rate"))).alias("up"), F.count_if(todo & across).alias("across"), F.count_if(todo & (F.col("target_bits") > F.col("bits_per_sample"))).alias("deeper"))


def conversion_intro(plan: DataFrame) -> DataFrame:
    """One row: files to convert, whether any ends at 16 bits, those that downgrade spares, bytes."""
    todo = F.col("needs_conversion")
    return plan.agg(
        F.count_if(todo).alias("to_convert"), F.coalesce(F.bool_or(todo & (F.col("target_bits") == 16) & (F.col("bits_per_sample") > 16)), F.lit(False)).alias("dither"),
        F.count_if(F.col("would_raise") & ~todo).alias("spared"), F.coalesce(F.sum(F.when(todo, F.col("file_size"))), F.lit(0)).alias("bytes"),
    )


def reencode_targets(plan: DataFrame, everything: bool = False, convert: bool = False) -> DataFrame:
    wanted = F.lit(True) if everything else (F.col("weak") | F.col("needs_conversion") if convert else F.col("weak"))
    return plan.where(F.col("error").isNull() & wanted)


def repair_targets(report: DataFrame) -> DataFrame:
    """report's rows to repair with kind: subset, header or salvage; a file is in one group."""
    kind = (
        F.when(F.col("really_damaged"), "salvage").when(F.col("harmless"), "header").when((F.size("fixable") > 0) & F.col("error").isNull(), "subset")
    )
    return report.withColumn("kind", kind).where(F.col("kind").isNotNull())


def outcome_measures(outcomes: DataFrame) -> DataFrame:
    """outcomes (old_size, new_size, total_samples, recovered_samples, sample_rate) with what was saved and lost."""
    share = lambda part, whole: F.coalesce(part / F.nullif(whole, F.lit(0)) * 100, F.lit(0.0))
    lost = F.greatest(F.lit(0).cast("long"), F.col("total_samples") - F.col("recovered_samples"))
    return outcomes.withColumns({
        "saved": F.col("old_size") - F.col("new_size"), "saved_pct": share(F.col("old_size") - F.col("new_size"), F.col("old_size")), "lost_samples": lost,
        "lost_seconds": F.coalesce(lost / F.nullif(F.col("sample_rate"), F.lit(0)), F.lit(0.0)), "recovered_pct": share(F.col("recovered_samples"), F.col("total_samples")),
    })


def reencode_summary(outcomes: DataFrame) -> DataFrame:
    """One row: converted, re-encoded, failed, bytes saved and how to call them."""
    good = F.col("status") != "failed"
    row = outcomes.agg(
        F.count_if(good & (F.col("kind") == "convert")).alias("converted"), F.count_if(good & (F.col("kind") != "convert")).alias("reencoded"), F.count_if(~good).alias("failed"),
        F.coalesce(F.sum(F.when(good, F.col("old_size") - F.col("new_size"))), F.lit(0)).alias("bytes"),
    )
    return row.select("converted", "reencoded", "failed", F.abs("bytes").alias("bytes"), F.when(F.col("bytes") < 0, "grew").otherwise("saved").alias("label"))


def repair_summary(outcomes: DataFrame) -> DataFrame:
    """(kind, settled, failed) for each kind."""
    return outcomes.groupBy("kind").agg(F.count_if(F.col("status") != "failed").alias("settled"), F.count_if(F.col("status") == "failed").alias("failed"))


def verify_lossless(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, problem) of rewritten files: the first field that differs, or the md5; null if all is well.

    old has audio_md5 where its header has none: the digest of the decoded audio.
    """
    fields = ("sample_rate", "channels", "bits_per_sample", "total_samples")
    new = new.select("path", *[F.col(c).alias(f"new_{c}") for c in (*fields, "md5_hex")])
    joined = old.join(new, "path")
    reference = F.when(F.col("md5_hex") == NO_MD5, F.col("audio_md5")).otherwise(F.col("md5_hex"))
    problem = F.coalesce(
        *[F.when(~F.col(c).eqNullSafe(F.col(f"new_{c}")), F.lit(c)) for c in fields],
        F.when(F.col("new_md5_hex") == NO_MD5, F.lit("md5_unset")), F.when(~F.col("new_md5_hex").eqNullSafe(reference), F.lit("md5_differs")),
    )
    return joined.select("path", problem.alias("problem"))


def verify_converted(plan: DataFrame, new: DataFrame) -> DataFrame:
    """(path, problem) of converted files against their plan and levels.

    plan has target_rate, target_bits, old_peak, old_rms; new has audio_md5, new_peak, new_rms.
    """
    new = new.select("path", *[F.col(c).alias(f"n_{c}") for c in ("sample_rate", "bits_per_sample", "channels", "total_samples", "md5_hex")], "audio_md5", "new_peak", "new_rms")
    joined = plan.join(new, "path")
    expected = F.bround(F.col("total_samples") * F.col("target_rate") / F.nullif(F.col("sample_rate"), F.lit(0)), 0).cast("long")
    drift = F.greatest(F.col("new_peak") - F.col("old_peak"), F.abs(F.col("new_rms") - F.col("old_rms")))
    known = F.col("new_peak").isNotNull() & F.col("old_peak").isNotNull() & F.col("new_rms").isNotNull() & F.col("old_rms").isNotNull()
    problem = F.coalesce(
        F.when(F.col("n_sample_rate") != F.col("target_rate"), F.lit("sample_rate")), F.when(F.col("n_bits_per_sample") != F.col("target_bits"), F.lit("bits_per_sample")),
        F.when(F.col("n_channels") != F.col("channels"), F.lit("channels")),
        F.when(F.abs(F.col("n_total_samples") - expected) > F.greatest(F.lit(LENGTH_SLACK).cast("long"), F.floor(expected / 1000)), F.lit("samples")),
        F.when(F.col("n_md5_hex") == NO_MD5, F.lit("md5_unset")), F.when(~F.col("n_md5_hex").eqNullSafe(F.col("audio_md5")), F.lit("md5_content")),
        F.when(known & (drift > LEVEL_DRIFT), F.lit("level")),
    )
    return joined.select("path", problem.alias("problem"))


def pair_originals(originals: DataFrame, files: DataFrame) -> DataFrame:
    """originals with target, the path they belong to, and target_size, null where it is gone."""
    paired = originals.where(is_original(F.col("path"))).withColumn("target", replacement_path(F.col("path")))
    return paired.join(files.select(F.col("path").alias("target"), F.col("file_size").alias("target_size")), "target", "left")


def revert_delta(paired: DataFrame) -> DataFrame:
    """One row: originals, those whose file is gone, and bytes that going back costs."""
    gone = F.col("target_size").isNull()
    return paired.agg(F.count("*").alias("originals"), F.count_if(gone).alias("gone"), F.coalesce(F.sum(F.col("file_size") - F.coalesce("target_size", F.lit(0))), F.lit(0)).alias("delta"))


def reclaimable(paired: DataFrame) -> DataFrame:
    """One row: originals that can be dropped as their file is there, and their bytes."""
    there = F.col("target_size").isNotNull()
    return paired.agg(F.count_if(there).alias("droppable"), F.coalesce(F.sum(F.when(there, F.col("file_size"))), F.lit(0)).alias("bytes"))


def backup_conflicts(targets: DataFrame, originals: DataFrame) -> DataFrame:
    """targets whose original can't be put aside, as one of exactly that name is there already."""
    taken = originals.select(F.col("path").alias("backup")).distinct()
    return targets.withColumn("backup", backup_path(F.col("path"))).join(taken, "backup", "left_semi").drop("backup")


def transcode_plan(videos: DataFrame, scale: str | None = None, audio_bitrate: str = "192k") -> DataFrame:
    """videos (input, output, encoder, qp, audio) with valid, video_filter and command (null if invalid)."""
    names = F.create_map(*[F.lit(x) for pair in (("h264", "h264_vaapi"), ("hevc", "hevc_vaapi"), ("av1", "av1_vaapi")) for x in pair])
    valid = F.col("qp").between(1, 51) & F.try_element_at(names, F.col("encoder")).isNotNull()
    video_filter = F.lit((f"scale_vaapi={scale}," if scale else "") + "format=nv12,hwupload")
    lits = lambda *x: F.array(*map(F.lit, x))
    audio = F.when(F.col("audio") == "copy", lits("-c:a", "copy")).otherwise(F.array(F.lit("-c:a"), F.col("audio"), F.lit("-b:a"), F.lit(audio_bitrate)))
    command = F.concat(
        lits("-hwaccel", "vaapi", "-i"), F.array("input"), lits("-map", "0:v", "-map", "0:a?", "-map", "0:s?", "-vf"), F.array(video_filter), lits("-c:v"), F.array(F.try_element_at(names, F.col("encoder"))),
        lits("-qp"), F.array(F.col("qp").cast("string")), lits("-c:s", "copy"), audio, lits("-map_metadata", "0", "-y"), F.array("output"),
    )
    return videos.withColumns({"valid": valid, "video_filter": video_filter, "command": F.when(valid, command)})


def scan_plan(documents: DataFrame) -> DataFrame:
    """documents (path, quality, dpi) with valid and output, the name of the scanned copy."""
    valid = F.col("quality").between(1, 100) & (F.col("dpi") >= 1)
    return documents.withColumns({"valid": valid, "output": F.concat(F.regexp_replace("path", r"\.[^./]*$", ""), F.lit("_scan.pdf"))})


def size_ratio(output: Column, source: Column) -> Column:
    return F.coalesce(output * 100 / F.nullif(source, F.lit(0)), F.lit(0.0))


def page_manifest(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc, pages, n_pages, failed) for each document: its page images by name; none means failed."""
    found = pages.groupBy("doc").agg(F.sort_array(F.collect_list("file_name")).alias("pages"))
    out = documents.select("doc").join(found, "doc", "left")
    return out.select("doc", F.coalesce("pages", F.array().cast("array<string>")).alias("pages"), F.coalesce(F.size("pages"), F.lit(0)).alias("n_pages"), F.col("pages").isNull().alias("failed"))


def scan_summary(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count_if(~F.col("failed")).alias("ok"), F.count_if(F.col("failed")).alias("failed"))
