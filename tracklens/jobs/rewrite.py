"""The jobs that write files: what was written is checked, and the report put right."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.operators import incremental, plan, rules

#: Statistics that only a whole analysis gives: unknown once a file is written anew.
DEEP = ("subframes", "lpc", "constant", "frames", "stereo_mode", "lpc_share", "max_lpc_order", "avg_lpc_order", "max_partition_order")
LOSSLESS = ("reencode", "subset")


def written_outcomes(targets: DataFrame, listing: DataFrame, written: DataFrame) -> DataFrame:
    """targets with state, problem and status: done, failed or skipped.

    targets are the report's rows to write, with kind and what the checks read
    (audio_md5, and for conversions target_rate, target_bits, old_peak, old_rms); written
    (path, header fields, audio_md5, new_peak, new_rms) has a row per file that was
    written. Targets that changed or went since the report are skipped, those without a
    written row fail as missing. Kinds reencode and subset must keep every sample, convert
    must meet its plan; header and salvage change what the checks compare.
    """
    live = incremental.live_targets(targets, listing)
    fresh = live.where("state = 'fresh'")
    kept = plan.verify_lossless(fresh.where(F.col("kind").isin(*LOSSLESS)), written.drop("audio_md5"))
    moved = plan.verify_converted(fresh.where("kind = 'convert'").drop("audio_md5"), written)
    problems = kept.unionByName(moved).where("problem is not null")
    found = live.join(problems, "path", "left").join(written.select("path", F.lit(True).alias("there")), "path", "left")
    problem = F.when(F.col("state") != "fresh", F.col("state")).when(F.col("there").isNull(), "missing").otherwise(F.col("problem"))
    status = F.when(F.col("state") != "fresh", "skipped").when(F.col("problem").isNull(), "done").otherwise("failed")
    return found.withColumn("problem", problem).withColumn("status", status).drop("there")


def rewritten_report(report: DataFrame, outcomes: DataFrame, new_headers: DataFrame) -> DataFrame:
    """report after the outcomes that are done: new headers, judged by header alone until the next analysis.

    A row whose new header can't be read keeps its verdict and has an error. Flags are worked out anew.
    """
    done = outcomes.where("status = 'done'").select("path", "kind")
    fresh = incremental.refresh_entries(report, new_headers, done)
    partial = F.col("is_partial") == 1
    fresh = fresh.withColumns({c: F.when(~partial, F.col(c)) for c in DEEP if c in fresh.columns})
    verdict = ("severity", "reasons", "fixable", "inherent")
    judged = rules.classify(fresh.withColumns({f"_{c}": F.col(c) for c in verdict}))
    judged = judged.withColumns({c: F.when(F.col("error").isNull(), F.col(c)).otherwise(F.col(f"_{c}")) for c in verdict}).drop(*[f"_{c}" for c in verdict])
    if "harmless" in judged.columns:
        judged = judged.withColumn("harmless", F.col("damaged") & F.col("harmless"))
    return rules.analysis_flags(judged)
