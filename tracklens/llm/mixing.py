"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Every source aims at its weight's share of all words; a source whose share exceeds
MAX_EPOCHS times its own words is clamped there and what it can't take is shared by
weight among the others, until no source is above. In closed form: sort the sources by
words a unit of weight, and the level of the first one that isn't clamped holds for all
behind it.

A source that is to give r times its words gives every document floor(r) whole times.
The rest goes to documents in a seeded order, each once more, until the words are used;
the last of these gives only the part that is still missing. The order is cut into
buckets by the leading digits of the hash, so that no task orders a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: A word is a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of the hash that name a bucket of the order.
DIGITS = 3


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(src, no_src, source_size, target), one row per source of sized (src, no_src, size).

    Sources are ordered by code point, a null source (no_src) last, and weigh
    weights[0], weights[1], ... in turn. Sources without words have target 0.
    """
    sources = sized.groupBy("src", "no_src").agg(F.sum("size").alias("source_size"))
    place = Window.partitionBy().orderBy("no_src", "src")
    turn = (F.row_number().over(place) - 1) % len(weights)
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("long"))
    sources = sources.withColumn("cap", F.col("source_size") * max_epochs)
    filling = Window.partitionBy().orderBy(F.col("cap") / F.col("weight"), "no_src", "src")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    behind = filling.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    sources = sources.withColumn("level", left / F.sum("weight").over(behind)).withColumn("turn", F.row_number().over(filling))
    free = F.when(F.col("weight") * F.col("level") < F.col("cap"), F.col("turn"))
    level = F.min_by("level", free).over(Window.partitionBy())
    target = F.least(F.col("weight") * F.coalesce(level, F.lit(float("inf"))), F.col("cap").cast("double"))
    return sources.select("src", "no_src", "source_size", target.alias("target"))


def mix(docs: DataFrame, seed: int = 1, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """docs with size, source_size, target, whole and part.

    The mix takes each document whole times, and part of its words once more; part is
    at most size, and below it for one document of a source at most. Texts are whole and
    counted whole; a null or empty text has size 0 and is not taken. Rows with a null
    source form the last source. Repeated rows count each; the order goes by a hash of id
    and text, so that reruns agree also where an id or a null id has several texts. Columns of docs
    with the names of the added ones are replaced; all others pass through.
    """
    added = ["size", "source_size", "target", "whole", "part"]
    own = [c for c in docs.columns if c not in added]
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))).cast("binary"))
    sized = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), n_words(F.col("text")).alias("size"), key.alias("key"),
        F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNull().alias("no_src"),
    ).withColumn("bucket", F.substring("key", 1, DIGITS))
    buckets = sized.groupBy("src", "no_src", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("src", "no_src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("earlier", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    targets = source_targets(buckets.select("src", "no_src", F.col("bucket_size").alias("size")), weights, max_epochs)
    buckets = buckets.join(targets, ["src", "no_src"])
    within = Window.partitionBy("src", "no_src", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(buckets, ["src", "no_src", "bucket"])
    words = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    placed = placed.withColumn("whole", whole).withColumn("start", F.col("earlier") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    rest = words - F.col("whole") * F.col("source_size") - F.col("start")
    placed = placed.withColumn("part", F.greatest(F.lit(0).cast("long"), F.least("size", rest)))
    return placed.select(*[F.col(f"row.`{c}`").alias(c) for c in own], *added)


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of docs, each as often as taken; a part is a text's first words."""
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("others")
    mixed = mix(docs.select(others, "doc_id", "source", "text"), **options)
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    copies = F.concat(
        F.array_repeat(F.col("text"), F.col("whole").cast("int")),
        F.when(F.col("part") == 0, F.array().cast("array<string>")).when(F.col("part") == F.col("size"), F.array("text"))
        .otherwise(F.array(F.array_join(F.slice(words, 1, F.col("part").cast("int")), ""))),
    )
    rows = mixed.where("whole > 0 or part > 0").select("others", F.explode(copies).alias("text"))
    return rows.select(*(F.col("text") if c == "text" else F.col(f"others.`{c}`") for c in docs.columns))


#: The same in DuckDB SQL.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce(source, '') AS src, source IS NULL AS no_src,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('1|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || coalesce(text, '')) AS key
  FROM documents),
s0 AS (SELECT src, no_src, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY ALL),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY no_src, src) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap FROM s0),
s2 AS (SELECT *, row_number() OVER f AS turn,
    CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
      / CAST(sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM s1 WINDOW f AS (ORDER BY CAST(cap AS DOUBLE) / weight, no_src, src)),
s3 AS (SELECT arg_min(level, turn) AS level FROM s2 WHERE weight * level < cap),
s4 AS (SELECT src, no_src, source_size, least(weight * coalesce(s3.level, CAST('inf' AS DOUBLE)), CAST(cap AS DOUBLE)) AS target FROM s2 CROSS JOIN s3),
s5 AS (SELECT *, CAST(round(target) AS BIGINT) AS words,
    CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS whole FROM s4),
d AS (SELECT sized.*, source_size, target, words, whole,
    coalesce(sum(size) OVER (PARTITION BY src, no_src ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized JOIN s5 USING (src, no_src))
SELECT doc_id, size, source_size, target,
  CAST(whole * size + greatest(0, least(size, words - whole * source_size - start)) AS BIGINT) AS taken
FROM d
"""
