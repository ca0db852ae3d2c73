"""Queries of the training-data operators, by name, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, article, centroids, ctw, dialogues, images, minhash, mixing, packing, pii, sharding, toxicity, warc
from .common import table


def op1_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.image_copies(images.pictures_of_vectors(table(spark, sf_dir, "embeddings")))


def op2_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op4_exact_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.coalesce("text", F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    placed = sharding.shuffle_into_shards(rows)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *pii.counted(F.col("base")), F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.listed(pii.all_spans(F.col("base"), F.col("terms"))).alias("spans")
    )


def op6_capped_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"))


def op7_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    scored = ctw.score(table(spark, sf_dir, "documents"), remainder != 1)
    return scored.select("doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score_corpus(docs, labels)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "rejected")


def op11_article_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article.extract_articles(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op12_exact_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))[0]


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogues.repair_conversations(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_image_copies": op1_image_copies,
    "op2_warc_dictionary": op2_warc_dictionary,
    "op3_anisotropic_search": op3_anisotropic_search,
    "op4_exact_shards": op4_exact_shards,
    "op5_disclosure": op5_disclosure,
    "op6_capped_mix": op6_capped_mix,
    "op7_context_tree": op7_context_tree,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_harmonic_packing": op9_harmonic_packing,
    "op10_toxicity": op10_toxicity,
    "op11_article_text": op11_article_text,
    "op12_exact_centroids": op12_exact_centroids,
    "op13_conversation_repair": op13_conversation_repair,
}

_OP2_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""

ORACLE: dict[str, str] = {"op2_warc_dictionary": _OP2_SQL, "op6_capped_mix": mixing.MIX_SQL, "op12_exact_centroids": centroids.clustering_sql()}
