"""The operators' queries over the driver's tables, with production parameters."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicscope.sources.tables import read_table

from . import brown_lm, conversation_repair, hard_negatives, packing, pii_surrogates, projected_ann, quality_llr, simhash_dedup, source_mixing, token_counts, token_frames, toxic_segments, url_reputation
from .common import shared_path

#: Key of the surrogates in these queries; a real run passes a secret one.
PII_KEY = "surrogate-key-1"
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
TOKENIZER, END_ID, CAPACITY = "byte_bpe_50k.json", 2, 1024


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


def op1_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the quality label of the document of its number."""
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return url_reputation.judge_urls(read_table(spark, sf_dir, "pages"), labels, rules=URL_RULES)


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pii_surrogates.replace_pii(docs, PII_KEY).select("doc_id", "text", "n_entities")


def op3_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return token_frames.write_and_digest(spark, docs, shared_path(spark, "token-frames"), tokenizer_path(), end_id=END_ID)


def op4_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score_texts(read_table(spark, sf_dir, "documents"))


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op5_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_llr.judge_quality(read_table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))


def op6_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_segments.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op9_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path(), capacity=CAPACITY, end_id=END_ID)


def op10_projected_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected_ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, by crc32 of ``conv_id:turn``; nulls are one space."""
    space = F.lit(" ")
    rule = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                            F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = conversations.withColumn("rule", rule).where("rule <> 0")
    return rows.select("conv_id", "turn", F.when(F.col("rule") == 4, "user").otherwise(role).alias("role"),
                       F.when(F.col("rule") == 1, "").when(F.col("rule") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
                       F.explode(F.when(F.col("rule") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations")
    fixed = conversation_repair.repair(damaged(conversations)).withColumnRenamed("conv_id", "id")
    every = conversations.select("conv_id").distinct()
    zero, nothing = F.lit(0).cast("long"), F.sha2(F.lit("").cast("binary"), 256)
    return every.join(fixed, F.col("conv_id").eqNullSafe(F.col("id")), "left").select(
        "conv_id", *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path(), limit=CAPACITY)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of rows whose id is divisible by 7 are moved on by one."""
    rows = read_table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_host_reputation, op2_pii_surrogates, op3_token_frames, op4_brown_lm, op5_quality_llr, op6_toxic_segments,
                                   op7_covering_simhash, op8_entropy_mixing, op9_residual_packing, op10_projected_ann,
                                   op11_conversation_repair, op12_token_counts, op13_hard_negatives)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLE: dict[str, str] = {
    "op13_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM pos JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY rank <= 5""",
}
