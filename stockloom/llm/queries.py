"""The registered queries of this package: each applies an operator to its whole table and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.llm import alignment, bpe, chat, decontamination, extraction, hard_negatives, jaccard, mixing, near_vectors, quality, token_count, topk, urls
from stockloom.llm.common import table

WORD_TOKENIZER, BYTE_TOKENIZER, PIECE_TOKENIZER = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def tokenizer_spec(name: str) -> str:
    """The content of a public tokenizer file, read on the driver and sent to the executors."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def tokenizer_bytes(name: str) -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def op1_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return chat.digests(chat.format_chats(turns.unionByName(extra)))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), tokenizer_spec(WORD_TOKENIZER)))


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_spec(BYTE_TOKENIZER))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_spec(BYTE_TOKENIZER), tokenizer_bytes(PIECE_TOKENIZER))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digests(decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return hard_negatives.mine(given.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


CHAT_SQL = r"""
WITH t AS (
 SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(i)),
e AS (
 SELECT *, replace(replace(text, '\', '\s'), '<', '\l') AS esc, replace(replace(replace(role, '\', '\s'), '<', '\l'), chr(10), '\n') AS head,
  role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS opens FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum(length(esc) + CASE WHEN opens THEN 6 + length(head) + 1 + 8 ELSE 6 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_scores, op2_url_filter, op3_chat_format, op4_jaccard_join, op5_top_k, op6_bpe_codec, op7_near_vectors, op8_source_mixing, op9_main_text, op10_token_counts, op11_alignment, op12_decontamination, op13_hard_negatives)}
ORACLE_SQL: dict[str, str] = {"op3_chat_format": CHAT_SQL, "op8_source_mixing": mixing.mix_sql(), "op12_decontamination": decontamination.DECONTAMINATION_SQL, "op13_hard_negatives": hard_negatives.NEGATIVES_SQL}
