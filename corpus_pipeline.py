"""The corpus pipeline: quality classifier, near-duplicate removal, source mixing and encoding over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept. ``run`` writes each stage's result to the shared
folder as Parquet and reads it back as the next one's ``docs``. All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.llm import bpe, jaccard, mixing, quality
from stockloom.llm.common import stored, table
from stockloom.llm.queries import WORD_TOKENIZER, tokenizer_spec


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score 0.3 or more)."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct([F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")  # the corpus keeps columns named as the scores are
    return quality.score_quality(rows, model).filter("predicted = 1").select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id (null last), of each group that links of similarity 0.8 connect."""
    return jaccard.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: up to three times, or not at all."""
    return mixing.take(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its token ids (binary, little-endian 32-bit), their number, and digests of ids and decoded text."""
    encoded = bpe.encode(docs, tokenizer_spec(WORD_TOKENIZER))
    return bpe.digests(encoded, "doc_id", keep=("ids",))


STAGES = [("quality classifier", keep_quality), ("near duplicates", drop_near_copies), ("source mixing", mix_sources), ("encoding", encode_texts)]

# A trained classifier and a byte-pair encoding have no SQL form; tests/llm compares stages 2 to 4 with brute-force versions, and
# stage 1 with a filter in plain Python on the scores of the same model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
