"""A corpus pipeline out of five operators: quality, near-duplicates, secrets, mixing, tokens.

Each stage is a function of (spark, docs, sf_dir) and gives back the columns of
``documents``; the last adds token ids. Columns that ``documents`` has besides
its own pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ensemblescope.llm import bpe_queue, importance_resampling, mixing, prob_minhash, secret_dfa
from ensemblescope.llm.common import set_aside
from ensemblescope.session import materialise

TOKENIZER = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the importance sample; those below its last key go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    aside, give_back = set_aside(docs, "doc_id", "text")
    scored, least = importance_resampling.resample(aside, labels)
    return give_back(scored.where(F.col("sample_key") >= F.lit(least)).select(*aside.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest id."""
    return prob_minhash.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and n_chars brought up to date."""
    aside, give_back = set_aside(docs, "doc_id", "text", "n_chars")
    masked = secret_dfa.find_secrets(aside, spans="_spans", masked="text").drop("_spans")
    return give_back(masked.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*aside.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it: not at all up to three times."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    plan = mixing.mix_documents(docs.select("doc_id", "source", "text"), labels)
    # Rows that repeat an id, a source and a size are taken equally often.
    plan = plan.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size")).agg(F.max("copies").alias("_copies"))
    plan = materialise(plan, "copies")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (mixing.word_count() == F.col("_size"))
    aside, give_back = set_aside(docs, "doc_id", "source", "text")
    taken = aside.join(plan.where("_copies > 0"), same)
    return give_back(taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))).select(*aside.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without their text, with token ids and the digest of what these decode to."""
    aside, give_back = set_aside(docs, "doc_id", "text")
    encoded = bpe_queue.encode_documents(aside, public_tokenizers.path(TOKENIZER), ids="token_ids", decoded="_decoded")
    digests = bpe_queue.token_digests(encoded, "token_ids", "_decoded")
    kept = [c for c in encoded.columns if c not in ("text", "_decoded")]
    return give_back(encoded.select(*kept, *digests))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
