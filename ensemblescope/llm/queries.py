"""Queries of the operators over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from . import adaptive_rules, attention_lm, bpe_queue, importance_resampling, mixing, periodic_runs, prob_minhash, reply_trees, secret_dfa, toxic_cnn, turn_repair, winnowing, zstd_langid
from .common import WORD, join_small, let

TOKENIZER = "word_bpe_49k.json"
RANKS = "byte_bpe_50k.tiktoken"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def remainder(divisor: int, column: str = "doc_id"):
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(divisor))


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = winnowing.fingerprint_neighbours(read(spark, sf_dir, "documents"))
    return prints.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )


def op2_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    formatted = reply_trees.format_trees(reply_trees.conversation_nodes(rows))
    found = formatted.select("*", reply_trees.read_back().alias("turns"), reply_trees.loss_text().alias("loss_text"))
    listing = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(listing, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op3_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(remainder(5) == 1, F.lit(False)))
    training = docs.where(~F.col("held_out"))
    fitted = attention_lm.fit_counts(training, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    fitted = attention_lm.fit_model(training, fitted)
    return attention_lm.score_texts(docs, fitted)


def op4_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", remainder(4) == 2)
    samples = zstd_langid.learn_languages(docs.where(~F.coalesce("held_out", F.lit(True))))
    found = zstd_langid.identify_languages(docs.select("doc_id", "held_out", "text"), samples)
    return found.drop("text")


def op5_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = adaptive_rules.apply_rules(read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secret_dfa.find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = tuple(r.kind for r in secret_dfa.BASE_RULES)
    return spans.select(
        "doc_id",
        *[secret_dfa.number_of(F.col("spans"), k).alias(f"n_{k}") for k in base],
        F.sha2(secret_dfa.listed(F.col("spans"), base), 256).alias("base_sha256"),
        secret_dfa.listed(F.col("spans")).alias("spans"),
    )


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored, least = importance_resampling.resample(docs, read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "log_ratio", "sample_key", (F.col("sample_key") >= F.lit(least)).alias("kept"))


def op9_bpe_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe_queue.encode_documents(docs, public_tokenizers.path(TOKENIZER))
    return encoded.select("doc_id", *bpe_queue.token_digests(encoded))


def op10_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prob_minhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "text_id", "class_id")


def _periodic_text(words, h):
    """The words from a on follow the original ones with a period, where h says so."""
    n, g = F.size(words).cast("bigint"), F.floor(h / 10)
    a = F.try_mod(g, n)
    period = 1 + F.floor((n - a) / (3 + g % 8))
    place = F.sequence(F.lit(0).cast("bigint"), n - 1)
    repeated = F.transform(place, lambda i: F.get(words, F.when(i < a, i).otherwise(a + F.try_mod(i - a, period)).cast("int")))
    return F.array_join(repeated, " ")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    changed = F.when((h % 10 == 0) & F.col("text").rlike(WORD), let(words, lambda w: _periodic_text(w, h))).otherwise(F.col("text"))
    found = periodic_runs.collapse_runs(docs.select("doc_id", changed.alias("text"))).withColumn("best", periodic_runs.most_repeated())
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(periodic_runs.listed(), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = F.lit(" ")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", *[F.coalesce(c, blank).alias(c) for c in ("role", "text")])
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    kind = F.crc32(key) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    changed = F.struct(F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    damaged = rows.select("conv_id", "turn", F.explode_outer(F.array_repeat(changed, times)).alias("row")).select("conv_id", "turn", "row.*")
    repaired = turn_repair.repair_conversations(damaged, present=F.col("role").isNotNull())
    return repaired.select("conv_id", "gaps", *turn_repair.COUNTS, "audit", F.sha2(turn_repair.listed(), 256).alias("repaired_sha256"))


def op13_toxic_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = F.coalesce(remainder(3) == 1, F.lit(False))
    model = toxic_cnn.fit(toxic_cnn.labelled_sample(docs, labels, ~held_out))
    scored = materialise(toxic_cnn.score_documents(docs.select("doc_id", "lang", held_out.alias("held_out"), "text"), model).drop("text"), "scores")
    # The limits by language come from the rows that the labels may be taken of.
    marks = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    limits = toxic_cnn.calibrate(scored.where(~F.col("held_out")).join(marks, "doc_id"))
    judged = join_small(scored, limits, ["lang"], salt_by=["doc_id"])
    limit = F.coalesce("threshold", F.lit(toxic_cnn.PLAIN_LIMIT))
    return judged.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), (F.col("score") >= limit).cast("int").alias("predicted_by_lang"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [(n, f) for n, f in globals().items() if n.startswith("op") and n[2].isdigit()]
    return dict(sorted(found, key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op5_weighted_mix": mixing.MIX_SQL, "op6_adaptive_rules": adaptive_rules.RULES_SQL}
