"""Columns called like those that operators use inside, or like their results."""

import pathlib
import re

import pytest
import public_tokenizers
from pyspark.sql import functions as F

from ensemblescope.llm import adaptive_rules, attention_lm, bpe_queue, importance_resampling, periodic_runs, prob_minhash, queries, secret_dfa, toxic_cnn, zstd_langid
from ensemblescope.llm.common import set_aside

FOLDER = pathlib.Path(adaptive_rules.__file__).parent
RESULTS = ("score", "spans", "kept", "ids", "decoded", "log_ratio", "sample_key", "n_words", "lang_pred", "runs", "n_tokens", "train_tokens")
#: Every name in the operators' code that begins with an underscore, and others that they use.
INSIDE = sorted(set(re.findall(r'"(_[a-z_]+)"', "".join(p.read_text() for p in FOLDER.glob("*.py")))) | {"good", "Digest", "symbols_high", "bands", "draw", "batch", "class_id", "word", "n"})


@pytest.fixture(scope="module")
def crowded(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta " * 12, "en", "a"), (2, None, None, None), (3, "password=abcdefgh12 and more words here", "de", "a"), (4, "", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    names = [n for n in INSIDE if n.lower() not in ("doc_id", "text", "lang", "source")]
    return docs.select("*", *[F.concat_ws("-", F.lit(n), "doc_id").alias(n) for n in names], *[F.lit("old").alias(n) for n in RESULTS])


def language_model(docs, spark):
    fitted = attention_lm.fit_counts(docs.select("doc_id", "text"), public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN)
    return attention_lm.score_texts(docs, attention_lm.fit_model(docs.select("doc_id", "text"), fitted))


def resampled(docs, spark):
    return importance_resampling.resample(docs, spark.createDataFrame([(1, 1), (3, 0)], "doc_id bigint, quality int"))[0]


def toxicity(docs, spark):
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id bigint, toxic int")
    return toxic_cnn.score_documents(docs, toxic_cnn.fit(toxic_cnn.labelled_sample(docs.select("doc_id", "text", "lang"), labels, F.lit(True))))


OPERATORS = {
    "op3": (language_model, ("n_tokens", "n_known", "base_score", "score", "train_tokens")),
    "op4": (lambda docs, spark: zstd_langid.identify_languages(docs, {"en": ["alpha beta gamma"], "de": ["und oder aber"]}), ("lang_pred", "score", "lang_margin", "lang_accepted")),
    "op6": (lambda docs, spark: adaptive_rules.apply_rules(docs), ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept")),
    "op7": (lambda docs, spark: secret_dfa.find_secrets(docs, masked="text"), ("spans",)),
    "op8": (resampled, ("log_ratio", "sample_key")),
    "op9": (lambda docs, spark: bpe_queue.encode_documents(docs, public_tokenizers.path(queries.TOKENIZER)), ("ids", "decoded")),
    "op10": (lambda docs, spark: prob_minhash.keep_one(docs), ()),
    "op11": (lambda docs, spark: periodic_runs.collapse_runs(docs), ("runs", "collapsed", "n_words")),
    "op13": (toxicity, ("score",)),
}


@pytest.mark.parametrize("operator", OPERATORS)
def test_no_name_clashes_and_none_is_lost(spark, crowded, operator):
    run, made = OPERATORS[operator]
    found = run(crowded, spark)
    assert len(set(found.columns)) == len(found.columns) and set(made) <= set(found.columns)
    passing = [c for c in crowded.columns if c not in ("doc_id", "text", "lang", "source", *made)]
    want = {r.doc_id: r for r in crowded.select("doc_id", *passing).collect()}
    got = found.select("doc_id", *passing).collect()
    # Keeping one of each class drops the empty text that equals the null one.
    assert len(got) == (3 if operator == "op10" else 4)
    assert all(r == want[r.doc_id] for r in got)
    assert not made or found.where(F.array_contains(F.array(*[F.col(m).cast("string") for m in made]), "old")).count() == 0


def test_set_aside_gives_names_back_but_for_results(spark):
    docs = spark.createDataFrame([(1, "a", 2, 3)], "doc_id int, Text string, _x int, Score int")
    aside, give_back = set_aside(docs, "doc_id", "text")
    assert aside.columns[:2] == ["doc_id", "Text"] and not {"_x", "Score"} & set(aside.columns)
    assert give_back(aside).columns == docs.columns and give_back(aside).collect() == docs.collect()
    assert give_back(aside.withColumn("score", F.lit(9))).columns == ["doc_id", "Text", "_x", "score"]
