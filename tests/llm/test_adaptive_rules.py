import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from llm_helpers import no_docs, odd_docs, plain  # noqa: F401

from ensemblescope.llm import queries
from ensemblescope.llm.adaptive_rules import RULES_SQL, apply_rules, measure, sketches, thresholds
from ensemblescope.llm.common import grid, grid_floor

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {i + k for places in seen.values() if len(places) > 1 for i in places for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines), len(lines) - len(set(lines)), len(repeated)


def test_measures_equal_brute_force(spark):
    random.seed(4)
    texts = [None, "", " \t", "a", "a a", "a a a", "a a a a", "x y z x y z", "😀 é\x0b#é |<b>\n\n😀 é\x0b#é |<b>", "ab\n ab\nab\n"]
    texts += [" ".join(random.choice("abcd") for _ in range(random.randint(0, 60))).replace("d", random.choice("d\n")) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("n_words", F.lit("clash"))
    got = {r.doc_id: tuple(r)[1:] for r in measure(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words").collect()}
    assert got == {k: brute(t) for k, t in enumerate(texts)}


def test_grid_is_exact_below_64_and_close_above(spark):
    values = [*range(70), 127, 128, 1000, 123_456_789]
    table = spark.createDataFrame([(v,) for v in values], "v bigint").withColumn("g", grid(F.col("v")))
    for r in table.withColumn("f", grid_floor(F.col("g"))).collect():
        assert r.f == r.v if r.v < 64 else r.f <= r.v <= r.f * (1 + 1 / 32)
    bins = [r.g for r in table.orderBy("v").collect()]
    assert bins == sorted(bins)


def test_limits_follow_language_and_source(spark):
    random.seed(5)

    def text(n, sign):
        return " ".join("".join(random.choice("abcdefghij") for _ in range(5)) + (sign if random.random() < 0.5 else "") for _ in range(n))

    rows = [(k, text(80, "#" if k % 2 else ""), "en", "tags" if k % 2 else "prose") for k in range(300)]
    rows += [(1000, text(80, "#"), "en", "prose"), (1001, text(80, "#"), "en", "tags"), (1002, "same words here " * 40, "en", "prose"), (1003, "few words", "en", "prose")]
    got = {r.doc_id: r for r in apply_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert not got[1000].kept and got[1001].kept
    assert got[1002].base_failed and got[1003].base_failed and not got[1002].kept
    assert all(got[k].kept for k in range(300))


def test_odd_documents(odd_docs, no_docs):
    got = apply_rules(odd_docs).collect()
    assert len(got) == 9
    assert all(r.base_failed and not r.kept for r in got if r.doc_id in (2, 3, 4, 5))
    assert apply_rules(no_docs).count() == 0


def test_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = con.sql(f"select {', '.join(columns)} from ({RULES_SQL})").fetchall()
    assert plain(queries.op6_adaptive_rules(spark, sf_dir), *columns) == sorted(want, key=repr)


@pytest.mark.parametrize("query", ["op2_reply_trees", "op5_weighted_mix", "op6_adaptive_rules"])
def test_native_plans_run_no_python(spark, sf_dir, query):
    plan = getattr(queries, query)(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def measured_rows(spark, groups):
    """Documents of 1,000 words in one line whose repeated words are given, by language and source."""
    rows = [(lang, source, 1000, 5000, 0, 1, 0, v) for (lang, source), values in groups.items() for v in values]
    return spark.createDataFrame(rows, "lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")


def test_widths_follow_the_spread_of_a_group(spark):
    groups = {("en", "narrow"): list(range(28, 33)) * 400, ("en", "wide"): list(range(10, 51)) * 50, ("en", "still"): [30] * 2000}
    got = {r.source: r for r in thresholds(sketches(measured_rows(spark, groups))).collect()}
    # Tail and middle are whole bins, so a limit is that of the values: 32 + 3 * 2, 46 + 3 * 16, 30.
    assert [got[s].repeats_high for s in ("still", "narrow", "wide")] == [30, 38, 94]
    assert [got[s].repeats_low for s in ("still", "narrow", "wide")] == [30, 22, -34]


def test_a_group_moves_from_its_language_to_itself(spark):
    highs = []
    for n in (1, 10, 40, 400):
        groups = {("en", "large"): [10] * 20_000, ("en", "own"): [40] * n, ("de", "large"): [10] * 10}
        highs.append({r.source: r for r in thresholds(sketches(measured_rows(spark, groups))).where("lang = 'en'").collect()}["own"].repeats_high)
    # Mostly its language; half of each, so wide; its own.
    assert highs[0] == 10 and highs[1] == 40 + 3 * 30 and highs[2:] == [40, 40]


def test_short_texts_are_not_judged_by_one_count(spark):
    text = " ".join(f"word{k}" for k in range(60))
    docs = [(k, text, "en", "a") for k in range(200)] + [(900, text + " #", "en", "a"), (901, text + " # # # # # # # # # # # #", "en", "a")]
    got = {r.doc_id: r.kept for r in apply_rules(spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")).collect()}
    assert got[900] and not got[901] and all(got[k] for k in range(200))
