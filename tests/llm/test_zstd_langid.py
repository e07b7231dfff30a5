import zlib

from llm_helpers import no_docs, odd_docs, plain as rows  # noqa: F401

from ensemblescope.llm import queries
from ensemblescope.llm.zstd_langid import Languages, identify_languages, learn_languages, plain


def test_plain_text():
    assert plain("Ab!! 12\nÉ_x") == "ab é x".encode()


def test_odd_documents(odd_docs, no_docs):
    samples = learn_languages(odd_docs)
    assert set(samples) == {"en", "de", "fr"}
    found = identify_languages(odd_docs, samples)
    assert found.count() == 9 and set(odd_docs.columns) - {"score"} <= set(found.columns)
    got = {r.doc_id: r for r in found.collect()}
    assert got[2].lang_pred == got[3].lang_pred == got[4].lang_pred == "und" and got[2].score == 0
    assert got[1].lang_pred == got[6].lang_pred == "en" and not got[2].lang_accepted
    assert all(0 <= r.score <= 1 for r in got.values())
    assert learn_languages(no_docs) == {} and identify_languages(no_docs, {}).count() == 0
    assert {r.lang_pred for r in identify_languages(odd_docs, {}).collect()} == {"und"}


def test_wrong_labels_leave_the_dictionaries():
    one, two = "the cat sat on the mat and saw the dog ", "der hund und die katze sitzen auf dem dach "
    samples = {"en": [one * 3] * 9 + [two * 3], "de": [two * 3] * 9 + [one * 3]}
    known = Languages(samples)
    assert known.predict(one * 2)[0] == "en" and known.predict(two * 2)[0] == "de"
    assert Languages({"en": [one]}).predict("hi")[:2] == ("en", 1.0)


def test_copies_of_a_text_are_one_piece(spark):
    docs = spark.createDataFrame([(f"text number {k % 30} of a few", "en") for k in range(900)], "text string, lang string").repartition(4)
    found = learn_languages(docs, pieces=20)["en"]
    assert len(found) == len(set(found)) == 20
    assert sorted(learn_languages(docs)["en"]) == sorted(f"text number {k} of a few" for k in range(30))


def test_held_out_accuracy(spark, sf_dir):
    labels = {r.doc_id: r.lang for r in queries.read(spark, sf_dir, "documents").select("doc_id", "lang").collect()}
    got = queries.op4_zstd_language(spark, sf_dir).collect()
    assert rows(queries.op4_zstd_language(spark, sf_dir)) == sorted((tuple(r) for r in got), key=repr)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got) and len(got) == len(labels)
    tested = [r for r in got if r.held_out]
    assert sum(r.lang_pred == labels[r.doc_id] for r in tested) >= 0.9 * len(tested)
