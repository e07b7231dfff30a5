import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm_helpers import no_docs, odd_docs, plain  # noqa: F401

from ensemblescope.llm import queries
from ensemblescope.llm.bpe_queue import Merges, decode_ids, encode_documents

PATH = public_tokenizers.path(queries.TOKENIZER)
BITS = [
    *"abc theZzÉéßΣσİſK'st reve 0123٣४ \n\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0  ​́­!!??..日本語😀👨#$", "<|endoftext|>", "<|startoftext|>",
    "<|endof", "'S", "'ll", "aaaa", "ing", "token", "ﬁ", "Å", "ǅ", "ͅ", "ᾳ", "\U0001d7d8", "½", "²", "the the",
]


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as f:
        return Merges(f.read(), cache_words=50), Tokenizer.from_file(PATH)


def test_ids_and_texts_equal_the_library(both):
    own, library = both
    random.seed(7)
    texts = ["", " ", "a" * 5000, "!" * 999, "ab" * 700 + "é" * 300]
    texts += ["".join(random.choice(BITS) for _ in range(random.randint(0, 50))) for _ in range(5000)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_other_kinds_of_tokenizers_are_refused():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f, pytest.raises(ValueError):
        Merges(f.read())


def test_odd_documents(odd_docs, no_docs):
    docs = odd_docs.withColumn("ids", F.lit("clash"))
    found = encode_documents(docs, PATH)
    got = {r.doc_id: r for r in found.collect()}
    assert found.count() == 9 and got[2].ids == got[3].ids == got[4].ids == [] and got[2].decoded == "" and got[2].text is None
    assert got[1].ids == got[6].ids and len(got[5].ids) == 60_000
    again = decode_ids(found.withColumnRenamed("decoded", "first"), PATH)
    assert again.where("first != decoded").count() == 0
    assert encode_documents(no_docs, PATH).count() == 0


def test_query(spark, sf_dir, both):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for r in queries.read(spark, sf_dir, "documents").collect():
        ids = both[1].encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(both[1].decode(ids, skip_special_tokens=False))))
    assert plain(queries.op9_bpe_queue(spark, sf_dir), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
