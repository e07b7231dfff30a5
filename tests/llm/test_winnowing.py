import hashlib
import random

import numpy as np
import pytest

from llm_helpers import no_docs, odd_docs, plain  # noqa: F401

from ensemblescope.llm import queries
from ensemblescope.llm.winnowing import Winnower, code_points, edited, fingerprint_neighbours, likeness


def brute(hashes, window):
    """Places that some window chooses: its smallest hash, the rightmost of equals."""
    chosen = set()
    for begin in range(max(1, len(hashes) - window + 1)):
        part = hashes[begin : begin + window]
        low = min(part)
        chosen.add(begin + max(i for i, h in enumerate(part) if h == low))
    return sorted(chosen)


@pytest.mark.parametrize("gram, window", [(1, 1), (3, 4), (5, 7), (8, 1)])
def test_places_equal_brute_force(gram, window):
    random.seed(gram)
    winnower = Winnower(gram, window)
    for n in (0, 1, gram, gram + 1, gram + window, 90):
        points = code_points("".join(random.choice("ab") for _ in range(n)))
        hashes, places = winnower.choose(points)
        if n >= gram:
            every = winnower.grams(points)
            assert places.tolist() == brute(every.tolist(), window)
            assert hashes.tolist() == every[places].tolist()
        else:
            assert len(places) == min(n, 1)


def test_a_shared_run_is_found_and_long_texts_are_whole():
    random.seed(3)
    gram, window = 16, 40
    winnower = Winnower(gram, window)
    shared = "".join(random.choice("abcdefgh") for _ in range(gram + window - 1))
    long = "".join(random.choice("abcdefgh") for _ in range(600_000))
    a, _ = winnower.choose(code_points(long + shared))
    b, _ = winnower.choose(code_points("xyz" + shared + "zyx"))
    assert len(np.intersect1d(a, b))
    _, places = winnower.choose(code_points(long))
    assert np.diff(places).max() <= window and places[-1] >= len(long) - gram - window
    assert likeness(a, a) == 1 and likeness(a[:0], a[:0]) == 1 and likeness(a, a[:0]) == 0


def test_odd_documents(odd_docs, no_docs):
    found = fingerprint_neighbours(odd_docs).collect()
    assert len(found) == 9
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[2][0].n_chars == 0 and by_id[2][0].fingerprint == "" and by_id[3][0].fingerprint == ""
    assert by_id[1][0].fingerprint == by_id[6][0].fingerprint
    assert by_id[2][0].near_next <= 1 and {r.near_next for r in by_id[1]} == {1.0, 0.0}
    assert fingerprint_neighbours(no_docs).count() == 0


def test_query_edits_whole_texts(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in queries.read(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    ids = sorted(docs, reverse=True)
    want = [
        (i, len(docs[i]), hashlib.sha256(edited(docs[i], docs[ids[(k + 1) % len(ids)]]).encode()).hexdigest()) for k, i in enumerate(ids)
    ]
    assert plain(queries.op1_winnowing(spark, sf_dir), "doc_id", "n_chars", "edited_sha256") == sorted(want, key=repr)
