import random

import numpy as np
import pytest

import corpus_pipeline
from sextant.llm.shingle_dedup import connecting_links

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def similarity(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b)


def planted(rng, words, aim):
    """A text and a copy of it whose end differs, of the least similarity that isn't below ``aim``."""
    text = [rng.choice(words) for _ in range(200)]
    copy = list(text)
    for k in range(1, 200):
        nearer, copy = copy, text[:-k] + [f"new{rng.randrange(10**9)}" for _ in range(k)]
        if similarity(" ".join(text), " ".join(copy)) < aim:
            return " ".join(text), " ".join(nearer), " ".join(copy)


@pytest.mark.parametrize("aim", [0.8, 0.85, 0.9, 0.95])
def test_pairs_planted_at_a_similarity(spark, aim):
    rng = random.Random(round(aim * 100))
    words = [f"w{i}" for i in range(900)]
    rows = []
    for k in range(60):
        text, nearer, further = planted(rng, words, aim)
        rows += [(3 * k, text, "en", "s", 1), (3 * k + 1, nearer, "en", "s", 1)]
        if aim == 0.8:
            alone, _, further = planted(rng, words, aim)
            rows += [(1000 + 2 * k, alone, "en", "s", 1), (1001 + 2 * k, further, "en", "s", 1)]
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert kept == {r[0] for r in rows if r[0] >= 1000 or r[0] % 3 == 0}


def test_links_that_no_least_node_shows(spark):
    rng = random.Random(4)
    text = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = []
    for k in range(12):  # each is a near copy of the next few only
        rows.append((k, " ".join(text), "en", "s", 1))
        text = text[20:] + [f"v{rng.randrange(5000)}" for _ in range(20)]
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()]
    assert kept == [0]


def test_rows_that_share_a_doc_id_are_judged_one_by_one(spark):
    rows = [(1, "a b c d e f", "en", "s", 1), (2, "a b c d e f", "en", "s", 1), (2, "no other copy of this text", "en", "s", 1), (None, "a b c d e f", "en", "s", 1)]
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == [(0, "a b c d e f"), (1, "a b c d e f"), (2, "no other copy of this text")]


def test_a_pair_below_the_similarity_hides_no_link():
    """Two components meet in a pair just below 0.8 that looks nearer by minimum hashes, and in one at 0.8."""
    rng = np.random.default_rng(12)
    fresh = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)

    def pair(common, own):
        both = fresh(common)
        return [np.sort(np.concatenate((both, fresh(own)))) for _ in range(2)]

    for _ in range(60):
        (a1, b1), (a2, b2) = pair(398, 51), pair(400, 50)  # 398 / 500 and 400 / 500
        links = connecting_links([a1, a2, b1, b2], np.array([0, 0, 1, 1]), np.zeros(4, int), 0.8)
        assert links == [(1, 3)]
    a, b = pair(400, 50)
    assert connecting_links([a, b], np.array([0, 1]), np.array([0, 1]), 0.8) == [(0, 1)]
    assert connecting_links([a, b], np.array([0, 0]), np.array([0, 1]), 0.8) == []
