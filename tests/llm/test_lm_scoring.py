import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sextant.llm import gru
from sextant.llm.lm_scoring import lexicon, lm_scores

SCHEMA = "doc_id long, text string, score string, row int"


def corpus(n=400):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        words = [f"{'ab'[i % 2]}{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(5, 120))]
        rows.append((i, " ".join(words) + f" Only{i} twice", "x", 1))
    return rows + [(5000, None, "", 1), (5001, "", "", 1), (5002, "NEW NEW new words\x0bhere é\x85x", "", 1), (3, rows[3][1], "", 1), (None, "a1 b2", "", 1), (5003, "a1 " * 30000, "", 1)]


def base(rows):
    tokens = {k: [w.decode("utf-8") for w in (r[1] or "").encode().lower().split()] + ["<end>"] for k, r in enumerate(rows)}
    held = {k: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for k, r in enumerate(rows)}
    counts = Counter(t for k, ts in tokens.items() if not held[k] for t in ts)
    n, v = sum(counts.values()), len(counts)
    return [(-1 if rows[k][0] is None else rows[k][0], held[k], len(ts), sum(counts[t] > 0 for t in ts), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts)) for k, ts in tokens.items()]


@pytest.mark.parametrize("frequent", [400_000, 40])
def test_counts_and_base_scores_match_the_definition(spark, frequent):
    rows = corpus()
    out = lm_scores(spark.createDataFrame(rows, SCHEMA), share=2, frequent=frequent).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out)
    for g, w in zip(got, sorted(base(rows)), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)
    if frequent > 40:
        held = [r for r in out if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)


def test_probabilities_sum_to_one_and_state_is_carried():
    rng = np.random.default_rng(0)
    p = gru.initial(rng.integers(0, 50, gru.WORDS))
    p = {k: v + rng.standard_normal(v.shape).astype(np.float32) * 0.1 for k, v in p.items()}
    h = rng.standard_normal((1, gru.HIDDEN)).astype(np.float32)
    every = np.arange(gru.WORDS)
    assert np.exp(gru.log_probability(p, np.repeat(h, gru.WORDS, 0), every).astype(float)).sum() == pytest.approx(1, abs=1e-4)
    docs = [rng.integers(0, gru.WORDS, n) for n in (1, 700, 3, 150)]
    got = gru.score(p, docs, 1)
    for d, g in zip(docs, got, strict=True):
        h, total = np.zeros((1, gru.HIDDEN), np.float32), 0.0
        for x, y in zip([1, *d[:-1]], d, strict=True):
            h, _ = gru.step(p, np.array([x]), h)
            total += float(gru.log_probability(p, h, np.array([y]))[0])
        assert g == pytest.approx(total, rel=1e-4)


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    p = {k: (v + rng.standard_normal(v.shape) * 0.3).astype(np.float64) for k, v in gru.initial(rng.integers(0, 50, gru.WORDS)).items()}
    inputs, targets, h = rng.integers(0, 90, (4, 3)), rng.integers(0, 200, (4, 3)), rng.standard_normal((3, gru.HIDDEN))
    d, _, _ = gru.gradients(p, inputs, targets, h)
    for name in p:
        for i in rng.integers(0, p[name].size, 60):
            i = np.unravel_index(i if name != "x" else inputs.ravel()[i % 12] * 3 * gru.HIDDEN + i % (3 * gru.HIDDEN), p[name].shape)
            up, down = {**p, name: p[name].copy()}, {**p, name: p[name].copy()}
            up[name][i] += 1e-5
            down[name][i] -= 1e-5
            slope = (gru.gradients(up, inputs, targets, h)[2] - gru.gradients(down, inputs, targets, h)[2]) / 2e-5
            assert d[name][i] == pytest.approx(slope, rel=2e-3, abs=2e-6), name


def test_training_learns_what_the_state_tells():
    rng = np.random.default_rng(2)
    words = np.concatenate([rng.integers(2, 40, 60) + 40 * (k % 2) for k in range(1000)])
    counts = np.bincount(words, minlength=gru.WORDS)
    p = gru.initial(counts)
    test = [rng.integers(2, 40, 60) + 40 * (k % 2) for k in range(20)]
    assert gru.score(gru.fit(p, words, 1), test, 1).sum() > gru.score(p, test, 1).sum() + 200


def test_empty_table(spark):
    assert lm_scores(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lexicon_has_the_most_frequent_words_at_every_size(spark):
    flat = [(100 + k, 50_000) for k in range(60)]
    steep = [(k - 50, 20_000 + 7 * k) for k in range(100)]
    for rows in (flat, steep, flat + steep, [(k, 1) for k in range(90)]):
        lex = lexicon(spark.createDataFrame(rows, "word long, n long"), 40)
        assert len(lex.keys) == 40 and lex.total == sum(n for _, n in rows) and lex.distinct == len(rows)
        assert sorted(lex.counts, reverse=True) == sorted((n for _, n in rows), reverse=True)[:40]
    assert len(lexicon(spark.createDataFrame(flat, "word long, n long"), 100).keys) == 60
    assert len(lexicon(spark.createDataFrame([], "word long, n long"), 40).keys) == 0


def test_every_token_trains_once_and_after_its_own(monkeypatch):
    seen, plain = [], gru.gradients

    def watched(p, inputs, targets, h):
        seen.extend(zip(inputs.ravel().tolist(), targets.ravel().tolist(), strict=True))
        return plain(p, inputs, targets, h)

    monkeypatch.setattr(gru, "gradients", watched)
    p = gru.initial(np.ones(gru.WORDS))
    for n in (1, 5, 128 * 3, 128 * 3 + 2, 128 * 3 + 127):
        seen.clear()
        gru.fit(p, np.arange(2, n + 2), 1)
        assert sorted(y for _, y in seen) == list(range(2, n + 2))
        assert all(x in (1, y - 1) for x, y in seen) and sum(x == 1 for x, _ in seen) == max(1, n // 128)
