import random
import re
import zlib
from itertools import product

import numpy as np
import pytest

from sextant.llm import crf, toxicity as tox

DOCS = "doc_id long, text string, lang string, score double, spans string, held_out string, sketch int, toxic int, kinds string"
LABELS = "doc_id long, quality int, toxic int, text string"


def held_out(i):
    return i is None or zlib.crc32(str(i).encode()) % 3 == 1


def weight(field, kinds, y):
    """A labelling's unnormalised log-probability."""
    pairs = {(0, 0): 0.0, (0, 1): field.pairs[0], (1, 0): field.pairs[1], (1, 1): field.pairs[2]}
    return field.begin * y[0] + sum(field.kinds[k] * v for k, v in zip(kinds, y, strict=True)) + sum(pairs[p] for p in zip(y, y[1:], strict=False))


def every(field, kinds):
    ys = list(product((0, 1), repeat=len(kinds)))
    w = np.exp([weight(field, kinds, y) for y in ys])
    return np.array(ys), w


def test_marginals_equal_the_sum_over_all_labellings(monkeypatch):
    rng = np.random.default_rng(1)
    field = crf.Field(rng.normal(size=5) * 3, 0.7, (-1.5, 0.4, 2.0))
    sizes = [1, 7, 3, 9, 1, 1, 5]
    kinds = rng.integers(0, 5, sum(sizes))
    begins = np.cumsum(sizes) - sizes
    want = []
    for b, n in zip(begins, sizes, strict=True):
        ys, w = every(field, kinds[b : b + n])
        want += (w @ ys / w.sum()).tolist()
    for window in (1, 4, 1 << 20):
        monkeypatch.setattr(crf, "WINDOW", window)
        assert crf.marginals(field, kinds, begins) == pytest.approx(want, abs=1e-12)


def test_slopes_equal_differences_of_the_likelihood():
    rng = np.random.default_rng(2)
    kinds, begins = rng.integers(0, 3, 11), np.array([0, 6])
    labels = rng.integers(0, 2, 11).astype(float)
    x = rng.normal(size=7)

    def likelihood(x):
        field = crf.Field(x[:3], x[3], x[4:])
        return sum(weight(field, kinds[a:b], labels[a:b].astype(int)) - np.log(every(field, kinds[a:b])[1].sum()) for a, b in ((0, 6), (6, 11)))

    by_kind, begin, pairs = crf.slopes(crf.Field(x[:3], x[3], x[4:]), kinds, begins, labels)
    steps = np.eye(7) * 1e-5
    assert np.concatenate((by_kind, [begin], pairs)) == pytest.approx([(likelihood(x + s) - likelihood(x - s)) / 2e-5 for s in steps], abs=1e-6)


def test_long_chains_stay_in_range():
    field = crf.Field(np.array([-19.0, 19.0]), 0.0, (-9.0, -9.0, 9.0))
    kinds = (np.arange(300_000) // 1000 % 2).astype(np.int16)
    p = crf.marginals(field, kinds, np.array([0]))
    assert np.isfinite(p).all() and (np.abs(p - kinds) < 1e-4).all()


def documents(n=900):
    """Toxic texts have a few words of two stems, some of them in forms that occur once only; a clean word begins alike."""
    rng = random.Random(4)
    piece = lambda: "".join(rng.choice(["an", "er", "ti", "on", "the", "wh", "ou", "re"]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [piece() for _ in range(rng.randint(40, 150))]
        toxic = i % 6 == 0
        for _ in range(rng.randint(3, 6) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["zlorb", "Quamp"]) + piece() + rng.choice(["", ",", "$$$"])
        if i % 5 == 1:
            words[3] = "zloty"
        rows.append((i, " ".join(words), "en", 0.5, "x", "y", 1, 0, "k"))
        labels.append((i, 1, int(toxic), "t"))
    return rows, labels


def test_held_out_accuracy_and_spans(spark):
    rows, labels = documents()
    out = {r.doc_id: r for r in tox.toxicity(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    assert len(out) == len(rows) and all(r.held_out == held_out(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in out.items())
    own = [(out[i].predicted, toxic) for i, _, toxic, _ in labels if held_out(i)]
    assert np.mean([p for p, t in own if t]) >= 0.95 and np.mean([p for p, t in own if not t]) <= 0.01
    texts, hits = {r[0]: r[1] for r in rows}, []
    for i, r in out.items():
        found = {at for s in r.spans for at in range(s.start, s.end)}
        want = {at for m in re.finditer("(zlorb|Quamp)[a-z]*", texts[i]) for at in range(*m.span())}
        if i % 6:
            assert not found
        else:
            hits.append((len(want & found) / len(want), len(want & found) / max(1, len(found))))
    assert (np.mean(hits, axis=0) > 0.95).all()


def test_labels_of_held_out_rows_change_nothing(spark):
    rows, labels = documents(300)
    docs = spark.createDataFrame(rows, DOCS)
    turned = [(i, q, 1 - t if held_out(i) else t, x) for i, q, t, x in labels]
    got = [sorted((r.doc_id, r.score) for r in tox.toxicity(docs, spark.createDataFrame(x, LABELS)).collect()) for x in (labels, turned)]
    assert got[0] == got[1]


def test_odd_rows_and_tables(spark):
    rows, labels = documents(400)
    tail = ("en", 0.5, "x", "y", 1, 0, "k")
    long = "e" * 2_000_000 + " " + "an ti on " * 200_000 + "zlorbti"
    odd = [(1000, None, *tail), (1001, "", *tail), (None, "zlorbti zlorbon zlorb an", *tail), (1002, "12 34 !! \n", *tail), (1003, long, *tail), rows[6], rows[6], (1004, "İİ zlorbanti", *tail), (1005, long[:-7], *tail)]
    more = labels + [(None, 1, 1, ""), (1, 1, None, ""), (2, 0, 1, ""), (5000, 0, 1, ""), *labels[:3]]
    out = tox.toxicity(spark.createDataFrame(rows + odd, DOCS), spark.createDataFrame(more, LABELS)).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 409 and by[1000].score == by[1001].score == by[1002].score < 0.7 and not by[1000].spans
    assert by[None].held_out and by[None].predicted == 1
    assert [(s.start, s.end) for s in by[1003].spans] == [(len(long) - 7, len(long))]
    assert by[1005].predicted == 0 and not by[1005].spans
    assert [(s.start, s.end) for s in by[1004].spans] == [(3, 12)]
    docs = spark.createDataFrame(rows, DOCS)
    assert tox.toxicity(docs.limit(0), spark.createDataFrame(labels, LABELS)).count() == 0
    assert {r.score for r in tox.toxicity(docs, spark.createDataFrame([], LABELS)).collect()} == {0.5}
    same = {r.score for r in tox.toxicity(docs, spark.createDataFrame([x for x in labels if not x[2]], LABELS)).collect()}
    assert len(same) == 1 and max(same) < 0.5
    assert {r.score > 0.9 for r in tox.toxicity(docs, spark.createDataFrame([x for x in labels if x[2]], LABELS)).collect()} == {True}


def test_words_are_cut_alike_in_slices(monkeypatch):
    text = "abc def-ghi ÄÖ1jk  longword $ x" * 30
    whole = [(m.start(), m.group()) for m in tox.WORD.finditer(text)]
    for size in (1, 2, 7, 50):
        monkeypatch.setattr(tox, "SLICE", size)
        assert [(at + m.start(), m.group()) for at, piece in tox.slices(text) for m in tox.WORD.finditer(piece)] == whole
