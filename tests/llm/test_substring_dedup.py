import hashlib
import random

import numpy as np

import sextant.llm.substring_dedup as sd
from sextant.llm.fm_index import FMIndex


def brute(rows, window=50):
    words = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i in sorted(x for x in words if x is not None):
        for s in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][s : s + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s : s + window])] < i:
                gone |= set(range(s, s + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def corpus():
    rng = random.Random(6)
    text = lambda n, v=400: " ".join(f"w{rng.randrange(v)}" for _ in range(n))
    passages = [text(n) for n in (49, 50, 51, 60, 90, 300)]
    rows = [(i, text(rng.randrange(120))) for i in range(40)]
    for i in range(40, 90):
        rows.append((i * 3, " ".join([text(rng.randrange(80)), rng.choice(passages), text(rng.randrange(80)), rng.choice(passages)])))
    common = text(55)
    rows += [(1000 + i, f"{text(30)} {common} {text(20)}") for i in range(60)]
    rows += [(2000, "a " * 400), (2001, "a " * 120), (2002, "a b " * 100), (2003, " ".join("ab" * 60)), (2004, rows[50][1]), (2005, rows[50][1]), (2006, ""), (2007, None), (2008, "x\x1cy\x85z " * 60), (2009, "x\x1cy\x85z\n" * 60)]
    rng.shuffle(rows)
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, row string, start int")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in sd.substring_dedup(df).collect()}
    assert got == brute(rows)


def test_busy_anchors_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(sd, "BUSY", 3)
    monkeypatch.setattr(sd, "SHARD_WORDS", 500)
    rows = corpus()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in sd.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False).collect()}
    assert got == brute(rows)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    long = " ".join(f"w{i}" for i in range(80))
    schema = "doc_id long, text string"
    assert sd.substring_dedup(spark.createDataFrame([], schema)).count() == 0
    rows = [(5, long), (5, long), (None, long), (9, long), (9, "start " + long)]
    out = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in sd.substring_dedup(spark.createDataFrame(rows, schema)).collect())
    assert out == [(-1, 80, 0), (5, 80, 0), (5, 80, 0), (9, 80, 80), (9, 81, 80)]


def test_matching_statistics_of_foreign_patterns():
    rng = np.random.default_rng(0)
    for _ in range(20):
        parts = [rng.integers(1, 5, rng.integers(1, 40)) for _ in range(6)]
        text = np.concatenate([np.concatenate((p, [0])) for p in parts])
        index = FMIndex(text, 5)
        pattern = rng.integers(1, 7, 60)
        pattern[pattern == 6] = -1
        lengths, classes = index.match(pattern, np.array([0, 30]), np.array([30, 60]))
        every = {tuple(p[i:j]) for p in parts for i in range(len(p)) for j in range(i + 1, min(len(p), i + 5) + 1)}
        for i in range(60):
            stop = 30 if i < 30 else 60
            want = max([n for n in range(1, 6) if i + n <= stop and tuple(pattern[i : i + n]) in every], default=0)
            assert lengths[i] == want and (classes[i] >= 0) == (want == 5)
