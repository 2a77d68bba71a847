import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sextant.functions.scratch import durable
from sextant.functions.text import STOP_WORDS
from sextant.operators import index, lexical, retrieval
from sextant.operators.cells import Cells

WORDS = [f"w{i}" for i in range(60)] + ["de", "común", "Común"]


def plain_bm25(questions, chunks, k):
    cut = lambda t: [w for w in re.findall("[a-z0-9]+", t.lower().replace("ú", "u")) if w not in STOP_WORDS]
    docs = {c: cut(t) for c, t in chunks if t is not None}
    mean = sum(map(len, docs.values())) / len(docs)
    df = Counter(w for ws in docs.values() for w in set(ws))
    raw = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw)
    out = {}
    for q, t in questions:
        score = {}
        for c, ws in docs.items():
            tf = Counter(ws)
            score[c] = round(sum((raw[w] if raw[w] >= 0 else low) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for w in cut(t) if tf[w]), 8)
        out[q] = [(c, s) for c, s in sorted(score.items(), key=lambda x: (-x[1], x[0])) if s > 0][:k]
    return out


def texts(n=400, seed=1):
    rng = random.Random(seed)
    rows = [(f"c{i:03}", " ".join(rng.choice(WORDS[: rng.choice((10, 63))]) for _ in range(rng.randint(1, 60)))) for i in range(n)]
    rare = [(f"r{i}", f"rare{i % 3} " * (1 + i % 4) + "común w1 w2") for i in range(9)]
    return [*rows, *rare, ("null", None), ("blank", ""), ("stop", "de de la")]


QUESTIONS = [("a", "rare1 w1"), ("b", "w1 w2 común w1"), ("c", "nothing of it"), ("d", ""), ("e", "rare0 rare2 w50 w51"), ("f", None)]


def ranked(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.question_id, r.rank)):
        out.setdefault(r.question_id, []).append((r.chunk_id, r.score))
    return out


@pytest.mark.parametrize("size", [3, 40, 5000])
def test_bm25_by_blocks_equals_all_scores(spark, size):
    chunks = texts()
    frame = spark.createDataFrame([(*c, i % 3) for i, c in enumerate(chunks)], "chunk_id string, text string, bucket int")
    got = ranked(lexical.search_terms(spark.createDataFrame(QUESTIONS, "question_id string, text string"), durable(lexical.postings(frame, size)), 4).collect())
    want = {q: rows for q, rows in plain_bm25([(q, t or "") for q, t in QUESTIONS], chunks, 4).items() if rows}
    assert {q: [c for c, _ in rows] for q, rows in got.items()} == {q: [c for c, _ in rows] for q, rows in want.items()}
    assert all(s == pytest.approx(t, abs=1e-7) for q in want for (_, s), (_, t) in zip(got[q], want[q], strict=True))


def test_blocks_that_cannot_reach_the_floor_stay_closed(spark):
    frame = spark.createDataFrame([(*c, 0) for c in texts(1500)], "chunk_id string, text string, bucket int")
    search = lexical.Search(spark.createDataFrame([("a", "rare1 w1"), ("e", "rare0 w50")], "question_id string, text string"), durable(lexical.postings(frame, 10)))
    every, (_, rest) = search.bounds().count(), search.plan(3)
    assert rest.count() < 0.5 * every


def test_an_opened_block_gives_the_best_chunks_of_a_question_only(spark, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", 500, raising=False)  # several rounds of questions a block
    frame = spark.createDataFrame([(*c, 0) for c in texts(1500)], "chunk_id string, text string, bucket int")
    asked = spark.createDataFrame([(i, f"w{i} w{i + 1} w1 w2") for i in range(20)], "question_id int, text string")
    search = lexical.Search(asked, durable(lexical.postings(frame)))
    pairs = search.bounds()
    found = search.opened(pairs, 3).collect()
    assert len(found) <= 4 * pairs.count()
    want = plain_bm25([(i, f"w{i} w{i + 1} w1 w2") for i in range(20)], texts(1500), 3)
    for q, rows in want.items():
        got = sorted(((r.chunk_id, r.score) for r in found if r.question_id == q), key=lambda x: (-x[1], x[0]))[:3]
        assert [c for c, _ in got] == [c for c, _ in rows] and [s for _, s in got] == pytest.approx([s for _, s in rows], abs=1e-7)


def test_an_index_of_nothing(spark):
    none = spark.createDataFrame([], "chunk_id string, text string")
    asked = spark.createDataFrame(QUESTIONS, "question_id string, text string")
    assert lexical.bm25(asked, none).count() == 0 and lexical.bm25(asked.limit(0), spark.createDataFrame([("c", "w1")], "chunk_id string, text string")).count() == 0


def test_postings_follow_the_index_on_disk(spark, tmp_path):
    path = f"{tmp_path}/index"
    rows = [(c, f"doc{i % 40}", i, t) for i, (c, t) in enumerate(texts())]
    frame = lambda rows: spark.createDataFrame(rows, index.CHUNKS)
    asked = spark.createDataFrame(QUESTIONS, "question_id string, text string")

    def agrees(rows):
        got = ranked(lexical.search_terms(asked, index.open_terms(spark, path), 4).collect())
        want = {q: found for q, found in plain_bm25([(q, t or "") for q, t in QUESTIONS], [(r[0], r[3]) for r in rows], 4).items() if found}
        assert {q: [c for c, _ in x] for q, x in got.items()} == {q: [c for c, _ in x] for q, x in want.items()}
        assert sorted(r.chunk_id for r in index.open_index(spark, path).collect()) == sorted(r[0] for r in rows)

    assert index.write_index(frame(rows), path, 5) == len(rows)
    assert max(spark.read.parquet(f).count() for f in index.open_index(spark, path).inputFiles()[:20]) <= 5
    agrees(rows)
    with pytest.raises(ValueError, match="at least 1"):
        index.write_index(frame(rows), path, 0)
    assert index.write_index(frame([]), f"{tmp_path}/none") == 0
    new = [("n1", "doc3", 0, "rare1 rare1 w1"), ("n2", "doc99", 0, "rare0 común")]
    index.replace_documents(spark, path, frame(new))
    rows = [r for r in rows if r[1] != "doc3"] + new
    agrees(rows)
    index.delete_documents(spark, path, spark.createDataFrame([("doc5",), ("doc99",), ("unknown",)], "doc_id string"))
    rows = [r for r in rows if r[1] not in ("doc5", "doc99")]
    agrees(rows)


def vectors(n=700, dim=8):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, dim))
    v = middle[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * 0.1
    v /= np.sqrt(np.square(v).sum(1))[:, None]
    rows = [(i, x.tolist(), str(i % 4)) for i, x in enumerate(v)]
    rows += [(n + i, rows[5][1], "9") for i in range(7)]  # ties
    rows += [(5000, None, "1"), (5001, [], "1"), (5002, [None] * dim, "1"), (5003, [1.0, 0.0], "1"), (5004, [0.6, 0.8], "1"), (5005, [-(dim**-0.5)] * dim, None)]
    return rows


def plain_cosine(questions, chunks, k):
    ok = lambda v: v is not None and all(x is not None for x in v)
    out = {}
    for q, v, only in questions:
        if ok(v):
            scored = [(c, min(1.0, max(0.0, float(np.dot(v, w))))) for c, w, r in chunks if ok(w) and len(w) == len(v) and (only is None or r == only)]
            found = sorted(scored, key=lambda x: (-round(x[1], 9), x[0]))[:k]
            if found:
                out[q] = [c for c, _ in found]
    return out


@pytest.mark.parametrize("k", [1, 5, 40])
def test_cells_equal_all_products(spark, k):
    chunks = vectors()
    opposite = (-np.array(chunks[0][1])).tolist()
    asked = [(c, v, None) for c, v, _ in chunks[::50]] + [(-1, chunks[3][1], "2"), (-2, opposite, None), (-3, [0.0] * 8, None), (-4, [0.6, 0.8], None), (-5, None, None), (-6, [1.0] * 3, None), (-7, [], None), (-8, chunks[5][1], None)]
    got = {}
    for r in retrieval.retrieve(spark.createDataFrame(asked, "question_id long, vector array<double>, only string"), spark.createDataFrame(chunks, "chunk_id long, vector array<double>, register string"), k).orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append(r.chunk_id)
    assert got == plain_cosine(asked, chunks, k)


def test_cells_that_cannot_rank_stay_closed(spark):
    chunks = [r for r in vectors(3000) if r[1] and len(r[1]) == 8 and None not in r[1]]
    built = Cells(spark.createDataFrame(chunks, "chunk_id long, c array<double>, register string"), 40)
    asked = spark.createDataFrame([(c, v) for c, v, _ in chunks[::100]], "question_id long, q array<double>")
    _, pairs = built.nearest(asked, 5)
    sizes = {(r.dim, r.cell): r["count"] for r in built.rows.groupBy("dim", "cell").count().collect()}
    scored = sum(sizes[r.dim, r.cell] for r in pairs.collect())
    assert scored < 0.5 * asked.count() * len(chunks)
