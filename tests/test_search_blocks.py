"""Searches by cosine in blocks of bounded size: SQL's rows, scores and ties, and what is shuffled for them."""

import os

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sextant import catalogue
from sextant.operators import cells, retrieval

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def vectors(n=600, dim=16):
    rng = np.random.default_rng(11)
    v = rng.normal(size=(n, dim))
    v = (v / np.sqrt(np.square(v).sum(1))[:, None]).astype(np.float32).astype(np.float64)  # as embeddings are; their products are exact
    rows = [(i, x.tolist(), str(i % 4 if i % 3 else 7)) for i, x in enumerate(v)]
    rows += [(n + i, rows[i % 9][1], rows[i % 9][2]) for i in range(60)]  # copies, so ties
    rows += [(2000, [0.0] * dim, "1"), (2001, [float("nan")] + rows[0][1][1:], "2"), (2002, (10 * v[5]).tolist(), "1"), (2003, (-v[6]).tolist(), "7"), (2004, (1e200 * v[7]).tolist(), "3"), (2005, rows[3][1], None)]
    return rows


SQL = """SELECT question_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM
(SELECT q.question_id, c.chunk_id, greatest(0.0, least(1.0, list_inner_product(q.vector, c.vector))) AS score FROM questions q JOIN chunks c ON q.only IS NULL OR q.only = c.register)) WHERE rank <= ? ORDER BY question_id, rank"""


@pytest.mark.parametrize("k", [1, 5, 30])
def test_any_blocks_give_the_rows_and_scores_of_sql(spark, monkeypatch, k):
    monkeypatch.setattr(cells, "CHUNKS", 32 * 70, raising=False)  # 70 chunks, 20 questions: large registers are cut, small cells put together
    monkeypatch.setattr(cells, "QUESTIONS", 32 * 20, raising=False)
    chunks = vectors()
    asked = [(c, v, only) for c, v, r in chunks[::7] + chunks[-6:] for c, only in ((c, None), (c + 10000, r)) if only or c < 10000]
    asked += [(-1, [0.0] * 16, None), (-2, (-np.array(chunks[0][1])).tolist(), "2"), (-3, [0.0] * 16, "7"), (-4, chunks[0][1], "unknown"), (-5, (2.0**-10 * np.array(chunks[9][1])).tolist(), None)]
    names = (["question_id", "vector", "only"], ["chunk_id", "vector", "register"])
    tables = [pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.list_(pa.float64()), pa.string()), strict=True)], names=n) for rows, n in zip((asked, chunks), names, strict=True)]
    con = duckdb.connect()
    con.register("questions", tables[0])
    con.register("chunks", tables[1])
    frames = [spark.createDataFrame(rows, f"{n[0]} long, vector array<double>, {n[2]} string") for rows, n in zip((asked, chunks), names, strict=True)]
    got = retrieval.retrieve(*frames, k).orderBy("question_id", "rank").select("question_id", "chunk_id", "score").collect()
    assert [tuple(r) for r in got] == con.execute(SQL, [k]).fetchall()


def test_a_question_is_sent_once_to_a_block_of_cells(spark, monkeypatch):
    monkeypatch.setattr(cells, "CHUNKS", 32 * 200, raising=False)
    chunks = [r for r in vectors(1500) if r[0] < 1500]
    built = cells.Cells(spark.createDataFrame(chunks, "chunk_id long, c array<double>, register string"), 40)
    asked = spark.createDataFrame([(c, v, 0.0) for c, v, _ in chunks[::10]], "question_id long, q array<double>, floor double")
    dealt = built.dealt(asked)
    assert dealt.count() == 150 * dealt.select("block").distinct().count() <= 150 * 15 < built.dealt(asked, to="cell").count()
    assert built.opened(asked, 3).count() <= 3 * dealt.count()


def test_copies_that_cannot_rank_are_not_multiplied():
    v = np.random.default_rng(5).normal(size=(40, 8))
    c = np.concatenate([np.repeat(v[:1], 3000, 0), v, np.zeros((50, 8))])
    best = cells.Best(v, c, 4, np.full(40, -1.0))
    assert best.ranking(np.arange(len(c))).tolist() == [0, 1, 2, 3, *range(3001, 3040), *range(3040, 3044)]
    assert cells.Best(v[:, :0], c[:, :0], 4, best.floor).ranking(np.arange(9)).tolist() == [0, 1, 2, 3]
    best.meet(np.arange(40), np.arange(len(c)))
    score = np.clip(v @ c.T, 0, 1)
    want = np.argsort(-np.round(score, 9), axis=1, kind="stable")[:, :4]
    assert best.row.tolist() == want.tolist()


def test_a_search_within_an_entity_returns_the_best_only(spark):
    chunks = spark.createDataFrame(vectors(), "chunk_id long, c array<double>, register string")
    asked = spark.createDataFrame([(c, v, r) for c, v, r in vectors()[:100]], "question_id long, q array<double>, only string")
    assert cells.within(asked, chunks, 2).count() == 200


@pytest.mark.skipif(not os.path.exists(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", ["search_by_entity", "evaluation_run"])
def test_pairs_of_questions_and_chunks_are_not_sorted_and_texts_are_masked_once(spark, name):
    text = plan(catalogue.QUERIES[name](spark, SF))
    assert "zip_with" not in text and "ArrowEvalPython" not in text
