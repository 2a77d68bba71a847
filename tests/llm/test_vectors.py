import numpy as np
import pytest

from sextant.llm.embedding_dedup import embedding_dedup
from sextant.llm.vector_topk import Block, vector_topk
from tests.llm.test_simhash_dedup import classes  # noqa: F401

SCHEMA = "vec_id long, embedding array<float>, n_links int, rank string, label int"


def table(dim=12, n=300):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(n, dim))
    more = base[rng.integers(0, n, n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.1, 0.3], (n, 1))
    rows = [v.astype(np.float32).tolist() for v in np.concatenate((base, more, np.repeat(base[:1], 5, 0), base[:3] * 2))]
    rows += [None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [float("nan")] + [1.0] * (dim - 1), [float("inf")] * dim, rows[0][:-1], rows[0][:-1]]
    return [(i * 10, v, 1, "x", 2) for i, v in enumerate(rows)]


def bad(v, zero=True):
    return not v or any(x is None or not np.isfinite(x) for x in v) or zero and not any(v)


def test_links_and_components_against_brute_force(spark):
    rows = table()
    out = {r.vec_id: r for r in embedding_dedup(spark.createDataFrame(rows, SCHEMA), interval=64).collect()}
    assert len(out) == len(rows)
    links = {i: set() for i, *_ in rows}
    for a, v, *_ in rows:
        for b, w, *_ in rows:
            if a < b and not bad(v) and not bad(w) and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.95:
                    links[a].add(b)
                    links[b].add(a)
    assert {i: r.n_links for i, r in out.items()} == {i: len(s) for i, s in links.items()}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert out[i].component_id == min(seen) and out[i].kept == (min(seen) == i)


def test_rows_without_an_id_carry_links_but_name_nothing(spark):
    turned = lambda degrees: [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees))), 0.0]
    rows = [(7, turned(0)), (None, turned(15)), (9, turned(30)), (None, turned(100)), (-4, turned(200)), (None, turned(201)), (5, None), (None, None)]
    out = embedding_dedup(spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)).collect()
    got = sorted(((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id is None, r.component_id or 0, r.kept) for r in out), key=str)
    want = [(7, 1, 7, True), (None, 2, 7, None), (9, 1, 7, False), (None, 0, None, None), (-4, 1, -4, True), (None, 1, -4, None), (5, 0, 5, True), (None, 0, None, None)]
    assert got == sorted(((i is None, i or 0, n, c is None, c or 0, k) for i, n, c, k in want), key=str)


def test_many_intervals_of_several_lengths(spark):
    rng = np.random.default_rng(8)
    rows = []
    for dim, n in ((3, 500), (9, 400), (2, 1)):
        rows += [(len(rows) + i, v.tolist(), 1, "x", 2) for i, v in enumerate(rng.normal(size=(n, dim)).astype(np.float32))]
    out = {r.vec_id: r for r in embedding_dedup(spark.createDataFrame(rows, SCHEMA), interval=16).collect()}
    for dim in (3, 9, 2):
        own = [(i, np.array(v)) for i, v, *_ in rows if len(v) == dim]
        u = np.stack([v / np.linalg.norm(v) for _, v in own])
        near = (u @ u.T >= 0.95).sum(1) - 1
        assert [out[i].n_links for i, _ in own] == near.tolist()


def test_topk_against_brute_force(spark):
    rows = table()
    got = {}
    for r in vector_topk(spark.createDataFrame(rows + rows[:1], SCHEMA), every=100, query_block=16).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = {i: np.floor(1024 * np.array(v, np.float64)).astype(np.int64) for i, v, *_ in rows if not bad(v, zero=False)}
    want = {}
    for q in whole:
        if q % 100 == 0:
            scored = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:10]
            want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert {q: sorted(v) for q, v in got.items()} == {q: v for q, v in want.items() if v}


def test_bounds_keep_every_pair_above_the_floor():
    rng = np.random.default_rng(1)
    q, v = np.floor(rng.normal(size=(20, 64)) * 400), np.floor(rng.normal(size=(500, 64)) * 400)
    block = Block(np.arange(20), q, 3, np.sort(q @ v.T, 1)[:, -3])
    block.add(np.arange(100, 600), v)
    assert (block.best_score == -np.sort(-(q @ v.T), 1)[:, :3]).all()


def test_scores_beyond_double_precision_are_exact():
    rng = np.random.default_rng(5)
    q, v = rng.integers(-(1 << 29), 1 << 29, (6, 8)), rng.integers(-(1 << 29), 1 << 29, (40, 8))
    block = Block(np.arange(6), q.astype(float), 3)
    block.add(np.arange(100, 140), v.astype(float))
    assert (block.best_score == -np.sort(-(q @ v.T), 1)[:, :3]).all()
    with pytest.raises(ValueError, match="exceed a long"):
        Block(np.arange(1), np.full((1, 2), 2.0**40), 1).add(np.arange(1), np.full((1, 2), 2.0**40))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert embedding_dedup(empty).count() == 0 and vector_topk(empty).count() == 0
    lone = spark.createDataFrame([(100, [1.0, 2.0], 1, "", 1), (None, [1.0, 2.0], 1, "", 1), (100, [1.0, 2.0], 1, "", 1)], SCHEMA)
    assert sorted((r.vec_id or -1, r.n_links, r.component_id) for r in embedding_dedup(lone).collect()) == [(-1, 2, 100), (100, 2, 100), (100, 2, 100)]
    assert vector_topk(lone).count() == 0
