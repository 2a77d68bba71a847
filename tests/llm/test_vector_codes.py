import hashlib

import duckdb
import numpy as np
import pytest

from sextant.llm.vector_codes import Codebook, oracle, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, v int, n int"


def plain(rows, entries=256, rounds=4, parts=4):
    """Codes by all distances, in Python's integers."""
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v], label) for i, v, label in rows if v and len(v) % parts == 0 and all(x is not None and np.isfinite(x) for x in v)]
    dim = len(min((i, v) for i, v, _ in kept if i is not None)[1])
    kept = [r for r in kept if len(r[1]) == dim]
    first = {}
    for i, v, _ in kept:
        if i is not None:
            first[i] = min(v, first.get(i, v))
    cut = lambda v: [v[k * dim // parts : (k + 1) * dim // parts] for k in range(parts)]
    books = [list(b) for b in zip(*(cut(first[i]) for i in sorted(first)[:entries]), strict=True)]

    def coded():
        return [[min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book)) for x, book in zip(cut(v), books, strict=True)] for _, v, _ in kept]

    for _ in range(rounds):
        codes = coded()
        for k, book in enumerate(books):
            for j in range(len(book)):
                own = [cut(v)[k] for (_, v, _), c in zip(kept, codes, strict=True) if c[k][1] == j]
                if own:
                    book[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out, sums = [], {}
    for (i, _, label), c in zip(kept, coded(), strict=True):
        error = sum(d for d, _ in c)
        sums[label] = sums.get(label, 0) + error
        out.append((i, "".join(f"{j:02x}" for _, j in c), error, label))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[label], digest) for i, c, e, label in out), key=str)


def table(n=330, dim=12):
    rng = np.random.default_rng(5)
    v = rng.choice([-1.0, 0.0, 0.125, 0.5], (n, dim)) + rng.normal(size=(n, dim)) * rng.choice([0, 0, 0.01], (n, 1))
    rows = [(int(i), x.astype(np.float32).tolist(), int(i) % 3 if i % 5 else None) for i, x in zip(rng.permutation(n) * 7 - 50, v, strict=True)]
    nan, inf = float("nan"), float("inf")
    rows += [(-99, None, 1), (-98, [], 1), (-97, [nan] + [0.0] * (dim - 1), 1), (-96, [inf] * dim, 1), (-95, [None] * dim, 0), (-90, [1.0] * 6, 0)]
    return rows + [(None, [0.25] * dim, 2), rows[0], rows[0], (rows[3][0], [0.5] * dim, None), (5001, [0.5] * (dim + 4), 1)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "e", 1, 2) for r in rows], SCHEMA)


@pytest.mark.parametrize(("entries", "rounds"), [(256, 2), (16, 4), (5, 0)])
def test_codes_against_brute_force(spark, entries, rounds):
    rows = table()
    out = vector_codes(frame(spark, rows), entries=entries, rounds=rounds).collect()
    assert sorted(map(tuple, out), key=str) == plain(rows, entries, rounds)


def test_oracle_on_repeated_labels(spark):
    rows = [r for r in table(300) if r[1] and len(r[1]) == 12 and r[0] is not None]
    rows = list({r[0]: r for r in rows}.values()) + [(-99, None, 1), (-97, [float("nan")] * 12, 1)]
    con = duckdb.connect()
    con.register("embeddings", frame(spark, rows).select("vec_id", "embedding", "label").toArrow())
    got = con.execute(oracle(2))
    names = [d[0] for d in got.description]
    mine = vector_codes(frame(spark, rows), rounds=2).select(*names).collect()
    assert sorted(map(tuple, mine)) == sorted(got.fetchall())


def test_search_drops_only_what_is_farther():
    """Few values make many ties; every number of dimensions, fewer than the leading ones too."""
    rng = np.random.default_rng(6)
    for dim in (1, 3, 4, 5, 16):
        for kind in (np.int32, np.int64):
            book, x = rng.integers(-3, 4, (40, dim)).astype(kind), rng.integers(-4, 5, (3000, dim)).astype(kind)
            every = np.square(x[:, None] - book[None]).sum(2)
            at, least = Codebook(book).nearest(x)
            assert (at == every.argmin(1)).all() and (least == every.min(1)).all()


def test_odd_tables(spark):
    assert vector_codes(frame(spark, table()).limit(0)).count() == 0
    assert vector_codes(frame(spark, [(None, [1.0] * 4, 1), (3, None, 1)])).count() == 0
    with pytest.raises(ValueError, match="long"):
        vector_codes(frame(spark, [(1, [1e30] * 4, 1)]))
    out = vector_codes(frame(spark, [(1, [1.0] * 4, None)] * 3)).collect()
    assert [tuple(r)[:4] for r in out] == [(1, "00000000", 0, 0)] * 3
