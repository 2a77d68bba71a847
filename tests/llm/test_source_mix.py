import re
from collections import defaultdict
from fractions import Fraction

import pytest

from sextant.llm.source_mix import mixed_documents, source_mix

SCHEMA = "doc_id long, text string, source string, size long, n_chars long"


def targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, got, free = sum(sizes.values()), {}, set(names)
    while True:
        left, weight = total - sum(got.values()), sum(w[s] for s in free)
        over = {s for s in free if Fraction(left * w[s], weight) > most * sizes[s]}
        if not over:
            return got | {s: Fraction(left * w[s], weight) for s in free}
        got |= {s: most * sizes[s] for s in over}
        free -= over


def rows():
    out = []
    for i in range(400):
        source = None if i % 11 == 0 else ["b", "a", "é", "Z", "tiny"][0 if i % 3 else i % 4]
        out.append((i, None if i % 50 == 0 else "w " * (i % 37), source, 1, 5))
    return out + [(1000, "x y z", "tiny", 1, 5), (7, "same row here", "a", 1, 1), (7, "same row here", "a", 1, 1), (2000, "w w\x0bq " * 3000, "Z", 0, 0), (5000, "", "blank", 0, 0), (5001, None, "blank", 0, 0)]


def test_targets_and_taken(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    out = source_mix(df).collect()
    assert len(out) == len(data)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id, r.size) for r in out) == sorted((d[0], count(d[1])) for d in data)
    sizes, taken = defaultdict(int), defaultdict(int)
    for d in data:
        sizes[d[2]] += count(d[1])
    want = targets(sizes)
    for r in out:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.taken <= 3 * r.size
        assert r.target == pytest.approx(float(want[r.source]), abs=1e-6)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2
    again = source_mix(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    per_source = defaultdict(set)
    for r in out:
        if r.size:
            per_source[r.source].add(r.taken // r.size)
    assert all(max(v) - min(v) <= 1 for v in per_source.values())


def test_mixed_documents_take_what_the_plan_says(spark):
    df = spark.createDataFrame([r for r in rows() if r[0] != 7], SCHEMA)
    plan = {r.doc_id: r.taken for r in source_mix(df).collect()}
    out = mixed_documents(df)
    assert out.columns == df.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert dict(got) == {k: v for k, v in plan.items() if v}


def test_empty_and_wordless(spark):
    assert source_mix(spark.createDataFrame([], SCHEMA)).count() == 0
    out = source_mix(spark.createDataFrame([(1, None, None, 1, 1), (2, "", "a", 1, 1)], SCHEMA)).collect()
    assert [(r.taken, r.target) for r in out] == [(0, 0.0), (0, 0.0)]


def test_equal_rows_of_two_sources_are_taken_by_their_own(spark):
    shared = [(i, f"t{i} " * (i % 9 + 1), s, 1, 1) for i in range(60) for s in ("a", "b", None)]
    df = spark.createDataFrame(shared + [(1000 + i, "w " * 30, "b", 1, 1) for i in range(20)], SCHEMA)
    want, got = defaultdict(int), defaultdict(int)
    for r in source_mix(df).collect():
        want[r.doc_id, r.source] += r.taken
    for r in mixed_documents(df).collect():
        got[r.doc_id, r.source] += len(r.text.split())
    assert dict(got) == {k: v for k, v in want.items() if v}
