import re
from collections import Counter
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from sextant.llm.filter_audit import ORACLE, filter_audit

DOCS = "doc_id long, text string, source string, lang string, mask int, part string, size string, first int, n int"
LABELS = "doc_id long, quality int, toxic int, part string"
COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def documents():
    good = " ".join(f"word{i}" for i in range(210))
    twins = [good + " x" * 400 + "y" * 5000 + end for end in ("a", "b", "a", "b", "b")]  # they differ in the last block only
    texts = [good, good, good.upper(), "short", "short", "short # one", "", None, good + " A#", "the " * 300, *twins, "é" * 70, "é" * 69 + "e", " \t\x0b", good + "😀" * 4200, good + "😀" * 4200]
    rows = [(i, t, ("a", "b", None, "a|b")[i % 4]) for i, t in enumerate(texts)]
    rows += [(3, "short", "b"), (0, good, "a"), (None, good, "b"), (None, None, None), (40, "short", "a"), (-5, "short", "a"), (41, good.upper(), ""), (5, "other text of five", "b")]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 30, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (3, None, 1)]
    return rows, labels


def plain(rows, labels):
    """Every order applied to every part, document by document."""
    rows = [(i, t or "", s or "") for i, t, s in rows]
    known = {i: [max(int((x or 0) == 1) for d, *v in labels if d == i for x in [v[k]]) for k in (0, 1)] for i in {d for d, *_ in labels} if i is not None}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t] = min(i, least.get(t, i))

    def fails(i, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        return out + "E" * (i is not None and i > least[t])

    out = {}
    for part in {s for *_, s in rows}:
        own = [(fails(i, t), *known.get(i, (0, 0))) for i, t, s in rows if s == part]
        share = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, c in enumerate(order):
                gone = [x for x in left if c in x[0]]
                left = [x for x in left if c not in x[0]]
                share[c] += len(gone)
                out[part, order, k + 1] = [len(left), len(gone), sum(c in x[0] for x in own) - len(gone), sum(x[0] == c for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for key, x in out.items():
            if key[0] == part:
                x.append(share[key[1][key[2] - 1]])
    return out


def frames(spark, rows, labels):
    return spark.createDataFrame([(*r, "en", 31, "p", "z", 0, 9) for r in rows], DOCS), spark.createDataFrame([(*r, "q") for r in labels], LABELS)


@pytest.mark.parametrize("bits", [64, 1])
def test_counts_against_brute_force(spark, bits):
    """With hashes of one bit, different texts share a class and are told apart by whole texts."""
    rows, labels = documents()
    docs, known = frames(spark, rows, labels)
    out = filter_audit(docs, known, bits).collect()
    assert {(r.part, r.filter_order, r.step): [r[c] for c in COLUMNS] for r in out} == plain(rows, labels)
    assert len(out) == 4 * 600


def test_oracle_on_odd_rows(spark):
    rows, labels = documents()
    docs, known = frames(spark, rows, labels)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toArrow())
    con.register("labels", known.toArrow())
    got = con.execute(ORACLE)
    names = [d[0] for d in got.description]
    mine = filter_audit(docs, known).select(*names).collect()
    assert sorted(map(tuple, mine)) == sorted(got.fetchall())


def test_empty_tables(spark):
    rows, labels = documents()
    docs, known = frames(spark, rows, labels)
    assert filter_audit(docs.limit(0), known).count() == 0
    out = filter_audit(docs.withColumn("text", F.lit(None)), known.limit(0)).filter("step = 5").collect()
    assert out and all(r.kept == r.good_lost == r.toxic_lost == 0 for r in out)
