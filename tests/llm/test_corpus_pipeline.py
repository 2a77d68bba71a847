import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_pii import base

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(12)
    vocabulary = ["river", "stone", "quiet", "harbor", "lantern", "meadow", "winter", "copper", "garden", "signal"]
    vocabulary += [a + b for a in vocabulary for b in vocabulary]
    rows = []
    for i in range(240):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.choice((3, 60, 150))))
        if i % 10 == 9:
            text = "".join(c + rng.choice("%&#$") for c in text)
        if i % 12 == 5:
            text += f" mail me{i}@site.org or +1 (415) 555-26{i % 90 + 10}"
        rows.append((i, text, "en" if i % 4 else None, f"s{i % 5}" if i % 7 else None, len(text)))
    rows += [(300 + k, rows[k][1] + (" end" if k % 2 and len(rows[k][1]) > 300 else ""), "en", "s1", 5) for k in range(0, 60)]
    rows += [(1, rows[1][1], "en", "s1", 9), (900, None, None, None, None), (901, "", "en", "s1", 0), (902, "stone " * 5000, "en", "s2", 30000)]
    out = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 != 9), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def near_roots(texts):
    """The smallest doc_id that links of a five-word shingle similarity of 0.8 or more reach, by comparing all pairs."""
    sets = {}
    for i, text in texts.items():
        words = (text or "").lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            a, b = sets[i], sets[j]
            if i < j and root[i] != root[j] and (len(a & b) >= 0.8 * len(a | b)):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def test_every_stage_on_its_own_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = spark.createDataFrame(seen[name], docs.schema)
    key = lambda r: (r.doc_id, r.text)
    before, kept = {key(r) for r in seen["documents"]}, {key(r) for r in seen["quality"]}
    assert kept <= before and not any(i % 10 == 9 for i, _ in kept if i < 240)
    clean = {k for k in before if k[0] < 240 and k[0] % 10 != 9}
    assert len(clean & kept) > 0.9 * len(clean)
    root = near_roots({r.doc_id: r.text for r in seen["quality"]})
    assert sorted(key(r) for r in seen["near_dedup"] if r.text is not None) == sorted(key(r) for r in seen["quality"] if root[r.doc_id] == r.doc_id and r.text is not None)
    was = {key(r): r.text for r in seen["near_dedup"]}
    assert len(seen["personal_data"]) == len(seen["near_dedup"])
    texts = {r.doc_id: r.text for r in seen["personal_data"]}
    for (i, _), t in was.items():
        assert texts[i] == t if not t or not re.search("[0-9@]", t) else not base(texts[i])
    taken = {}
    for r in seen["source_mix"]:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.split())
    assert all(n <= 3 * len(texts[i].split()) * sum(r.doc_id == i for r in seen["personal_data"]) for i, n in taken.items())
    assert abs(sum(taken.values()) - sum(len((r.text or "").split()) for r in seen["personal_data"])) <= 10
    pieces = seen["packing"]
    assert all(p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) for p in pieces)
    assert {p.doc_id for p in pieces} == set(taken)


def test_run_and_empty_table(spark, sf_dir, tmp_path):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
