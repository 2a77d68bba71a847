import hashlib
import json
import math
import re

import pytest
from pyspark.sql import functions as F

from sextant.operators import index, lexical
from sextant.operators.embedding import hashed_vectors
from sextant.streaming import events as ev


def put(folder, name, rows):
    (folder / "events").mkdir(exist_ok=True)
    lines = [json.dumps(dict(zip(("seq", "kind", "doc_id", "text"), r, strict=True))) for r in rows]
    (folder / "events" / f"{name}.json").write_text("\n".join(lines))


def content(spark, path):
    return sorted((r.doc_id, r.text) for r in index.open_index(spark, path).collect())


def test_events_take_effect_once_and_a_restart_goes_on(spark, tmp_path, monkeypatch):
    path, run = f"{tmp_path}/index", lambda: ev.follow(ev.read_events(spark, f"{tmp_path}/events"), f"{tmp_path}/index", f"{tmp_path}/checkpoint").awaitTermination()
    put(tmp_path, "1", [(1, "upload", "a", "first text"), (2, "upload", "b", "second text"), (3, "upload", "a", "its new version"), (4, "delete", "never seen", None), (5, "rename", "a", "x"), (6, "upload", None, "y"), (7, "upload", "blank", "")])
    run()
    assert content(spark, path) == [("a", "its new version"), ("b", "second text")] and index.applied(spark, path) == {"documents": 0}
    # The batch fails after the index has its next state: the stream repeats it, the index doesn't.
    put(tmp_path, "2", [(8, "delete", "a", None), (9, "upload", "c", "third text")])
    real, states = ev.apply_events, []

    def failing(*args):
        states.append(real(*args))
        raise RuntimeError("lost after the change")

    with monkeypatch.context() as patch:
        patch.setattr(ev, "apply_events", failing)
        with pytest.raises(Exception, match="lost after the change"):
            run()
    put(tmp_path, "3", [(10, "upload", "c", "third text, mended")])
    seen = []
    with monkeypatch.context() as patch:
        patch.setattr(ev, "apply_events", lambda *args: seen.append(real(*args)))
        run()
    assert states == [True] and seen == [False, True]
    assert content(spark, path) == [("b", "second text"), ("c", "third text, mended")] and index.applied(spark, path) == {"documents": 2}
    postings = index.open_terms(spark, path)
    assert sorted({r.term for r in postings.filter("term <> ''").select("term").collect()}) == ["mended", "second", "text", "third"]
    others = lexical.postings(spark.createDataFrame([(f"o{i}", 99, "some other text") for i in range(5)], "chunk_id string, bucket int, text string"))
    found = lexical.search_terms(spark.createDataFrame([(1, "mended third")], "question_id int, text string"), postings.unionByName(others))
    assert [r.chunk_id for r in found.collect()] == ["c::0"]
    # A batch that changes nothing is recorded too, and other streams count for themselves.
    nothing = spark.createDataFrame([], ev.EVENTS)
    assert ev.apply_events(nothing, path, 0, "other") and not ev.apply_events(nothing, path, 0, "other")
    assert index.applied(spark, path) == {"documents": 2, "other": 0} and len(content(spark, path)) == 2


def test_postings_of_a_bucket_are_sorted_where_they_are_made(spark):
    chunks = spark.createDataFrame([(f"c{i}", i % 5, f"w{i % 9} máximo {i}") for i in range(400)], "chunk_id string, bucket int, text string")
    made = lexical.postings(chunks, 8, whole_buckets=True)
    tasks = made.select("bucket", F.spark_partition_id().alias("task")).distinct()
    assert tasks.groupBy("bucket").count().filter("count > 1").isEmpty() and made.select("block").distinct().count() > 5
    row = lambda r: (r.bucket, r.block, r.term, r.df, r.most, r.least, r.words, sorted(tuple(e) for e in r.entries))
    assert sorted(map(row, made.collect())) == sorted(map(row, lexical.postings(chunks, 8).collect()))
    sorted_ = made.sortWithinPartitions("bucket", "term", "block")
    assert sorted_._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2  # the texts, and the buckets' sizes


def test_tokens_in_a_task_are_those_of_the_expression(spark):
    from sextant.functions import text as tx

    texts = ["Ñandú MÁXIMA ﬁn ½ Straße", "İstanbul ΑΣ x", "é́e\u0301 日本12語ab", "", "plain de la text 9", "a\u0301\u0302b Ǆc ꜳ"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", tx.tokens(F.col("text")).alias("t")).collect()
    plain = lambda t: [w for w in tx.TOKEN.findall(t.lower().translate(tx._folding())) if w not in tx.STOP_WORDS]
    assert [tx.tokens_of(r.text) for r in rows] == [plain(r.text) for r in rows]
    assert tx.tokens_of(texts[0]) == rows[0].t


def test_hashed_vectors_against_their_definition(spark):
    texts = [(1, "Dosis de paracetamol, dosis MÁXIMA"), (2, ""), (3, None), (4, "¿¡ !?"), (5, "a_b 12 " * 500)]

    def plain(text, dim):
        v = [0.0] * dim
        for w in re.findall(r"\w+", (text or "").lower()):
            v[int(hashlib.md5(w.encode()).hexdigest(), 16) % dim] += 1
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        return [x / norm for x in v]

    for dim in (64, 16):
        rows = hashed_vectors(spark.createDataFrame(texts, "id int, text string"), "id", dim).collect()
        assert {r.id: r.vector for r in rows} == {i: pytest.approx(plain(t, dim)) for i, t in texts}
    assert hashed_vectors(spark.createDataFrame(texts, "id int, text string").limit(0), "id").count() == 0
    with pytest.raises(ValueError, match="power of two"):
        hashed_vectors(spark.createDataFrame(texts, "id int, text string").withColumn("x", F.lit(1)), "id", 48)
