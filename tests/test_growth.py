"""Plans that hold at any size: tasks by rows, few sorts, nothing that grows through the driver."""

import os

import pytest

from sextant import catalogue
from sextant.functions import scratch
from sextant.operators import chunking, sections
from sextant.plans import inputs

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="the driver's tables aren't here")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_of_sheets_are_dealt_by_rows_and_sorted_once(spark, monkeypatch):
    monkeypatch.setattr(scratch, "TASK_ROWS", 500)
    lines = inputs.frame(spark, SF, "sheet_lines")
    rows = lines.count()
    assert lines.rdd.getNumPartitions() == -(-rows // 500) > 4
    for name, shuffles in (("section_spans", 1), ("detect_sections", 1)):
        text = plan(catalogue.QUERIES[name](spark, SF))
        assert text.count("Exchange ") == shuffles and text.count(" Sort ") == 1, text


@pytest.mark.parametrize("name", ["strategy_mix", "sheet_parts"])
def test_spans_and_sheets_are_not_broadcast(spark, name):
    assert "BroadcastExchange" not in plan(catalogue.QUERIES[name](spark, SF))


def test_lines_are_marked_as_by_the_rule_of_runs(spark):
    """A product begins at a 1 after a run that reached 7, whatever the runs before it reached."""
    titles = ["1. Nombre", "7. Titular", "1. Nombre", "2. Composición", "1. Nombre", "8. Autorización", "1. Nombre", "2. Composición"]
    lines = spark.createDataFrame([("a", 1, i, t) for i, t in enumerate(["x", *titles])], "doc_id string, page int, line int, text string")
    rows = sections.mark_sections(lines).orderBy("line").collect()
    assert [r["product"] for r in rows] == [1, 1, 1, 2, 2, 2, 2, 3, 3]
    assert [r["is_title"] for r in rows] == [False, True, True, True, True, False, True, True, True]


def test_a_text_is_cut_once(spark):
    docs = spark.createDataFrame([("a", "One. " * 900), ("b", ""), ("c", None)], "doc_id string, text string")
    from pyspark.sql import functions as F

    cut = docs.withColumn("cut", chunking.pieces(F.col("text"))).select("doc_id", F.size("cut").alias("parts"), F.posexplode("cut").alias("part", "piece"))
    assert plan(cut).count("ArrowEvalPython") == 1
    assert {(r.doc_id, r.parts) for r in cut.collect()} == {("a", len(chunking.split_text("One. " * 900)))}


def test_mentions_are_dealt_by_questions(spark, monkeypatch):
    monkeypatch.setattr(scratch, "TASK_ROWS", 100)
    df = catalogue.QUERIES["detect_one"](spark, SF)
    tasks = -(-inputs.frame(spark, SF, "part").count() * 16 // 100)
    assert f"{tasks}), REPARTITION_BY_NUM" in plan(df)
    assert sum(f"Exchange hashpartitioning(question_id" in x for x in plan(df).splitlines()) <= 1


def test_short_rows_with_much_work_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(scratch, "TASK_ROWS", 100)
    assert catalogue.QUERIES["pages_cleaned"](spark, SF).rdd.getNumPartitions() == -(-inputs.frame(spark, SF, "part").count() * 20 // 100)


def test_pieces_of_a_batch_are_sent_off_a_few_texts_at_once():
    import pyarrow as pa
    from sextant.operators import chunking

    texts = pa.array([None if i % 7 == 3 else f"Text {i}. " * (i % 400) for i in range(1000)])
    parts = list(chunking._by_few(iter([texts, texts[:5], texts[:0]]), lambda t: chunking._cut(t, 1000, 150, None)))
    assert max(map(len, parts)) <= chunking.ROWS and max(p.nbytes for p in parts) < 0.4 * texts.nbytes
    want = [None if t is None else chunking.located(t, 1000, 150) for t in texts.to_pylist()]
    assert [x for p in parts for x in p.to_pylist()] == want + want[:5]
