"""Quality of retrieval, of segmentation and of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Categories in which nothing should be found. Fixed values.
REJECTED = ("medicamento_ausente", "fuera_de_alcance")
WITH_PII = "con_respuesta_con_pii"
KEY_SECTIONS = ("4.1", "4.2", "4.3", "4.4", "4.5", "4.8")
KS = (1, 3, 5)


def rate(hits, total):
    """Rounded share, null of nothing."""
    return F.round(hits / F.nullif(total, F.lit(0)), 4)


def _count(condition):
    return F.sum(F.when(condition, 1).otherwise(0))


def question_hits(golden: DataFrame, retrieved: DataFrame, threshold: float | None = None) -> DataFrame:
    """Per question: first rank of the right sheet and section, of the right sheet, the best section, whether nothing is left.

    ``golden``: question_id, category, answerable, expected_register, expected_section.
    ``retrieved``: question_id, rank, register, section, score. The threshold comes first,
    then the ranks are numbered anew.
    """
    left = retrieved if threshold is None else retrieved.filter(F.col("score") >= threshold)
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("rank"))
    rows = golden.join(left.select("question_id", "register", "section", place.alias("place")), "question_id", "left")
    same = F.col("register").eqNullSafe(F.col("expected_register")) & F.col("place").isNotNull()
    both = same & F.col("section").eqNullSafe(F.col("expected_section"))
    return rows.groupBy("question_id", "category", "answerable", "expected_section").agg(
        F.min(F.when(both, F.col("place"))).alias("hit_rank"),
        F.min(F.when(same, F.col("place"))).alias("sheet_rank"),
        F.max(F.when(F.col("place") == 1, F.col("section"))).alias("best_section"),
        (F.count("place") == 0).alias("nothing"),
    )


def retrieval_metrics(hits: DataFrame, k_max: int = 5) -> DataFrame:
    """One row of rates over ``question_hits``; cut-offs above ``k_max`` are left out."""
    answerable, rejected = F.col("answerable"), F.col("category").isin(*REJECTED)
    n, m = _count(answerable), _count(rejected)
    columns = [F.count("*").alias("n_questions"), n.alias("n_answerable"), m.alias("n_rejected")]
    for k in (k for k in KS if k <= k_max):
        columns += [rate(_count(answerable & (F.col("hit_rank") <= k)), n).alias(f"hit_rate_{k}"), rate(_count(answerable & (F.col("sheet_rank") <= k)), n).alias(f"sheet_rate_{k}")]
    reciprocal = F.sum(F.when(answerable & (F.col("hit_rank") <= k_max), 1.0 / F.col("hit_rank")).otherwise(0.0))
    columns += [rate(reciprocal, n).alias("mrr"), rate(_count(answerable & F.col("best_section").eqNullSafe(F.col("expected_section"))), n).alias("section_rate_1")]
    columns += [rate(_count(rejected & F.col("nothing")), m).alias("right_rejections"), rate(_count(answerable & F.col("nothing")), n).alias("false_rejections")]
    return hits.agg(*columns)


def metrics_by_section(hits: DataFrame, k_max: int = 5) -> DataFrame:
    found = _count(F.col("hit_rank") <= k_max)
    return hits.filter("answerable").groupBy(F.coalesce("expected_section", F.lit("?")).alias("section")).agg(F.count("*").alias("n"), rate(found, F.count("*")).alias("hit_rate"))


def failed_questions(hits: DataFrame, k_max: int = 5) -> DataFrame:
    return hits.filter(F.col("answerable") & ~F.coalesce(F.col("hit_rank") <= k_max, F.lit(False))).select("question_id")


def _last_step(score, width: float, digits: int):
    """The last threshold, by its number from 0, that ``score`` reaches; -1 if none."""
    reached = lambda i: F.round(i * F.lit(width), digits) <= score
    about = F.floor(score / width).cast("int")
    return F.greatest(F.when(reached(about + 1), about + 1).when(reached(about), about).otherwise(about - 1), F.lit(-1))


def threshold_sweep(golden: DataFrame, retrieved: DataFrame, steps: int = 19, k_max: int = 5, width: float = 0.05, digits: int = 2) -> DataFrame:
    """Rates at ``steps`` thresholds 0, ``width``, ...; the retrieval isn't repeated.

    A row above a threshold keeps its rank order, so its place is the number of rows above
    the threshold so far. It is a hit from where so many rows before it have gone that its
    place is ``k_max`` up to its own score. A question marks where its hits begin and end and
    where nothing is left; sums of the marks along the thresholds give the rates. Neither
    questions nor rows meet the thresholds.
    """
    order = Window.partitionBy("question_id").orderBy("rank")
    left = retrieved.select("question_id", "rank", "register", "section", "score").join(golden.select("question_id", "expected_register", "expected_section"), "question_id")
    above = F.get(F.reverse(F.array_sort(F.collect_list("score").over(order))), F.lit(k_max))  # the first score that has to go
    step = lambda c: _last_step(c, width, digits)
    rows = left.withColumn("begin", F.coalesce(step(above) + 1, F.lit(0))).withColumn("end", F.least(step(F.col("score")), F.lit(steps - 1)))
    both = F.col("register").eqNullSafe(F.col("expected_register")) & F.col("section").eqNullSafe(F.col("expected_section"))
    spans = rows.filter(both & (F.col("begin") <= F.col("end")) & F.lit(k_max in KS))
    # Where a question's spans overlap, only what goes beyond the ones before counts.
    beyond = F.max("end").over(Window.partitionBy("question_id").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("begin", F.greatest("begin", F.coalesce(beyond + 1, F.lit(0)))).filter("begin <= end").join(golden.filter("answerable").select("question_id"), "question_id")
    mark = lambda at, hit, right, wrong: F.struct(at.alias("step"), hit.alias("hit"), right.alias("right"), wrong.alias("wrong"))
    zero, one = F.lit(0), F.lit(1)
    hits = spans.select(F.explode(F.array(mark(F.col("begin"), one, zero, zero), mark(F.col("end") + 1, -one, zero, zero))).alias("m")).select("m.*")
    top = golden.join(retrieved.groupBy("question_id").agg(F.max("score").alias("top")), "question_id", "left")
    gone = F.coalesce(step(F.col("top")) + 1, F.lit(0))
    nothing = top.select(mark(gone, zero, F.col("category").isin(*REJECTED).cast("int"), F.col("answerable").cast("int")).alias("m")).select("m.*")
    marks = hits.union(nothing).groupBy("step").agg(*[F.sum(F.coalesce(c, zero)).alias(c) for c in ("hit", "right", "wrong")])
    whole = golden.agg(_count(F.col("answerable")).alias("answerable"), _count(F.col("category").isin(*REJECTED)).alias("rejected"), F.count("*").alias("n")).filter("n > 0")
    grid = golden.sparkSession.range(steps).select(F.col("id").cast("int").alias("step")).join(marks, "step", "left")
    sums = grid.select("step", *[F.sum(F.coalesce(c, zero)).over(Window.orderBy("step")).alias(c) for c in ("hit", "right", "wrong")]).join(F.broadcast(whole))
    share = lambda c, of: F.coalesce(rate(F.col(c), F.col(of)), F.lit(0.0))
    out = sums.select(F.round(F.col("step") * F.lit(width), digits).alias("threshold"), share("hit", "answerable").alias("hit_rate"), share("right", "rejected").alias("right_rejections"), rate(F.col("wrong"), F.col("answerable")).alias("false_rejections"))
    return out.withColumn("score", F.round((F.col("hit_rate") + F.col("right_rejections")) / 2, 4))


def best_threshold(sweep: DataFrame) -> DataFrame:
    return sweep.orderBy(F.desc("score"), "threshold").limit(1)


def link_golden(golden: DataFrame, chunks: DataFrame) -> DataFrame:
    """Questions with the ids of the chunks (chunk_id, register, section, position) that answer them, in chunk order."""
    at = golden.join(chunks.select("chunk_id", F.col("register").alias("expected_register"), F.col("section").alias("expected_section"), "position"), ["expected_register", "expected_section"], "left")
    ids = F.transform(F.array_sort(F.collect_list(F.when(F.col("chunk_id").isNotNull(), F.struct("position", "chunk_id")))), lambda x: x["chunk_id"])
    return at.groupBy("question_id", "answerable").agg(ids.alias("chunk_ids"))


def golden_gaps(linked: DataFrame) -> DataFrame:
    """Answerable questions that no chunk answers."""
    return linked.filter(F.col("answerable") & (F.size("chunk_ids") == 0)).select("question_id")


def compare_sections(sheets: DataFrame, template: tuple[str, ...]) -> DataFrame:
    """Official and detected section sets of each sheet (register, official, detected) against each other.

    Both are held against the template first; sheets without official sections are left out.
    """
    known = F.array(*[F.lit(s) for s in template])
    rows = sheets.select("register", F.array_sort(F.array_intersect("official", known)).alias("official"), F.array_sort(F.array_intersect("detected", known)).alias("detected")).filter(F.size("official") > 0)
    return rows.select("*", F.array_except("official", "detected").alias("missing"), F.array_except("detected", "official").alias("extra"), F.size(F.array_intersect("official", "detected")).alias("hits"))


def validate_sheets(found: DataFrame, official: DataFrame, template: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Detected against official sections of a folder's sheets, and how many sheets have no official data.

    ``found``: register, product, number, of which the first product counts. ``official``:
    register, number; numbers outside the template don't count.
    """
    known = official.filter(F.col("number").isin(*template)).groupBy("register").agg(F.collect_set("number").alias("official"))
    own = found.groupBy("register").agg(F.collect_set(F.when(F.col("product") == 1, F.col("number"))).alias("detected"))
    both = own.join(known, "register", "left")
    skipped = both.agg(F.count(F.when(F.col("official").isNull(), 1)).alias("skipped"))
    return compare_sections(both.filter("official is not null"), template), skipped


def section_metrics(compared: DataFrame) -> DataFrame:
    """Micro-averaged recall and precision, recall on key sections, sheets without a fault; zero of nothing."""
    key = F.array(*[F.lit(s) for s in KEY_SECTIONS])
    share = lambda a, b: F.coalesce(F.round(F.sum(a) / F.nullif(F.sum(b), F.lit(0)), 8), F.lit(0.0))
    own = F.array_intersect("official", key)
    return compared.agg(
        F.count("*").alias("sheets"),
        share(F.col("hits"), F.size("official")).alias("recall"),
        share(F.col("hits"), F.size("detected")).alias("precision"),
        share(F.size(F.array_intersect(own, F.col("detected"))), F.size(own)).alias("key_recall"),
        _count((F.size("missing") == 0) & (F.size("extra") == 0)).alias("perfect"),
    )


def section_report(compared: DataFrame) -> DataFrame:
    """The report's rows, the most faults first; sets as text, in string order."""
    join = lambda c: F.array_join(F.array_sort(c), " ")
    faults = F.size("missing") + F.size("extra")
    return compared.orderBy(F.desc(faults), "register").select("register", F.size("official").alias("n_official"), F.size("detected").alias("n_detected"), "hits", join("missing").alias("missing"), join("extra").alias("extra"))


def check_answers(answers: DataFrame) -> DataFrame:
    """Checks of each answer against its sources and its golden question.

    ``answers``: question_id, category, answerable, expected_register, expected_section,
    expected_pii, forbidden (array), answer, found, pii_notice, sources (array of struct
    index, doc_id, section), error. Rows with an error get nulls.
    """
    cited = F.transform(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("long"))
    index = F.transform("sources", lambda s: s["index"].cast("long"))
    wanted = F.concat(F.lit("FT_"), F.col("expected_register"))
    fits = lambda s: s["doc_id"].eqNullSafe(wanted) & s["section"].eqNullSafe(F.col("expected_section"))
    rows = answers.withColumn("cited", cited)
    leak = F.exists(F.coalesce("forbidden", F.array().cast("array<string>")), lambda p: F.lower("answer").contains(F.lower(p)))
    checks = {
        "n_citations": F.size("cited"),
        "citations_valid": F.size(F.array_except("cited", index)) == 0,
        "has_citations": F.size("cited") > 0,
        "source_retrieved": F.exists("sources", fits),
        "source_cited": F.exists("sources", lambda s: fits(s) & F.array_contains("cited", s["index"].cast("long"))),
        "pii_notice_right": F.col("pii_notice") == F.coalesce("expected_pii", F.lit(False)),
        "no_leak": ~leak,
    }
    ok = F.col("error").isNull()
    return rows.select("question_id", "category", "answerable", "found", "pii_notice", "error", *[F.when(ok, v).alias(k) for k, v in checks.items()])


def answer_metrics(checked: DataFrame) -> DataFrame:
    """Rates over the answers without an error; null of nothing."""
    ok = F.col("error").isNull()
    found, answerable, rejected = ok & F.col("found"), ok & F.col("answerable"), ok & F.col("category").isin(*REJECTED)
    pii, plain = ok & (F.col("category") == WITH_PII), ok & (F.col("category") != WITH_PII)
    of = lambda what, among: rate(_count(among & what), _count(among))
    return checked.agg(
        F.count("*").alias("n_questions"),
        _count(~ok).alias("n_errors"),
        of(~F.col("found"), rejected).alias("right_rejections"),
        of(~F.col("found"), answerable).alias("false_rejections"),
        of(F.col("citations_valid"), found).alias("citations_valid"),
        of(F.col("has_citations"), found).alias("has_citations"),
        of(F.col("source_cited"), answerable).alias("source_cited"),
        of(F.col("source_retrieved"), answerable).alias("source_retrieved"),
        of(F.col("pii_notice"), pii).alias("pii_notices"),
        of(F.col("pii_notice"), plain).alias("pii_false_alarms"),
        of(F.col("no_leak"), ok).alias("no_leak"),
    )


def review_sheet(checked: DataFrame, manual: DataFrame) -> DataFrame:
    """Questions to look over by hand: answered ones and those of ``manual`` (question_id), errors left out."""
    flagged = manual.select("question_id").distinct().withColumn("manual", F.lit(True))
    rows = checked.join(flagged, "question_id", "left")
    return rows.filter(F.col("error").isNull() & ((F.col("answerable") & F.col("found")) | F.coalesce("manual", F.lit(False)))).select("question_id", "category", "found")
