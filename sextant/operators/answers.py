"""Answers: numbered sources, prompt context, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The answer when nothing is found, and when the model fails. Fixed values.
NOT_FOUND = "No consta en las fichas técnicas consultadas."
FAILED = "Error temporal al consultar el modelo de lenguaje."


def sources(retrieved: DataFrame) -> DataFrame:
    """Per question the sources, numbered by rank; one row per question.

    ``retrieved``: question_id, rank, doc_id, name, section, title, page, text, score.
    """
    one = F.struct(F.col("rank").alias("index"), "doc_id", "name", "section", "title", "page", "text", "score")
    return retrieved.groupBy("question_id").agg(F.array_sort(F.collect_list(one)).alias("sources"))


def context(found: Column) -> Column:
    """The sources as the prompt's context."""
    about = lambda s: F.when(F.length(s["section"]) > 0, F.concat(F.lit(" (Sección "), s["section"], F.lit(": "), F.coalesce(s["title"], F.lit("None")), F.lit(")"))).otherwise("")
    return F.array_join(F.transform(found, lambda s: F.concat(F.lit("["), s["index"].cast("string"), F.lit("] "), s["name"], about(s), F.lit("\nTexto: "), s["text"])), "\n\n")


def plain_citations(answer: Column) -> Column:
    """Corner-bracket citations as [n]."""
    return F.regexp_replace(answer, r"【\s*(\d+)[^】]*】", "[$1]")


def real_citations(answer: Column, n_sources: Column) -> Column:
    """Without the citations of sources that there aren't: those but 1 to ``n_sources``."""
    between = F.split(answer, r"\[\d+\]", -1)
    cited = F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1))
    real = F.transform(cited, lambda x: F.when(x.try_cast("long").between(1, n_sources), F.concat(F.lit("["), x, F.lit("]"))).otherwise(""))
    return F.array_join(F.flatten(F.zip_with(between, real, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


def answer(questions: DataFrame) -> DataFrame:
    """The response to each question (question_id, pii_notice, sources, model_text, model).

    Without sources the fixed sentence, and no model is asked; a null ``model_text`` beside
    sources is a failure of the model.
    """
    some = F.size(F.coalesce("sources", F.array().cast(questions.schema["sources"].dataType))) > 0
    spoken = some & F.col("model_text").isNotNull()
    text = F.when(~some, F.lit(NOT_FOUND)).when(~spoken, F.lit(FAILED)).otherwise(real_citations(plain_citations(F.col("model_text")), F.size("sources")))
    return questions.select("question_id", text.alias("answer"), spoken.alias("found"), F.when(spoken, F.col("sources")).otherwise(F.array().cast(questions.schema["sources"].dataType)).alias("sources"), "pii_notice", F.when(spoken, F.col("model")).alias("model"))


def says_nothing(answer_: Column, found: Column) -> Column:
    """The user interface's test of an empty answer."""
    return ~found | (F.trim(answer_) == NOT_FOUND)
