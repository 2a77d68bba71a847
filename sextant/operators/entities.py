"""Entities of a catalogue: aliases, mentions in questions, checks of ingredients, incremental building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.scratch import tasks_for
from sextant.functions.text import match_form, upper_form

#: First words of names that are no brands. Fixed values.
NO_BRANDS = ("acido",)
#: Kinds of alias in their order. Fixed values.
SEARCHED, OFFICIAL, COMMERCIAL = "searched_active_ingredient", "official_active_ingredient", "commercial_name"


def commercial_alias(name: Column) -> Column:
    """The name's words before the first with a digit; the whole name if there are none."""
    words = F.split(match_form(name), " ")
    with_digit = F.transform(words, lambda w: w.rlike("[0-9]"))
    at = F.array_position(with_digit, True)
    return F.when(at == 1, match_form(name)).when(at > 1, F.array_join(F.slice(words, F.lit(1), (at - 1).cast("int")), " ")).otherwise(match_form(name))


def brand_alias(name: Column, ingredients: Column) -> Column:
    """The alias's first word, unless it is short, no brand or an ingredient's word; else empty."""
    first = F.split(commercial_alias(name), " ")[0]
    return F.when((F.length(first) >= 4) & ~first.isin(*NO_BRANDS) & ~F.array_contains(F.split(match_form(ingredients), " "), first), first).otherwise("")


def aliases(catalogue: DataFrame) -> DataFrame:
    """Alias rows of catalogue rows (row, register, name, searched, ingredients)."""
    pair = lambda at, a, kind: F.struct(F.lit(at).alias("at"), a.alias("alias"), F.lit(kind).alias("match_type"))
    four = F.array(pair(0, match_form(F.col("searched")), SEARCHED), pair(1, match_form(F.col("ingredients")), OFFICIAL), pair(2, commercial_alias(F.col("name")), COMMERCIAL), pair(3, brand_alias(F.col("name"), F.col("ingredients")), COMMERCIAL))
    return catalogue.select("row", "register", "name", "ingredients", F.explode(four).alias("a")).select("row", "register", "name", "ingredients", "a.*").filter("alias <> ''")


def find_medications(questions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """One mention per question (question_id, text) and register: the alias of most words, then the longest, then the first.

    An alias is found as whole words. Questions are cut into their word n-grams of the
    lengths that aliases have, so the search is an equi-join on the phrase.
    """
    every = aliases(catalogue).withColumn("words", F.size(F.split("alias", " ")))
    lengths = every.agg(F.sort_array(F.collect_set("words")).alias("lengths"))
    asked = questions.select("question_id", F.split(match_form(F.col("text")), " ").alias("q")).join(F.broadcast(lengths))
    grams = F.flatten(F.transform("lengths", lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.size("q")), lambda i: i + n - 1 <= F.size("q")), lambda i: F.array_join(F.slice("q", i, n), " "))))
    phrases = asked.select("question_id", F.explode(F.array_distinct(grams)).alias("alias"))
    # Dealt by the number of questions: the mentions take few bytes, so Spark would give a task ever more of them.
    found = phrases.join(every, "alias").repartition(tasks_for(questions, 16), "question_id")
    best = Window.partitionBy("question_id", "register").orderBy(F.desc("words"), F.desc(F.length("alias")), "row", "at")
    first = F.min("row").over(Window.partitionBy("question_id", "register"))
    one = found.withColumn("best", F.row_number().over(best)).withColumn("first", first).filter("best = 1")
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("first"))
    return one.select("question_id", place.alias("place"), "register", "name", "ingredients", "alias", "match_type")


def detect_medication(mentions: DataFrame) -> DataFrame:
    """The mention of questions that have exactly one."""
    return mentions.withColumn("n", F.count("*").over(Window.partitionBy("question_id"))).filter("n = 1").drop("n", "place")


def _words(text: Column) -> Column:
    return F.filter(F.split(upper_form(text), r"\s+"), lambda w: w != "")


def ingredient_matches(searched: Column, ingredients: Column) -> Column:
    """All words of the searched name are words of one of the comma-separated ingredients."""
    wanted = _words(searched)
    return (F.size(wanted) > 0) & F.exists(F.split(F.coalesce(ingredients, F.lit("")), ","), lambda p: F.size(F.array_except(wanted, _words(p))) == 0)


def suspicious(catalogue: DataFrame) -> DataFrame:
    """Rows in which no ingredient is the searched one, alone or followed by a salt."""
    wanted = upper_form(F.col("searched"))
    fits = F.exists(F.split(F.coalesce("ingredients", F.lit("")), ","), lambda p: (upper_form(p) == wanted) | upper_form(p).startswith(F.concat(wanted, F.lit(" "))))
    return catalogue.filter((wanted != "") & ~fits)


def choose_candidates(results: DataFrame, most: int = 60) -> DataFrame:
    """The first fitting record of each search.

    ``results``: searched, place (of the search result), register, segmented, has_sheet, and
    details name and ingredients, null where the lookup failed. Segmented sheets go first,
    ``most`` are looked at.
    """
    order = Window.partitionBy("searched").orderBy(F.desc("segmented"), "place")
    seen = results.filter("has_sheet").withColumn("try", F.row_number().over(order)).filter(F.col("try") <= most)
    right = seen.filter(ingredient_matches(F.col("searched"), F.col("ingredients")))
    return right.withColumn("first", F.min("try").over(Window.partitionBy("searched"))).filter("try = first").select("searched", "register", "name", "ingredients")


def extend_catalogue(catalogue: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``found`` (place, searched, register, ...) to append: new names and new registers, the first of each register."""
    fresh = found.join(catalogue.select(F.lower("searched").alias("_done")).distinct(), F.lower(found["searched"]) == F.col("_done"), "left_anti")
    fresh = fresh.join(catalogue.select(F.col("register").alias("_known")).distinct(), fresh["register"] == F.col("_known"), "left_anti")
    first = F.row_number().over(Window.partitionBy("register").orderBy("place"))
    return fresh.withColumn("_first", first).filter("_first = 1").drop("_first")


def catalogue_of_files(files: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Files (path) with the catalogue row whose register their name FT_<digits> has."""
    stem = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^FT_(\d+)\.[^.]*$", 1)
    return files.withColumn("register", F.nullif(stem, F.lit(""))).join(catalogue, "register", "left")
