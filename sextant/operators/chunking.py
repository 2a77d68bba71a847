"""Chunks: recursive splitting, headers and ids, comparison of strategies, run summary."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant.functions.text import trim_memory
from sextant.operators.evaluation import KEY_SECTIONS
from sextant.operators.sections import LEAST_TEXT, all_sections, by_document, page_at, section_url

#: Sections up to LONGEST stay whole, others are split to SIZE with OVERLAP.
LONGEST, SIZE, OVERLAP = 1500, 1000, 150
SEPARATORS = ("\n\n", "\n", ". ", "; ", ", ", " ", "")
#: Texts of which Python objects are made at once.
ROWS = 128
PIECES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("text", T.StringType())]))


def _parts(text: str, separator: str) -> list[str]:
    """Cut before each separator, which stays with what follows it."""
    if not separator:
        return list(text)
    cut = text.split(separator)
    return [p for p in (cut[0], *(separator + c for c in cut[1:])) if p]


def _merge(parts: list[str], size: int, overlap: int) -> Iterator[str]:
    """Join parts up to ``size``; the next piece begins with the last parts, ``overlap`` characters at most."""
    held: list[str] = []
    total = 0
    for part in parts:
        if held and total + len(part) > size:
            yield "".join(held).strip()
            while total > overlap or (total and total + len(part) > size):
                total -= len(held.pop(0))
        held.append(part)
        total += len(part)
    if held:
        yield "".join(held).strip()


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Recursive character splitting: the first separator that occurs cuts, oversize parts are cut by the later ones."""
    at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    later, out, fitting = separators[at + 1 :], [], []
    for part in _parts(text, separators[at]):
        if len(part) < size:
            fitting.append(part)
            continue
        out += _merge(fitting, size, overlap)
        fitting = []
        out += split_text(part, size, overlap, later) if later else [part]
    out += _merge(fitting, size, overlap)
    return [p for p in out if p]


def located(text: str, size: int, overlap: int) -> list[dict]:
    """The pieces with where they start, looked for from the overlap before the last one's end."""
    out, at, length = [], 0, 0
    for piece in split_text(text, size, overlap):
        at = text.find(piece, max(0, at + length - overlap))
        out.append({"start": at, "text": piece})
        length = len(piece)
    return out


def _cut(texts: pa.Array, size: int, overlap: int, longest: int | None) -> pa.Array:
    """The pieces of each text as a list."""
    starts, cuts, ends = [], [], [0]
    for t in texts:
        t = t.as_py()
        if t is not None:
            for p in [{"start": 0, "text": t}] if longest is not None and len(t) <= longest else located(t, size, overlap):
                starts.append(p["start"])
                cuts.append(p["text"])
        ends.append(len(starts))
    rows = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(cuts, pa.string())], names=["start", "text"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows, mask=texts.is_null())


def _by_few(batches: Iterator[pa.Array], cut: Callable[[pa.Array], pa.Array]) -> Iterator[pa.Array]:
    """``cut`` of a few rows at once, each result sent off before the next: a task never holds what a batch becomes."""
    for rows in batches:
        for at in range(0, len(rows), ROWS):
            yield cut(rows.slice(at, ROWS))
        del rows  # before the next is read
        trim_memory()


def pieces(text: Column, size: int = SIZE, overlap: int = OVERLAP, longest: int | None = None) -> Column:
    """Array of (start, text); texts up to ``longest`` stay whole. An Arrow UDF: the merge is sequential.

    It is declared nondeterministic so that no filter that Spark derives computes it once more.
    """

    @F.arrow_udf(PIECES)
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _by_few(batches, lambda texts: _cut(texts, size, overlap, longest))

    return cut.asNondeterministic()(text)


def pieces_of_all(texts: Column, size: int = SIZE, overlap: int = OVERLAP, longest: int | None = None) -> Column:
    """The same for arrays of texts."""

    @F.arrow_udf(T.ArrayType(PIECES))
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def each(lists: pa.Array) -> pa.Array:
            lists = lists.cast(pa.list_(pa.string()))
            first = lists.offsets[0].as_py()
            ends = pc.subtract(lists.offsets, first).cast(pa.int32())
            return pa.ListArray.from_arrays(ends, _cut(lists.flatten(), size, overlap, longest))

        return _by_few(batches, each)

    return cut.asNondeterministic()(texts)


def chunk_documents(lines: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of paged documents, with ids, header and pages.

    ``lines``: doc_id, page, line, text. ``documents``: doc_id, is_sheet, markdown, register,
    origin, file_name, name, ingredients, atc (the last three from the catalogue, or null).
    Sheets are cut by their sections, those with too few and other documents generically.
    """
    # The documents are dealt to where the lines lie, which are never moved again.
    known = documents.hint("shuffle_hash")
    typed = lines.join(known.select("doc_id", "is_sheet", "markdown"), "doc_id")
    rows = by_document(all_sections(typed)).join(known.drop("is_sheet", "markdown"), "doc_id")
    rows = rows.withColumn("sections", F.filter("sections", lambda s: F.length(s["text"]) >= LEAST_TEXT))
    # A document is one row until it is cut, so its chunks are counted without another shuffle.
    rows = rows.withColumn("cuts", pieces_of_all(F.transform("sections", lambda s: s["text"]), SIZE, OVERLAP, LONGEST))
    rows = rows.withColumn("sections", F.transform("sections", lambda s: s.dropFields("text")))
    each = rows.select("*", F.posexplode("sections").alias("at", "section")).drop("sections")
    before = F.aggregate(F.slice("cuts", F.lit(1), F.col("at")), F.lit(0), lambda n, c: n + F.size(c))
    each = each.select(*[c for c in documents.columns if c not in ("is_sheet", "markdown")], "section.*", before.alias("before"), F.get("cuts", "at").alias("cut"))
    exploded = each.withColumn("parts", F.size("cut")).select("*", F.posexplode("cut").alias("part", "piece")).drop("cut")
    position = F.col("before") + F.col("part")
    name = F.coalesce(F.nullif("own_name", F.lit("")), F.nullif("name", F.lit("")), "file_name")
    label = F.when(F.col("number").isNotNull(), F.concat_ws(" ", "number", "title")).otherwise(F.coalesce("title", F.lit("")))
    head = F.concat(F.lit("["), name, F.when(label != "", F.concat(F.lit(" · "), label)).otherwise(""), F.when(F.col("parts") > 1, F.format_string(" · parte %d/%d]", F.col("part") + 1, F.col("parts"))).otherwise("]"))
    prefix = F.when(F.col("product") > 1, F.concat(F.lit("::p"), F.col("product").cast("string"), F.lit("::"))).otherwise("::")
    start = F.col("piece.start")
    first = page_at(F.col("offsets"), start, F.col("first_page").cast("int"))
    last = page_at(F.col("offsets"), start + F.length("piece.text") - 1, F.col("first_page").cast("int"))
    placed = exploded.withColumn("position", position)
    tail = F.when(F.col("number").isNull(), F.col("position")).otherwise(F.col("part") + 1).cast("string")
    null = F.lit(None).cast("string")
    return placed.select(
        F.concat(F.col("doc_id").cast("string"), prefix, F.coalesce("number", F.lit("doc")), F.lit("::"), tail).alias("chunk_id"),
        "doc_id",
        F.when(F.col("sheet"), "ficha_tecnica").otherwise("documento").alias("kind"),
        name.alias("name"),
        "register",
        F.nullif("ingredients", F.lit("")).alias("ingredients"),
        F.nullif("atc", F.lit("")).alias("atc"),
        F.when(F.col("sheet"), F.col("origin")).otherwise(null).alias("origin"),
        "date",
        F.col("number").alias("section"),
        "title",
        first.alias("first_page"),
        F.greatest(first, last).alias("last_page"),
        "position",
        (F.col("part") + 1).alias("part"),
        "parts",
        F.when(F.col("sheet"), section_url(F.col("register"), F.col("number"))).alias("url"),
        F.concat(head, F.lit("\n"), F.trim(F.col("piece.text"))).alias("text"),
    )


#: Bins of the histogram of lengths.
BINS = 4096
#: Sizes of the fixed strategies; their overlap is the share. Fixed values.
FIXED, FIXED_OVERLAP = {"fijo_500": 500, "fijo_1000": 1000}, 0.15


def fixed_chunks(texts: DataFrame, strategy: str, size: int) -> DataFrame:
    """Chunks (strategy, doc_id, chunk, start, end) of whole texts (doc_id, text) by the recursive splitter."""
    return all_fixed_chunks(texts, {strategy: size})


def all_fixed_chunks(texts: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """The same for several strategies (name, size), where the texts lie."""
    cuts = F.array(*[F.struct(F.lit(name).alias("strategy"), F.transform(pieces(F.col("text"), size, round(size * FIXED_OVERLAP)), lambda p: F.struct(p["start"].alias("start"), (p["start"] + F.length(p["text"])).alias("end"))).alias("pieces")) for name, size in sizes.items()])
    return exploded_strategies(texts.select("doc_id", F.explode(cuts).alias("s")))


def exploded_strategies(cut: DataFrame) -> DataFrame:
    """A row for each piece of doc_id, s (strategy, pieces)."""
    return cut.select("s.strategy", "doc_id", F.posexplode("s.pieces").alias("chunk", "piece")).select("strategy", "doc_id", "chunk", "piece.start", "piece.end")


def overlapping(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """``chunks`` (doc_id, start, end and others) with the numbers of the sections that they overlap.

    A document has each place of the template once at most, so its spans are one short array.
    """
    s = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "number")).alias("spans"))
    met = F.filter("spans", lambda x: (x["start"] < F.col("end")) & (x["end"] > F.col("start")))
    numbers = F.array_distinct(F.transform(met, lambda x: x["number"]))
    return chunks.join(s.hint("shuffle_hash"), "doc_id", "left").select(*chunks.columns, F.coalesce(numbers, F.array().cast("array<string>")).alias("numbers"))


def strategy_metrics(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """Per strategy: chunks, mean size (floor), share of chunks in several sections, share of key sections in one chunk.

    Both sides are dealt by document, and each is computed once.
    """
    touched = overlapping(chunks, spans)
    keys = [(f"key_{i}", F.array_contains("numbers", k)) for i, k in enumerate(KEY_SECTIONS)]
    each = touched.groupBy("doc_id", "strategy", "chunk").agg(F.count("*").alias("rows"), F.sum(F.col("end") - F.col("start")).alias("size"), F.max(F.size("numbers") > 1).cast("int").alias("mixed"), *[F.max(has).cast("int").alias(k) for k, has in keys])
    per = each.groupBy("doc_id", "strategy").agg(*[F.sum(c).alias(c) for c in ("rows", "size", "mixed", *(k for k, _ in keys))])
    broken = sum((F.col(k) > 1).cast("int") for k, _ in keys)
    rows = per.groupBy("strategy").agg(F.sum("rows").alias("chunks"), F.sum("size").alias("size"), F.sum("mixed").alias("mixed"), F.count("doc_id").alias("docs"), F.sum(broken).alias("broken"))
    # A key section counts for every document, also one that no chunk touches.
    total = F.col("docs") * len(KEY_SECTIONS)
    return rows.select("strategy", "chunks", F.expr("size div chunks").alias("mean_size"), F.round(100 * F.col("mixed") / F.col("chunks"), 4).alias("mixed_percent"), F.round(100 * (total - F.col("broken")) / total, 4).alias("whole_key_percent"))


def section_metrics(chunks: DataFrame) -> DataFrame:
    """The same row for chunks cut by section (doc_id, section, parts, text): none is mixed, and a key section is whole if it has one part."""
    per = chunks.groupBy("doc_id", "section").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("size"), F.max("parts").alias("parts"))
    key = F.col("section").isin(*KEY_SECTIONS)
    one = per.agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.sum("size").alias("size"), F.count(F.when(key, 1)).alias("keys"), F.count(F.when(key & (F.col("parts") == 1), 1)).alias("kept"))
    share = F.coalesce(F.round(100 * F.col("kept") / F.nullif("keys", F.lit(0)), 4), F.lit(0.0))
    return one.select(F.lit("por_seccion").alias("strategy"), "chunks", F.coalesce(F.expr("size div nullif(chunks, 0)"), F.lit(0).cast("long")).alias("mean_size"), F.lit(0.0).alias("mixed_percent"), share.alias("whole_key_percent"))


def run_summary(chunks: DataFrame) -> DataFrame:
    """Documents, chunks and their sizes (text): mean by floor, the upper middle as median, least, most."""
    sized = chunks.select("doc_id", F.length("text").alias("n"))
    lengths = sized.groupBy("n").agg(F.count("*").alias("many"))
    total = sized.agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.expr("sum(n) div count(*)").alias("mean_size"), F.min("n").alias("least"), F.max("n").alias("most"))
    # The middle is found among the bins of a histogram first, then among the lengths of its bin.
    half = F.broadcast(total.select(F.expr("chunks div 2").alias("half"), F.greatest(F.floor(F.col("most") / BINS), F.lit(1)).alias("width")))
    binned = lengths.join(half).withColumn("bin", F.floor(F.col("n") / F.col("width")))
    upto = lambda key: F.sum("many").over(Window.orderBy(key))
    bins = binned.groupBy("bin", "half").agg(F.sum("many").alias("many")).withColumn("upto", upto("bin")).filter("upto > half").orderBy("bin").limit(1)
    inside = binned.join(F.broadcast(bins.select("bin", (F.col("upto") - F.col("many")).alias("before"))), "bin").select("n", "many", "half", "before")
    middle = inside.withColumn("upto", F.col("before") + upto("n")).filter("upto > half").agg(F.min("n").alias("median"))
    return total.join(F.broadcast(middle)).select("documents", "chunks", "mean_size", "median", "least", "most")
