"""Reading and writing documents, catalogues, lists and chunk files."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant.functions.text import fold

CATALOGUE = ("principio_activo_buscado", "nregistro", "nombre", "principios_activos", "atc", "url_ficha_tecnica", "ficha_segmentada")
FORMATS = {".txt": "txt", ".md": "md", ".markdown": "md", ".pdf": "pdf"}
#: Mean characters per page below which a document counts as a scan without text.
LEAST_PAGE_TEXT = 100
CHUNK_SCHEMA = T.StructType(
    [T.StructField("texto", T.StringType())]
    + [T.StructField("metadata", T.StructType([T.StructField(n, T.StringType()) for n in ("chunk_id", "doc_id", "tipo_documento", "nombre", "nregistro", "principios_activos", "atc", "origen", "fecha_revision", "seccion", "titulo_seccion")] + [T.StructField(n, T.IntegerType()) for n in ("pagina_inicio", "pagina_fin", "orden", "parte", "total_partes")] + [T.StructField("url_fuente", T.StringType())]))]
)


def document_id(path: Column, content: Column) -> Column:
    """FT_<digits> for files of that name, else a readable form of the name with the content's first eight SHA-1 digits."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    bare = F.regexp_replace(fold(stem), r"[^\x00-\x7F]", "")
    slug = F.left(F.trim(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(40))
    return F.when(stem.rlike(r"^FT_\d+$"), stem).otherwise(F.concat(F.when(slug == "", "documento").otherwise(slug), F.lit("-"), F.left(F.sha1(content), F.lit(8))))


#: Windows-1252 beyond Latin-1, from the codec; Spark decodes Latin-1 only.
_WINDOWS = {chr(b): c for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "ignore"))}


def decoded(content: Column) -> Column:
    """UTF-8, without a byte order mark, or else Windows-1252."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.translate(F.decode(content, "iso-8859-1"), "".join(_WINDOWS), "".join(_WINDOWS.values())))
    return F.regexp_replace(text, "^\ufeff", "")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text and Markdown files as one-page documents: path, doc_id, format, register, page, text, error.

    Unsupported, empty and blank files are rows with an error instead of a text.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # Spark's scan leaves out files of no bytes; their names are in the listing, which the driver holds anyway.
    listed = spark.createDataFrame([(re.sub("^file:///", "file:/", unquote(name)),) for name in files.inputFiles()], "path string")
    empty = listed.join(files.select("path"), "path", "left_anti").select("path", F.lit(b"").alias("content"), F.lit(0).cast("long").alias("length"))
    files = files.select("path", "content", "length").unionByName(empty)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    kind = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])[suffix]
    text = F.when(kind.isin("txt", "md"), decoded(F.col("content")))
    error = F.when(kind.isNull(), F.lit("unsupported format")).when(F.col("length") == 0, F.lit("empty")).when(kind == "pdf", F.lit("pages must be extracted before")).when(text.rlike(r"(?U)^\s*$"), F.lit("blank"))
    doc_id = document_id(F.col("path"), F.col("content"))
    return files.select("path", doc_id.alias("doc_id"), kind.alias("format"), F.nullif(F.regexp_extract(doc_id, r"^FT_(\d+)$", 1), F.lit("")).alias("register"), F.lit(1).alias("page"), F.when(error.isNull(), text).alias("text"), error.alias("error"))


def unreadable_pages(pages: DataFrame) -> DataFrame:
    """Documents (doc_id) of extracted pages that hold next to no text."""
    return pages.groupBy("doc_id").agg(F.avg(F.length(F.trim("text"))).alias("mean")).filter(F.col("mean") < LEAST_PAGE_TEXT).select("doc_id")


def ingest_report(read: DataFrame) -> DataFrame:
    return read.agg(F.count("*").alias("files"), F.count("error").alias("failures"), F.count_distinct(F.when(F.col("error").isNull(), F.col("doc_id"))).alias("documents"))


def read_catalogue(spark: SparkSession, path: str, digits_only: bool = True) -> DataFrame:
    """The catalogue as text columns, trimmed; rows without a register, or with ``digits_only`` without a numeric one, are dropped."""
    header = spark.read.option("header", "true").csv(path).columns
    missing = sorted({"nregistro", "nombre", "principio_activo_buscado", "principios_activos"} - set(header))
    if missing:
        raise ValueError(f"the catalogue lacks the columns {', '.join(missing)}")
    rows = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in header])).option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    rows = rows.select(*[F.trim(c).alias(c) for c in header])
    return rows.filter(F.col("nregistro").rlike("^[0-9]+$") if digits_only else F.length("nregistro") > 0)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Items of a text file, one a line, in order; blank lines and # comments aside, the first of each item whatever its case."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r\n|\r|\n")).alias("place", "item"))
    rows = rows.withColumn("item", F.trim("item")).filter("item <> '' and not startswith(item, '#')")
    first = F.row_number().over(Window.partitionBy(F.lower("item")).orderBy("place"))
    return rows.withColumn("first", first).filter("first = 1").select("place", "item")


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, wrong: Column | None = None, what: str = "row") -> DataFrame:
    """Rows of JSON lines, blank ones aside. The first row, by file and line, that isn't JSON or is ``wrong`` raises with its place."""
    corrupt = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    parsed = F.from_json("value", corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.filter(F.trim("value") != "").withColumn("row", parsed)
    bad = F.col("row._corrupt").isNotNull()
    flat = rows.select("file", "block", "at", "value", bad.alias("bad"), "row.*")
    found = flat.filter(F.col("bad") | wrong if wrong is not None else F.col("bad")).orderBy("file", "block", "at").select("file", "block", "at", "value").limit(1).collect()
    if found:
        b = found[0]
        before = lines.filter((F.col("file") == b.file) & ((F.col("block") < b.block) | ((F.col("block") == b.block) & (F.col("at") < b["at"])))).count()
        raise ValueError(f"{b.file}:{before + 1}: not a valid {what}: {b.value[:200]}")
    return flat.select(*schema.names)


def read_chunks(spark: SparkSession, path: str, validate: bool = True) -> DataFrame:
    """Chunks of JSON lines; with ``validate`` the first bad row raises with its file, line and content."""
    if not validate:
        return spark.read.schema(CHUNK_SCHEMA).json(path)
    m = F.col("metadata")
    least = {"pagina_inicio": 1, "pagina_fin": 1, "orden": 0, "parte": 1, "total_partes": 1}
    wrong = ~F.coalesce(F.length("texto") >= 1, F.lit(False)) | m["chunk_id"].isNull()
    for name, low in least.items():
        wrong |= F.coalesce(m[name] < low, F.lit(False))
    return read_json_lines(spark, path, CHUNK_SCHEMA, wrong, "chunk")


#: Fields of a golden question. Fixed values.
GOLDEN_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "question", "categoria", "expected_nregistro", "expected_seccion")] + [T.StructField(n, T.BooleanType()) for n in ("answerable", "expected_pii", "revision_manual", "verificado")] + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("no_debe_contener", "expected_chunk_ids")])


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions of JSON lines, with all their fields; the first line that isn't JSON raises with its file and line.

    Answers may not hold any of ``forbidden``; ``manual`` are to be looked over by hand.
    """
    none, no = F.array().cast("array<string>"), F.lit(False)
    rows = read_json_lines(spark, path, GOLDEN_SCHEMA, what="question")
    return rows.select(F.col("id").alias("question_id"), F.col("question").alias("text"), F.coalesce("categoria", F.lit("")).alias("category"), "answerable", F.col("expected_nregistro").alias("expected_register"), F.col("expected_seccion").alias("expected_section"), F.coalesce("expected_pii", no).alias("expected_pii"), F.coalesce("no_debe_contener", none).alias("forbidden"), F.coalesce("expected_chunk_ids", none).alias("expected_chunk_ids"), F.coalesce("revision_manual", no).alias("manual"), F.coalesce("verificado", no).alias("verified"))


def read_folder(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``read_texts`` of the supported files of a folder, in name order the first ``limit`` of them."""
    rows = read_texts(spark, path).filter("format is not null")
    if limit is None:
        return rows
    return rows.join(F.broadcast(rows.select("path").orderBy("path").limit(limit)), "path")

def registry_records(responses: DataFrame) -> DataFrame:
    """Records of registry responses: nregistro, nombre, pactivos, atcs (array of codigo, nivel), docs (array of tipo, url, secc).

    The sheet is the first document of type 1, the ATC code the first of the highest level.
    """
    sheet = F.get(F.filter("docs", lambda d: d["tipo"] == 1), F.lit(0))
    top = F.array_max(F.transform("atcs", lambda a: a["nivel"]))
    atc = F.get(F.filter("atcs", lambda a: a["nivel"] == top), F.lit(0))["codigo"]
    return responses.select("nregistro", "nombre", F.col("pactivos").alias("principios_activos"), atc.alias("atc"), sheet["url"].alias("url_ficha_tecnica"), F.coalesce(sheet["secc"], F.lit(False)).alias("ficha_segmentada"), (F.length(sheet["url"]) > 0).alias("has_sheet"))
