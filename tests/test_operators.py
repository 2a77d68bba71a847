"""Literal cases of the operators that SQL can't express, and of reading and writing."""

import pytest
from pyspark.sql import functions as F

from sextant.functions import scratch
from sextant.functions import text as tx
from sextant.operators import answers, chunking, cleaning, index, ingest, masking, search, sections
from sextant.sources import documents as src
from sextant.sources import reports


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("4.2.\n\nPosología y forma", "4.2. Posología y forma"),
        ("•\nPrimero\n-\nSegundo", "• Primero\n- Segundo"),
        ("según la sección\n4.2.\nOtra cosa", "según la sección 4.2.\nOtra cosa"),
        ("4.2.\n4.5. Interacción", "4.2.\n4.5. Interacción"),
        ("1\nNOMBRE DEL MEDICAMENTO", "1 NOMBRE DEL MEDICAMENTO"),
        ("6 . DATOS   FARMACÉUTICOS", "6. DATOS FARMACÉUTICOS"),
        ("exten-\nsamente", "extensamente"),
        ("dosis 10-\n20 mg", "dosis 10-\n20 mg"),
        ("una línea abierta\nque sigue", "una línea abierta que sigue"),
        ("termina.\nque sigue", "termina.\nque sigue"),
        ("(≥1/10)\n, frecuentes", "(≥1/10), frecuentes"),
        ("corta\n48 horas", "corta\n48 horas"),
        ("x" * 70 + "\n48 horas", "x" * 70 + " 48 horas"),
        ("9. FECHA DE LA\nAUTORIZACIÓN", "9. FECHA DE LA AUTORIZACIÓN"),
        ("7. TITULAR\nLABORATORIOS", "7. TITULAR\nLABORATORIOS"),
        ("[Tabla] a | b\nseguido", "[Tabla] a | b\nseguido"),
        ("a\n\n\n\nB —", "a\n\nB"),
    ],
)
def test_clean_page(spark, text, want):
    assert cleaning.clean_pages(spark.createDataFrame([(1, text, "x")], "doc_id long, text string, at string")).first() == (1, want, "x")


def test_table_text(spark):
    by_frequency = [["Sistema", "Frecuentes", "Raras"], ["Nervioso", "Cefalea", "Insom-\nnio"], ["Otro", None, "Tos"]]
    tables = [
        (1, 0, by_frequency),
        (1, 1, [["Piel", "Prurito", ""]]),
        (1, 2, [[None, " "]]),
        (1, 3, [["Ojo", "", "Conjuntivitis"]]),
        (1, 4, [["Sistema", "x", "y"], ["Oído", "Tinnitus", "z"]]),
        (2, 0, [["a" * 90, "b"], ["c", ""]]),
        (2, 1, [["c", "d"]]),
        (3, 0, [["Nombre", "Valor"], ["x", "1"]]),
        (3, 1, [["y", "2"], ["z", "3"]]),
        (3, 2, [["uno", "dos", "tres"]]),
        (3, 3, [["w", "4"]]),
        (4, 0, []),
    ]
    rows = spark.createDataFrame(tables, "doc_id long, number long, rows array<array<string>>")
    got = {(r.doc_id, r.number): r.text for r in cleaning.table_texts(rows).collect()}
    assert got == {
        (1, 0): "[Tabla] Sistema | Frecuentes | Raras\nNervioso — Frecuentes: Cefalea; Raras: Insom-nio\nOtro — Raras: Tos",
        (1, 1): "Piel — Frecuentes: Prurito",
        (1, 2): "",
        (1, 3): "Ojo — Raras: Conjuntivitis",
        (1, 4): "[Tabla] Sistema | x | y\nOído — x: Tinnitus; y: z",
        (2, 0): "a" * 90 + " | b\nc",
        (2, 1): "c | d",
        (3, 0): "[Tabla] Nombre | Valor\nx — Valor: 1",
        (3, 1): "y — Valor: 2\nz — Valor: 3",
        (3, 2): "uno | dos | tres",
        (3, 3): "w | 4",
        (4, 0): "",
    }


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("correo ana.lopez@hospital.es", ["email"]),
        ("DNI 12345678Z", ["dni"]),
        ("DNI 12345678-A", ["dni_posible"]),
        ("NIE X1234567L", ["nie"]),
        ("tel 612 345 678", ["telefono"]),
        ("NHC: 123456", ["historia_clinica"]),
        ("tarjeta sanitaria ABCD123456", ["tarjeta_sanitaria"]),
        ("nació el 01/02/1950", ["fecha_nacimiento"]),
        ("la paciente María García", ["nombre"]),
        ("Juan Pérez pregunta", ["nombre"]),
        ("dosis de 500 mg cada 8 horas", []),
        ("registro 12345678", []),
    ],
)
def test_masking(spark, text, kinds):
    got = _masked(spark, text)
    assert got.kinds == kinds and got.has_pii == bool(kinds) and (masking.MASK in got.masked) == bool(kinds)


def _masked(spark, text):
    return spark.createDataFrame([(text,)], "text string").select(masking.mask_pii(F.col("text")).alias("r")).select("r.*").first()


def test_masking_keeps_the_rest_and_orders_by_position(spark):
    got = _masked(spark, "Llame al 612345678 o a.b@c.es, DNI 12345678Z.")
    assert got.masked == "Llame al [DATO] o [DATO], DNI [DATO]." and got.kinds == ["telefono", "email", "dni"]
    assert _masked(spark, None).masked == ""
    assert _masked(spark, "a@b.es+c@d.es 612345678612345678").masked == "[DATO][DATO] 612345678612345678"
    assert _masked(spark, "Sra. Ana de la Rosa Gil, NHC: AB-1234x; nacida el 1/2/1950").masked == "Sra. [DATO], NHC: [DATO]; nacida el [DATO]"


def test_splitter():
    text = "Uno dos tres. " * 60
    parts = chunking.located(text, 200, 30)
    assert all(len(p["text"]) <= 200 for p in parts) and all(text[p["start"] :].startswith(p["text"]) for p in parts)
    assert chunking.split_text("a" * 250, 100, 10) == ["a" * 100, "a" * 100, "a" * 70]
    assert chunking.split_text("corto") == ["corto"]


def test_expressions(spark):
    row = spark.sql("select 'Árbol ﬁno Straße İ' as a, 12345678L as n").select(
        tx.match_form(F.col("a")).alias("m"), tx.control_letter(F.col("n")).alias("c"), tx.identity_is_valid(F.lit("X1234567-L")).alias("v"), answers.real_citations(F.lit("a [1] [3]."), F.lit(2)).alias("r"), answers.plain_citations(F.lit("x 【2†L1】")).alias("p")
    ).first()
    assert tuple(row) == ("arbol fino strasse i", "Z", True, "a [1] .", "x [2]")


def test_answers(spark):
    rows = spark.createDataFrame([(1, False, [(1,)], "yes [1] [2]", "m"), (2, True, [], None, "m"), (3, False, [(1,)], None, "m")], "question_id int, pii_notice boolean, sources array<struct<index:int>>, model_text string, model string")
    out = {r.question_id: r for r in answers.answer(rows).collect()}
    assert out[1].answer == "yes [1] " and out[1].found and out[2].answer == answers.NOT_FOUND and out[3].answer == answers.FAILED
    assert not out[2].found and out[3].sources == [] and out[3].model is None


def test_sources_on_disk(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "FT_007.txt").write_bytes("﻿Hola\nmundo".encode())
    (d / "Guía Rápida.md").write_bytes("á".encode("cp1252"))
    (d / "blank.txt").write_text("  \n")
    (d / "x.docx").write_text("x")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in src.read_texts(spark, str(d)).collect()}
    assert rows["FT_007.txt"].doc_id == "FT_007" and rows["FT_007.txt"].register == "007" and rows["FT_007.txt"].text == "Hola\nmundo"
    guide = next(r for n, r in rows.items() if n.endswith(".md"))
    assert guide.text == "á" and guide.doc_id.startswith("gu")
    assert rows["blank.txt"].error and rows["x.docx"].error
    (tmp_path / "list.txt").write_text("Ibuprofeno\n# no\n\nibuprofeno\nCodeína\n")
    assert [r.item for r in src.read_list(spark, str(tmp_path / "list.txt")).orderBy("place").collect()] == ["Ibuprofeno", "Codeína"]
    (tmp_path / "cat.csv").write_text("principio_activo_buscado,nregistro,nombre,principios_activos\nA, 0016 ,N,\"P, Q\"\nB,,N,P\nC,x1,N,P\n")
    assert [r.nregistro for r in src.read_catalogue(spark, str(tmp_path / "cat.csv")).collect()] == ["0016"]
    assert src.read_catalogue(spark, str(tmp_path / "cat.csv"), digits_only=False).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"texto": "a", "metadata": {"chunk_id": "1"}}\n{"texto": "", "metadata": {"chunk_id": "2"}}\n')
    assert src.read_chunks(spark, str(tmp_path / "bad.jsonl"), validate=False).count() == 2
    with pytest.raises(ValueError, match="not a valid chunk"):
        src.read_chunks(spark, str(tmp_path / "bad.jsonl"))


def test_index_on_disk(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "chunk_id string, doc_id string, name string, kind string, position int, text string")
    path = str(tmp_path / "index")
    index.write_index(make([(f"d{i}:{j}", f"d{i}", f"n{i}", "k", j, "old") for i in range(9) for j in range(3)]), path)
    index.replace_documents(spark, path, make([("d1:0", "d1", "new", "k", 0, "twice"), ("d1:0", "d1", "new", "k", 1, "new"), ("x:0", "x", "x", "k", 0, "new")]))
    rows = {r.chunk_id: r.text for r in index.open_index(spark, path).collect()}
    assert len(rows) == index.open_index(spark, path).count() == 8 * 3 + 2 and rows["d1:0"] == "new" and "d1:1" not in rows and rows["d2:2"] == "old"
    broken = make([("d2:0", "d2", "new", "k", 0, "new"), ("d3:0", "d3", "new", "k", 0, "bad")]).withColumn("text", F.when(F.col("text") == "bad", F.raise_error(F.lit("halfway")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="halfway"):
        index.replace_documents(spark, path, broken)
    assert {r.chunk_id: r.text for r in index.open_index(spark, path).collect()} == rows
    before = index.open_index(spark, path)
    index.replace_documents(spark, path, make([("d2:7", "d2", "new", "k", 0, "newer")]))
    assert before.count() == len(rows) and {r.text for r in index.open_index(spark, path).filter("doc_id = 'd2'").collect()} == {"newer"}
    with pytest.raises(FileNotFoundError):
        index.open_index(spark, str(tmp_path / "none"))


def test_validated_lines_name_file_and_line(spark, tmp_path):
    good = '{"id": "Q1", "question": "¿Qué?", "answerable": true, "expected_nregistro": "1"}\n'
    (tmp_path / "golden.jsonl").write_text(good + "\n" + good + "{broken\n" + "{worse\n")
    with pytest.raises(ValueError, match=r"golden\.jsonl:4: not a valid question: \{broken"):
        src.read_golden(spark, str(tmp_path / "golden.jsonl"))
    (tmp_path / "golden.jsonl").write_text(good)
    assert tuple(src.read_golden(spark, str(tmp_path / "golden.jsonl")).first()) == ("Q1", "¿Qué?", "", True, "1", None, False, [], [], False, False)
    (tmp_path / "chunks.jsonl").write_text('{"texto": "a", "metadata": {"chunk_id": "1"}}\n\n{"texto": "b", "metadata": {"chunk_id": "2", "parte": 0}}\n')
    with pytest.raises(ValueError, match=r"chunks\.jsonl:3: not a valid chunk"):
        src.read_chunks(spark, str(tmp_path / "chunks.jsonl"))
    src.write_chunks(src.read_chunks(spark, str(tmp_path / "chunks.jsonl"), validate=False).filter("texto = 'a'"), str(tmp_path / "out"))
    assert src.read_chunks(spark, str(tmp_path / "out")).select("texto", "metadata.chunk_id").collect() == [("a", "1")]


SHEET = """FICHA TÉCNICA
1. NOMBRE DEL MEDICAMENTO
Prueba 10 mg
2. COMPOSICIÓN CUALITATIVA Y CUANTITATIVA
Contiene algo.
3. FORMA FARMACÉUTICA
Comprimido
4. DATOS CLÍNICOS
4.1 Indicaciones terapéuticas
Dolor.
4.2 Posología y forma de administración
Una al día.
4.3 Contraindicaciones
Alergia.
5. PROPIEDADES FARMACOLÓGICAS
Ninguna.
6. DATOS FARMACÉUTICOS
Nada.
7. TITULAR DE LA AUTORIZACIÓN
Laboratorio
"""


def test_folder_to_chunks_and_summary(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "FT_1.txt").write_text(SHEET)
    (d / "FT_2.txt").write_text("FICHA TÉCNICA\nNOMBRE DEL MEDICAMENTO\nsin nada más")
    (d / "nota.md").write_text("# Uno\nTexto.\n\n# Dos\nOtro.")
    (d / "vacio.txt").write_text("")
    (d / "zzz.txt").write_text("último")
    (tmp_path / "cat.csv").write_text("principio_activo_buscado,nregistro,nombre,principios_activos,atc\nA,1,Prueba,Algo,X1\n")
    read = src.read_folder(spark, str(d), 4)
    assert read.count() == 4 and read.filter("path like '%zzz%'").isEmpty()
    documents = ingest.described(read, src.read_catalogue(spark, str(tmp_path / "cat.csv")))
    chunks = ingest.ingest(read, documents)
    rows = {r.chunk_id: r for r in chunks.collect()}
    assert rows["FT_1::4.1::1"].text == "[Prueba 10 mg · 4.1 Indicaciones terapéuticas]\nDolor." and rows["FT_1::4.1::1"].atc == "X1"
    assert [r.title for r in rows.values() if r.doc_id.startswith("nota")] == ["Uno", "Dos"]
    assert tuple(ingest.ingest_summary(read, documents, chunks).first())[:5] == (3, 1, 1, 0, len(rows))
    assert {r.section: r.chunks for r in ingest.chunks_per_section(chunks).collect()}[ingest.NO_SECTION] == 3


def test_strategies_against_plain_loops(spark):
    text = "\n".join([SHEET] + ["Frase larga de relleno. " * 30] * 4)
    lines = spark.createDataFrame([("a", 1, i, t) for i, t in enumerate(text.split("\n"))], "doc_id string, page int, line int, text string")
    spans = sections.section_spans(lines)
    got = chunking.strategy_metrics(chunking.fixed_chunks(spark.createDataFrame([("a", text)], "doc_id string, text string"), "fijo_500", 500), spans).first()
    found = chunking.located(text, 500, 75)
    touched = [{s.number for s in spans.collect() if s.start < p["start"] + len(p["text"]) and s.end > p["start"]} for p in found]
    keys = [sum(k in t for t in touched) for k in ("4.1", "4.2", "4.3", "4.4", "4.5", "4.8")]
    want = (len(found), sum(len(p["text"]) for p in found) // len(found), round(100 * sum(len(t) > 1 for t in touched) / len(found), 4), round(100 * sum(n <= 1 for n in keys) / 6, 4))
    assert (got.chunks, got.mean_size, got.mixed_percent, got.whole_key_percent) == want
    cut = spark.createDataFrame([("a", "4.1", 1, "xx"), ("a", "4.2", 2, "xxxx"), ("a", "4.2", 2, "xx"), ("a", "5", 3, "x")], "doc_id string, section string, parts int, text string")
    assert tuple(chunking.section_metrics(cut).first()) == ("por_seccion", 4, 2, 0.0, 50.0)


def test_search_skips_filters_or_goes_global(spark):
    catalogue = spark.createDataFrame([(1, "100", "Aspirina 500 mg", "acido acetilsalicilico", "acido acetilsalicilico"), (2, "200", "Nolotil", "metamizol", "metamizol")], "row int, register string, name string, searched string, ingredients string")
    chunks = spark.createDataFrame([("a", [1.0, 0.0], "100"), ("b", [0.6, 0.8], "200"), ("c", [0.0, 1.0], "300"), ("d", None, "100"), ("e", [1.0], "100")], "chunk_id string, vector array<double>, register string")
    asked = [("one", "¿Y la aspirina?", [0.0, 1.0]), ("two", "aspirina o nolotil", [0.0, 1.0]), ("none", "¿qué hora es?", [0.0, 1.0]), ("blank", "  ", [0.0, 1.0]), ("pii", "DNI 12345678Z nolotil", [1.0, 0.0])]
    questions = spark.createDataFrame(asked, "question_id string, text string, vector array<double>")
    masked, found = search.run_evaluation(questions, catalogue, chunks, 2)
    got = {}
    for r in found.orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append((r.chunk_id, round(r.score, 6)))
    assert got == {"one": [("a", 0.0)], "two": [("c", 1.0), ("b", 0.8)], "pii": [("b", 0.6)]}
    assert {r.question_id for r in masked.filter("masked").collect()} == {"pii"} and masked.count() == 5
    with pytest.raises(ValueError):
        search.search(questions, catalogue, chunks, 0)


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("2", 3, 3, 3, "", ""), ("1", 3, 2, 2, "4.1", ""), ("3", 3, 4, 1, "4.1 4.2", "5")], "register string, n_official int, n_detected int, hits int, missing string, extra string")
    reports.write_section_report(rows, str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()
    assert text == ["nregistro,oficiales,detectadas,aciertos,faltan,sobran", "3,3,4,1,4.1 4.2,5", "1,3,2,2,4.1,", "2,3,3,3,,"]
    reports.write_summary({"all": rows.agg(F.count("*").alias("n")), "by": rows.groupBy("hits").agg(F.count("*").alias("n"))}, str(tmp_path / "json"))
    made = spark.read.json(str(tmp_path / "json")).first()
    assert made["all"][0].n == 3 and {r.hits for r in made["by"]} == {1, 2, 3}


def test_reading_order_and_scans(spark):
    blocks = spark.createDataFrame([(1, 1, 0.0, 10.4, 5.0, 12.0, "b"), (1, 1, 9.0, 10.1, 12.0, 12.0, "c"), (1, 1, 0.0, 2.0, 5.0, 4.0, "a"), (1, 1, 20.0, 20.0, 30.0, 30.0, "in the table")], "doc_id int, page int, x0 double, y0 double, x1 double, y1 double, text string")
    boxes = spark.createDataFrame([(1, 1, 15.0, 15.0, 40.0, 40.0, "[Tabla] t")], blocks.schema)
    assert cleaning.reading_order(blocks, boxes).first().text == "a\nb\nc\n[Tabla] t"
    pages = spark.createDataFrame([(1, "x" * 99), (1, "x" * 101), (2, " " * 300), (2, "x" * 150), (3, None)], "doc_id int, text string")
    assert sorted(r.doc_id for r in src.unreadable_pages(pages).collect()) == [2]


def test_passing_tables_go(spark, tmp_path):
    with scratch.passing() as kept:
        gone = scratch.durable(spark.range(3))
        kept.append(scratch.durable(gone.filter("id > 0")))
    assert kept[0].count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND|not exist"):
        spark.read.parquet(gone._sextant_path)
    scratch.discard(kept[0])
