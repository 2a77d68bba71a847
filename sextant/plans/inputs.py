"""Inputs that the driver's tables don't hold, derived from them by SQL that Spark and DuckDB both run.

Each is a SELECT over the driver's tables. ``sql`` gives the text, ``frame`` the DataFrame.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from sextant.functions.scratch import spread

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Lines of a sheet for each part: page, line, expression.
SHEET = (
    (1, 0, "'FICHA TÉCNICA'"),
    (1, 1, "'1. NOMBRE DEL MEDICAMENTO'"),
    (1, 2, "p_name"),
    (1, 3, "'2. COMPOSICIÓN CUALITATIVA Y CUANTITATIVA'"),
    (1, 4, "concat('Contiene ', p_type)"),
    (1, 5, "CASE WHEN p_size % 3 = 0 THEN '4.3. Contraindicaciones' ELSE '3. FORMA FARMACÉUTICA' END"),
    (1, 6, "p_brand"),
    (1, 7, "'4. DATOS CLÍNICOS'"),
    (1, 8, "'4.1 Indicaciones terapéuticas.'"),
    (1, 9, "concat('Vea la sección ', p_size)"),
    (2, 0, "'4.2. Posología y forma de administración'"),
    (2, 1, "concat('Dosis de ', p_size, ' mg al día')"),
    (2, 2, "'4.3. Contraindicaciones'"),
    (2, 3, "'Hipersensibilidad'"),
    (2, 4, "'4.1. Indicaciones terapéuticas'"),
    (2, 5, "'4.8. Reacciones adversas'"),
    (2, 6, "p_name"),
    (2, 7, "'5. PROPIEDADES FARMACOLÓGICAS'"),
    (2, 8, "'6.2 Otra cosa'"),
    (3, 0, "'7. TITULAR DE LA AUTORIZACIÓN'"),
    (3, 1, "p_brand"),
    (3, 2, "'10. FECHA DE LA REVISIÓN DEL TEXTO'"),
    (3, 3, "CASE WHEN p_size % 2 = 0 THEN 'Julio 2024' ELSE concat('0', p_size % 9 + 1, '/2023') END"),
    (3, 4, "CASE WHEN p_size % 4 = 0 THEN '1. NOMBRE DEL MEDICAMENTO' ELSE '# Anexo' END"),
    (3, 5, "p_brand"),
    (3, 6, "'2. COMPOSICIÓN'"),
    (3, 7, "p_type"),
)

INPUTS = {
    "sheet_lines": " UNION ALL ".join(f"SELECT p_partkey AS doc_id, {p} AS page, {n} AS line, {e} AS text FROM part" for p, n, e in SHEET),
    "turn_pages": "SELECT conv_id AS doc_id, turn + 1 AS page, concat('Corpus sheet', chr(10), turn + 1, chr(10), text, CASE WHEN turn = 2 AND conv_id % 2 = 0 THEN concat(chr(10), 'Anexo II', chr(10), 'rest') ELSE '' END, chr(10), CASE WHEN conv_id % 3 = 0 THEN 'FOOT LINE' ELSE 'NOMBRE DEL MEDICAMENTO' END, chr(10), 'Página ', turn + 1, ' de 9') AS text FROM conversations",
    "turn_chunks": "SELECT concat(conv_id, ':', turn) AS chunk_id, conv_id AS doc_id, concat(CASE WHEN conv_id % 2 = 0 THEN 'Talk ' ELSE 'chat ' END, conv_id) AS name, role AS kind, turn AS position, text FROM conversations",
    "new_chunks": "SELECT concat(conv_id + CASE WHEN turn = 0 THEN 1000000 ELSE 0 END, ':', turn) AS chunk_id, conv_id + CASE WHEN turn = 0 THEN 1000000 ELSE 0 END AS doc_id, 'new' AS name, role AS kind, turn AS position, concat('NEW ', text) AS text FROM conversations WHERE role = 'user'",
    "golden": "SELECT vec_id AS question_id, vec_id % 300 <> 0 AS answerable, CASE WHEN vec_id % 300 <> 0 THEN 'con_respuesta' ELSE 'medicamento_ausente' END AS category, CAST((label + vec_id % 7) % 10 AS STRING) AS expected_register, CAST((label + vec_id % 7) % 3 AS STRING) AS expected_section FROM embeddings WHERE vec_id % 100 = 0",
    "link_questions": "SELECT conv_id AS question_id, CAST(conv_id AS STRING) AS expected_register, CASE WHEN conv_id % 2 = 0 THEN 'assistant' ELSE 'system' END AS expected_section, conv_id % 3 <> 0 AS answerable FROM conversations GROUP BY conv_id",
    "link_chunks": "SELECT concat(conv_id, ':', turn) AS chunk_id, CAST(conv_id AS STRING) AS register, role AS section, turn AS position FROM conversations",
    "catalogue": "SELECT min(p_partkey) AS row, CAST(min(p_partkey) AS STRING) AS register, concat(upper(p_name), ' ', min(p_size), ' mg tablets') AS name, p_name AS searched, CASE WHEN split_part(p_name, ' ', 2) < 'm' THEN concat('salt of ', p_name) ELSE split_part(p_name, ' ', 2) END AS ingredients FROM part GROUP BY p_name",
    "questions": "SELECT p_partkey AS question_id, concat('¿Dose of ', upper(p_name), ', or ', p_type, '?') AS text FROM part",
    "asked": "SELECT p_partkey AS question_id, CASE WHEN p_size % 9 = 0 THEN ' ' ELSE concat(CASE WHEN p_size % 2 = 0 THEN 'La paciente María García pregunta: ' ELSE '' END, '¿Dose of ', upper(p_name), CASE WHEN p_size % 7 = 0 THEN ' or green' ELSE '' END, ', or ', p_type, '?') END AS text FROM part",
    "audited": "SELECT p_partkey AS row, CAST(p_partkey AS STRING) AS register, p_brand AS name, CASE WHEN p_size % 2 = 0 THEN split_part(p_name, ' ', 1) ELSE split_part(p_name, ' ', 2) END AS searched, CASE WHEN p_size % 3 = 0 THEN concat('Sódico', p_name, ', ', p_type) ELSE concat(p_type, ', ', p_name, ' é') END AS ingredients FROM part",
    "search_results": "SELECT split_part(p_name, ' ', 2) AS searched, p_partkey AS place, CAST(p_partkey AS STRING) AS register, p_size % 2 = 0 AS segmented, p_size % 5 <> 0 AS has_sheet, p_brand AS name, CASE WHEN p_size % 7 = 0 THEN NULL ELSE concat(p_name, 's, ', p_type, ' ', p_name) END AS ingredients FROM part",
    "known_rows": "SELECT p_brand AS searched, CAST(p_partkey % 500 AS STRING) AS register FROM part WHERE p_size < 20",
    "found_rows": "SELECT p_partkey AS place, upper(p_type) AS searched, CAST(p_partkey % 900 AS STRING) AS register, p_name AS name FROM part",
    "answers": "SELECT concat(conv_id, ':', turn) AS question_id, CASE WHEN turn % 4 = 0 THEN 'con_respuesta_con_pii' WHEN turn % 4 = 1 THEN 'fuera_de_alcance' ELSE 'con_respuesta' END AS category, turn % 4 <> 1 AS answerable, CAST(conv_id AS STRING) AS expected_register, CAST(turn AS STRING) AS expected_section, turn % 4 = 0 AS expected_pii, CASE WHEN conv_id % 2 = 0 THEN lower(split_part(text, ' ', 2)) ELSE concat(split_part(text, ' ', 2), '#') END AS forbidden, concat(CASE WHEN conv_id % 5 = 0 THEN '' ELSE '[1] ' END, CASE WHEN conv_id % 7 = 0 THEN 'see [9] and [2]' ELSE 'see [2]' END, text) AS answer, turn % 5 <> 0 AS found, conv_id % 4 = 0 AS pii_notice, conv_id AS s_doc, turn % 3 AS s_turn, CASE WHEN conv_id % 11 = 0 THEN 'timeout' END AS error FROM conversations",
}


def sql(name: str) -> str:
    """The SELECT for DuckDB."""
    return INPUTS[name].replace("AS STRING)", "AS VARCHAR)")


#: Inputs of which a row of parts becomes so many rows (of a question: phrases and mentions); all that become of it stay together.
TIMES = {"sheet_lines": len(SHEET), "questions": 16, "asked": 16}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input or, under its own name, a table."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = INPUTS[name]
    used = [t for t in TABLES if re.search(rf"\bFROM {t}\b", text)]
    if name == "sheet_lines":
        rows = ", ".join(f"named_struct('page', {p}, 'line', {n}, 'text', {e})" for p, n, e in SHEET)
        text = f"SELECT p_partkey AS doc_id, s.page, s.line, s.text FROM part LATERAL VIEW explode(array({rows})) AS s"
    tables = {t: frame(spark, sf_dir, t) for t in used}
    if name in TIMES:
        tables["part"] = spread(tables["part"], "p_partkey", TIMES[name])
    for t in used:
        text = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", text)
    return spark.sql(text, **tables)
