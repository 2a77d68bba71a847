"""The reference operators as queries, each with an independently shaped DuckDB query where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.functions import text as tx
from sextant.functions.scratch import durable, scratch_folder, spread
from sextant.operators import answers, chunking, cleaning, embedding, entities, evaluation, index, ingest, lexical, masking, retrieval, search, sections
from sextant.plans import splitting
from sextant.plans.inputs import frame, sql
from sextant.sources import documents as src
from sextant.streaming import events

QUERIES: dict = {}
ORACLE: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


# Retrieval -----------------------------------------------------------------


def _questions(spark: SparkSession, sf_dir: str, only: bool) -> DataFrame:
    return frame(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"), (F.col("label").cast("string") if only else F.lit(None).cast("string")).alias("only"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("register"))


def _retrieved(spark: SparkSession, sf_dir: str, k: int = 5, only: bool = False, threshold: float | None = None) -> DataFrame:
    return retrieval.retrieve(_questions(spark, sf_dir, only), _chunks(spark, sf_dir), k, threshold)


def _ranked(k: int, on: str = "TRUE", keep: str = "TRUE") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT q.vec_id AS question_id, c.vec_id AS chunk_id, CAST(c.label AS VARCHAR) AS register, greatest(0.0, least(1.0, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])))) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 AND {on})) WHERE rank <= {k} AND {keep}"


_ROUNDED = "SELECT question_id, chunk_id, register, rank, round(score, 6) AS score FROM ({})"


@query(_ROUNDED.format(_ranked(5)))
def cosine_topk(spark, sf_dir):
    return _retrieved(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(_ROUNDED.format(_ranked(5, "q.label = c.label")))
def cosine_topk_filtered(spark, sf_dir):
    return _retrieved(spark, sf_dir, only=True).withColumn("score", F.round("score", 6))


@query(_ROUNDED.format(_ranked(5, keep="score >= 0.4")))
def cosine_topk_threshold(spark, sf_dir):
    return _retrieved(spark, sf_dir, threshold=0.4).withColumn("score", F.round("score", 6))


_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_TOKENS = "unnest(list_filter(regexp_extract_all(strip_accents(lower({})), '[a-z0-9]+'), lambda x: x NOT IN (" + _STOP + ")))"
_BM25 = f"""WITH t AS (SELECT doc_id AS chunk_id, {_TOKENS.format("text")} AS term FROM documents),
d AS (SELECT doc_id AS chunk_id, coalesce(n, 0) AS size FROM documents LEFT JOIN (SELECT chunk_id, count(*) AS n FROM t GROUP BY 1) ON chunk_id = doc_id WHERE text IS NOT NULL),
tf AS (SELECT chunk_id, term, count(*) AS f FROM t GROUP BY 1, 2),
raw AS (SELECT term, ln((SELECT count(*) FROM d) - count(*) + 0.5) - ln(count(*) + 0.5) AS v FROM tf GROUP BY 1),
idf AS (SELECT term, CASE WHEN v < 0 THEN 0.25 * (SELECT avg(v) FROM raw) ELSE v END AS v FROM raw),
q AS (SELECT item_id AS question_id, {_TOKENS.format("text")} AS term FROM benchmark),
s AS (SELECT question_id, chunk_id, round(sum(v * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * size / (SELECT avg(size) FROM d)))), 8) AS score FROM q JOIN tf USING (term) JOIN idf USING (term) JOIN d USING (chunk_id) GROUP BY 1, 2)
SELECT question_id, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score > 0) WHERE rank <= 5"""


@query(_BM25)
def bm25_topk(spark, sf_dir):
    asked = frame(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    chunks = frame(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text").filter("text is not null")
    return lexical.bm25(asked, chunks).select("question_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH r AS (SELECT question_id, chunk_id, rank FROM ({_ranked(8)}) UNION ALL SELECT question_id, chunk_id, rank FROM ({_ranked(8, "q.label = c.label")})),
s AS (SELECT question_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 10) AS score FROM r GROUP BY 1, 2)
SELECT question_id, chunk_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 5""")
def hybrid_rrf(spark, sf_dir):
    return retrieval.fuse([_retrieved(spark, sf_dir, 8), _retrieved(spark, sf_dir, 8, only=True)])


# Retrieval metrics ------------------------------------------------------------


def _hits(spark, sf_dir, threshold=None):
    return evaluation.question_hits(frame(spark, sf_dir, "golden"), _evaluated(spark, sf_dir), threshold)


def _evaluated(spark, sf_dir):
    return _retrieved(spark, sf_dir).withColumn("section", (F.col("register").cast("int") % 3).cast("string"))


_EVALUATED = f"SELECT *, CAST(CAST(register AS INT) % 3 AS VARCHAR) AS section FROM ({_ranked(5)})"
_ABSENT = "category = 'medicamento_ausente'"
_HITS = f"""g AS ({sql("golden")}), r AS ({_EVALUATED}),
l AS (SELECT question_id, register, section, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS place FROM r WHERE score >= 0.1),
h AS (SELECT g.*, (SELECT min(place) FROM l WHERE l.question_id = g.question_id AND register = expected_register AND section = expected_section) AS hit,
(SELECT min(place) FROM l WHERE l.question_id = g.question_id AND register = expected_register) AS sheet,
(SELECT max(section) FROM l WHERE l.question_id = g.question_id AND place = 1) AS best, NOT EXISTS (SELECT 1 FROM l WHERE l.question_id = g.question_id) AS nothing FROM g)"""


def _share(condition: str, among: str) -> str:
    return f"round(count(*) FILTER (WHERE {among} AND {condition}) / nullif(count(*) FILTER (WHERE {among}), 0)::DOUBLE, 4)"


@query(
    f"WITH {_HITS} SELECT count(*) AS n_questions, count(*) FILTER (WHERE answerable) AS n_answerable, count(*) FILTER (WHERE {_ABSENT}) AS n_rejected, "
    + ", ".join(f"{_share(f'hit <= {k}', 'answerable')} AS hit_rate_{k}, {_share(f'sheet <= {k}', 'answerable')} AS sheet_rate_{k}" for k in (1, 3, 5))
    + f", round(sum(CASE WHEN answerable THEN coalesce(1.0::DOUBLE / hit, 0) END) / nullif(count(*) FILTER (WHERE answerable), 0), 4) AS mrr, {_share('best = expected_section', 'answerable')} AS section_rate_1, {_share('nothing', _ABSENT)} AS right_rejections, {_share('nothing', 'answerable')} AS false_rejections FROM h"
)
def retrieval_metrics(spark, sf_dir):
    return evaluation.retrieval_metrics(_hits(spark, sf_dir, 0.1))


@query(f"WITH {_HITS} SELECT expected_section AS section, count(*) AS n, {_share('hit <= 5', 'TRUE')} AS hit_rate FROM h WHERE answerable GROUP BY 1")
def metrics_by_section(spark, sf_dir):
    return evaluation.metrics_by_section(_hits(spark, sf_dir, 0.1))


@query(f"WITH {_HITS} SELECT question_id FROM h WHERE answerable AND hit IS NULL")
def failed_questions(spark, sf_dir):
    return evaluation.failed_questions(_hits(spark, sf_dir, 0.1))


_SWEEP = f"""WITH g AS ({sql("golden")}), r AS ({_EVALUATED}), t AS (SELECT round(i * 0.05, 2)::DOUBLE AS threshold FROM range(19) x(i)),
h AS (SELECT threshold, question_id, answerable, category,
(SELECT min(1 + (SELECT count(*) FROM r b WHERE b.question_id = a.question_id AND b.rank < a.rank AND b.score >= threshold)) FROM r a WHERE a.question_id = g.question_id AND a.score >= threshold AND a.register = expected_register AND a.section = expected_section) AS hit,
NOT EXISTS (SELECT 1 FROM r a WHERE a.question_id = g.question_id AND a.score >= threshold) AS nothing FROM g, t),
m AS (SELECT threshold, coalesce({_share("hit <= 5", "answerable")}, 0) AS hit_rate, coalesce({_share("nothing", _ABSENT)}, 0) AS right_rejections, {_share("nothing", "answerable")} AS false_rejections FROM h GROUP BY 1)
SELECT *, round((hit_rate + right_rejections) / 2, 4) AS score FROM m"""


def _sweep(spark, sf_dir):
    return evaluation.threshold_sweep(frame(spark, sf_dir, "golden"), _evaluated(spark, sf_dir))


@query(_SWEEP)
def threshold_sweep(spark, sf_dir):
    return _sweep(spark, sf_dir)


@query(f"SELECT * FROM ({_SWEEP}) ORDER BY score DESC, threshold LIMIT 1")
def best_threshold(spark, sf_dir):
    return evaluation.best_threshold(_sweep(spark, sf_dir))


_LINKED = f"SELECT question_id, answerable, coalesce(string_agg(chunk_id, ',' ORDER BY position, chunk_id), '') AS chunk_ids FROM ({sql('link_questions')}) q LEFT JOIN ({sql('link_chunks')}) c ON register = expected_register AND section = expected_section GROUP BY ALL"


def _linked(spark, sf_dir):
    return evaluation.link_golden(frame(spark, sf_dir, "link_questions"), frame(spark, sf_dir, "link_chunks"))


@query(_LINKED)
def link_golden(spark, sf_dir):
    return _linked(spark, sf_dir).withColumn("chunk_ids", F.array_join("chunk_ids", ","))


@query(f"SELECT question_id FROM ({_LINKED}) WHERE answerable AND chunk_ids = ''")
def golden_gaps(spark, sf_dir):
    return evaluation.golden_gaps(_linked(spark, sf_dir))


# Section sets ------------------------------------------------------------------

_NUMBERS = ", ".join(f"'{n}'" for n in sections.NUMBERS)
_KEYS = ", ".join(f"'{n}'" for n in evaluation.KEY_SECTIONS)
_SETS = f"""o AS (SELECT DISTINCT l_orderkey AS register, '4.' || l_linenumber AS s FROM lineitem), d AS (SELECT DISTINCT l_orderkey AS register, CASE WHEN l_returnflag = 'R' THEN '5.' || l_linenumber ELSE '4.' || l_linenumber END AS s FROM lineitem),
f AS (SELECT coalesce(o.register, d.register) AS register, coalesce(o.s, d.s) AS s, o.s IS NOT NULL AS o, d.s IS NOT NULL AS d FROM (SELECT * FROM o WHERE s IN ({_NUMBERS})) o FULL JOIN (SELECT * FROM d WHERE s IN ({_NUMBERS})) d ON o.register = d.register AND o.s = d.s),
r AS (SELECT register, count(*) FILTER (WHERE o) AS n_official, count(*) FILTER (WHERE d) AS n_detected, count(*) FILTER (WHERE o AND d) AS hits, coalesce(string_agg(s, ' ' ORDER BY s) FILTER (WHERE o AND NOT d), '') AS missing, coalesce(string_agg(s, ' ' ORDER BY s) FILTER (WHERE d AND NOT o), '') AS extra, count(*) FILTER (WHERE o AND s IN ({_KEYS})) AS ko, count(*) FILTER (WHERE o AND d AND s IN ({_KEYS})) AS kh FROM f GROUP BY 1)"""


def _compared(spark, sf_dir):
    n = F.col("l_linenumber").cast("string")
    rows = frame(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("register")).agg(F.collect_set(F.concat(F.lit("4."), n)).alias("official"), F.collect_set(F.concat(F.when(F.col("l_returnflag") == "R", "5.").otherwise("4."), n)).alias("detected"))
    return evaluation.compare_sections(rows, sections.NUMBERS)


@query(f"WITH {_SETS} SELECT register, n_official, n_detected, hits, missing, extra FROM r WHERE n_official > 0")
def section_sets(spark, sf_dir):
    return evaluation.section_report(_compared(spark, sf_dir))


@query(f"WITH {_SETS} SELECT count(*) AS sheets, round(sum(hits) / sum(n_official), 8) AS recall, round(sum(hits) / sum(n_detected), 8) AS precision, round(sum(kh) / sum(ko), 8) AS key_recall, count(*) FILTER (WHERE missing = '' AND extra = '') AS perfect FROM r WHERE n_official > 0")
def section_micro_metrics(spark, sf_dir):
    return evaluation.section_metrics(_compared(spark, sf_dir))


# Index ---------------------------------------------------------------------------


@query(f"SELECT doc_id, coalesce(arg_min(name, position), '') AS name, coalesce(arg_min(kind, position), 'documento') AS kind, count(*) AS n_chunks FROM ({sql('turn_chunks')}) GROUP BY 1")
def list_documents(spark, sf_dir):
    return index.list_documents(frame(spark, sf_dir, "turn_chunks"))


@query(f"SELECT doc_id, min(name) AS name FROM ({sql('turn_chunks')}) GROUP BY 1 HAVING contains(lower(min(name)), 'alk 1') OR contains(CAST(doc_id AS VARCHAR), 'alk 1')")
def search_documents(spark, sf_dir):
    return index.search_documents(index.list_documents(frame(spark, sf_dir, "turn_chunks")), "ALK 1").select("doc_id", "name")


@query(f"WITH b AS ({sql('turn_chunks')}), n AS ({sql('new_chunks')}) SELECT * FROM n UNION ALL SELECT * FROM b WHERE chunk_id NOT IN (SELECT chunk_id FROM n)")
def upsert_chunks(spark, sf_dir):
    return index.upsert(frame(spark, sf_dir, "turn_chunks"), frame(spark, sf_dir, "new_chunks"))


@query(f"SELECT * FROM ({sql('turn_chunks')}) WHERE doc_id <> 1")
def delete_document(spark, sf_dir):
    return index.delete_document(frame(spark, sf_dir, "turn_chunks"), 1)


@query(f"WITH b AS ({sql('turn_chunks')}), n AS ({sql('new_chunks')}) SELECT * FROM n UNION ALL SELECT * FROM b WHERE doc_id NOT IN (SELECT doc_id FROM n)")
def reindex_document(spark, sf_dir):
    return index.reindex(frame(spark, sf_dir, "turn_chunks"), frame(spark, sf_dir, "new_chunks"))


@query(f"WITH b AS ({sql('turn_chunks')}), n AS ({sql('new_chunks')}) SELECT doc_id, count(*) AS n_chunks, (SELECT count(*) FROM b WHERE b.doc_id = n.doc_id) AS n_replaced, (SELECT count(*) FROM b WHERE b.doc_id = n.doc_id) > 0 AS was_there FROM n GROUP BY doc_id")
def reindex_report(spark, sf_dir):
    return index.reindex_report(frame(spark, sf_dir, "turn_chunks"), frame(spark, sf_dir, "new_chunks"))


@query("WITH s AS (SELECT doc_id, length(text) AS n, row_number() OVER (ORDER BY length(text)) - 1 AS i, count(*) OVER () AS c FROM documents WHERE text IS NOT NULL) SELECT count(DISTINCT doc_id) AS documents, count(*) AS chunks, CAST(floor(sum(n) / count(*)) AS BIGINT) AS mean_size, max(CASE WHEN i = c // 2 THEN n END) AS median, min(n) AS least, max(n) AS most FROM s")
def corpus_summary(spark, sf_dir):
    return chunking.run_summary(frame(spark, sf_dir, "documents").select("doc_id", "text").filter("text is not null"))


# Sections -----------------------------------------------------------------------

_TEMPLATE = ", ".join(f"('{n}', {i}, '{w}')" for i, (n, ws) in enumerate(sections.TEMPLATE) for w in ws)
_RE = r"^(\d{1,2}(?:\.\d{1,2})?)\.?\s+(\S.*)$"
_MARKED = f"""l AS ({sql("sheet_lines")}), t(number, pos, word) AS (VALUES {_TEMPLATE}),
c AS (SELECT doc_id, page, line, max(pos) AS pos FROM l JOIN t ON t.number = regexp_extract(trim(text), '{_RE}', 1) AND contains(lower(strip_accents(regexp_extract(trim(text), '{_RE}', 2))), word) GROUP BY 1, 2, 3),
s AS (SELECT *, count(*) FILTER (WHERE pos = 0) OVER (PARTITION BY doc_id ORDER BY page, line) AS seg FROM c),
m AS (SELECT doc_id, seg, max(pos) AS top FROM s GROUP BY 1, 2),
p AS (SELECT s.*, 1 + (SELECT count(*) FROM m WHERE m.doc_id = s.doc_id AND m.seg < s.seg AND m.top >= 24) AS product FROM s),
a AS (SELECT * FROM (SELECT *, max(pos) OVER (PARTITION BY doc_id, product ORDER BY page, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p) WHERE before IS NULL OR pos > before),
k AS (SELECT l.*, (SELECT count(*) FROM a WHERE a.doc_id = l.doc_id AND (a.page, a.line) <= (l.page, l.line)) AS section_id FROM l)"""
_TITLES = "ti AS (SELECT a.doc_id, a.product, row_number() OVER (PARTITION BY a.doc_id ORDER BY a.page, a.line) AS section_id, regexp_extract(trim(l.text), '" + _RE + "', 1) AS number, rtrim(regexp_extract(trim(l.text), '" + _RE + "', 2), ' .') AS raw FROM a JOIN l USING (doc_id, page, line))"
_SECTIONS = f"{_MARKED}, {_TITLES}, b AS (SELECT doc_id, section_id, string_agg(text, chr(10) ORDER BY page, line) AS text FROM k WHERE section_id > 0 AND NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = k.doc_id AND a.page = k.page AND a.line = k.line) GROUP BY 1, 2), se AS (SELECT ti.doc_id, ti.section_id, product, number, CASE WHEN raw = upper(raw) AND raw <> lower(raw) THEN upper(raw[1]) || lower(raw[2:]) ELSE raw END AS title, coalesce(b.text, '') AS text FROM ti LEFT JOIN b ON b.doc_id = ti.doc_id AND b.section_id = ti.section_id)"


@query(f"WITH {_SECTIONS} SELECT doc_id, section_id, product, number, title, text FROM se")
def detect_sections(spark, sf_dir):
    return sections.sections(frame(spark, sf_dir, "sheet_lines")).select("doc_id", "section_id", "product", "number", "title", "text")


_DATE = r"(?i)((?:julio|agosto)(?:\s+de)?\s+(?:19|20)\d{2}|\d{1,2}[/.-]\d{1,2}[/.-](?:19|20)\d{2}|\d{1,2}[/.-](?:19|20)\d{2})"


@query(f"WITH {_SECTIONS}, d AS (SELECT doc_id, product, max(CASE WHEN number = '1' AND text <> '' THEN trim(string_split(text, chr(10))[1]) END) AS name, max(CASE WHEN number = '10' THEN nullif(regexp_extract(text, '{_DATE}', 1), '') END) AS own FROM se GROUP BY 1, 2) SELECT doc_id, product, name, coalesce(own, (SELECT own FROM d e WHERE e.doc_id = d.doc_id AND own IS NOT NULL ORDER BY product LIMIT 1)) AS date FROM d")
def section_names_dates(spark, sf_dir):
    return sections.names_and_dates(sections.sections(frame(spark, sf_dir, "sheet_lines")))


@query(f"WITH {_SECTIONS} SELECT doc_id, count(*) AS n_sections, count(*) >= 8 AS is_sheet FROM se GROUP BY 1")
def sheet_fallback(spark, sf_dir):
    found = sections.fall_back(sections.sections(frame(spark, sf_dir, "sheet_lines")))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_sections"), F.max("is_sheet").alias("is_sheet"))


@query(f"WITH l AS ({sql('sheet_lines')}), h AS (SELECT *, nullif(trim(regexp_extract(trim(text), '^#{{1,6}}\\s+(.+)$', 1)), '') AS heading FROM l), s AS (SELECT *, count(heading) OVER (PARTITION BY doc_id ORDER BY page, line) AS section_id FROM h) SELECT doc_id, section_id, max(heading) AS title, string_agg(text, chr(10) ORDER BY page, line) FILTER (WHERE heading IS NULL) AS text FROM s GROUP BY 1, 2 HAVING count(*) FILTER (WHERE heading IS NULL) > 0")
def generic_sections(spark, sf_dir):
    lines = frame(spark, sf_dir, "sheet_lines").withColumn("markdown", F.lit(True))
    return sections.generic_sections(lines).select("doc_id", "section_id", "title", "text")




def _spans_of(lines: str, x: str = "") -> str:
    """CTEs that end with sp (doc_id, start, end, number) of ``lines``; ``x`` ends their names."""
    return f"""l{x} AS ({lines}), t{x}(number, pos, word) AS (VALUES {_TEMPLATE}),
o{x} AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY page, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS beg, sum(length(text) + 1) OVER (PARTITION BY doc_id) AS total FROM l{x}),
c{x} AS (SELECT doc_id, page, line, beg, total, max(t{x}.number) AS number, max(pos) AS pos FROM o{x} JOIN t{x} ON t{x}.number = regexp_extract(trim(text), '{_RE}', 1) AND contains(lower(strip_accents(regexp_extract(trim(text), '{_RE}', 2))), word) GROUP BY 1, 2, 3, 4, 5),
a{x} AS (SELECT * FROM (SELECT *, max(pos) OVER (PARTITION BY doc_id ORDER BY page, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c{x}) WHERE before IS NULL OR pos > before),
sp{x} AS (SELECT doc_id, CAST(beg AS BIGINT) AS start, CAST(coalesce(lead(beg) OVER (PARTITION BY doc_id ORDER BY page, line), total) AS BIGINT) AS "end", number FROM a{x})"""


_SPANS = _spans_of(sql("sheet_lines"))


@query(f'WITH {_SPANS} SELECT doc_id, start, "end", number FROM sp')
def section_spans(spark, sf_dir):
    return sections.section_spans(frame(spark, sf_dir, "sheet_lines"))


def _windows(text, size: int, overlap: int):
    """Plain windows of fixed size as (chunk, start, end)."""
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.transform(starts, lambda s, i: F.struct(i.alias("chunk"), s.alias("start"), F.least(s + size, n).alias("end")))


@query("SELECT doc_id, CAST(i // 425 AS INT) AS chunk, i AS start, least(i + 500, length(text)) AS \"end\", substr(text, CAST(i + 1 AS BIGINT), 500) AS text FROM documents, range(0, 10000000, 425) r(i) WHERE text <> '' AND i <= greatest(length(text) - 76, 0) AND i < (SELECT max(length(text)) FROM documents)".replace("range(0, 10000000, 425)", "range(0, (SELECT max(length(text)) FROM documents), 425)"))
def fixed_chunks(spark, sf_dir):
    docs = frame(spark, sf_dir, "documents").filter("text <> ''").select("doc_id", "text")
    return docs.select("doc_id", "text", F.explode(_windows(F.col("text"), 500, 75)).alias("w")).select("doc_id", "w.chunk", F.col("w.start").cast("long").alias("start"), F.col("w.end").cast("long").alias("end"), F.substring("text", F.col("w.start") + 1, F.lit(500)).alias("text"))


def _strategy(spark, sf_dir):
    lines = frame(spark, sf_dir, "sheet_lines")
    whole = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    of = lambda name, size, overlap: F.struct(F.lit(name).alias("strategy"), F.transform(_windows(F.col("text"), size, overlap), lambda w: F.struct(w["start"], w["end"])).alias("pieces"))
    cut = whole.select("doc_id", F.explode(F.array(of("fixed_100", 100, 15), of("fixed_200", 200, 30))).alias("s"))
    return chunking.exploded_strategies(cut), sections.section_spans(lines)


@query(f"""WITH {_SPANS}, w AS (SELECT doc_id, sum(length(text) + 1) - 1 AS n FROM l GROUP BY 1),
ch AS (SELECT 'fixed_100' AS strategy, doc_id, i AS s, least(i + 100, n) AS e FROM w, range(0, 4000, 85) r(i) WHERE i <= greatest(n - 16, 0) UNION ALL SELECT 'fixed_200', doc_id, i, least(i + 200, n) FROM w, range(0, 4000, 170) r(i) WHERE i <= greatest(n - 31, 0)),
x AS (SELECT strategy, ch.doc_id, s, e, number FROM ch LEFT JOIN sp ON sp.doc_id = ch.doc_id AND start < e AND "end" > s),
y AS (SELECT strategy, doc_id, s, e, count(DISTINCT number) AS n FROM x GROUP BY ALL),
z AS (SELECT strategy, doc_id, number, count(DISTINCT s) AS n FROM x WHERE number IN ({_KEYS}) GROUP BY ALL),
zz AS (SELECT strategy, count(*) FILTER (WHERE n > 1) AS broken FROM z GROUP BY 1)
SELECT strategy, count(*) AS chunks, CAST(floor(sum(e - s) / count(*)) AS BIGINT) AS mean_size, round(100 * count(*) FILTER (WHERE y.n > 1) / count(*)::DOUBLE, 4) AS mixed_percent, round(100 * (6 * count(DISTINCT doc_id) - max(broken)) / (6 * count(DISTINCT doc_id))::DOUBLE, 4) AS whole_key_percent FROM y JOIN zz USING (strategy) GROUP BY 1""")
def strategy_mix(spark, sf_dir):
    return chunking.strategy_metrics(*_strategy(spark, sf_dir))


@query(f"WITH RECURSIVE d AS (SELECT doc_id AS key, text FROM documents), {splitting.pieces('d', 1000, 150, 'p')} SELECT key AS doc_id, part, start, text FROM p")
def recursive_chunks(spark, sf_dir):
    docs = frame(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.pieces(F.col("text"))).alias("part", "piece"))
    return docs.select("doc_id", "part", "piece.start", "piece.text")


@query()
def chunk_documents(spark, sf_dir):
    return _sheet_chunks(spark, sf_dir, frame(spark, sf_dir, "sheet_lines"))


def _sheet_chunks(spark, sf_dir, lines):
    null = F.lit(None).cast("string")
    part = frame(spark, sf_dir, "part")
    sheets = part.select(F.col("p_partkey").alias("doc_id"), F.lit(True).alias("is_sheet"), F.lit(False).alias("markdown"), F.col("p_partkey").cast("string").alias("register"), F.lit("aemps").alias("origin"), F.concat(F.lit("FT_"), F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("file_name"), null.alias("name"), F.col("p_type").alias("ingredients"), null.alias("atc"))
    return chunking.chunk_documents(lines, sheets)


@query(f"WITH p AS ({sql('sheet_lines')}), o AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY page, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS beg FROM p) SELECT doc_id, offset_ AS \"offset\", arg_max(page, beg) AS page FROM o, (VALUES (0), (60), (150), (250), (330), (100000)) v(offset_) WHERE beg <= offset_ GROUP BY 1, 2")
def page_of_offset(spark, sf_dir):
    lines = frame(spark, sf_dir, "sheet_lines")
    size = F.length("text") + 1
    at = F.sum(size).over(Window.partitionBy("doc_id").orderBy("page", "line")) - size
    offsets = lines.withColumn("start", at).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "page"))).alias("offsets"))
    asked = offsets.withColumn("offset", F.explode(F.array(*[F.lit(x) for x in (0, 60, 150, 250, 330, 100000)])))
    return asked.select("doc_id", "offset", sections.page_at(F.col("offsets"), F.col("offset"), F.lit(1)).alias("page"))


# Cleaning ---------------------------------------------------------------------------

_LINES = f"l AS (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM ({sql('turn_pages')}))"


def _turn_lines(spark, sf_dir):
    return cleaning.page_lines(frame(spark, sf_dir, "turn_pages"))


@query(f"""WITH {_LINES}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line) AS u, row_number() OVER (PARTITION BY doc_id, page ORDER BY line DESC) AS d, coalesce(lead(trim(text)) OVER (PARTITION BY doc_id, page ORDER BY line), '') AS nx FROM l WHERE trim(text) <> '')
SELECT l.doc_id, l.page, l.line, CASE WHEN (u <= 2 OR d <= 2) AND regexp_matches(lower(l.text), '^\\s*(?:página\\s*)?\\d{{1,3}}(?:\\s*(?:de|/)\\s*\\d{{1,3}})?\\s*$') AND NOT (regexp_full_match(trim(l.text), '\\d{{1,2}}') AND length(nx) > 5 AND regexp_matches(nx, '^\\p{{L}}') AND nx = upper(nx) AND nx <> lower(nx)) THEN '' ELSE l.text END AS text FROM l LEFT JOIN f ON f.doc_id = l.doc_id AND f.page = l.page AND f.line = l.line""")
def page_numbers(spark, sf_dir):
    return cleaning.drop_page_numbers(_turn_lines(spark, sf_dir))


@query(f"""WITH {_LINES}, f AS (SELECT doc_id, page, trim(text) AS b, row_number() OVER (PARTITION BY doc_id, page ORDER BY line) AS u, row_number() OVER (PARTITION BY doc_id, page ORDER BY line DESC) AS d FROM l WHERE trim(text) <> ''),
n AS (SELECT doc_id, count(DISTINCT page) AS n FROM l GROUP BY 1), r AS (SELECT doc_id, b FROM f JOIN n USING (doc_id) WHERE (u <= 3 OR d <= 3) AND length(b) > 3 GROUP BY doc_id, b, n HAVING n >= 3 AND count(DISTINCT page) > 0.6 * n)
SELECT doc_id, page, line, text FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = l.doc_id AND b = trim(text))""")
def repeated_lines(spark, sf_dir):
    return cleaning.drop_repeated_lines(_turn_lines(spark, sf_dir))


@query(f"""WITH {_LINES}, c AS (SELECT doc_id, min(page * 100000 + line) AS cut FROM l WHERE upper(trim(text)) = 'ANEXO II' GROUP BY 1),
k AS (SELECT l.* FROM l LEFT JOIN c USING (doc_id) WHERE cut IS NULL OR page * 100000 + line < cut), p AS (SELECT doc_id, page, max(contains(upper(text), 'NOMBRE DEL MEDICAMENTO')) AS named FROM k GROUP BY 1, 2 HAVING max(trim(text)) <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS i FROM p) SELECT doc_id, page, line, text FROM k JOIN o USING (doc_id, page) WHERE named OR i > 1""")
def annex_cut(spark, sf_dir):
    return cleaning.trim_annexes(_turn_lines(spark, sf_dir))


@query(f"WITH x AS (SELECT doc_id, upper(string_agg(text, chr(10) ORDER BY page, line)) AS t FROM ({sql('sheet_lines')}) WHERE page <= 2 GROUP BY 1) SELECT doc_id, CASE WHEN contains(t, 'ANEXO I') AND contains(t, 'RESUMEN DE LAS CARACTER') THEN 'ema' WHEN contains(t, 'FICHA TÉCNICA') AND contains(t, 'NOMBRE DEL MEDICAMENTO') THEN 'aemps' END AS origin FROM x")
def classify_sheets(spark, sf_dir):
    return cleaning.classify_sheets(cleaning.join_lines(frame(spark, sf_dir, "sheet_lines")))


def _replaced(expression: str) -> str:
    for k, v in tx.REPLACED.items():
        expression = f"replace({expression}, chr({ord(k)}), '{v}')"
    return expression


@query(f"SELECT doc_id, {_replaced('nfc_normalize(concat(text, chr(160), chr(8239), chr(173), chr(64257), chr(8208), chr(61623), chr(9), chr(101), chr(769)))')} AS text FROM documents")
def clean_chars(spark, sf_dir):
    odd = "".join(map(chr, (160, 8239, 173, 64257, 8208, 61623, 9, 101, 769)))
    return frame(spark, sf_dir, "documents").select("doc_id", tx.clean_characters(F.concat(F.coalesce("text", F.lit("")), F.lit(odd))).alias("text"))


@query("SELECT conv_id, turn, regexp_replace(replace(text, ' e', '-' || chr(10) || 'e'), '([a-záéíóúüñ])-\\n([a-záéíóúüñ])', '\\1\\2', 'g') AS text FROM conversations")
def hyphens_rejoined(spark, sf_dir):
    return frame(spark, sf_dir, "conversations").select("conv_id", "turn", cleaning.rejoin_hyphens(F.replace(F.col("text"), F.lit(" e"), F.lit("-\ne"))).alias("text"))


@query()
def clean_document(spark, sf_dir):
    return cleaning.clean_documents(frame(spark, sf_dir, "turn_pages"))


@query()
def table_text(spark, sf_dir):
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", F.array(F.col("l_linenumber").cast("string"), "l_returnflag", "l_linestatus"))))
    tables = frame(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(rows.alias("r"))
    header = F.array(F.lit("Line"), F.lit("Flag"), F.lit("Status"))
    return cleaning.table_texts(tables.select("doc_id", F.lit(0).cast("long").alias("number"), F.concat(F.array(header), F.transform("r", lambda x: x["col2"])).alias("rows")))


# Entities -----------------------------------------------------------------------------

_NORM = "trim(regexp_replace(lower(strip_accents({})), '[^a-z0-9]+', ' ', 'g'))"
_COMMERCIAL = f"coalesce(nullif(trim(regexp_extract({_NORM.format('name')} || ' ', '^((?:[a-z]+ )*)', 1)), ''), {_NORM.format('name')})"
_MENTIONS = f"""q AS ({sql("questions")}), c AS ({sql("catalogue")}),
a AS (SELECT row, register, name, ingredients, 0 AS slot, {_NORM.format("searched")} AS alias, 'searched_active_ingredient' AS match_type FROM c UNION ALL SELECT row, register, name, ingredients, 1, {_NORM.format("ingredients")}, 'official_active_ingredient' FROM c UNION ALL SELECT row, register, name, ingredients, 2, {_COMMERCIAL}, 'commercial_name' FROM c
UNION ALL SELECT row, register, name, ingredients, 3, CASE WHEN length(w) >= 4 AND w <> 'acido' AND NOT list_contains(string_split({_NORM.format("ingredients")}, ' '), w) THEN w ELSE '' END, 'commercial_name' FROM (SELECT *, string_split({_COMMERCIAL}, ' ')[1] AS w FROM c)),
f AS (SELECT question_id, a.* FROM q JOIN a ON alias <> '' AND contains(' ' || {_NORM.format("text")} || ' ', ' ' || alias || ' ')),
o AS (SELECT *, row_number() OVER (PARTITION BY question_id, register ORDER BY len(string_split(alias, ' ')) DESC, length(alias) DESC, row, slot) AS best, min(row) OVER (PARTITION BY question_id, register) AS first FROM f),
e AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY first) AS place, register, name, ingredients, alias, match_type FROM o WHERE best = 1)"""


def _mentions(spark, sf_dir):
    return entities.find_medications(frame(spark, sf_dir, "questions"), frame(spark, sf_dir, "catalogue"))


@query(f"WITH {_MENTIONS} SELECT * FROM e")
def find_medications(spark, sf_dir):
    return _mentions(spark, sf_dir)


@query(f"WITH {_MENTIONS} SELECT question_id, register, name, ingredients, alias, match_type FROM (SELECT *, count(*) OVER (PARTITION BY question_id) AS n FROM e) WHERE n = 1")
def detect_one(spark, sf_dir):
    return entities.detect_medication(_mentions(spark, sf_dir))


_UP = "upper(trim(strip_accents({})))"


@query(f"SELECT row, len(list_filter(string_split(ingredients, ','), lambda p: list_has_all(string_split({_UP.format('p')}, ' '), string_split({_UP.format('searched')}, ' ')))) > 0 AS fits FROM ({sql('audited')})")
def ingredient_match(spark, sf_dir):
    return frame(spark, sf_dir, "audited").select("row", entities.ingredient_matches(F.col("searched"), F.col("ingredients")).alias("fits"))


@query(f"SELECT row, searched, ingredients FROM ({sql('audited')}) WHERE len(list_filter(string_split(ingredients, ','), lambda p: starts_with({_UP.format('p')} || ' ', {_UP.format('searched')} || ' '))) = 0")
def audit_catalogue(spark, sf_dir):
    return entities.suspicious(frame(spark, sf_dir, "audited")).select("row", "searched", "ingredients")


@query(f"WITH t AS (SELECT *, row_number() OVER (PARTITION BY searched ORDER BY segmented DESC, place) AS i FROM ({sql('search_results')}) WHERE has_sheet), v AS (SELECT * FROM t WHERE i <= 60 AND len(list_filter(string_split(coalesce(ingredients, ''), ','), lambda p: list_contains(string_split({_UP.format('p')}, ' '), upper(searched)))) > 0) SELECT searched, register, name, ingredients FROM v QUALIFY i = min(i) OVER (PARTITION BY searched)")
def choose_candidate(spark, sf_dir):
    return entities.choose_candidates(frame(spark, sf_dir, "search_results"))


@query(f"WITH k AS ({sql('known_rows')}), f AS ({sql('found_rows')}) SELECT place, searched, register, name FROM f WHERE lower(searched) NOT IN (SELECT lower(searched) FROM k) AND register NOT IN (SELECT register FROM k) QUALIFY row_number() OVER (PARTITION BY register ORDER BY place) = 1")
def extend_catalogue(spark, sf_dir):
    return entities.extend_catalogue(frame(spark, sf_dir, "known_rows"), frame(spark, sf_dir, "found_rows"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_partkey AS VARCHAR) END AS register, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_name END AS name FROM part")
def files_to_catalogue(spark, sf_dir):
    part = frame(spark, sf_dir, "part")
    files = part.select("p_partkey", F.concat(F.lit("/in/"), F.when(F.col("p_size") % 3 == 0, "doc_").otherwise("FT_"), F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("path"))
    return entities.catalogue_of_files(files, part.select(F.col("p_partkey").cast("string").alias("register"), F.col("p_name").alias("name"))).select("p_partkey", "register", "name")


@query("SELECT d.id, d.n, substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST(d.n % 23 + 1 AS BIGINT), 1) AS letter FROM (SELECT 'c' || c_custkey AS id, (c_custkey * 7919 + 1234567) % 100000000 AS n FROM customer UNION ALL SELECT 'o' || o_orderkey, (o_orderkey * 104729 + 76543) % 100000000 FROM orders) d")
def id_control_letter(spark, sf_dir):
    a = frame(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), ((F.col("c_custkey").cast("long") * 7919 + 1234567) % 100000000).alias("n"))
    b = frame(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), ((F.col("o_orderkey").cast("long") * 104729 + 76543) % 100000000).alias("n"))
    return a.union(b).withColumn("letter", tx.control_letter(F.col("n")))


@query("SELECT doc_id, regexp_replace(text, '[\\p{L}\\p{N}\\p{M}_.+-]+@[\\p{L}\\p{N}\\p{M}_-]+(?:\\.[\\p{L}\\p{N}\\p{M}_-]+)+', '[DATO]', 'g') AS text FROM documents")
def pii_email_mask(spark, sf_dir):
    return frame(spark, sf_dir, "documents").select("doc_id", masking.mask_emails(F.col("text")).alias("text"))


_HAS_MAIL = r"regexp_matches(coalesce(text, ''), '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(\.[\p{L}\p{N}_-]+)+')"


def _masked_in_turn(text: str) -> str:
    """The rules one after the other, as DuckDB knows no look-around: what bounds a match is put back, and every rule runs twice."""
    word, end = r"[\p{L}\p{N}_]", r"($|[^\p{L}\p{N}_])"
    begin = end.replace("$", "^")
    cued = {5: 4, 6: 5, 7: 6, 8: 7}  # rules of which a part is masked, by their place in ours
    patterns = [masking.EMAIL, rf"{begin}[XYZxyz]\d{{7}}[\s-]?[A-Za-z]{end}", rf"{begin}\d{{8}}[\s-]?[A-Za-z]{end}", r"(^|\D)(?:(?:\+|00)34[\s.-]?)?[6789]\d{2}[\s.-]?\d{3}[\s.-]?\d{3}($|\D)"]
    patterns += [(lambda cue, data: f"({cue}){data}")(*masking.RULES[at][1].removesuffix(")").split("(?P<data>")) for at in cued.values()]
    names = f"(?:{'|'.join(masking.GIVEN_NAMES)})"
    patterns.append(rf"{begin}{names}(?:\s+(?:{masking.PARTICLE}\s+)?{masking.NAME_WORD}){{1,3}}{end}")
    for at, pattern in enumerate(patterns, 1):
        kept = masking.MASK if at == 1 else rf"\1{masking.MASK}" if at in cued else rf"\1{masking.MASK}\2"
        pattern = pattern.replace(r"[\w", r"[\p{L}\p{N}_").replace(r"\w", word).replace("'", "''")
        for _ in range(2):
            text = f"regexp_replace({text}, '{pattern}', '{kept}', 'g')"
    return text


@query(f"SELECT doc_id, TRUE AS has_pii, {_masked_in_turn("concat('El paciente Juan Pérez, DNI ', lpad(CAST(doc_id AS VARCHAR), 8, '0'), substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST(doc_id % 23 + 1 AS BIGINT), 1), ', tel. 612 345 678. ', coalesce(text, ''), ' NHC: A-', doc_id + 100, ', nacida el 1/2/1950, cip ABCD', doc_id + 10000, ' y X1234567', substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST(doc_id % 23 + 1 AS BIGINT), 1), '; Carmen Ruiz de la Torre, t@u.es')")} AS masked, concat('nombre,dni,telefono,', CASE WHEN {_HAS_MAIL} THEN 'email,' ELSE '' END, 'historia_clinica,fecha_nacimiento,tarjeta_sanitaria,nie', CASE WHEN doc_id % 23 = 1234567 % 23 THEN '' ELSE '_posible' END, CASE WHEN {_HAS_MAIL} THEN '' ELSE ',email' END) AS kinds FROM documents")
def pii_masked(spark, sf_dir):
    docs = frame(spark, sf_dir, "documents")
    number, letter = F.col("doc_id").cast("string"), tx.control_letter(F.col("doc_id"))
    parts = [F.lit("El paciente Juan Pérez, DNI "), F.lpad(number, 8, "0"), letter, F.lit(", tel. 612 345 678. "), F.coalesce("text", F.lit("")), F.lit(" NHC: A-"), (F.col("doc_id") + 100).cast("string"), F.lit(", nacida el 1/2/1950, cip ABCD"), (F.col("doc_id") + 10000).cast("string"), F.lit(" y X1234567"), letter, F.lit("; Carmen Ruiz de la Torre, t@u.es")]
    return docs.select("doc_id", masking.mask_pii(F.concat(*parts)).alias("r")).select("doc_id", "r.has_pii", "r.masked", F.array_join("r.kinds", ",").alias("kinds"))


@query()
def pii_mask_full(spark, sf_dir):
    docs = frame(spark, sf_dir, "documents")
    cue = F.concat(F.lit("El paciente Juan Pérez, DNI "), F.lpad(F.col("doc_id").cast("string"), 8, "0"), tx.control_letter(F.col("doc_id")), F.lit(", tel. 612 345 678. "), F.coalesce("text", F.lit("")))
    return docs.select("doc_id", masking.mask_pii(cue).alias("r")).select("doc_id", "r.has_pii", F.array_join("r.kinds", ",").alias("kinds"), "r.masked")


# Answers ---------------------------------------------------------------------------------


@query("SELECT conv_id, turn, regexp_replace(concat(lower(text), '【', turn + 1, '†L3】 y [', turn, '] [', conv_id, ']'), '【\\s*(\\d+)[^】]*】', '[\\1]', 'g') AS text FROM conversations")
def citations_plain(spark, sf_dir):
    t = frame(spark, sf_dir, "conversations")
    made = F.concat(F.lower("text"), F.lit("【"), (F.col("turn") + 1).cast("string"), F.lit("†L3】 y ["), F.col("turn").cast("string"), F.lit("] ["), F.col("conv_id").cast("string"), F.lit("]"))
    return t.select("conv_id", "turn", answers.plain_citations(made).alias("text"))


@query("SELECT conv_id, turn, concat('a [1] b', CASE WHEN turn BETWEEN 1 AND 3 THEN concat('[', turn, ']') ELSE '' END, ' c ', CASE WHEN conv_id BETWEEN 1 AND 3 THEN concat('[', conv_id, ']') ELSE '' END, '.') AS text FROM conversations")
def citations_clean(spark, sf_dir):
    t = frame(spark, sf_dir, "conversations")
    made = F.concat(F.lit("a [1] b["), F.col("turn").cast("string"), F.lit("] c ["), F.col("conv_id").cast("string"), F.lit("]."))
    return t.select("conv_id", "turn", answers.real_citations(made, F.lit(3)).alias("text"))


def _answers(spark, sf_dir):
    return evaluation.check_answers(_with_sources(frame(spark, sf_dir, "answers")).withColumn("forbidden", F.array("forbidden")))


def _with_sources(a: DataFrame) -> DataFrame:
    source = lambda i, d, s: F.struct(F.lit(i).alias("index"), F.concat(F.lit("FT_"), d.cast("string")).alias("doc_id"), s.cast("string").alias("section"))
    return a.withColumn("sources", F.array(source(1, F.col("s_doc"), F.col("s_turn")), source(2, F.col("s_doc"), F.col("s_turn") + 1)))


_CHECKS = f"""a AS ({sql("answers")}), k AS (SELECT *, CAST(regexp_extract_all(answer, '\\[(\\d+)\\]', 1) AS BIGINT[]) AS c, s_turn = CAST(expected_section AS INT) AS one, s_turn + 1 = CAST(expected_section AS INT) AS two FROM a),
ch AS (SELECT question_id, category, answerable, found, pii_notice, error, CASE WHEN error IS NULL THEN len(c) END AS n_citations, CASE WHEN error IS NULL THEN len(list_filter(c, lambda x: x NOT IN (1, 2))) = 0 END AS citations_valid, CASE WHEN error IS NULL THEN len(c) > 0 END AS has_citations, CASE WHEN error IS NULL THEN one OR two END AS source_retrieved,
CASE WHEN error IS NULL THEN (one AND list_contains(c, 1)) OR (two AND list_contains(c, 2)) END AS source_cited, CASE WHEN error IS NULL THEN pii_notice = expected_pii END AS pii_notice_right, CASE WHEN error IS NULL THEN NOT contains(lower(answer), lower(forbidden)) END AS no_leak FROM k)"""


@query(f"WITH {_CHECKS} SELECT * FROM ch")
def answer_checks(spark, sf_dir):
    return _answers(spark, sf_dir)


_OK = "error IS NULL AND "


@query(
    f"WITH {_CHECKS} SELECT count(*) AS n_questions, count(error) AS n_errors, "
    + ", ".join(
        f"{_share(what, _OK + among)} AS {name}"
        for name, what, among in (
            ("right_rejections", "NOT found", "category = 'fuera_de_alcance'"),
            ("false_rejections", "NOT found", "answerable"),
            ("citations_valid", "citations_valid", "found"),
            ("has_citations", "has_citations", "found"),
            ("source_cited", "source_cited", "answerable"),
            ("source_retrieved", "source_retrieved", "answerable"),
            ("pii_notices", "pii_notice", "category = 'con_respuesta_con_pii'"),
            ("pii_false_alarms", "pii_notice", "category <> 'con_respuesta_con_pii'"),
            ("no_leak", "no_leak", "TRUE"),
        )
    )
    + " FROM ch"
)
def answer_metrics(spark, sf_dir):
    return evaluation.answer_metrics(_answers(spark, sf_dir))


@query(f"WITH {_CHECKS} SELECT question_id, category, found FROM ch WHERE error IS NULL AND ((answerable AND found) OR ends_with(question_id, ':1'))")
def review_sheet(spark, sf_dir):
    checked = _answers(spark, sf_dir)
    return evaluation.review_sheet(checked, checked.filter(F.col("question_id").endswith(":1")))


@query(f"WITH {_CHECKS} SELECT question_id, category, n_citations, citations_valid, source_cited, pii_notice_right, no_leak, error IS NULL AND ((answerable AND found) OR ends_with(question_id, ':1')) AS to_review FROM ch")
def golden_file_checks(spark, sf_dir):
    """Answers held against a golden file that is written and read with all its fields: the checks, and what to look over by hand."""
    a = frame(spark, sf_dir, "answers")
    folder = scratch_folder(spark)
    fields = {"id": "question_id", "question": "question_id", "categoria": "category", "answerable": "answerable", "expected_nregistro": "expected_register", "expected_seccion": "expected_section", "expected_pii": "expected_pii"}
    a.select(*(F.col(c).alias(n) for n, c in fields.items()), F.array("forbidden").alias("no_debe_contener"), F.col("question_id").endswith(":1").alias("revision_manual")).write.json(f"{folder}/golden")
    golden = src.read_golden(spark, f"{folder}/golden")
    given = _with_sources(a).select("question_id", "answer", "found", "pii_notice", "sources", "error")
    checked = evaluation.check_answers(golden.join(given, "question_id"))
    review = evaluation.review_sheet(checked, golden.filter("manual")).select("question_id", F.lit(True).alias("to_review"))
    return checked.join(review, "question_id", "left").select("question_id", "category", "n_citations", "citations_valid", "source_cited", "pii_notice_right", "no_leak", F.coalesce("to_review", F.lit(False)).alias("to_review"))


@query(f"""WITH r AS ({_ranked(5)}), x AS (SELECT question_id, rank, 'doc ' || chunk_id AS name, CASE WHEN CAST(register AS INT) % 3 > 0 THEN register END AS section, 'Label ' || register AS title, d.text FROM r JOIN documents d ON d.doc_id = chunk_id)
SELECT question_id, count(*) AS n_sources, string_agg('[' || rank || '] ' || name || CASE WHEN section IS NOT NULL THEN ' (Sección ' || section || ': ' || title || ')' ELSE '' END || chr(10) || 'Texto: ' || text, chr(10) || chr(10) ORDER BY rank) AS context FROM x GROUP BY 1""")
def sources_context(spark, sf_dir):
    docs = frame(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    section = F.when(F.col("register").cast("int") % 3 > 0, F.col("register"))
    rows = _retrieved(spark, sf_dir).join(docs, "chunk_id").select("question_id", "rank", F.concat(F.lit("FT_"), F.col("register")).alias("doc_id"), F.concat(F.lit("doc "), F.col("chunk_id").cast("string")).alias("name"), section.alias("section"), F.concat(F.lit("Label "), F.col("register")).alias("title"), F.lit(1).alias("page"), "text", "score")
    found = answers.sources(rows)
    return found.select("question_id", F.size("sources").alias("n_sources"), answers.context(F.col("sources")).alias("context"))


@query(f"SELECT question_id, CASE WHEN NOT found OR error IS NOT NULL THEN TRUE ELSE FALSE END AS nothing FROM ({sql('answers')})")
def empty_answers(spark, sf_dir):
    a = frame(spark, sf_dir, "answers")
    text = F.when(F.col("error").isNotNull(), answers.NOT_FOUND).otherwise(F.col("answer"))
    return a.select("question_id", answers.says_nothing(text, F.col("found")).alias("nothing"))


# Sources -----------------------------------------------------------------------------------


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'FT_' || page_id ELSE 'guia-rapida-' || substr(sha1(html), 1, 8) END AS doc_id FROM pages")
def document_ids(spark, sf_dir):
    pages = frame(spark, sf_dir, "pages")
    path = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/in/FT_"), F.col("page_id").cast("string"), F.lit(".txt"))).otherwise("/in/Guía  Rápida!.md")
    return pages.select("page_id", src.document_id(path, F.col("html").cast("binary")).alias("doc_id"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS nregistro, p_name AS nombre, p_type AS principios_activos, CASE WHEN p_size % 2 = 0 THEN 'B' || p_size ELSE 'C' || p_size END AS atc, CASE WHEN p_size % 3 = 0 THEN 'http://x/' || p_partkey END AS url_ficha_tecnica, p_size % 3 = 0 AND p_size % 2 = 0 AS ficha_segmentada, CASE WHEN p_size % 3 = 0 THEN TRUE END AS has_sheet FROM part")
def registry_records(spark, sf_dir):
    n = F.col("p_size")
    code = lambda c, level: F.struct(F.concat(F.lit(c), n.cast("string")).alias("codigo"), level.alias("nivel"))
    doc = lambda kind, url, secc: F.struct(kind.alias("tipo"), url.alias("url"), secc.alias("secc"))
    made = frame(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("nregistro"),
        F.col("p_name").alias("nombre"),
        F.col("p_type").alias("pactivos"),
        F.array(code("A", F.lit(1)), code("B", F.when(n % 2 == 0, 4).otherwise(2)), code("C", F.when(n % 2 == 0, 4).otherwise(3))).alias("atcs"),
        F.array(doc(F.lit(2), F.lit("http://other"), F.lit(True)), doc(F.when(n % 3 == 0, 1).otherwise(2), F.concat(F.lit("http://x/"), F.col("p_partkey").cast("string")), n % 2 == 0), doc(F.when(n % 3 == 0, 1).otherwise(3), F.lit("http://late"), F.lit(False))).alias("docs"),
    )
    return src.registry_records(made)


# Compositions ------------------------------------------------------------------------------


def _asked(spark, sf_dir):
    q = frame(spark, sf_dir, "asked")
    return q.join(frame(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector")), "question_id")


def _shelf(spark, sf_dir):
    return frame(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), (F.col("vec_id") % 50 + 1).cast("string").alias("register"))


_SEARCHED = f"""{_MENTIONS.replace(sql("questions"), sql("asked"))}, v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CAST(vec_id % 50 + 1 AS VARCHAR) AS register FROM embeddings),
ro AS (SELECT question_id, CASE WHEN count(*) = 1 THEN min(register) END AS own FROM e GROUP BY 1),
sc AS (SELECT ro.question_id, c.vec_id AS chunk_id, c.register, greatest(0.0, least(1.0, list_inner_product(w.e, c.e))) AS score FROM ro JOIN v w ON w.vec_id = ro.question_id JOIN v c ON ro.own IS NULL OR ro.own = c.register),
fo AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM sc)"""


@query(f"WITH {_SEARCHED} SELECT question_id, chunk_id, register, rank, round(score, 6) AS score FROM fo WHERE rank <= 5 AND score >= 0.1")
def search_by_entity(spark, sf_dir):
    return search.search(_asked(spark, sf_dir), frame(spark, sf_dir, "catalogue"), _shelf(spark, sf_dir), 5, 0.1).withColumn("score", F.round("score", 6))


@query(f"WITH {_SEARCHED}, b AS (SELECT question_id, count(*) AS found, min(chunk_id) AS least FROM fo WHERE rank <= 3 GROUP BY 1) SELECT q.question_id, contains(q.text, 'paciente') AS masked, coalesce(found, 0) AS found, least FROM ({sql('asked')}) q JOIN embeddings ON vec_id = q.question_id LEFT JOIN b ON b.question_id = q.question_id")
def evaluation_run(spark, sf_dir):
    masked, found = search.run_evaluation(_asked(spark, sf_dir), frame(spark, sf_dir, "catalogue"), _shelf(spark, sf_dir), 3)
    each = found.groupBy("question_id").agg(F.count("*").alias("found"), F.min("chunk_id").alias("least"))
    return masked.join(each, "question_id", "left").select("question_id", "masked", F.coalesce("found", F.lit(0)).alias("found"), "least")


@query(f"""{_BM25.replace("SELECT question_id, chunk_id, rank, round(score, 6) AS score FROM (SELECT *,", "SELECT question_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 10) AS score FROM (SELECT question_id, chunk_id, rank FROM (SELECT *,", 1)[: -len("WHERE rank <= 5")]} WHERE rank <= 8
UNION ALL SELECT question_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT i.item_id AS question_id, c.vec_id AS chunk_id, greatest(0.0, least(1.0, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])))) AS score FROM benchmark i JOIN embeddings q ON q.vec_id = i.item_id, embeddings c)) WHERE rank <= 8) GROUP BY 1, 2""")
def hybrid_bm25_cosine(spark, sf_dir):
    vectors = frame(spark, sf_dir, "embeddings")
    items = frame(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    chunks = frame(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text").filter("text is not null")
    asked = items.join(vectors.select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector")), "question_id").withColumn("only", F.lit(None).cast("string"))
    return retrieval.fuse([lexical.bm25(items, chunks, 8), retrieval.retrieve(asked, _chunks(spark, sf_dir), 8)], 16).select("question_id", "chunk_id", "score")


@query(f"WITH {_MARKED}, f AS (SELECT CAST(k.doc_id AS VARCHAR) AS register, regexp_extract(trim(l.text), '{_RE}', 1) AS number FROM a k JOIN l USING (doc_id, page, line) WHERE product = 1), o AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS register, '4.' || l_linenumber AS number FROM lineitem), ob AS (SELECT * FROM o WHERE number IN ({_NUMBERS})), r AS (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS register FROM part) SELECT register, (SELECT count(*) FROM ob WHERE ob.register = r.register) AS n_official, (SELECT count(*) FROM f WHERE f.register = r.register) AS n_detected, (SELECT count(*) FROM f JOIN ob USING (register, number) WHERE f.register = r.register) AS hits FROM r WHERE register IN (SELECT register FROM ob)")
def folder_validation(spark, sf_dir):
    found = sections.sections(frame(spark, sf_dir, "sheet_lines")).select(F.col("doc_id").cast("string").alias("register"), "product", "number")
    official = frame(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("register"), F.concat(F.lit("4."), F.col("l_linenumber").cast("string")).alias("number"))
    compared, _ = evaluation.validate_sheets(found, official, sections.NUMBERS)
    return evaluation.section_report(compared).select("register", "n_official", "n_detected", "hits")


@query(f"SELECT count(DISTINCT p_partkey) - count(DISTINCT CASE WHEN '4.' || l_linenumber IN ({_NUMBERS}) THEN p_partkey END) AS skipped FROM part LEFT JOIN lineitem ON l_partkey = p_partkey")
def folder_without_official(spark, sf_dir):
    found = sections.sections(frame(spark, sf_dir, "sheet_lines")).select(F.col("doc_id").cast("string").alias("register"), "product", "number")
    official = frame(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("register"), F.concat(F.lit("4."), F.col("l_linenumber").cast("string")).alias("number"))
    return evaluation.validate_sheets(found, official, sections.NUMBERS)[1]


_BOXES = "SELECT o_orderkey AS doc_id, 1 AS page, 10.0 AS x0, 20.4 AS y0, 50.0 AS x1, 60.0 AS y1, 'TABLE' AS text FROM orders WHERE o_orderkey % 2 = 0"
_BLOCKS = "SELECT l_orderkey AS doc_id, 1 AS page, 1.0 * (l_linenumber % 3) * 25 AS x0, 10.0 * l_linenumber + 0.2 * (l_partkey % 3) AS y0, 1.0 * (l_linenumber % 3) * 25 + 8 AS x1, 10.0 * l_linenumber + 8 AS y1, concat(' ', l_linenumber, l_returnflag, ' ') AS text FROM lineitem"


@query(f"""WITH b AS ({_BLOCKS}), x AS ({_BOXES}), k AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = b.doc_id AND (b.x0 + b.x1) / 2 >= x.x0 AND (b.x0 + b.x1) / 2 < x.x1 AND (b.y0 + b.y1) / 2 >= x.y0 AND (b.y0 + b.y1) / 2 < x.y1) UNION ALL SELECT * FROM x)
SELECT doc_id, CAST(page AS INT) AS page, string_agg(trim(text), chr(10) ORDER BY round(y0), x0, trim(text)) AS text FROM k GROUP BY 1, 2""")
def reading_order(spark, sf_dir):
    def made(text, table):
        df = spark.sql(text.replace(f"FROM {table}", "FROM {t}"), t=frame(spark, sf_dir, table))
        return df.select("doc_id", F.col("page").cast("int").alias("page"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], "text")

    return cleaning.reading_order(made(_BLOCKS, "lineitem"), made(_BOXES, "orders"))


@query("SELECT page_id AS doc_id FROM (SELECT page_id, length(trim(substr(html, 1, page_id % 260), ' ')) AS n FROM pages UNION ALL SELECT page_id, 40 FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, 0 FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, 0 FROM pages WHERE page_id % 2 = 0) GROUP BY 1 HAVING avg(n) < 100")
def scanned_documents(spark, sf_dir):
    pages = frame(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.left("html", (F.col("page_id") % 260).cast("int")).alias("text"))
    short = pages.filter("doc_id % 3 = 0").select("doc_id", F.explode(F.array(F.lit(" " + "x" * 40), F.lit("  "))).alias("text"))
    return src.unreadable_pages(pages.unionByName(short).unionByName(pages.filter("doc_id % 2 = 0").select("doc_id", F.lit("").alias("text"))))


@query("""WITH d AS (SELECT doc_id, regexp_replace(text, '[ .;,\\n]', '_', 'g') AS t FROM documents WHERE text <> ''),
w AS (SELECT doc_id, t, length(t) AS n, unnest(range(0, greatest(length(t) - 150, 1), 850)) AS i FROM d)
SELECT doc_id, CAST(i // 850 AS INT) AS part, CAST(i AS INT) AS start, substr(t, CAST(i + 1 AS BIGINT), 1000) AS text FROM w""")
def recursive_chunks_solid(spark, sf_dir):
    """The splitter where no separator but the last occurs: plain windows with its overlap."""
    text = F.translate("text", " .;,\n", "_____")
    docs = frame(spark, sf_dir, "documents").filter("text <> ''").select("doc_id", F.posexplode(chunking.pieces(text)).alias("part", "piece"))
    return docs.select("doc_id", "part", "piece.start", "piece.text")


_LONG = f"SELECT doc_id, page, line, CASE WHEN regexp_matches(text, '^[0-9]') THEN text ELSE repeat(text || '. ', 12 + CASE WHEN doc_id % 3 = 0 THEN 60 ELSE 0 END) END AS text FROM ({sql('sheet_lines')})"
_LONG_SECTIONS = _SECTIONS.replace(f"l AS ({sql('sheet_lines')})", f"l AS ({_LONG})")
#: The sheets' sections cut where they are longer than a chunk, with what their chunks show; documents with few sections as a whole.
_PARTS = f"""{_LONG_SECTIONS}, n AS (SELECT doc_id, count(*) AS n FROM se GROUP BY 1),
names AS (SELECT doc_id, product, max(CASE WHEN number = '1' AND text <> '' THEN trim(string_split(text, chr(10))[1]) END) AS name FROM se GROUP BY 1, 2),
sec AS (SELECT doc_id, section_id, product, number, title, text FROM se JOIN n USING (doc_id) WHERE n >= 8 AND length(text) >= 3
  UNION ALL SELECT doc_id, 0, 1, NULL, NULL, regexp_replace(string_agg(text, chr(10) ORDER BY page, line), '^\\n+|\\n+$', '', 'g') FROM l LEFT JOIN n USING (doc_id) WHERE coalesce(n, 0) < 8 GROUP BY doc_id),
keyed AS (SELECT *, doc_id || '/' || section_id AS key FROM sec), longs AS (SELECT key, text FROM keyed WHERE length(text) > 1500), {splitting.pieces("longs", 1000, 150, "pc")},
cut AS (SELECT key, part, text FROM pc UNION ALL SELECT key, 0, text FROM keyed WHERE length(text) <= 1500),
placed AS (SELECT k.* EXCLUDE (text), part, c.text AS piece, count(*) OVER (PARTITION BY key) AS parts, row_number() OVER (PARTITION BY k.doc_id ORDER BY section_id, part) - 1 AS position FROM cut c JOIN keyed k USING (key)),
chunks AS (SELECT CAST(doc_id AS VARCHAR) || CASE WHEN product > 1 THEN '::p' || product || '::' ELSE '::' END || coalesce(number, 'doc') || '::' || CASE WHEN number IS NULL THEN position ELSE part + 1 END AS chunk_id, doc_id, number AS section, part + 1 AS part, CAST(parts AS INT) AS parts,
  'https://cima.aemps.es/cima/dochtml/ft/' || doc_id || CASE WHEN number IS NULL THEN NULL ELSE '/' || number END || '/FichaTecnica.html' AS url,
  '[' || coalesce(nullif(CASE WHEN number IS NULL THEN NULL ELSE names.name END, ''), 'FT_' || doc_id || '.pdf') || CASE WHEN number IS NULL THEN '' ELSE ' · ' || number || ' ' || title END || CASE WHEN parts > 1 THEN ' · parte ' || (part + 1) || '/' || parts ELSE '' END || ']' || chr(10) || trim(piece, ' ') AS text
  FROM placed LEFT JOIN names USING (doc_id, product))"""


def _long_lines(spark, sf_dir):
    times = F.when(F.col("doc_id") % 3 == 0, 72).otherwise(12)
    return frame(spark, sf_dir, "sheet_lines").withColumn("text", F.when(F.col("text").rlike("^[0-9]"), F.col("text")).otherwise(F.repeat(F.concat("text", F.lit(". ")), times)))


@query(f"WITH RECURSIVE {_PARTS} SELECT chunk_id, doc_id, section, part, parts, url, text FROM chunks")
def sheet_parts(spark, sf_dir):
    """Chunks of sheets of which many sections are longer than a chunk: their parts, headers and addresses."""
    return _sheet_chunks(spark, sf_dir, _long_lines(spark, sf_dir)).select("chunk_id", "doc_id", "section", "part", "parts", "url", "text")


@query(f"""WITH RECURSIVE {_PARTS}, {_spans_of(_LONG, "_of")},
w AS (SELECT doc_id AS key, string_agg(text, chr(10) ORDER BY page, line) AS text FROM l GROUP BY 1), {splitting.pieces("w", 500, 75, "f5")}, {splitting.pieces("w", 1000, 150, "f10")},
ch AS (SELECT 'fijo_500' AS strategy, key AS doc_id, part, start AS s, start + length(text) AS e FROM f5 UNION ALL SELECT 'fijo_1000', key, part, start, start + length(text) FROM f10),
x AS (SELECT strategy, ch.doc_id, part, number FROM ch JOIN sp_of sp ON sp.doc_id = ch.doc_id AND sp.start < e AND "end" > s),
y AS (SELECT strategy, count(*) FILTER (WHERE n > 1) AS mixed FROM (SELECT strategy, doc_id, part, count(DISTINCT number) AS n FROM x GROUP BY ALL) GROUP BY 1),
z AS (SELECT strategy, count(*) FILTER (WHERE n > 1) AS broken FROM (SELECT strategy, doc_id, number, count(DISTINCT part) AS n FROM x WHERE number IN ({_KEYS}) GROUP BY ALL) GROUP BY 1),
whole AS (SELECT count(*) AS keys, count(*) FILTER (WHERE parts = 1) AS kept FROM (SELECT doc_id, section, max(parts) AS parts FROM chunks WHERE section IN ({_KEYS}) GROUP BY 1, 2))
SELECT strategy, count(*) AS chunks, CAST(floor(sum(e - s) / count(*)) AS BIGINT) AS mean_size, round(100 * coalesce(max(mixed), 0) / count(*)::DOUBLE, 4) AS mixed_percent, round(100 * (6 * count(DISTINCT doc_id) - coalesce(max(broken), 0)) / (6 * count(DISTINCT doc_id))::DOUBLE, 4) AS whole_key_percent FROM ch LEFT JOIN y USING (strategy) LEFT JOIN z USING (strategy) GROUP BY 1
UNION ALL SELECT 'por_seccion', count(*), CAST(floor(sum(length(text)) / count(*)) AS BIGINT), 0.0, (SELECT coalesce(round(100 * kept / nullif(keys, 0)::DOUBLE, 4), 0) FROM whole) FROM chunks""")
def strategy_comparison(spark, sf_dir):
    """The fixed sizes by the recursive splitter and the cut by section, over sheets of which each line is long."""
    lines = _long_lines(spark, sf_dir)
    whole = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    fixed = chunking.all_fixed_chunks(whole, chunking.FIXED)
    return chunking.strategy_metrics(fixed, sections.section_spans(lines)).unionByName(chunking.section_metrics(_sheet_chunks(spark, sf_dir, lines)))


_READ = "SELECT conv_id AS doc_id, turn + 1 AS page, text, CASE WHEN conv_id % 7 = 0 THEN 'blank' END AS error FROM conversations"


@query(f"WITH r AS ({_READ}), d AS (SELECT DISTINCT doc_id FROM r WHERE error IS NULL) SELECT (SELECT count(*) FROM d) AS documents, (SELECT count(error) FROM r) AS failures, (SELECT count(*) FROM part WHERE p_partkey % 5 = 0) AS unsectioned, (SELECT count(*) FROM part WHERE p_size % 4 = 0) AS multi_product, count(*) AS chunks, CAST(floor(sum(n) / count(*)) AS BIGINT) AS mean_size, max(CASE WHEN i = c // 2 THEN n END) AS median, min(n) AS least, max(n) AS most FROM (SELECT length(p_name) AS n, row_number() OVER (ORDER BY length(p_name)) - 1 AS i, count(*) OVER () AS c FROM part)")
def ingest_summary(spark, sf_dir):
    read = spark.sql(_READ.replace("FROM conversations", "FROM {t}"), t=frame(spark, sf_dir, "conversations"))
    part = frame(spark, sf_dir, "part")
    several = F.when(F.col("p_size") % 4 == 0, "::p2::").otherwise("::")
    chunks = part.select(F.col("p_partkey").alias("doc_id"), F.concat(F.col("p_partkey").cast("string"), several, F.lit("1")).alias("chunk_id"), F.when(F.col("p_partkey") % 5 == 0, "documento").otherwise("ficha_tecnica").alias("kind"), F.col("p_name").alias("text"))
    return ingest.ingest_summary(read, part.select(F.col("p_partkey").alias("doc_id"), F.lit(True).alias("is_sheet")), chunks)


@query(f"WITH {_SECTIONS}, n AS (SELECT doc_id, count(*) AS n FROM se GROUP BY 1) SELECT CASE WHEN n >= 8 THEN number ELSE 'sin sección' END AS section, count(DISTINCT CASE WHEN n >= 8 THEN doc_id || ':' || section_id ELSE CAST(doc_id AS VARCHAR) END) AS chunks FROM se JOIN n USING (doc_id) WHERE n < 8 OR length(text) >= 3 GROUP BY 1")
def chunks_per_section(spark, sf_dir):
    return ingest.chunks_per_section(_sheet_chunks(spark, sf_dir, frame(spark, sf_dir, "sheet_lines")))


@query(f"WITH {_SECTIONS}, n AS (SELECT doc_id, count(*) AS n FROM se GROUP BY 1) SELECT CAST(doc_id AS VARCHAR) || CASE WHEN product > 1 THEN '::p' || product || '::' ELSE '::' END || number || '::1' AS chunk_id, '[' || coalesce(nullif(max(CASE WHEN number = '1' THEN trim(string_split(text, chr(10))[1]) END) OVER (PARTITION BY doc_id, product), ''), 'FT_' || doc_id || '.pdf') || ' · ' || number || ' ' || title || ']' || chr(10) || trim(text) AS text, number AS section FROM se JOIN n USING (doc_id) WHERE n >= 8 QUALIFY length(se.text) >= 3 UNION ALL SELECT doc_id || '::doc::0', '[FT_' || doc_id || '.pdf]' || chr(10) || string_agg(text, chr(10) ORDER BY page, line), NULL FROM l JOIN n USING (doc_id) WHERE n < 8 GROUP BY doc_id")
def sheet_chunks(spark, sf_dir):
    """Identifiers, headers and texts of sheets whose sections all fit a chunk."""
    return _sheet_chunks(spark, sf_dir, frame(spark, sf_dir, "sheet_lines")).select("chunk_id", "text", "section")


@query("""SELECT p_partkey AS doc_id, n AS number, CASE n WHEN 0 THEN concat('[Tabla] Sistema | Frecuentes | Raras', chr(10), p_name, ' — Frecuentes: ', p_brand, '; Raras: ', p_type)
WHEN 1 THEN concat(p_brand, ' — Raras: ', p_name, chr(10), 'Frecuentes: ', p_type) WHEN 2 THEN concat(p_brand, ' | ', p_name) ELSE CASE WHEN p_size % 2 = 0 THEN concat(p_name, ' — Frecuentes: ', p_type, '; Raras: ', p_brand) ELSE concat(p_name, ' | ', p_type, ' | ', p_brand) END END AS text
FROM part, (VALUES (0::BIGINT), (1), (2), (3)) v(n) WHERE n <> 2 OR p_size % 2 = 1""")
def tables_carried_over(spark, sf_dir):
    """Several tables of a document: a header by frequencies, its carry-over, a table of another width that ends it, one without a header."""
    cells = lambda *xs: F.array(*[F.lit(x) if x in ("Sistema", "Frecuentes", "Raras", "") else F.col(x) for x in xs])
    tables = [F.array(cells("Sistema", "Frecuentes", "Raras"), cells("p_name", "p_brand", "p_type")), F.array(cells("p_brand", "", "p_name"), cells("", "p_type", "")), F.array(cells("p_brand", "p_name")), F.array(cells("p_name", "p_type", "p_brand"))]
    made = F.array(*[F.struct(F.lit(n).cast("long").alias("number"), t.alias("rows")) for n, t in enumerate(tables)])
    rows = frame(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_size", F.explode(made).alias("t")).filter("t.number <> 2 or p_size % 2 = 1")
    return cleaning.table_texts(rows.select("doc_id", "t.number", "t.rows"))


@query("""SELECT p_partkey AS doc_id, concat('4.2. Dosis ', p_brand, chr(10), '• ', p_name, ' según la sección 4.3.', chr(10), 'Texto ', repeat('x', p_size + 40), CASE WHEN p_size + 46 >= 70 THEN ' 48 horas ' ELSE concat(chr(10), '48 horas', chr(10)) END, 'extensa, (y más)', chr(10), '9. FECHA DE LA AUTORIZACIÓN', chr(10), '7. TITULAR', chr(10), upper(p_name), chr(10), chr(10), 'Fin') AS text FROM part""")
def pages_cleaned(spark, sf_dir):
    """Lone markers, open references, wrapped lines, hyphens and cut titles, where SQL can state the result."""
    lines = ["4.2.", "", F.concat(F.lit("Dosis  "), "p_brand"), "•", F.col("p_name"), "según la sección", "4.3.", F.concat(F.lit("Texto "), F.repeat(F.lit("x"), F.col("p_size") + 40)), "48 horas", "exten-", "sa", ", (y más)", "9. FECHA DE LA", "AUTORIZACIÓN", "7. TITULAR", F.upper("p_name"), "", "", "", "Fin —"]
    text = F.array_join(F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines]), "\n")
    part = spread(frame(spark, sf_dir, "part"), "p_partkey", len(lines))  # Python's work goes by rows
    return cleaning.clean_pages(part.select(F.col("p_partkey").alias("doc_id"), text.alias("text")))


_VECTOR = """SELECT {id} AS id, list_transform(range(64), lambda d: coalesce(len(list_filter(hit, lambda x: x = d)), 0)) AS v FROM (SELECT {id}, list_transform(regexp_extract_all(lower(text), '[\\pL\\pN_]+'), lambda w: ('0x' || right(md5(w), 7))::BIGINT % 64) AS hit FROM {table})"""


@query(f"""WITH d AS ({_VECTOR.format(id="doc_id", table="documents WHERE text IS NOT NULL")}), b AS ({_VECTOR.format(id="item_id", table="benchmark")}),
u AS (SELECT id, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1.0)) AS v FROM d), q AS (SELECT id, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1.0)) AS v FROM b),
s AS (SELECT q.id AS question_id, u.id AS chunk_id, round(least(1.0, list_inner_product(q.v::DOUBLE[], u.v::DOUBLE[])), 9) AS score FROM q, u)
SELECT question_id, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 5""")
def hashed_text_search(spark, sf_dir):
    """Texts to search without a given vector: hashed bags of words, then cosine over more than the five to return, as equal ones differ in the last bit."""
    texts = frame(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("chunk_id"), "text")
    asked = frame(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    chunks = durable(embedding.hashed_vectors(texts, "chunk_id").withColumn("register", F.lit(None).cast("string")))
    found = retrieval.retrieve(embedding.hashed_vectors(asked, "question_id").withColumn("only", F.lit(None).cast("string")), chunks, 40)
    best = retrieval.top(found.select("question_id", "chunk_id", F.round("score", 9).alias("score")), 5)
    return best.select("question_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


#: Uploads of all pages, new versions of some, deletions, and uploads once more, by turns.
_EVENT = "SELECT {} AS seq, '{}' AS kind, CAST(page_id AS STRING) AS doc_id, {} AS text FROM {{t}} WHERE page_id % {} = 0"
_TURNS = (
    _EVENT.format(1, "upload", "html", 1),
    _EVENT.format(2, "upload", "concat('v2. ', substr(html, 1, 1200))", 3),
    _EVENT.format(3, "delete", "CAST(NULL AS STRING)", 5),
    _EVENT.format(4, "upload", "substr(html, 1, 900)", 10) + " UNION ALL " + _EVENT.format(5, "delete", "html", 20),
)


@query(f"""WITH RECURSIVE e(seq, kind, doc_id, text) AS ({" UNION ALL ".join(x.format(t="pages") for x in _TURNS)}), last AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) = 1),
d AS (SELECT doc_id AS key, text FROM last WHERE kind = 'upload'), {splitting.pieces("d", 1000, 150, "p")} SELECT key || '::' || part AS chunk_id, key AS doc_id, part AS position, text FROM p""")
def document_events(spark, sf_dir):
    """The index after a stream of uploads and deletions, each turn in files of its own."""
    folder = scratch_folder(spark)
    pages = frame(spark, sf_dir, "pages")
    for k, turn in enumerate(_TURNS):
        spark.sql(turn, t=pages).write.mode("append").json(f"{folder}/events")
        events.follow(events.read_events(spark, f"{folder}/events"), f"{folder}/index", f"{folder}/checkpoint").awaitTermination()
    return index.open_index(spark, f"{folder}/index").select("chunk_id", "doc_id", "position", "text")
