"""The library's own queries, and SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docfield.functions import features as ff
from docfield.functions import lines as fl
from docfield.functions import values as fv
from docfield.operators import answers, chunks, documents, evaluation, ocr, pages, ranking
from docfield.operators.store import fresh_path, stored
from docfield.plans import fixtures as fx
from docfield.plans import service, sql
from docfield.sources import files
from docfield.streaming.ingest import text_chunks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PAGE_LINES = 5
AS_OF = dt.date(2024, 1, 1)


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as long, so that engines agree on types."""
    return df.select(*[F.col(f.name).cast("long").alias(f.name) if isinstance(f.dataType, (T.IntegerType, T.ShortType)) else F.col(f.name) for f in df.schema])


def query(oracle: str | None = None):
    def keep(function):
        QUERIES[function.__name__] = lambda spark, sf_dir: plain(function(spark, sf_dir))
        if oracle:
            ORACLE_SQL[function.__name__] = oracle
        return function

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str, task_rows: int = 5_000) -> DataFrame:
    """Small rows that grow to long texts, dealt to more tasks than their few files would give."""
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // task_rows))
    return rows.repartition(n, key)


_DOC_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents"
_CONTRACTS = fx.contract_lines_sql()


# --- lines ----------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, n, {sql.clean_line('line')} AS cleaned, {sql.squeezed('line')} AS squeezed, {sql.inline('line')} AS inlined FROM ({_DOC_LINES})")
def line_clean(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    x = F.col("line")
    return rows.select("doc_id", "n", fl.clean_line(x).alias("cleaned"), fl.squeezed_line(x).alias("squeezed"), fl.inline(x).alias("inlined"))


@query(f"SELECT doc_id, {sql.clean_text('text')} AS text FROM documents")
def page_text_clean(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", fl.clean_page_text(F.col("text")).alias("text"))


@query(f"SELECT doc_id, page_num, ln, {sql.furniture('line')} AS furniture, {sql.audit('line')} AS audit, {sql.clause('line')} AS clause, {sql.loose('line')} AS loose, {sql.content('line')} AS content, {sql.subclause('line')} AS subclause, {sql.heading('line')} AS heading, {sql.hint('line')} AS hint FROM ({_CONTRACTS}) WHERE line <> ''")
def line_classify(spark, sf_dir):
    x, names = F.col("line"), (("furniture", fl.is_furniture), ("audit", fl.is_audit), ("clause", fl.is_clause_start), ("loose", fl.is_loose_clause_start), ("content", fl.is_content), ("subclause", fl.is_subclause), ("heading", fl.is_heading), ("hint", fl.section_hint))
    return fx.contract_lines(spark, sf_dir).where("line <> ''").select("doc_id", "page_num", "ln", *[f(x).alias(n) for n, f in names])


@query(f"SELECT doc_id, key FROM (SELECT doc_id, n // {PAGE_LINES} AS page_num, lower({sql.clean_line('line')}) AS key FROM ({_DOC_LINES})) WHERE key <> '' AND length(key) <= 120 GROUP BY doc_id, key HAVING count(DISTINCT page_num) >= 2")
def repeated_lines(spark, sf_dir):
    return pages.repeated_lines(pages.text_lines(_table(spark, sf_dir, "documents"), PAGE_LINES))


# --- pages ----------------------------------------------------------------------------------------------

_SPLIT = f"""
lines AS (SELECT doc_id, page_num, ln, {sql.clean_line('line')} AS line FROM ({_CONTRACTS})),
marked AS (SELECT *, lower(line) AS key, {sql.content('line')} AS content, sum({sql.audit('line')}::INT) OVER p >= 3 AS audit FROM lines WINDOW p AS (PARTITION BY doc_id, page_num)),
near AS (SELECT *, coalesce(lag(content) OVER o, false) OR coalesce(lead(content) OVER o, false) AS near FROM marked WINDOW o AS (PARTITION BY doc_id, page_num ORDER BY ln)),
rep AS (SELECT doc_id, key FROM lines2 WHERE length(key) BETWEEN 1 AND 120 GROUP BY doc_id, key HAVING count(DISTINCT page_num) >= 2),
lines2 AS (SELECT doc_id, page_num, lower(line) AS key FROM lines),
parted AS (SELECT n.*, CASE WHEN line = '' THEN 'blank' WHEN audit THEN 'body' WHEN {sql.furniture('line')} THEN 'residual' WHEN rep.key IS NOT NULL THEN CASE WHEN content THEN 'body' ELSE 'residual' END WHEN content OR near THEN 'body' ELSE 'residual' END AS part FROM near n LEFT JOIN rep ON rep.doc_id = n.doc_id AND rep.key = n.key),
split_pages AS (SELECT doc_id, page_num,
  {sql.clean_text("coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (WHERE part = 'body' OR (part = 'blank' AND NOT audit)), '')")} AS body_text,
  {sql.clean_text("coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (WHERE part = 'residual'), '')")} AS residual_text
  FROM parted GROUP BY doc_id, page_num)""".replace("rep AS (", "REP(", 1)
# lines2 has to stand before rep
_head, _rest = _SPLIT.split("REP(", 1)
_rep, _rest = _rest.split(",\nlines2 AS ", 1)
_two, _rest = _rest.split("),\nparted", 1)
_SPLIT = f"{_head}lines2 AS {_two}),\nrep AS ({_rep},\nparted{_rest}"
_CELLS = "list_filter(['part ' || l_partkey, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity::BIGINT::VARCHAR ELSE '' END, l_returnflag], lambda c: c <> '')"
_TABLE = f"tables AS (SELECT l_orderkey AS doc_id, 2 AS page_num, string_agg(array_to_string({_CELLS}, ' | '), chr(10) ORDER BY l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity::BIGINT::VARCHAR END NULLS FIRST, l_returnflag) AS table_text FROM lineitem GROUP BY l_orderkey)"


def contract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = fx.contract_tables(spark, sf_dir).select("doc_id", "page_num", F.array(pages.table_text(F.col("table"))).alias("table_texts"))
    return pages.assembled(pages.split_pages(fx.contract_lines(spark, sf_dir)), tables)


@query(f"WITH {_SPLIT} SELECT * FROM split_pages")
def body_residual_split(spark, sf_dir):
    return pages.split_pages(fx.contract_lines(spark, sf_dir))


@query(f"WITH {_TABLE} SELECT doc_id, table_text FROM tables")
def table_text(spark, sf_dir):
    return fx.contract_tables(spark, sf_dir).select("doc_id", pages.table_text(F.col("table")).alias("table_text"))


_FULL = f"concat_ws(chr(10) || chr(10), nullif(body_text, ''), table_text, CASE WHEN residual_text <> '' THEN '{pages.MARKER}' || chr(10) || residual_text END)"


@query(f"WITH {_SPLIT}, {_TABLE} SELECT p.doc_id, p.page_num, {_FULL} AS full_text FROM split_pages p LEFT JOIN tables t USING (doc_id, page_num)")
def page_assemble(spark, sf_dir):
    return contract_pages(spark, sf_dir).select("doc_id", "page_num", "full_text")


@query("SELECT l_orderkey AS doc_id, string_agg(trim(l_linestatus || ' block ' || l_linenumber), chr(10) ORDER BY round_even(l_tax * 10.0, 1), round_even(l_quantity, 1), l_linenumber, l_linestatus) AS text FROM lineitem GROUP BY l_orderkey")
def text_blocks(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem")
    blocks = items.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_tax") * 10.0).alias("y0"), F.col("l_quantity").alias("x0"), F.col("l_linenumber").alias("block_no"), F.concat(F.lit(" "), "l_linestatus", F.lit(" block "), F.col("l_linenumber").cast("string")).alias("text"))
    return pages.block_text(blocks, "doc_id")


# --- chunks ---------------------------------------------------------------------------------------------

_CHUNKS = f"""{_SPLIT}, {_TABLE},
body AS (SELECT doc_id, page_num, unnest(string_split(body_text, chr(10))) AS raw, generate_subscripts(string_split(body_text, chr(10)), 1) AS n FROM split_pages WHERE body_text <> ''),
bodyl AS (SELECT doc_id, page_num, n, {sql.squeezed('raw')} AS line FROM body),
isle AS (SELECT *, sum(CASE WHEN {sql.clause('line')} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_num ORDER BY n) AS g FROM bodyl WHERE line <> ''),
parts AS (SELECT doc_id, page_num, 1 AS branch, g AS pos, string_agg(line, chr(10) ORDER BY n) AS text FROM isle GROUP BY doc_id, page_num, g
  UNION ALL SELECT doc_id, page_num, 2, 1, table_text FROM tables WHERE table_text <> '' UNION ALL SELECT doc_id, page_num, 3, 1, {sql.clean_text('residual_text')} FROM split_pages WHERE residual_text <> ''),
chunk0 AS (SELECT doc_id, page_num, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY branch, pos) AS chunk_idx, {sql.clean_text('text')} AS text FROM parts),
chunk AS (SELECT doc_id, page_num, chunk_idx, 'p' || page_num || '_c' || chunk_idx AS chunk_id, text, {sql.hint('text')} AS section_hint FROM chunk0)"""


@query(f"WITH {_CHUNKS} SELECT * FROM chunk")
def clause_chunks(spark, sf_dir):
    return chunks.chunk_pages(contract_pages(spark, sf_dir))


_CLAUSE = "'1. TERMS of ' || p_name || chr(10) || repeat('The buyer keeps all records of ' || p_brand || ' in good order; ', 20 + (p_partkey % 40)::INT) || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || '(a) ' || repeat('as the ' || p_type || ' was sold. ', (p_partkey % 100)::INT) || chr(10) || 'b. the end' ELSE '' END"
_OVERSIZED = f"""
WITH src AS (SELECT p_partkey AS doc_id, {sql.clean_text(_CLAUSE)} AS text FROM part),
rows AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM src WHERE length(text) > 1800),
lined AS (SELECT doc_id, text, n, {sql.squeezed('raw')} AS line FROM rows),
isle AS (SELECT *, sum(CASE WHEN {sql.subclause('line')} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS g FROM lined WHERE line <> ''),
part0 AS (SELECT doc_id, any_value(text) AS text, g, string_agg(line, chr(10) ORDER BY n) AS part FROM isle GROUP BY doc_id, g),
part1 AS (SELECT doc_id, g, CASE WHEN count(*) OVER (PARTITION BY doc_id) > 1 THEN part ELSE text END AS part FROM part0 UNION ALL SELECT doc_id, 0, text FROM src WHERE length(text) <= 1800),
cut AS (SELECT doc_id, g, {sql.packed('part')} AS xs FROM part1),
flat AS (SELECT doc_id, g, unnest(xs) AS text, generate_subscripts(xs, 1) AS n FROM cut)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g, n) AS n, text FROM flat"""


@query(_OVERSIZED)
def oversized_clauses(spark, sf_dir):
    p = spread(_table(spark, sf_dir, "part"), "p_partkey")
    key = F.col("p_partkey")
    body = F.repeat(F.concat(F.lit("The buyer keeps all records of "), "p_brand", F.lit(" in good order; ")), (20 + key % 40).cast("int"))
    tail = F.when(key % 2 == 0, F.concat(F.lit("\n(a) "), F.repeat(F.concat(F.lit("as the "), "p_type", F.lit(" was sold. ")), (key % 100).cast("int")), F.lit("\nb. the end"))).otherwise("")
    text = F.concat(F.lit("1. TERMS of "), "p_name", F.lit("\n"), body, tail)
    return p.select(key.alias("doc_id"), F.posexplode(chunks.split_clause(text)).alias("n", "text")).withColumn("n", F.col("n") + 1)


_PACKED = f"packed AS (SELECT doc_id, {sql.packed('t')} AS xs FROM (SELECT doc_id, {sql.clean_text('text')} AS t FROM documents)), docchunk AS (SELECT doc_id, generate_subscripts(xs, 1) AS chunk_idx, unnest(xs) AS text FROM packed)"


@query(f"WITH {_PACKED} SELECT doc_id, chunk_idx, text FROM docchunk")
def sentence_pack_chunks(spark, sf_dir):
    return text_chunks(_table(spark, sf_dir, "documents")).select("doc_id", "chunk_idx", "text")


# --- tokens and ranking ---------------------------------------------------------------------------------


@query(f"SELECT doc_id, len({sql.tokens('text')}) AS n_tokens, len({sql.long_terms('text')}) AS n_long_terms, len({sql.plain_tokens('text')}) AS n_plain, len({sql.query_terms('text')}) AS n_query_terms FROM documents")
def tokenize_terms(spark, sf_dir):
    x = F.col("text")
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(fl.index_tokens(x)).alias("n_tokens"), F.size(fl.long_terms(x)).alias("n_long_terms"), F.size(fl.plain_tokens(x)).alias("n_plain"), F.size(fl.query_terms(x)).alias("n_query_terms"))


_BM = """
post AS (SELECT doc_id, chunk_idx, term, count(*) AS tf FROM (SELECT doc_id, chunk_idx, unnest({tok}) AS term FROM docchunk) GROUP BY ALL),
dl AS (SELECT doc_id, chunk_idx, len({tok}) AS dl FROM docchunk), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, st GROUP BY term),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)""".format(tok=sql.tokens("text"))


@query(f"WITH {_PACKED}, {_BM} SELECT idf.term, df, cf, round(idf, 6) AS idf FROM idf JOIN (SELECT term, sum(tf)::BIGINT AS cf FROM post GROUP BY term) USING (term)")
def term_stats(spark, sf_dir):
    rows = text_chunks(_table(spark, sf_dir, "documents")).withColumn("scope", F.lit(1))
    posts = ranking.postings(rows, "scope", "doc_id", "chunk_idx")
    idf = ranking.bm25_idf(posts, ranking.corpus_stats(rows, ["scope"]), ["scope"])
    counts = posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return counts.join(idf, "term").select("term", "df", "cf", F.round("idf", 6).alias("idf"))


_TOP = "SELECT item_id, doc_id, chunk_idx, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, chunk_idx) AS rank FROM scored) WHERE rank <= 5"


def _top(scores: DataFrame, value: str) -> DataFrame:
    out = scores.select(F.col("request_id").alias("item_id"), "doc_id", "chunk_idx", F.round(value, 6).alias("score"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id", "chunk_idx")
    return out.withColumn("rank", F.row_number().over(order)).where("rank <= 5")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request_id"), F.lit(1).alias("scope"), F.col("text").alias("query"))


@query(f"""WITH {_PACKED}, {_BM},
asked AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest({sql.tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT item_id, doc_id, chunk_idx, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM asked JOIN post USING (term) JOIN idf USING (term) JOIN dl USING (doc_id, chunk_idx), st GROUP BY item_id, doc_id, chunk_idx) {_TOP}""")
def bm25_topk(spark, sf_dir):
    found = ranking.bm25_topk(text_chunks(_table(spark, sf_dir, "documents")), _asked(spark, sf_dir), ["doc_id", "chunk_idx"], 5)
    return found.withColumnRenamed("request_id", "item_id")


def _grams(x: str) -> str:
    w = rf"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+'), lambda w: length(w) >= 2)"
    return f"list_concat({w}, list_transform(range(1, len({w})), lambda i: ({w})[i] || ' ' || ({w})[i + 1]))"


@query(f"""WITH asked0 AS (SELECT item_id, unnest({_grams('text')}) AS term FROM benchmark), words AS (SELECT doc_id, 1 AS chunk_idx, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+') AS w0 FROM documents),
two AS (SELECT doc_id, chunk_idx, list_filter(w0, lambda x: length(x) >= 2) AS w FROM words),
tf AS (SELECT doc_id, chunk_idx, term, count(*) AS tf FROM (SELECT doc_id, chunk_idx, unnest(list_concat(w, list_transform(list_zip(w[1:len(w) - 1], w[2:]), lambda z: z[1] || ' ' || z[2]))) AS term FROM two) GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term), w AS (SELECT doc_id, chunk_idx, term, tf * idf AS w FROM tf JOIN idf USING (term)),
dn AS (SELECT doc_id, chunk_idx, sqrt(sum(w * w)) AS dn FROM w GROUP BY ALL),
asked AS (SELECT item_id, term, count(*) * any_value(idf) AS qw FROM asked0 JOIN idf USING (term) GROUP BY ALL), qn AS (SELECT item_id, sqrt(sum(qw * qw)) AS qn FROM asked GROUP BY ALL),
scored AS (SELECT item_id, doc_id, chunk_idx, round(sum(qw * w) / greatest(any_value(dn) * any_value(qn), 1e-12), 6) AS score FROM asked JOIN w USING (term) JOIN dn USING (doc_id, chunk_idx) JOIN qn USING (item_id) GROUP BY item_id, doc_id, chunk_idx) {_TOP}""")
def tfidf_topk(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("chunk_idx"), "text", F.lit(1).alias("scope"))
    return _top(ranking.tfidf_scores(rows, _asked(spark, sf_dir), ["scope"], ["doc_id", "chunk_idx"]), "semantic")


@query("SELECT query_id, vec_id, score, rank FROM (SELECT q.vec_id AS query_id, d.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) DESC, d.vec_id) AS rank FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0) WHERE rank <= 6")
def dense_cosine_topk(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings")
    return ranking.dense_topk(rows, rows.where("vec_id % 20 = 0"), 6)


def _features(t: str = "text") -> str:
    names = (("token_overlap", sql.overlap("query", t)), ("hint_overlap", sql.hint_overlap("query", "section_hint")), ("phrase", sql.phrase("query", t)), ("page", sql.page("query", "page_num")), ("recital", sql.recital("query", t, "page_num")))
    return ", ".join(f"({e})::DOUBLE AS {n}" for n, e in names)


@query(f"WITH {_CHUNKS}, req AS ({fx.requests_sql()}) SELECT request_id, page_num, chunk_idx, {_features()}, ({sql.label_boost('query', 'section_hint', 'text')})::DOUBLE AS label, {sql.junk('text')} AS junk, ({sql.size_penalty('text')})::DOUBLE AS size_penalty FROM req JOIN chunk USING (doc_id)")
def query_features(spark, sf_dir):
    q, t, h, p = F.col("query"), F.col("text"), F.col("section_hint"), F.col("page_num")
    rows = fx.requests(spark, sf_dir).join(chunks.chunk_pages(contract_pages(spark, sf_dir)), "doc_id")
    return rows.select("request_id", "page_num", "chunk_idx", ff.token_overlap(q, t).alias("token_overlap"), ff.hint_overlap(q, h).alias("hint_overlap"), ff.phrase(q, t).alias("phrase"), ff.page_boost(q, p).alias("page"), ff.recital_boost(q, t, p).alias("recital"), ff.label_boost(q, h, t).alias("label"), (ff.junk_penalty(t) > 0).alias("junk"), ff.size_penalty(t).alias("size_penalty"))


_HYBRID = f"""{_CHUNKS}, req AS ({fx.requests_sql()}),
post AS (SELECT doc_id, page_num, chunk_idx, term, count(*) AS tf FROM (SELECT doc_id, page_num, chunk_idx, unnest({sql.tokens('text')}) AS term FROM chunk) GROUP BY ALL),
dl AS (SELECT doc_id, page_num, chunk_idx, len({sql.tokens('text')}) AS dl FROM chunk), st AS (SELECT doc_id, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY doc_id),
raw AS (SELECT doc_id, term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post JOIN st USING (doc_id) GROUP BY doc_id, term), mean AS (SELECT doc_id, avg(raw) AS mean FROM raw GROUP BY doc_id),
idf AS (SELECT doc_id, term, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM raw JOIN mean USING (doc_id)),
qt AS (SELECT request_id, doc_id, term, count(*) AS qf FROM (SELECT request_id, doc_id, unnest({sql.tokens('query')}) AS term FROM req) GROUP BY ALL),
bm AS (SELECT request_id, page_num, chunk_idx, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM qt JOIN post USING (doc_id, term) JOIN idf USING (doc_id, term) JOIN dl USING (doc_id, page_num, chunk_idx) JOIN st USING (doc_id) GROUP BY ALL),
tf AS (SELECT doc_id, page_num, chunk_idx, term, count(*) AS tf FROM (SELECT doc_id, page_num, chunk_idx, unnest({_grams('text')}) AS term FROM chunk) GROUP BY ALL),
ti AS (SELECT doc_id, term, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM tf JOIN st USING (doc_id) GROUP BY doc_id, term),
w AS (SELECT doc_id, page_num, chunk_idx, term, tf * idf AS w FROM tf JOIN ti USING (doc_id, term)), dn AS (SELECT doc_id, page_num, chunk_idx, sqrt(sum(w * w)) AS dn FROM w GROUP BY ALL),
qw AS (SELECT request_id, doc_id, term, count(*) * any_value(idf) AS qw FROM (SELECT request_id, doc_id, unnest({_grams('query')}) AS term FROM req) JOIN ti USING (doc_id, term) GROUP BY ALL), qn AS (SELECT request_id, sqrt(sum(qw * qw)) AS qn FROM qw GROUP BY ALL),
sm AS (SELECT request_id, page_num, chunk_idx, sum(qw * w) / greatest(any_value(dn) * any_value(qn), 1e-12) AS semantic FROM qw JOIN w USING (doc_id, term) JOIN dn USING (doc_id, page_num, chunk_idx) JOIN qn USING (request_id) GROUP BY ALL),
s0 AS (SELECT r.request_id, r.query, c.*, round(coalesce(bm25, 0), 6) AS bm25, round(coalesce(semantic, 0), 6) AS semantic, {_features()} FROM req r JOIN chunk c USING (doc_id) LEFT JOIN bm USING (request_id, page_num, chunk_idx) LEFT JOIN sm USING (request_id, page_num, chunk_idx)),
s1 AS (SELECT *, min(bm25) OVER q AS b0, max(bm25) OVER q AS b1, min(semantic) OVER q AS m0, max(semantic) OVER q AS m1 FROM s0 WINDOW q AS (PARTITION BY request_id)),
s2 AS (SELECT *, CASE WHEN abs(b1 - b0) <= 1e-9 * greatest(abs(b1), abs(b0)) THEN 0.0 ELSE round((bm25 - b0) / (b1 - b0), 6) END AS bm25_norm, CASE WHEN abs(m1 - m0) <= 1e-9 * greatest(abs(m1), abs(m0)) THEN 0.0 ELSE round((semantic - m0) / (m1 - m0), 6) END AS semantic_norm FROM s1),
s3 AS (SELECT *, 0.34 * bm25_norm + 0.34 * semantic_norm + 0.07 * token_overlap + 0.03 * hint_overlap + 0.05 * phrase + 0.07 * page + 0.10 * recital AS combined FROM s2),
scores AS (SELECT *, round(0.34 * combined + 0.18 * bm25_norm + 0.16 * semantic_norm + 0.10 * phrase + 0.08 * token_overlap + 0.04 * hint_overlap + 0.03 * page + 0.03 * recital + {sql.label_boost('query', 'section_hint', 'text')} - CASE WHEN {sql.junk('text')} THEN 0.20 ELSE 0.0 END - {sql.size_penalty('text')}, 6) AS rerank FROM s3)"""


def _hybrid(spark: SparkSession, sf_dir: str, columns: list[str], by: str | None = None) -> DataFrame:
    return documents.scored(fx.contract_documents(spark, sf_dir), fx.requests(spark, sf_dir), columns, by)


@query(f"WITH {_HYBRID} SELECT request_id, chunk_id, page_num, section_hint, bm25_norm::DOUBLE AS bm25_norm, semantic_norm::DOUBLE AS semantic_norm, token_overlap, hint_overlap, phrase, page, recital, rerank::DOUBLE AS rerank, {sql.junk('text')} AS junk, text FROM scores")
def hybrid_scores_debug(spark, sf_dir):
    return _hybrid(spark, sf_dir, ["request_id", "chunk_id", "page_num", "section_hint", "bm25_norm", "semantic_norm", "token_overlap", "hint_overlap", "phrase", "page", "recital", "rerank", "junk", "text"])


@query(f"""WITH {_HYBRID}, k0 AS (SELECT *, count(*) OVER (PARTITION BY request_id) AS n FROM scores), k1 AS (SELECT *, greatest(least(CASE WHEN {sql.party('query')} THEN 8 ELSE 5 END, n), 1) AS k FROM k0),
k2 AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY bm25_norm DESC, page_num, chunk_idx) AS rb, row_number() OVER (PARTITION BY request_id ORDER BY semantic_norm DESC, page_num, chunk_idx) AS rs FROM k1),
k3 AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rerank DESC, page_num, chunk_idx) AS rank FROM k2 WHERE rb <= least(n, greatest(16, 4 * k)) OR rs <= least(n, greatest(16, 4 * k)))
SELECT request_id, chunk_id, rank, rerank::DOUBLE AS rerank FROM k3 WHERE rank <= k""")
def hybrid_topk(spark, sf_dir):
    return _hybrid(spark, sf_dir, ["request_id", "chunk_id", "rank", "rerank"], "hybrid")


def _single(by: str) -> str:
    return f"WITH {_HYBRID} SELECT request_id, chunk_id, rank, score FROM (SELECT request_id, chunk_id, {by}::DOUBLE AS score, row_number() OVER (PARTITION BY request_id ORDER BY {by} DESC, phrase DESC, token_overlap DESC, hint_overlap DESC, page_num, chunk_idx) AS rank FROM scores) WHERE rank <= 6"


@query(_single("bm25_norm"))
def bm25_only_topk(spark, sf_dir):
    return _hybrid(spark, sf_dir, ["request_id", "chunk_id", "rank", "bm25_norm"], "bm25_norm").withColumnRenamed("bm25_norm", "score")


@query(_single("semantic_norm"))
def semantic_only_topk(spark, sf_dir):
    return _hybrid(spark, sf_dir, ["request_id", "chunk_id", "rank", "semantic_norm"], "semantic_norm").withColumnRenamed("semantic_norm", "score")


# --- prompts, responses, values -------------------------------------------------------------------------

_LIT = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query(f"""WITH {_CHUNKS}, req AS ({fx.requests_sql()}), ev AS (SELECT doc_id, string_agg('Chunk ID: ' || chunk_id || chr(10) || 'Page: ' || page_num || CASE WHEN coalesce(section_hint, '') <> '' THEN chr(10) || 'Section: ' || section_hint ELSE '' END || chr(10) || 'Text:' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page_num, chunk_idx) AS ev FROM chunk GROUP BY doc_id)
SELECT request_id, {_LIT(answers.INSTRUCTIONS)} || chr(10) || chr(10) || 'Query: ' || query || chr(10) || 'Output type: ' || output_type || chr(10) || chr(10) || {_LIT(answers.RULES)} || chr(10) || chr(10) || CASE WHEN request_id % 3 = 0 THEN 'Few-shot examples:' || chr(10) || 'Example 1' || chr(10) || 'Input:' || chr(10) || '{{' || chr(10) || '  "q": 1' || chr(10) || '}}' || chr(10) || 'Output:' || chr(10) || '{{' || chr(10) || '  "v": 2' || chr(10) || '}}' || chr(10) || chr(10) ELSE '' END || 'Evidence:' || chr(10) || ev AS prompt FROM req JOIN ev USING (doc_id)""")
def prompt_build(spark, sf_dir):
    rows = chunks.chunk_pages(contract_pages(spark, sf_dir)).withColumn("rank", F.col("page_num") * 1000 + F.col("chunk_idx"))
    req = fx.requests(spark, sf_dir)
    shots = F.when(F.col("request_id") % 3 == 0, F.array(F.struct(F.lit('{"q": 1}').alias("input"), F.lit('{"v": 2}').alias("output"))))
    ranked = req.join(rows, "doc_id")
    return req.join(answers.evidence_of(ranked), "request_id").select("request_id", answers.prompt(F.col("query"), F.col("output_type"), F.col("chunks"), shots).alias("prompt"))


_RESPONSE = "CASE doc_id % 9 WHEN 0 THEN '{\"found\": true, \"value\": ' || k || ', \"evidence_chunk_ids\": [\"c' || k % 3 || '\"]}' WHEN 1 THEN '{\"found\": false, \"value\": 3, \"evidence_chunk_ids\": []}' WHEN 2 THEN '{\"found\": 1}' WHEN 3 THEN '[1, 2]' WHEN 4 THEN '{\"found\": true, \"evidence_chunk_ids\": \"c1\"}' WHEN 5 THEN '{\"found\": true, \"value\": \"x\", \"evidence_chunk_ids\": [\" \"]}' WHEN 6 THEN 'not JSON ' || k WHEN 7 THEN '```json' || chr(10) || '{\"found\": true, \"value\": \"' || k || '\", \"evidence_chunk_ids\": [\" c1 \"]}' || chr(10) || '```' ELSE '{\"found\": false, \"evidence_chunk_ids\": [\"c9\"]}' END"


@query("""SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN CASE WHEN k % 3 = 2 THEN 'a chunk id is unknown' END WHEN 2 THEN 'found is not a boolean' WHEN 3 THEN 'response is not an object' WHEN 4 THEN 'evidence_chunk_ids is not a list' WHEN 5 THEN 'a chunk id is not text' WHEN 6 THEN 'response is not JSON' WHEN 8 THEN 'a chunk id is unknown' END AS parse_error,
CASE doc_id % 9 WHEN 0 THEN CASE WHEN k % 3 <> 2 THEN true END WHEN 1 THEN false WHEN 7 THEN true END AS found,
CASE WHEN doc_id % 9 = 0 AND k % 3 <> 2 THEN k::VARCHAR WHEN doc_id % 9 = 7 THEN k::VARCHAR END AS value_text, CASE WHEN doc_id % 9 = 0 AND k % 3 <> 2 THEN 'number' WHEN doc_id % 9 = 7 THEN 'string' ELSE 'null' END AS value_kind,
CASE WHEN doc_id % 9 = 0 AND k % 3 <> 2 THEN 'c' || k % 3 WHEN doc_id % 9 = 7 THEN 'c1' ELSE '' END AS ids FROM (SELECT event_id AS doc_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events)""")
def response_parse(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    given = rows.withColumn("response_text", F.expr(_RESPONSE.replace("chr(10)", "char(10)")))
    out = answers.parsed_responses(given, F.array(F.lit("c0"), F.lit("c1")))
    return out.select("doc_id", "parse_error", "found", "value_text", "value_kind", F.array_join("ids", ",").alias("ids"))


_NUM = f"regexp_extract(replace({{x}}, ',', ''), '(?:^|[^A-Za-z0-9])([-+]?\\d+(?:\\.\\d+)?)(?:[^A-Za-z0-9]|$)', 1)"
_MONEY = "CASE o_orderkey % 6 WHEN 0 THEN 'Rs. ' || amount_text WHEN 1 THEN amount || '.50%' WHEN 2 THEN 'INR' || amount WHEN 3 THEN '(' || amount_text || ')  only' WHEN 4 THEN '-' || amount || ' and 7' ELSE 'no amount' END"


def _money(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.truth(spark, sf_dir).withColumnRenamed("doc_id", "o_orderkey").select("o_orderkey", F.expr(_MONEY).alias("text"))


_MONEY_SQL = f"SELECT o_orderkey, {_MONEY} AS text FROM (SELECT *, doc_id AS o_orderkey FROM ({fx.truth_sql()}))"


@query(f"SELECT o_orderkey, nullif({_NUM.format(x='text')}, '') AS number_text, CASE WHEN NOT contains({_NUM.format(x='text')}, '.') THEN TRY_CAST({_NUM.format(x='text')} AS BIGINT) END AS whole, TRY_CAST({_NUM.format(x='text')} AS DOUBLE) AS number, TRY_CAST(replace(regexp_extract(text, '[-+]?\\d[\\d,]*(?:\\.\\d+)?', 0), ',', '') AS DOUBLE) AS loose FROM ({_MONEY_SQL})")
def validate_number(spark, sf_dir):
    x = F.col("text")
    return _money(spark, sf_dir).select("o_orderkey", fv.number_text(x).alias("number_text"), fv.number_long(x).alias("whole"), fv.number_double(x).alias("number"), fv.loose_number(x).alias("loose"))


@query(f"SELECT doc_id, nullif({sql.inline('text')}, '') AS text FROM documents")
def validate_string(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", fv.clean_string(F.col("text")).alias("text"))


_SHAPES = ("yyyy-MM-dd", "%Y-%m-%d"), ("dd/MM/yyyy", "%d/%m/%Y"), ("d MMM yyyy", "%-d %b %Y"), ("d MMMM yyyy", "%-d %B %Y"), ("MMMM d, yyyy", "%B %-d, %Y"), ("d'th' MMM yyyy", "%-dth %b %Y")
_SHOWN = "CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN strftime(o_orderdate, '{s}')" for i, (_, s) in enumerate(_SHAPES)) + " END"
_ISO = "CASE WHEN o_orderkey % 6 = 0 AND day(o_orderdate) <= 12 THEN strftime(o_orderdate, '%Y-%d-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END"


@query(f"SELECT o_orderkey, {_SHOWN} AS shown, {_ISO} AS iso, strftime(o_orderdate, '%Y-%m-%d') AS strict FROM orders")
def validate_date_formats(spark, sf_dir):
    shown = F.element_at(F.array(*[F.date_format("o_orderdate", s) for s, _ in _SHAPES]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", shown.alias("shown"))
    return rows.select("o_orderkey", "shown", fv.date_iso(F.col("shown")).alias("iso"), fv.date_iso(F.col("shown"), strict_iso=True).alias("strict"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (2, 5) THEN NULL ELSE CASE WHEN contains({_NUM.format(x='text')}, '.') THEN TRY_CAST({_NUM.format(x='text')} AS DOUBLE)::VARCHAR ELSE {_NUM.format(x='text')} END || ';12' END AS numbers, CASE WHEN o_orderkey % 6 IN (2, 5) THEN 'value does not fit its type' END AS value_error FROM ({_MONEY_SQL})")
def validate_arrays(spark, sf_dir):
    rows = _money(spark, sf_dir).select("o_orderkey", F.lit("array[number]").alias("output_type"), F.concat(F.lit('{"found": true, "value": ["'), "text", F.lit('", 12]}')).alias("response_text"))
    out = answers.validated(answers.parsed_responses(rows, F.array().cast("array<string>")))
    return out.select("o_orderkey", F.array_join("normalized", ";").alias("numbers"), "value_error")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ';' || strftime(o_orderdate, '%Y-%m-%d') || ';2024-03-05' END AS dates, CASE WHEN o_orderkey % 5 = 0 THEN 'value does not fit its type' END AS value_error FROM orders")
def validate_date_arrays(spark, sf_dir):
    """Lists of dates: inside other text, with the month first, in a usual shape; each fifth list has an item without a date."""
    free = F.concat(F.lit("signed on the "), F.date_format("o_orderdate", "d"), F.lit("th of "), F.date_format("o_orderdate", "MMMM yyyy"), F.lit(" in town"))
    last = F.when(F.col("o_orderkey") % 5 == 0, "no day at all").otherwise("5 March 2024")
    text = F.concat(F.lit('{"found": true, "value": ["'), free, F.lit('", "'), F.date_format("o_orderdate", "MMM d, yyyy"), F.lit('", "'), last, F.lit('"]}'))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.lit("array[date]").alias("output_type"), text.alias("response_text"))
    out = answers.validated(answers.parsed_responses(rows, F.array().cast("array<string>")), AS_OF)
    return out.select("o_orderkey", F.array_join("normalized", ";").alias("dates"), "value_error")


@query()
def nfkc_normalize(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", fv.comparable(F.col("text")).alias("text"))


@query()
def fuzzy_date(spark, sf_dir):
    text = F.concat(F.lit("signed on the "), F.date_format("o_orderdate", "d"), F.lit("th of "), F.date_format("o_orderdate", "MMMM yyyy"), F.lit(" in town"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", fv.any_date(text, AS_OF).alias("iso"))


_TRIM = f"CASE WHEN length({{x}}) <= 300 THEN {{x}} ELSE regexp_replace(substring({{x}}, 1, 297), '\\s+$', '') || '...' END"
_SNIPPETS = f"""{_CHUNKS}, req AS ({fx.requests_sql()}),
pl AS (SELECT doc_id, page_num, chunk_idx, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM chunk),
pm AS (SELECT doc_id, page_num, chunk_idx, n, {sql.strip('raw')} AS line FROM pl), pb AS (SELECT *, coalesce(lag(line = '') OVER (PARTITION BY doc_id, page_num, chunk_idx ORDER BY n), true) OR {sql.loose('line')} AS cut FROM pm),
pg AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_num, chunk_idx ORDER BY n) AS g FROM pb WHERE line <> ''),
pp AS (SELECT doc_id, page_num, chunk_idx, g, string_agg(line, chr(10) ORDER BY n) AS passage FROM pg GROUP BY ALL),
ps AS (SELECT r.request_id, r.query, p.*, lower({sql.inline('passage')}) AS low, {sql.inline('passage')} AS flat FROM req r JOIN pp p USING (doc_id)),
pz AS (SELECT *, round(CASE WHEN contains(low, lower(query)) THEN 6.0 ELSE 0 END + CASE WHEN len({sql.query_terms('query')}) > 0 THEN 4.0 * len(list_intersect({sql.query_terms('query')}, list_distinct({sql.plain_tokens('flat')}))) / len({sql.query_terms('query')}) ELSE 0 END
  + CASE WHEN contains(lower(query), 'govern') AND (contains(low, 'applicable law') OR contains(low, 'governing law')) THEN 3.0 ELSE 0 END + CASE WHEN length(flat) BETWEEN 80 AND 1200 THEN 0.5 ELSE 0 END, 6) AS score FROM ps),
sn AS (SELECT request_id, page_num, chunk_idx, {_TRIM.format(x='flat')} AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY request_id, page_num, chunk_idx ORDER BY score DESC, g) AS r FROM pz) WHERE r = 1)"""


@query(f"WITH {_SNIPPETS} SELECT * FROM sn")
def passage_snippets(spark, sf_dir):
    rows = fx.requests(spark, sf_dir).join(chunks.chunk_pages(contract_pages(spark, sf_dir)), "doc_id")
    return rows.select("request_id", "page_num", "chunk_idx", answers.snippet(F.col("text"), F.col("query"), F.array().cast("array<string>")).alias("snippet"))


# --- the whole service ----------------------------------------------------------------------------------


def contract_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = fx.requests(spark, sf_dir, 50).join(fx.replay(spark, sf_dir).withColumnRenamed("response_text", "replay"), "request_id", "left")
    return service.extract_documents(fx.contract_documents(spark, sf_dir), asked, lambda rows: answers.recorded(rows, "replay"), as_of=AS_OF)


_CODE = "CASE doc_id % 20 WHEN 3 THEN 'LLM_ERROR' WHEN 5 THEN 'SERVICE_ERROR' WHEN 9 THEN CASE doc_id % 4 WHEN 1 THEN 'WEAK_EVIDENCE' END WHEN 11 THEN 'SERVICE_ERROR' WHEN 13 THEN 'SERVICE_ERROR' WHEN 15 THEN 'SERVICE_ERROR' END"
_VALUE = "CASE doc_id % 4 WHEN 0 THEN amount::VARCHAR WHEN 1 THEN n_name WHEN 2 THEN CASE WHEN day(signed::DATE) <= 12 THEN strftime(signed::DATE, '%Y-%d-%m') ELSE signed END ELSE c_name || ';' || person END"


_VARIANTS = f"va AS (SELECT doc_id AS request_id, CASE doc_id % 4 WHEN 0 THEN ['rs. ' || amount_text, amount::VARCHAR] WHEN 1 THEN [lower(n_name)] WHEN 2 THEN list_distinct([signed, {_VALUE}]) ELSE [] END AS variants FROM ({fx.truth_sql()}))"
_CITED = "cited AS (SELECT * FROM (VALUES (0, 1, 1, 3), (1, 1, 2, 2), (2, 1, 2, 4), (2, 2, 1, 1), (3, 1, 1, 2)) AS v(kind, place, page_num, chunk_idx))"
_CITED_SNIPPETS = _SNIPPETS.replace("ps AS (", f"{_VARIANTS}, {_CITED}, ps AS (", 1).replace(", 6) AS score FROM ps)", " + 2.0 * len(list_filter(variants, lambda v: contains(low, v))), 6) AS score FROM ps JOIN va USING (request_id))")


@query(f"""WITH {_CITED_SNIPPETS} SELECT doc_id AS request_id, ok AS found, code AS error_code, CASE WHEN ok THEN {_VALUE} END AS value, CASE WHEN ok THEN src ELSE '' END AS sources
FROM (SELECT *, {_CODE} AS code, ({_CODE}) IS NULL AND doc_id % 20 <> 7 AS ok FROM ({fx.truth_sql()}) t
  LEFT JOIN (SELECT request_id, string_agg(page_num || ':' || snippet, '|' ORDER BY c.place) AS src FROM sn JOIN cited c USING (page_num, chunk_idx) WHERE request_id % 4 = c.kind GROUP BY request_id) s ON s.request_id = t.doc_id)""")
def extract_service(spark, sf_dir):
    out = contract_responses(spark, sf_dir)
    shown = F.transform("sources", lambda s: F.concat(s["page"].cast("string"), F.lit(":"), s["snippet"]))
    return out.select("request_id", "found", "error_code", F.array_join("value", ";").alias("value"), F.array_join(shown, "|").alias("sources"))


# --- sources and sinks ----------------------------------------------------------------------------------


def _lines_as_blocks(content: bytes) -> list[tuple]:
    """A parser of plain text: five lines a page, a block for each line, a table beside the first."""
    lines = content.decode().split("\n")
    return [(n // PAGE_LINES + 1, n % PAGE_LINES, 0.0, float(n % PAGE_LINES), line, [[[str(len(line)), " x "], [None, ""]]] if n % PAGE_LINES == 0 else None) for n, line in enumerate(lines)]


@query(f"""SELECT doc_id::VARCHAR AS doc_id, n // {PAGE_LINES} + 1 AS page_num, n % {PAGE_LINES} AS block_no, line AS text, CASE WHEN n % {PAGE_LINES} = 0 THEN length(line) || ' | x' ELSE '' END AS table_text, NULL AS error FROM ({_DOC_LINES}) WHERE doc_id % 50 <> 0
UNION ALL SELECT doc_id::VARCHAR, NULL, NULL, NULL, '', 'failed to parse: the document is empty' FROM documents WHERE doc_id % 50 = 0""")
def parsed_blocks(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.when(F.col("doc_id") % 50 != 0, F.encode("text", "UTF-8")).alias("content"))
    out = files.parsed_documents(docs, _lines_as_blocks)
    return out.select("doc_id", "page_num", "block_no", "text", pages.table_text(F.get("tables", F.lit(0))).alias("table_text"), "error")


@query(f"SELECT {fx.CROP} AS crop_id, 777 AS img_width, count(*) AS n_steps, NULL::VARCHAR AS gt FROM embeddings GROUP BY ALL")
def softmax_source(spark, sf_dir):
    path = fresh_path(spark, "softmax")
    fx.ocr_crops(spark, sf_dir).withColumn("gt", F.lit(None).cast("string")).write.parquet(path)
    return files.softmax_crops(spark, path).select("crop_id", "img_width", F.size("softmax").alias("n_steps"), "gt")


_RESULT = "event_id AS case_id, concat('doc', cast(event_id % 7 AS VARCHAR(10))) AS doc_name, concat('say \"', cast(event_id AS VARCHAR(20)), '\", twice') AS query, 'string' AS output_type, event_id % 2 = 0 AS expected_found, 'path' AS input_mode, event_id % 3 = 0 AS used_examples, event_id % 5 <> 0 AS match_pass, true AS found_match, event_id % 11 <> 0 AS type_valid, true AS source_valid, 0.25 AS latency_sec"


@query(f"SELECT kind, case_id::VARCHAR AS case_id, doc_name, query, expected_found, used_examples, match_pass, type_valid FROM (SELECT {_RESULT} FROM events), (SELECT unnest(['csv', 'json', 'parquet']) AS kind)")
def result_sinks(spark, sf_dir):
    rows, out = spark.sql(f"SELECT {_RESULT} FROM {{events}}", events=_table(spark, sf_dir, "events")), None
    for kind in ("csv", "json", "parquet"):
        path = fresh_path(spark, f"results-{kind}")
        files.write_results(rows, path, kind)
        back = spark.read.format(kind).options(**({"header": "true"} if kind == "csv" else {})).load(path)
        part = back.select(F.lit(kind).alias("kind"), F.col("case_id").cast("string").alias("case_id"), "doc_name", "query", *[F.col(c).cast("boolean").alias(c) for c in ("expected_found", "used_examples", "match_pass", "type_valid")])
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'NO_FILE' WHEN event_id % 7 = 1 THEN 'NO_QUERY' WHEN event_id % 7 = 2 THEN 'INVALID_OUTPUT_TYPE' WHEN event_id % 7 = 3 THEN 'BAD_EXAMPLES_JSON' WHEN event_id % 7 = 4 THEN 'BAD_EXAMPLES' END AS request_error FROM events""")
def request_checks(spark, sf_dir):
    e, n = _table(spark, sf_dir, "events"), F.col("event_id") % 7
    rows = e.select("event_id", F.when(n != 0, F.col("event_id")).alias("doc_id"), F.when(n == 1, "  ").otherwise(" a query ").alias("query"), F.when(n == 2, "text").otherwise("string").alias("output_type"), F.when(n == 3, "[1,").when(n == 4, F.col("props")).when(n == 5, F.concat(F.lit("["), "props", F.lit("]"))).alias("examples"))
    return service.checked_requests(rows).select("event_id", "request_error")


@query("SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS input, json_extract_string(props, '$.k') AS output FROM events")
def examples_json(spark, sf_dir):
    text = F.concat(F.lit('[{"input": '), "props", F.lit(', "output": '), F.get_json_object("props", "$.k"), F.lit("}]"))
    shots = _table(spark, sf_dir, "events").select("event_id", F.get(files.examples(text), F.lit(0)).alias("x"))
    return shots.select("event_id", "x.input", "x.output")


# --- evaluation -----------------------------------------------------------------------------------------

_MATCHES = "CASE doc_id % 9 WHEN 0 THEN 'string_exact' WHEN 1 THEN 'string_contains' WHEN 2 THEN 'string_contains_any' WHEN 3 THEN 'number_exact' WHEN 4 THEN 'date_exact' WHEN 5 THEN 'array_string_subset' WHEN 6 THEN 'array_date_exact' WHEN 7 THEN 'array_number_exact' ELSE 'not_found' END"


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for each contract: the truth as expected, a rendering of it as predicted, wrong at some remainders of doc_id by 11."""
    t = fx.truth(spark, sf_dir)
    n, wrong = F.col("doc_id") % 9, F.col("doc_id") % 11 == 0
    amount, other = F.col("amount").cast("string"), F.lit("something else")
    expected = F.when(n == 3, F.array(amount)).when(n == 4, F.array("signed")).when(n == 5, F.array("c_name", "person")).when(n == 6, F.array(F.lit("2024-01-02"), F.col("signed"))).when(n == 7, F.array(amount, F.lit("2.5"))).otherwise(F.array("c_name"))
    right = F.when(n == 0, F.array(F.concat(F.lit("  "), F.upper("c_name")))).when(n.isin(1, 2), F.array(F.concat(F.lit("by "), "c_name", F.lit(" here")))).when(n == 3, F.array(F.concat(F.lit("Rs. "), "amount_text"))).when(n == 4, F.array("signed")).when(n == 5, F.array(F.concat(F.lit("M/s "), "c_name"), F.col("person"))).when(n == 6, F.array(F.col("signed"), F.lit("2024-01-02"))).when(n == 7, F.array(amount, F.lit("2.50"))).otherwise(F.array("c_name"))
    found = (n != 8) | wrong
    kind = F.when(n.isin(5, 6, 7), "array").when(n == 3, "string").otherwise("string")
    return t.select("doc_id", F.concat(F.lit("doc "), (F.col("doc_id") % 6).cast("string")).alias("doc_name"), F.expr(_MATCHES).alias("match_type"), (n != 8).alias("expected_found"), found.alias("found"), expected.alias("expected"), F.array(F.lit("nobody"), F.lower("c_name")).alias("expected_any"), F.when(wrong, F.array(other)).otherwise(right).alias("pred"), F.when(found, kind).otherwise("null").alias("kind"), F.when(n.isin(5, 7), "array[string]").when(n == 6, "array[date]").when(n == 4, "date").when(n == 3, "number").otherwise("string").alias("output_type"), F.when(F.col("doc_id") % 2 == 0, "path").otherwise("bytes").alias("input_mode"))


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.matched(_cases(spark, sf_dir), ascii_only=True)
    items = F.transform("pred", lambda x: F.lit("string"))
    valid = evaluation.type_valid(F.col("kind"), F.col("pred"), items, F.col("output_type"))
    sources = F.when(F.col("found") & (F.col("doc_id") % 13 != 0), F.array(F.struct(F.lit(1).alias("page"), F.col("doc_name").alias("snippet")))).otherwise(F.array().cast("array<struct<page:int,snippet:string>>"))
    return rows.withColumn("found_match", F.col("expected_found") == F.col("found")).withColumn("type_valid", valid).withColumn("source_valid", evaluation.source_valid(sources, F.col("expected_found"))).withColumn("latency_sec", (F.col("doc_id") % 8) / 4)


_EVAL = f"""SELECT doc_id, 'doc ' || doc_id % 6 AS doc_name, {_MATCHES} AS match_type, CASE WHEN doc_id % 9 = 5 OR doc_id % 9 = 7 THEN 'array[string]' WHEN doc_id % 9 = 6 THEN 'array[date]' WHEN doc_id % 9 = 4 THEN 'date' WHEN doc_id % 9 = 3 THEN 'number' ELSE 'string' END AS output_type,
doc_id % 11 <> 0 AS match_pass, doc_id % 9 <> 8 OR doc_id % 11 <> 0 AS found_match, CASE doc_id % 9 WHEN 3 THEN false WHEN 4 THEN doc_id % 11 <> 0 WHEN 6 THEN doc_id % 11 <> 0 ELSE true END AS type_valid, doc_id % 9 = 8 OR doc_id % 13 <> 0 AS source_valid, (doc_id % 8) / 4.0::DOUBLE AS latency_sec FROM ({fx.truth_sql()})"""


@query(f"SELECT doc_id, match_type, match_pass, found_match, type_valid, source_valid FROM ({_EVAL})")
def eval_match(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("doc_id", "match_type", "match_pass", "found_match", "type_valid", "source_valid")


@query(f"""SELECT CASE g WHEN 3 THEN 'overall' WHEN 1 THEN 'document' ELSE 'type' END AS bucket, coalesce(doc_name, output_type, '') AS name, n, passed, failed, found_match_pass, type_valid_pass, source_valid_pass, latency_total_sec, round(passed / n, 4) AS pass_rate, round(failed / n, 4) AS fail_rate, round(found_match_pass / n, 4) AS found_match_rate, round(type_valid_pass / n, 4) AS type_valid_rate, round(source_valid_pass / n, 4) AS source_valid_rate, round(latency_total_sec / n, 4) AS avg_latency_sec FROM (
SELECT grouping(doc_name, output_type) AS g, doc_name, output_type, count(*) AS n, count(*) FILTER (WHERE match_pass) AS passed, count(*) FILTER (WHERE NOT match_pass) AS failed, count(*) FILTER (WHERE found_match) AS found_match_pass, count(*) FILTER (WHERE type_valid) AS type_valid_pass, count(*) FILTER (WHERE source_valid) AS source_valid_pass, sum(latency_sec) AS latency_total_sec FROM ({_EVAL}) GROUP BY GROUPING SETS ((), (doc_name), (output_type)))""")
def eval_summary(spark, sf_dir):
    return evaluation.summary(_evaluated(spark, sf_dir))


@query(f"SELECT count(*) AS n_cases, count(DISTINCT doc_id % 6) AS n_documents, count(*) FILTER (WHERE doc_id % 2 = 1) AS n_bytes, count(*) FILTER (WHERE doc_id % 5 = 0) AS n_few_shot, count(*) FILTER (WHERE doc_id % 9 = 8) AS n_not_found FROM ({fx.truth_sql()})")
def eval_coverage(spark, sf_dir):
    shots = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("{}"))).otherwise(F.array().cast("array<string>"))
    return evaluation.coverage(_cases(spark, sf_dir).withColumn("examples", shots))


# --- OCR ------------------------------------------------------------------------------------------------

_OCR_SET = ocr.CHARSET[: fx.OCR_CLASSES - 1]
_STEPS = f"""steps AS (SELECT {fx.CROP} AS crop_id, row_number() OVER (PARTITION BY {fx.CROP} ORDER BY vec_id) - 1 AS t, embedding AS p FROM embeddings),
arg AS (SELECT crop_id, t, list_position(p, list_max(p)) - 1 AS c, list_max(p)::DOUBLE AS best FROM steps), seq AS (SELECT *, lag(c) OVER o AS before, lead(c) OVER o AS after, count(*) OVER (PARTITION BY crop_id) AS n FROM arg WINDOW o AS (PARTITION BY crop_id ORDER BY t))"""


def _crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.process(fx.ocr_crops(spark, sf_dir), _OCR_SET)


@query(f"WITH {_STEPS} SELECT crop_id, coalesce(string_agg(substring('{_OCR_SET}', c::INT + 1, 1), '' ORDER BY t) FILTER (WHERE c <> {fx.OCR_CLASSES - 1} AND c IS DISTINCT FROM before), '') AS text FROM seq GROUP BY crop_id")
def ctc_decode(spark, sf_dir):
    return _crops(spark, sf_dir).select("crop_id", "text")


@query(f"WITH {_STEPS} SELECT crop_id, round(coalesce(exp(avg(ln(greatest(best, 1e-6))) FILTER (WHERE c <> {fx.OCR_CLASSES - 1} AND c IS DISTINCT FROM before)), 0.0), 6) AS confidence FROM seq GROUP BY crop_id")
def ctc_confidence(spark, sf_dir):
    return _crops(spark, sf_dir).select("crop_id", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {_STEPS}, runs AS (SELECT *, sum(CASE WHEN c IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY crop_id ORDER BY t) AS g FROM seq)
SELECT crop_id, row_number() OVER (PARTITION BY crop_id ORDER BY min(t)) AS pos, trunc(min(t) * (777 / any_value(n)::DOUBLE))::BIGINT AS x1, trunc((max(t) + 1) * (777 / any_value(n)::DOUBLE))::BIGINT AS x2 FROM runs WHERE c <> {fx.OCR_CLASSES - 1} GROUP BY crop_id, g""")
def ctc_regions(spark, sf_dir):
    rows = _crops(spark, sf_dir).select("crop_id", F.posexplode("regions").alias("pos", "r"))
    return rows.select("crop_id", (F.col("pos") + 1).alias("pos"), "r.x1", "r.x2")


_PRED = "SELECT doc_id % 10 < 6 AS correct, (doc_id * 7919 % 1000) / 1000.0::DOUBLE AS confidence FROM documents"
_SWEEP = f"""WITH t AS (SELECT CASE WHEN i = 99 THEN 1.0::DOUBLE ELSE i * ((1.0::DOUBLE - 0.4::DOUBLE) / 99) + 0.4::DOUBLE END AS threshold FROM range(100) r(i)), p AS ({_PRED}),
c AS (SELECT threshold, count(*) FILTER (WHERE correct AND confidence >= threshold) AS tp, count(*) FILTER (WHERE NOT correct AND confidence >= threshold) AS fp, count(*) FILTER (WHERE NOT correct AND confidence < threshold) AS tn, count(*) FILTER (WHERE correct AND confidence < threshold) AS fn FROM t, p GROUP BY threshold),
m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0)::DOUBLE AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0)::DOUBLE AS recall, ((tp + tn) / (tp + fp + tn + fn))::DOUBLE AS accuracy FROM c), f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM m)"""


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return _table(spark, sf_dir, "documents").select((d % 10 < 6).alias("correct"), (d * 7919 % 1000 / 1000.0).alias("confidence"))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


@query(f"{_SWEEP} SELECT round(threshold, 9) AS threshold, tp, fp, tn, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(accuracy, 9) AS accuracy, round(f1, 9) AS f1 FROM f")
def threshold_sweep(spark, sf_dir):
    return _rounded(ocr.metrics_at(_predictions(spark, sf_dir), ocr.grid()), "threshold", "precision", "recall", "accuracy", "f1")


@query(f"{_SWEEP}, u AS (SELECT 'f1' AS objective, threshold, f1 AS best FROM f UNION ALL SELECT 'precision', threshold, precision FROM f UNION ALL SELECT 'accuracy', threshold, accuracy FROM f) SELECT objective, round(CASE WHEN best > 0 THEN threshold ELSE 0.0 END, 9) AS threshold, round(best, 9) AS best FROM (SELECT *, row_number() OVER (PARTITION BY objective ORDER BY best DESC, threshold) AS n FROM u) WHERE n = 1")
def best_thresholds(spark, sf_dir):
    return _rounded(ocr.best_thresholds(ocr.metrics_at(_predictions(spark, sf_dir), ocr.grid())), "threshold", "best")


@query("SELECT p_partkey, trunc(p_size * 13 / 4.0001)::BIGINT AS steps, greatest(41, trunc(p_size * 13 * 32 / (10 + p_partkey % 50)::DOUBLE))::BIGINT AS width FROM part")
def image_sizes(spark, sf_dir):
    size = F.col("p_size") * 13
    return _table(spark, sf_dir, "part").select("p_partkey", ocr.sequence_length(size).alias("steps"), ocr.scaled_width(size, 10 + F.col("p_partkey") % 50).alias("width"))


@query("SELECT 'crop' || page_id || '.png' AS name FROM pages")
def crop_listing(spark, sf_dir):
    base = F.concat(F.lit("dir/crop"), F.col("page_id").cast("string"), F.lit(".png"))
    paths = _table(spark, sf_dir, "pages").select(F.explode(F.array(base, F.concat(base, F.lit(".txt")), F.concat(base, F.lit(".pkl")))).alias("path"))
    return ocr.crop_names(paths)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-text search of every benchmark passage over all chunks."""
    return QUERIES["bm25_topk"](spark, sf_dir)
