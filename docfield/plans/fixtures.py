"""Deterministic input tables made from the test tables: contracts with known answers, and OCR stand-ins.

Each is one SQL text that Spark and other engines read alike (braces name tables); its columns are the ground truth of
the queries over it. Every order becomes a contract of three pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_AMOUNT = "cast(floor(o_totalprice) AS BIGINT)"
TRUTH = f"""
SELECT o_orderkey AS doc_id, c_name, n_name, concat('Consultant#', cast(o_custkey % 97 AS VARCHAR(10))) AS person, {_AMOUNT} AS amount,
  CASE WHEN {_AMOUNT} < 1000 THEN cast({_AMOUNT} AS VARCHAR(20)) ELSE concat(cast(cast(floor({_AMOUNT} / 1000) AS BIGINT) AS VARCHAR(20)), ',', lpad(cast({_AMOUNT} % 1000 AS VARCHAR(20)), 3, '0')) END AS amount_text,
  cast(cast(o_orderdate AS DATE) AS VARCHAR(10)) AS signed
FROM {{orders}} o JOIN {{customer}} c ON o_custkey = c_custkey JOIN {{nation}} n ON c_nationkey = n_nationkey
"""

#: page, then lines as SQL expressions over TRUTH.
PAGES = (
    (1, (
        "'SERVICE AGREEMENT'", "concat('Document Ref: ', cast(doc_id AS VARCHAR(20)))", "concat('Prepared for: ', c_name)", "c_name",
        "concat('1. PARTIES This Agreement is made between ', c_name, ' (Company) and ', person, ' (Consultant)')",
        "concat('2. COMPENSATION The Company shall pay Rs. ', amount_text, ' for the  services')", "'Initialled'", "''", "'zz'", "''", "'Page 1 of 3'",
    )),
    (2, (
        "concat('Document Ref: ', cast(doc_id AS VARCHAR(20)))", "concat('Prepared for: ', c_name)", "c_name", "concat('3. APPLICABLE LAW This Agreement follows the laws of ', n_name, '.')",
        "'4. NON-COMPETE The Consultant shall not compete with the Company'", "'(a) within the same region; and'", "'a. for a period of 12 months'", "'7.1. not a strict clause start here'", "''", "''", "'yy'", "''",
        "concat('5.2 TERM The effective date is ', signed, ' and no other.')", "'Page 2 of 3'",
    )),
    (3, ("'Email viewed'", "'Email verified'", "'IP address'", "'Recipient verification'", "'zz'")),
)

QUESTIONS = (
    ("What is the compensation amount", "number"), ("What is the applicable law", "string"), ("What is the effective date", "date"), ("Who are the parties", "array[string]"),
)


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TRUTH, **_tables(spark, sf_dir, "orders", "customer", "nation"))


def truth_sql() -> str:
    return TRUTH.format(orders="orders", customer="customer", nation="nation")


def _page_lines() -> Column:
    return F.expr("array(" + ", ".join(f"struct({p} AS page_num, {n} AS ln, {e} AS line)" for p, lines in PAGES for n, e in enumerate(lines, 1)) + ")")


def contract_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_num, ln, line."""
    return truth(spark, sf_dir).select("doc_id", F.explode(_page_lines()).alias("x")).select("doc_id", "x.page_num", "x.ln", "x.line")


def contract_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines, tables: the rows of contract_lines() and contract_tables(), a row for each contract. Keys of orders are unique; the lines are made behind the join, so none is sorted or shuffled."""
    rows = truth(spark, sf_dir).join(contract_tables(spark, sf_dir), "doc_id", "left")
    return rows.select("doc_id", _page_lines().alias("lines"), F.when(F.col("table").isNotNull(), F.array(F.struct("page_num", F.col("table").alias("rows")))).alias("tables"))


def contract_lines_sql() -> str:
    rows = ", ".join(f"{{'page_num': {p}, 'ln': {n}, 'line': {e}}}" for p, lines in PAGES for n, e in enumerate(lines, 1))
    return f"SELECT doc_id, x.page_num AS page_num, x.ln AS ln, x.line AS line FROM (SELECT doc_id, unnest([{rows}]) AS x FROM ({truth_sql()}))"


def contract_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_num, table (rows of cells): the items of each order, on page 2."""
    items = _tables(spark, sf_dir, "lineitem")["lineitem"]
    cells = F.array(F.concat(F.lit(" part  "), F.col("l_partkey").cast("string")), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity").cast("bigint").cast("string")), F.col("l_returnflag"))
    row = F.struct("l_linenumber", "l_partkey", cells.alias("cells"))
    return items.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["cells"]).alias("table")).select("doc_id", F.lit(2).alias("page_num"), "table")


def requests(spark: SparkSession, sf_dir: str, top_k: int = 5) -> DataFrame:
    """One request for each contract, of four kinds in turn: request_id, doc_id, query, output_type, top_k."""
    n = F.col("o_orderkey") % len(QUESTIONS)
    pick = lambda k: F.element_at(F.array(*[F.lit(q[k]) for q in QUESTIONS]), (n + 1).cast("int"))
    return _tables(spark, sf_dir, "orders")["orders"].select(F.col("o_orderkey").alias("request_id"), F.col("o_orderkey").alias("doc_id"), pick(0).alias("query"), pick(1).alias("output_type"), F.lit(top_k).alias("top_k"))


def requests_sql() -> str:
    case = lambda k: "CASE o_orderkey % 4 " + " ".join(f"WHEN {i} THEN '{q[k]}'" for i, q in enumerate(QUESTIONS)) + " END"
    return f"SELECT o_orderkey AS request_id, o_orderkey AS doc_id, {case(0)} AS query, {case(1)} AS output_type FROM orders"


#: Recorded responses over TRUTH, with every kind of failure at some remainder of doc_id by 20.
REPLAY = """
CASE WHEN doc_id % 20 = 3 THEN '' WHEN doc_id % 20 = 5 THEN '{"value": 1, "found": "yes"}' WHEN doc_id % 20 = 7 THEN '{"value": null, "found": false, "evidence_chunk_ids": []}'
  WHEN doc_id % 20 = 9 THEN concat('{"value": "', person, '", "found": true, "evidence_chunk_ids": []}') WHEN doc_id % 20 = 11 THEN 'no JSON at all'
  WHEN doc_id % 20 = 13 THEN '{"value": 7, "found": true, "evidence_chunk_ids": ["p9_c9"]}' WHEN doc_id % 20 = 15 THEN '{"value": {"a": 1}, "found": true, "evidence_chunk_ids": ["p1_c2"]}'
  WHEN doc_id % 4 = 0 THEN concat('{"value": "Rs. ', amount_text, '", "found": true, "evidence_chunk_ids": ["p1_c3"]}')
  WHEN doc_id % 4 = 1 THEN concat('```json', chr(10), '{"value": "', n_name, '  ", "found": true, "evidence_chunk_ids": ["p2_c2", " p2_c2 "]}', chr(10), '```')
  WHEN doc_id % 4 = 2 THEN concat('{"value": "', signed, '", "found": true, "evidence_chunk_ids": ["p2_c4", "p1_c1"]}')
  ELSE concat('{"value": ["', c_name, '", " ', person, ' "], "found": true, "evidence_chunk_ids": ["p1_c2"]}') END
"""


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth(spark, sf_dir).select(F.col("doc_id").alias("request_id"), F.expr(REPLAY).alias("response_text"))


#: Classes of a timestep: all numbers of a vector. A crop is made of a label's vectors among a thousand successive ones, so that no crop grows with the table.
OCR_CLASSES = 64
CROP = "label + 1000 * cast(floor(vec_id / 1000) AS BIGINT)"


def ocr_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """crop_id, img_width, softmax: whole vectors, in order, are the timesteps of a crop."""
    e = _tables(spark, sf_dir, "embeddings")["embeddings"]
    step = F.struct("vec_id", F.col("embedding").alias("p"))
    return e.groupBy(F.expr(CROP).alias("crop_id")).agg(F.transform(F.array_sort(F.collect_list(step)), lambda s: s["p"]).alias("softmax")).withColumn("img_width", F.lit(777))
