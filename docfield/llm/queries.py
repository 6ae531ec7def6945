"""The queries of this package, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfield.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from docfield.llm.pieces import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docfield.llm.simhash import classes, hexed

    return classes(table(spark, sf_dir, "documents")).select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op6_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docfield.llm.divergence import quality_report

    return quality_report(table(spark, sf_dir, "documents"))


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docfield.llm.phrases import digests

    return digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op1_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from docfield.llm.wavelet import read_documents, write_shards

    return read_documents(spark, write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docfield.llm.pii import pii_spans

    return pii_spans(table(spark, sf_dir, "documents"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docfield.llm.toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docfield.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docfield.llm.secrets import digests

    return digests(table(spark, sf_dir, "documents"))


@query
def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docfield.llm.chat import digests

    said = "</s>[INST] ok [/INST]"
    extra = spark.range(0, 2, 1, 1).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))


ORACLE_SQL["op10_chat"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 17 ELSE 15 + length(role) END AS marks,
    CASE role WHEN 'user' THEN contains(text, ' [/INST]') WHEN 'assistant' THEN contains(text, '</s>') WHEN 'system' THEN contains(text, chr(10) || '<</SYS>>') ELSE contains(text, ' [/ROLE]') END AS clash,
    len(regexp_extract_all(text, '[<\[]\\*(/?s>|</?SYS>>|/?INST\]|ROLE |/ROLE\])')) AS escapes
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(marks + length(text)) + CASE WHEN bool_or(clash) THEN sum(escapes) ELSE 0 END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w"
ORACLE_SQL["op5_decontaminate"] = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} FROM documents), item AS (SELECT item_id, {_WORDS} FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM item WHERE len(w) > 0)),
grams AS (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT r, k, n, item_id FROM grams JOIN win USING (n, g)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT r, k, n FROM hit)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS digest FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
