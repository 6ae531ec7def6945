"""A training-corpus pipeline in five stages, each over all rows that the one before kept.

Stages 1 to 4 return the columns of documents, whatever they are; the last returns token ids. Each result
is written to the shared folder and read again, so a lost executor costs one stage at most; what a stage stores on its
way is deleted once its result is written.

Nulls, ties and repeats: null texts are empty texts. quality_rules drops them (no words) and keeps or drops
repeated rows together. near_duplicates keeps the row of the smallest id (of equal ids the smallest text hash, of rows equal in
both the one whose JSON is smallest); null ids come last. decontamination and pii treat repeated rows alike, and pii masks
texts of any length; null columns pass. sentencepiece gives a row for each row, null ids included. Empty tables
give empty tables; further columns pass through stages 1 to 4 whatever their names.

ORACLE_SQL is None: SQL can't express the divergence verdict, the field or the encoder. The stages are tested against
brute-force versions in tests/llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfield.llm.common import MADE, release, stored, table
from docfield.llm.divergence import keep_good
from docfield.llm.phrases import drop_contaminated
from docfield.llm.pieces import encode_documents
from docfield.llm.pii import mask_documents
from docfield.llm.simhash import drop_near_duplicates


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the distribution divergence."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class, that of the smallest id."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked by kind."""
    return mask_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens of each document."""
    import public_tokenizers

    coded = encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), decode=False)
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("sentencepiece", sentencepiece)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        first = len(MADE)
        docs = stored(stage(spark, docs, sf_dir), name)
        release(spark, first, keep=1)  # what the stage stored on its way
    return docs
