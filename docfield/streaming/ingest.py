"""Micro-batch ingest: documents as they arrive become chunks. Each document is one row, so there is no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docfield.functions.lines import section_hint
from docfield.operators.chunks import MAX_CHARS, packed_sentences


def document_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def text_chunks(docs: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """doc_id, chunk_idx, text, section_hint of plain documents, batch or stream: one projection and one generator."""
    rows = docs.select("doc_id", F.posexplode(packed_sentences(F.coalesce("text", F.lit("")), max_chars)).alias("n", "text"))
    return rows.select("doc_id", (F.col("n") + 1).cast("int").alias("chunk_idx"), "text", section_hint(F.col("text")).alias("section_hint"))


def write_chunks(docs: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends the chunks of a document stream to a Parquet table, exactly once."""
    out = text_chunks(docs).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if available_now else out).start()
