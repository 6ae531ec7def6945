"""Sources and sinks: documents as binary files, few-shot JSON, results as JSON, CSV or Parquet."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = "doc_id string, page_num int, block_no int, x0 double, y0 double, text string, tables array<array<array<string>>>, error string"
RESULT_COLUMNS = ("case_id", "doc_name", "query", "output_type", "expected_found", "input_mode", "used_examples", "match_pass", "found_match", "type_valid", "source_valid", "latency_sec")


def binary_documents(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """doc_id (the path), content of files; any file system that Spark reads. Spark lists no file of zero length."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.col("path").alias("doc_id"), "content")


def parsed_documents(documents: DataFrame, parse: Callable[[bytes], list[tuple]]) -> DataFrame:
    """Layout blocks of documents (doc_id, content). parse gives (page_num, block_no, x0, y0, text, tables) of a file's bytes.

    The parser is a plug-in (none is bundled); a file that it can't read becomes one row with an error and ends nothing else.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc_id, content in zip(b["doc_id"], b["content"], strict=True):
                try:
                    if not content:
                        raise ValueError("the document is empty")
                    rows = [(str(doc_id), *r, None) for r in parse(bytes(content))]
                except Exception as e:  # noqa: BLE001
                    rows = [(str(doc_id), None, None, None, None, None, None, f"failed to parse: {e}")]
                yield pd.DataFrame(rows, columns=["doc_id", "page_num", "block_no", "x0", "y0", "text", "tables", "error"])

    return documents.mapInPandas(run, BLOCKS)


def examples(text: Column) -> Column:
    """Few-shot JSON (an array of objects with input and output) as array<struct<input, output>> of JSON texts; null if it is no array."""
    items = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    part = lambda x, name: F.to_json(F.try_variant_get(x, f"$.{name}", "variant"))
    return F.transform(items, lambda x: F.struct(part(x, "input").alias("input"), part(x, "output").alias("output")))


def softmax_crops(spark: SparkSession, path: str) -> DataFrame:
    """crop_id, img_width, gt, softmax from Parquet. Pickled arrays are never read."""
    return spark.read.parquet(path).select("crop_id", "img_width", "gt", "softmax")


def write_results(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    if kind == "csv":
        rows.select(*RESULT_COLUMNS).write.option("header", True).csv(path)
    elif kind in ("json", "parquet"):
        rows.write.format(kind).save(path)
    else:
        raise ValueError(f"unknown kind {kind}")
