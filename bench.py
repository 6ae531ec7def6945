"""Prints one JSON line with the wall time of each headline query at $BENCH_SF_DIR."""

import json
import os
import time

from pyspark.sql import SparkSession

from docfield.plans.queries import QUERIES

HEADLINES = ("line_clean", "repeated_lines", "table_text", "sentence_pack_chunks", "bm25_topk", "dense_cosine_topk", "validate_date_formats", "response_parse", "eval_summary", "ctc_decode", "threshold_sweep")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", "16").config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINES)).split(",")
    spark.read.parquet(f"{sf}/documents.parquet").count()
    took = {}
    for name in names:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
