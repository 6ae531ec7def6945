"""One field of one document from the command line: prints the response as JSON; exit code 0, or 1 if the call itself fails.

    python -m docfield.cli --document a.pdf --query "..." --output-type number --parser my.module:parse --model my.module:Client

The parser and the model are plug-ins: a function from bytes to layout blocks, and a class (without arguments) that has generate(prompt).
"""

from __future__ import annotations

import argparse
import datetime as dt
import importlib
import json
import sys
from collections.abc import Sequence
from pathlib import Path

from docfield.functions.values import OUTPUT_TYPES

TOP_K = 5


def _failure(code: str, message: str) -> dict:
    return {"value": None, "found": False, "sources": [], "error": {"code": code, "message": message}}


def _plug_in(name: str):
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _value(texts: list[str] | None, output_type: str):
    """Canonical texts as JSON values."""
    if texts is None:
        return None
    number = lambda x: float(x) if any(c in x for c in ".eEnN") else int(x)
    items = [number(x) for x in texts] if "number" in output_type else list(texts)
    return items if output_type.startswith("array") else items[0]


def response(spark, document: str, query: str, output_type: str, parse, model, top_k: int = TOP_K, examples: str | None = None, as_of: dt.date | None = None) -> dict:
    """value, found, sources and error of one request against one document."""
    from docfield.operators.answers import generated
    from docfield.operators.pages import pages_of_blocks
    from docfield.operators.store import stored
    from docfield.plans.service import extract
    from docfield.sources.files import binary_documents, parsed_documents

    path = Path(document)
    blocks = stored(parsed_documents(binary_documents(spark, str(path), "*"), parse), "blocks")
    doc = blocks.select("doc_id").first()
    if doc is None:
        return _failure("SERVICE_ERROR", "failed to parse: the document is empty")
    asked = spark.createDataFrame([(1, doc.doc_id, query, output_type, top_k, examples)], "request_id long, doc_id string, query string, output_type string, top_k int, examples string")
    unread = blocks.where("error IS NOT NULL").selectExpr("doc_id", "error AS message")
    r = extract(pages_of_blocks(blocks), asked, lambda prompts: generated(prompts, model), parse_errors=unread, as_of=as_of).first()
    error = {"code": r.error_code, "message": r.error_message} if r.error_code else None
    return {"value": _value(r.value, output_type), "found": bool(r.found), "sources": [{"page": s.page, "snippet": s.snippet} for s in r.sources], "error": error}


def main(argv: Sequence[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Extract one typed field from a document.")
    p.add_argument("--document", "--pdf", dest="document", required=True, help="path of the document")
    p.add_argument("--query", required=True, help="the field in plain words")
    p.add_argument("--output-type", required=True, help=", ".join(OUTPUT_TYPES))
    p.add_argument("--top-k", type=int, default=TOP_K, help="chunks that the model sees")
    p.add_argument("--examples", help="few-shot examples: a JSON array of objects with input and output")
    p.add_argument("--as-of", type=dt.date.fromisoformat, help="day that completes dates inside other text")
    p.add_argument("--parser", required=True, help="module:function, bytes to layout blocks")
    p.add_argument("--model", required=True, help="module:class with generate(prompt)")
    a = p.parse_args(argv)
    kind, code = a.output_type.strip().lower(), 1
    if not Path(a.document).exists():
        out = _failure("FILE_NOT_FOUND", f"file not found: {a.document}")
    elif kind not in OUTPUT_TYPES:
        out = _failure("INVALID_OUTPUT_TYPE", f"use one of: {', '.join(OUTPUT_TYPES)}")
    else:
        try:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("docfield").getOrCreate()
            out, code = response(spark, a.document, a.query, kind, _plug_in(a.parser), _plug_in(a.model)(), a.top_k, a.examples, a.as_of), 0
        except Exception as e:  # noqa: BLE001
            out = _failure("CLI_ERROR", str(e))
    print(json.dumps(out, indent=2, ensure_ascii=False))
    return code


if __name__ == "__main__":
    sys.exit(main())
