"""Golden vectors of the scalar operators and small cases of the others."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from docfield.functions import features as ff
from docfield.functions import lines as fl
from docfield.functions import values as fv
from docfield.operators import answers, chunks, evaluation, ocr, pages, ranking
from docfield.plans import service
from docfield.sources import files
from docfield.streaming import ingest


def values(spark, column, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r.v for r in rows.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


def test_numbers(spark):
    shown = ["Rs. 27,500", "5.25%", ".5", "1.5x", "10-20", "a-5", "--7", "1.2.3", "2 (Two) years", "12abc", "INR27500", "v2", "1e5", None, " "]
    assert values(spark, fv.number_text, *shown) == ["27500", "5.25", "5", "1", "10", "5", "-7", "1.2", "2", None, None, None, None, None, None]


def test_dates(spark):
    shown = ["05/04/2026", "2026-04-05", "2024-03-15", "March 15, 2024", "13 Aug 2024", "1 October 2012", "1/10/12", "13thAug2024", "abc", None]
    assert values(spark, fv.date_iso, *shown) == ["2026-04-05", "2026-05-04", "2024-03-15", "2024-03-15", "2024-08-13", "2012-10-01", "2012-10-01", "2024-08-13", None, None]
    assert values(spark, lambda c: fv.any_date(c, dt.date(2024, 2, 9)), "March 2024", "due on 3rd May 2020 at noon", "abc") == ["2024-03-09", "2020-05-03", None]


def test_strings_and_comparison(spark):
    assert values(spark, fv.clean_string, "  Hello   World  ", "  \n", None) == ["Hello World", None, None]
    assert values(spark, fv.comparable, "ﬁne  Day", None) == ["fine day", ""]
    assert values(spark, fv.loose_number, "about -1,200.50 or 3", "none") == [-1200.5, None]


def test_clause_starts(spark):
    lines = ["7.1 Foo", "7.NON", "7. NON", "7.1. Foo", "7 NON", "7.foo", "(a) x", "a) x"]
    assert values(spark, fl.is_clause_start, *lines) == [True] * 3 + [False] * 5
    assert values(spark, fl.is_loose_clause_start, *lines) == [True] * 8
    assert values(spark, fl.is_subclause, "a. x", "(a) x", "a) x") == [True, True, False]
    assert values(spark, fl.clean_line, "a  b\tc \t d ") == ["a b\tc d"]
    assert values(spark, fl.section_hint, "\n1. TERM x\ny", "plain text of a line", "ALL CAPS") == ["1. TERM x", None, "ALL CAPS"]


def test_pages_of_a_contract(spark):
    one = ["SERVICE AGREEMENT", "Document Ref: 1001", "Prepared for: Customer#1", "Customer#1", "1. PARTIES This Agreement is made", "Initialled", "", "zz", "", "Page 1 of 3"]
    two = ["Document Ref: 1001", "Prepared for: Customer#1", "Customer#1", "3. APPLICABLE LAW of the land", "(a) within the same region; and", "", "yy", "", "Page 2 of 3"]
    three = ["Email viewed", "Email verified", "IP address", "Recipient verification", "zz"]
    rows = [(1, p, n, x) for p, page in enumerate((one, two, three), 1) for n, x in enumerate(page, 1)]
    out = pages.split_pages(spark.createDataFrame(rows, "doc_id long, page_num int, ln int, line string")).orderBy("page_num").collect()
    assert out[0].body_text == "SERVICE AGREEMENT\nPrepared for: Customer#1\n1. PARTIES This Agreement is made\nInitialled"
    assert out[0].residual_text == "Document Ref: 1001\nCustomer#1\nzz\nPage 1 of 3"
    assert out[1].residual_text == "Document Ref: 1001\nCustomer#1\nyy\nPage 2 of 3"
    assert (out[2].body_text, out[2].residual_text) == ("\n".join(three), "")


def test_chunks(spark):
    long = "x" * 4000
    got = values(spark, lambda c: chunks.packed_sentences(c, 1800), long, "a. " + long, "One. Two! Three?", "", " ")
    assert [len(x) for x in got[0]] == [1800, 1800, 400]
    assert got[1] == ["a.", long]
    assert got[2:] == [["One. Two! Three?"], [], []]
    assert values(spark, chunks.clauses, "intro\n1. ONE a\nb\n\n2. TWO c") == [["intro", "1. ONE a\nb", "2. TWO c"]]


def test_bm25_worked_example(spark):
    rows = spark.createDataFrame([(1, 1, "total premium payable 443"), (1, 2, "policy number 920 total"), (1, 3, "nominee father")], "doc_id long, chunk_idx int, text string")
    asked = spark.createDataFrame([(7, 1, "total premium premium")], "request_id long, doc_id long, query string")
    got = {r.chunk_idx: r.bm25 for r in ranking.bm25_scores(ranking.with_length(rows), asked, ["doc_id"], ["chunk_idx"]).collect()}
    assert got[1] == pytest.approx(1.028421, abs=1e-6) and got[2] == pytest.approx(0.091126, abs=1e-6) and 3 not in got


def test_weights():
    assert sum(ranking.Weights().shares()) == pytest.approx(1)
    with pytest.raises(ValueError):
        ranking.Weights(bm25=-1)
    with pytest.raises(ValueError):
        ranking.Weights(0, 0, 0, 0, 0, 0, 0)


def test_features(spark):
    row = spark.range(1)
    q, t = F.lit("Who are the parties"), F.lit("Agreement between the Company and the Consultant")
    got = row.select(ff.recital_boost(q, t, F.lit(1)).alias("a"), ff.page_boost(q, F.lit(2)).alias("b"), ff.size_penalty(t).alias("c"), ff.phrase(F.lit("the company"), t).alias("d"), ff.phrase(F.lit(" "), t).alias("e")).first()
    assert (got.a, got.b, got.c, got.d, got.e) == (1.0, 0.0, 0.12, 1.0, 0.0)


def test_responses(spark):
    given = ['```json\n{"value": 1, "found": true, "evidence_chunk_ids": ["c1"]}\n```', '{"value": 1, "found": false, "evidence_chunk_ids": []}', '{"found": 1}', "[1]", "no", '{"found": false, "evidence_chunk_ids": ["c9"]}', '{"found": true, "value": {"a": 1}, "evidence_chunk_ids": ["c1"]}']
    rows = spark.createDataFrame([(i, t, "number") for i, t in enumerate(given)], "i int, response_text string, output_type string")
    out = answers.validated(answers.parsed_responses(rows, F.array(F.lit("c1")))).orderBy("i").collect()
    assert [r.parse_error is None for r in out] == [True, True, False, False, False, False, False]
    assert out[0].normalized == ["1"] and out[0].ids == ["c1"] and out[1].ids == [] and out[1].value_kind == "null"
    assert out[6].parse_error == "value is neither a scalar nor a list of scalars"


def test_booleans_are_numbers_in_answers(spark):
    rows = spark.createDataFrame([('{"found": true, "value": true, "evidence_chunk_ids": []}', "number"), ('{"found": true, "value": ["5.25", "3,500", 7], "evidence_chunk_ids": []}', "array[number]"), ('{"found": true, "value": "a", "evidence_chunk_ids": []}', "array[string]"), ('{"found": true, "value": [], "evidence_chunk_ids": []}', "array[date]")], "response_text string, output_type string")
    out = answers.validated(answers.parsed_responses(rows, F.array(F.lit("c1")))).collect()
    assert [r.normalized for r in out] == [["1.0"], ["5.25", "3500", "7"], None, []]


def test_dates_in_text_in_answers(spark):
    rows = spark.createDataFrame([(i, f'{{"found": true, "value": {v}, "evidence_chunk_ids": []}}', t) for i, (v, t) in enumerate((('["signed on the 5th of March 2024", "Mar 5, 2024", "2024-03-25"]', "array[date]"), ('["Mar 5, 2024", "none"]', "array[date]"), ("[]", "array[date]"), ('"signed on the 5th of March 2024"', "date"), ('["Mar 5, 2024"]', "array[string]"), ('["5 March 2024", null]', "array[date]")))], "i int, response_text string, output_type string")
    out = answers.validated(answers.parsed_responses(rows, F.array(F.lit("c1"))), dt.date(2024, 1, 1)).orderBy("i").collect()
    assert [r.normalized for r in out] == [["2024-03-05", "2024-03-05", "2024-03-25"], None, [], ["2024-03-05"], ["Mar 5, 2024"], None]


def test_model_boundary(spark):
    class Echo:
        def generate(self, prompt):
            if "bad" in prompt:
                raise RuntimeError("down")
            return prompt.upper()

    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, " ")], "request_id long, prompt string")
    got = {r.request_id: (r.response_text, r.llm_error) for r in answers.generated(rows, Echo()).collect()}
    assert got == {1: ("A", None), 2: (None, "down"), 3: (None, "the prompt is empty")}


def test_snippets(spark):
    text = "1. PARTIES made between A and B\n\nThe governing text\n2. LAW the applicable law is that of the land " + "x" * 400
    got = spark.range(1).select(answers.snippet(F.lit(text), F.lit("which law would govern"), F.array().cast("array<string>")).alias("s")).first().s
    assert got.startswith("2. LAW") and got.endswith("...") and len(got) == 300


def test_service_codes(spark):
    body = "1. PREMIUM Total premium payable is Rs. 443 for the first year of this policy, as agreed between both."
    pages_ = spark.createDataFrame([(1, 1, body, [], ""), (2, 1, "", [], "")], "doc_id long, page_num int, body_text string, table_texts array<string>, residual_text string")
    ok = '{"value": "Rs. 443", "found": true, "evidence_chunk_ids": ["p1_c1"]}'
    replies = {1: ok, 2: ok, 3: '{"value": null, "found": false, "evidence_chunk_ids": []}', 4: '{"value": "none", "found": true, "evidence_chunk_ids": ["p1_c1"]}', 5: '{"value": 1, "found": true, "evidence_chunk_ids": []}', 6: "", 7: "not JSON", 8: ok}
    docs = {2: 2, 8: 9}
    requests = spark.createDataFrame([(i, docs.get(i, 1), "total premium", "number", 5) for i in replies], "request_id long, doc_id long, query string, output_type string, top_k int")
    recorded = spark.createDataFrame(list(replies.items()), "request_id long, response_text string")
    unread = spark.createDataFrame([(9, "failed to parse: x")], "doc_id long, message string")
    respond = lambda prompts: answers.replayed(prompts, recorded)
    out = {r.request_id: r for r in service.extract(pages_, requests, respond, parse_errors=unread).collect()}
    assert [out[i].error_code for i in range(1, 9)] == [None, "NO_TEXT_EXTRACTED", None, "VALIDATION_FAILED", "WEAK_EVIDENCE", "LLM_ERROR", "SERVICE_ERROR", "SERVICE_ERROR"]
    assert out[1].found and out[1].value == ["443"] and out[1].sources[0].page == 1 and not out[3].found
    nothing = lambda chunks, requests: service.hybrid(chunks, requests).limit(0)
    assert {r.error_code for r in service.extract(pages_, requests.where("doc_id = 1"), respond, nothing).collect()} == {"NO_RELEVANT_EVIDENCE"}


def test_ctc(spark):
    a, b, blank = [0.9, 0.05, 0.05], [0.1, 0.8, 0.1], [0.2, 0.1, 0.7]
    rows = spark.createDataFrame([(1, 50, [a, a, blank, a, b]), (2, 50, [blank] * 3)], "crop_id long, img_width int, softmax array<array<double>>")
    one, two = ocr.process(rows, "AB").orderBy("crop_id").collect()
    assert one.text == "AAB" and [(r.x1, r.x2) for r in one.regions] == [(0, 20), (30, 40), (40, 50)]
    assert one.confidence == pytest.approx((0.9 * 0.9 * 0.8) ** (1 / 3))
    assert (two.text, two.confidence, two.regions) == ("", 0.0, [])


def test_thresholds(spark):
    import numpy as np

    assert ocr.grid() == list(np.linspace(0.4, 1, 100))
    none = spark.createDataFrame([(True, 0.1)], "correct boolean, confidence double")
    assert all(r.threshold == 0 for r in ocr.best_thresholds(ocr.metrics_at(none, ocr.grid())).where("objective = 'f1'").collect())
    rows = spark.createDataFrame([(True, 0.9), (True, 0.8), (False, 0.5), (False, 0.45)], "correct boolean, confidence double")
    best = {r.objective: r for r in ocr.best_thresholds(ocr.metrics_at(rows, ocr.grid())).collect()}
    assert best["f1"].best == 1.0 and 0.5 < best["f1"].threshold < 0.52
    assert math.isclose(best["accuracy"].best, 1.0)


def test_evaluation_order_rules(spark):
    rows = spark.createDataFrame([(True, True, "array_date_exact", ["2024-01-01", "2024-02-02"], None, ["2024-02-02", "2024-01-01"]), (True, True, "array_number_exact", ["1", "2"], None, ["2", "1"]), (True, False, "string_exact", ["a"], None, ["a"]), (False, False, "anything", None, None, None), (True, True, "unknown", ["a"], None, ["a"])], "expected_found boolean, found boolean, match_type string, expected array<string>, expected_any array<string>, pred array<string>")
    assert [r.match_pass for r in evaluation.matched(rows, ascii_only=True).collect()] == [True, False, False, True, False]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"hello")
    (tmp_path / "b.pdf").write_bytes(b"\xff")
    docs = files.binary_documents(spark, str(tmp_path))
    out = files.parsed_documents(docs, lambda content: [(1, 0, 0.0, 0.0, content.decode(), None)]).orderBy("doc_id").collect()
    assert out[0].text == "hello" and out[1].error.startswith("failed to parse")
    files.write_results(spark.range(2), str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    with pytest.raises(ValueError):
        files.write_results(spark.range(1), str(tmp_path / "no"), "xml")


def test_streaming_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "One. Two."), (2, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = ingest.document_stream(spark, str(tmp_path / "in"), docs.schema)
    ingest.write_chunks(stream, str(tmp_path / "out"), str(tmp_path / "marks")).awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, ingest.text_chunks(docs).collect()))


# --- requests with examples, values the model may not give, plug-ins ------------------------------------


def test_examples_reach_the_prompt(spark):
    body = "1. PREMIUM Total premium payable is Rs. 443 for the first year of this policy, as agreed between both."
    pages_ = spark.createDataFrame([(1, 1, body, [], "")], "doc_id long, page_num int, body_text string, table_texts array<string>, residual_text string")
    shots = '[{"input": {"b": "é", "a": 1}, "output": ["x"]}]'
    rows = [(1, 1, "total premium", "number", shots), (2, 1, "total premium", "number", None), (3, 1, "total premium", "number", "[1,"), (4, 1, "total premium", "number", "{}"), (5, 1, " ", "number", None), (6, 1, "x", "text", None), (7, None, "x", "date", None)]
    requests = spark.createDataFrame(rows, "request_id long, doc_id long, query string, output_type string, examples string")
    seen = []

    def respond(prompts):
        seen.extend(prompts.collect())
        return prompts.select("request_id", F.lit('{"value": 443, "found": true, "evidence_chunk_ids": ["p1_c1"]}').alias("response_text"), F.lit(None).cast("string").alias("llm_error"))

    out = {r.request_id: r for r in service.extract(pages_, requests, respond).collect()}
    prompts = {r.request_id: r.prompt for r in seen}
    assert set(prompts) == {1, 2} and "Few-shot" not in prompts[2]
    assert 'Few-shot examples:\nExample 1\nInput:\n{\n  "b": "é",\n  "a": 1\n}\nOutput:\n[\n  "x"\n]\n\nEvidence:' in prompts[1]
    assert [out[i].error_code for i in range(1, 8)] == [None, None, "BAD_EXAMPLES_JSON", "BAD_EXAMPLES", "NO_QUERY", "INVALID_OUTPUT_TYPE", "NO_FILE"]
    assert out[1].value == ["443"] and "top_k" not in requests.columns


def test_values_that_are_no_scalars(spark):
    values = ['{"a": 1}', "[1, null]", '[{"a": 1}]', "[[1]]", "[]", "[1, true]", "null"]
    rows = spark.createDataFrame([(i, f'{{"found": {f}, "value": {v}, "evidence_chunk_ids": []}}', "array[number]") for f in ("true", "false") for i, v in enumerate(values, 100 * (f == "false"))], "i int, response_text string, output_type string")
    out = {r.i: r for r in answers.validated(answers.parsed_responses(rows, F.array(F.lit("c1")))).collect()}
    assert [out[i].parse_error is None for i in range(7)] == [False] * 4 + [True] * 3
    assert all(out[100 + i].parse_error is None and out[100 + i].found is False for i in range(7))
    assert out[5].normalized == ["1", "1.0"] and out[4].normalized == []


def test_matches_in_compatibility_form(spark):
    rows = spark.createDataFrame([(True, True, "string_exact", ["ﬁne １２"], None, ["Fine 12"]), (True, True, "array_string_subset", ["Ⅳ", "b"], None, ["iv x", "B"]), (True, True, "string_contains_any", ["a"], ["ﬂat"], ["the FLAT one"]), (True, True, "string_exact", None, None, [None])], "expected_found boolean, found boolean, match_type string, expected array<string>, expected_any array<string>, pred array<string>")
    assert [r.match_pass for r in evaluation.matched(rows).collect()] == [True, True, True, True]


def test_an_encoder_in_the_hybrid(spark):
    from docfield.operators import ranking

    chunks_ = spark.createDataFrame([(1, 1, 1, "p1_c1", "alpha beta", None, [1.0, 0.0]), (1, 1, 2, "p1_c2", "gamma delta", None, [0.6, 0.8])], "doc_id long, page_num int, chunk_idx int, chunk_id string, text string, section_hint string, embedding array<double>")
    asked = spark.createDataFrame([(7, 1, "nothing shared", 1, [0.0, 2.0])], "request_id long, doc_id long, query string, top_k int, embedding array<double>")
    key = ["page_num", "chunk_idx"]
    meaning = ranking.dense_scores(chunks_, asked, ["doc_id"], key)
    assert sorted((r.chunk_idx, round(r.semantic, 6)) for r in meaning.collect()) == [(1, 0.0), (2, 0.8)]
    scores = ranking.base_scores(chunks_, asked, ["doc_id"], key, semantic=meaning)
    assert [r.chunk_id for r in ranking.hybrid_topk(scores, key).collect()] == ["p1_c2"]


def test_bm25_topk_is_the_joined_ranking(spark):
    import random

    from docfield.operators import ranking

    r = random.Random(3)
    rows = [(n // 3, n % 3, " ".join(r.choice(["aa", "bb", "cc", "dd", "ee", "the"]) for _ in range(r.randint(0, 9)))) for n in range(200)]
    asked = [(n, " ".join(r.choice(["aa", "bb", "cc", "zz", "the"]) for _ in range(r.randint(0, 4)))) for n in range(25)]
    chunks_ = spark.createDataFrame(rows, "doc_id long, chunk_idx int, text string").repartition(3)
    requests = spark.createDataFrame(asked, "request_id long, query string").withColumn("scope", F.lit(1))
    scores = ranking.bm25_scores(ranking.with_length(chunks_).withColumn("scope", F.lit(1)), requests, ["scope"], ["doc_id", "chunk_idx"]).collect()
    want = {}
    for s in scores:
        want.setdefault(s.request_id, []).append((-round(s.bm25, 6), s.doc_id, s.chunk_idx))
    for size in (1000, 7):
        got = {}
        for x in sorted(ranking.bm25_topk(chunks_, requests.drop("scope"), ["doc_id", "chunk_idx"], 5, block_rows=size).collect(), key=lambda x: x["rank"]):
            got.setdefault(x.request_id, []).append((-x.score, x.doc_id, x.chunk_idx))
        assert got == {k: sorted(v)[:5] for k, v in want.items()}
    named = ranking.bm25_topk(chunks_.select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 3, "0")).alias("doc_id"), "chunk_idx", "text"), requests.select(F.col("request_id").cast("int").alias("request_id"), "query"), ["doc_id", "chunk_idx"], 2)
    assert sorted((x.request_id, x["rank"], x.doc_id) for x in named.collect()) == sorted((k, n, f"d{x[1]:03}") for k, v in want.items() for n, x in enumerate(sorted(v)[:2], 1))
    assert ranking.bm25_topk(chunks_.limit(0), requests.drop("scope"), ["doc_id", "chunk_idx"], 5).count() == 0 and ranking.bm25_topk(chunks_, requests.drop("scope").limit(0), ["doc_id", "chunk_idx"], 5).count() == 0


def test_date_shapes_are_the_ladder(spark):
    from docfield.functions import values as fv

    texts = ["2024-03-05", "2024-13-05", "2024-05-13", "2024-31-12", "5/3/2024", "13/5/2024", "5/13/2024", "31/31/2024", "5/3/24", "5 Mar 2024", "5 March 2024", "March 5, 2024", "5th of March", "1st May 2024", "May 1st, 2024", "2024", "5 Foo 2024", "", None, "2024-02-30", "30/2/2024", "5 May 2024"]
    ladder = ("yyyy-dd-MM", "yyyy-MM-dd", "d/M/yyyy", "M/d/yyyy", "d/M/yy", "d MMM yyyy", "d MMMM yyyy", "MMMM d, yyyy")
    x = F.col("t")
    naive = lambda formats: F.date_format(F.coalesce(*[F.try_to_date(fv.date_text(x), f) for f in formats]), "yyyy-MM-dd")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fv.date_iso(x).alias("a"), naive(ladder).alias("b"), fv.date_iso(x, strict_iso=True).alias("c"), naive(("yyyy-MM-dd", *ladder[2:])).alias("d")).collect()
    assert [(r.t, r.a) for r in rows] == [(r.t, r.b) for r in rows] and [(r.t, r.c) for r in rows] == [(r.t, r.d) for r in rows]


def test_fuzzy_dates_and_normal_forms_by_another_way(spark):
    import unicodedata

    from dateutil import parser

    from docfield.plans import queries as q

    sf = "/root/testdata/sf0.001"
    orders = {r.o_orderkey: r.o_orderdate for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate")).collect()}
    for r in q.QUERIES["fuzzy_date"](spark, sf).collect():
        assert r.iso == parser.parse(f"{orders[r.o_orderkey]:%d %B %Y}").date().isoformat()
    out = spark.createDataFrame([("ﬁ Ａ ①",), (None,), ("é",)], "t string").select("t", __import__("docfield.functions.values", fromlist=["nfkc"]).nfkc(F.col("t")).alias("n")).collect()
    assert [r.n for r in out] == [None if r.t is None else unicodedata.normalize("NFKC", r.t) for r in out]


class EchoModel:
    def generate(self, prompt):
        return '{"value": "Rs. 443", "found": true, "evidence_chunk_ids": ["p1_c1"]}'


def plain_parser(content):
    return [(1, 0, 0.0, 0.0, content.decode(), [[["Plan", "Gold"]]])]


def test_command_line(spark, tmp_path, capsys):
    import json

    from docfield import cli

    path = tmp_path / "a.txt"
    path.write_text("1. PREMIUM Total premium payable is Rs. 443 for the first year of this policy, as agreed between both.")
    base = ["--query", "total premium", "--parser", "tests.test_vectors:plain_parser", "--model", "tests.test_vectors:EchoModel"]
    run = lambda *more: (cli.main([*base, *more]), json.loads(capsys.readouterr().out))
    code, out = run("--pdf", str(path), "--output-type", " Number ")
    assert code == 0 and out["value"] == 443 and out["found"] and out["sources"][0]["page"] == 1 and out["error"] is None
    assert run("--document", str(tmp_path / "no"), "--output-type", "date")[1]["error"]["code"] == "FILE_NOT_FOUND"
    assert run("--document", str(path), "--output-type", "text")[1]["error"]["code"] == "INVALID_OUTPUT_TYPE"
    code, out = run("--document", str(path), "--output-type", "date", "--model", "tests.test_vectors:Nothing")
    assert code == 1 and out["error"]["code"] == "CLI_ERROR"
    (tmp_path / "bad.txt").write_bytes(b"\xff")
    assert run("--document", str(tmp_path / "bad.txt"), "--output-type", "date")[1]["error"]["code"] == "SERVICE_ERROR"


def test_stored_folders_go(spark):
    from docfield.operators import store

    rows = store.stored(spark.range(3), "three")
    assert rows.count() == 3 and store.MADE
    store.release(spark)
    assert not store.MADE


def expressions(df, name: str) -> int:
    """Calls of a function in the optimized plan."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(f"{name}(")


def test_snippets_are_made_once(spark):
    """The best passage was found again wherever its text was used."""
    rows = spark.createDataFrame([("a b c", "what law")], "text string, query string")
    once = rows.select(answers.snippet(F.col("text"), F.col("query"), F.array().cast("array<string>")).alias("s"))
    assert once.first().s == "a b c"
    assert expressions(once, "array_min") == 1


def test_clauses_are_cleaned_once(spark):
    """A clause's text was cleaned again in every branch that used it: all its characters many times."""
    rows = spark.createDataFrame([("1. A b\r\n\n\n\nc " + "word word; " * 400 + "\n(a) x\n(b)  y",), (" ",), (None,)], "text string")
    cut = rows.select(chunks.split_clause(F.col("text")).alias("xs"), F.length("text").alias("n"))
    got = [r.xs for r in cut.collect()]
    assert got[0][0].startswith("1. A b\nc word word; word") and got[0][-2:] == ["(a) x", "(b) y"] and got[1:] == [[], None]
    assert expressions(cut.select("xs"), "repeat") == 0 and cut._jdf.queryExecution().optimizedPlan().toString().count("text#") <= 4


def test_word_counts_without_cutting(spark):
    texts = ["", "a", "a b c", "a b c  d", "one two three four five"]
    for n in (1, 4):
        want = [c >= n for c in values(spark, fl.word_count, *texts)]
        assert values(spark, lambda x, n=n: fl.has_words(fl.strip(x), n), *texts) == want


def test_long_clauses_are_dealt_to_many_tasks(spark):
    """A file of part is small, its clauses are not: one task made and cut all of them."""
    from docfield.plans import queries

    rows = queries.spread(spark.range(100, numPartitions=1), "id", 10)
    assert rows.rdd.getNumPartitions() == 10 and sorted(r.id for r in rows.collect()) == list(range(100))
    assert queries.QUERIES["oversized_clauses"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1


def test_scores_need_one_join(spark):
    """Terms, counts, norms and scores were joined by term and by chunk, in many joins that the driver had to plan."""
    rows = spark.createDataFrame([(1, 1, 1, "pay the fee now", None), (1, 1, 2, "law of the land", None), (1, 2, 1, "", None), (2, 1, 1, "fee", None)], "doc_id int, page_num int, chunk_idx int, text string, section_hint string")
    asked = spark.createDataFrame([(7, 1, "the fee fee"), (8, 2, "law"), (9, 1, "")], "request_id int, doc_id int, query string")
    scores = ranking.base_scores(rows, asked, ["doc_id"], ["page_num", "chunk_idx"])
    assert scores._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    got = {(r.request_id, r.page_num, r.chunk_idx): r for r in scores.collect()}
    assert len(got) == 7 and got[7, 1, 1].bm25_norm == 1.0 and got[7, 2, 1].semantic == 0.0 and got[8, 1, 1].bm25 == 0.0
    key = ["page_num", "chunk_idx"]
    old = ranking.bm25_scores(ranking.with_length(rows), asked, ["doc_id"], key).collect() + ranking.tfidf_scores(rows, asked, ["doc_id"], key).collect()
    for r in old:
        name = "bm25" if "bm25" in r else "semantic"
        assert abs(got[r.request_id, r.page_num, r.chunk_idx][name] - r[name]) < 2e-6
