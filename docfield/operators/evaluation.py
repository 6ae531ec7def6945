"""Evaluation of predictions against cases: matching, validity checks, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfield.functions.values import comparable, is_iso_date, loose_number, nfkc_items

MATCH_TYPES = ("string_exact", "string_contains", "string_contains_any", "number_exact", "date_exact", "array_string_subset", "array_date_exact", "array_number_exact", "not_found")


def type_valid(kind: Column, values: Column, item_kinds: Column, output_type: Column) -> Column:
    """Whether a value (its kind, its texts, kinds of its items) has the shape of its type; null is valid."""
    every = lambda k: F.forall(item_kinds, lambda x: x == k)
    return (
        F.when(kind == "null", True).when(output_type == "string", kind == "string").when(output_type == "number", kind == "number")
        .when(output_type == "date", (kind == "string") & is_iso_date(F.get(values, F.lit(0))))
        .when(output_type == "array[string]", (kind == "array") & every("string")).when(output_type == "array[number]", (kind == "array") & every("number"))
        .when(output_type == "array[date]", (kind == "array") & every("string") & F.forall(values, is_iso_date)).otherwise(False)
    )


def source_valid(sources: Column, expected_found: Column) -> Column:
    """Where something is expected: at least one source, each with a page and a snippet that isn't blank."""
    good = F.forall(sources, lambda s: s["page"].isNotNull() & (F.trim(F.coalesce(s["snippet"], F.lit(""))) != ""))
    return F.when(~expected_found, True).otherwise(F.coalesce((F.size(sources) > 0) & good, F.lit(False)))


def matched(cases: DataFrame, ascii_only: bool = False) -> DataFrame:
    """cases with match_pass.

    Columns: expected_found, found (booleans), match_type, expected and pred (arrays of text; one for scalars), expected_any (array).
    Date arrays are compared as sets with repeats, number arrays in order, string arrays by containment either way.
    """
    form = (lambda xs: xs) if ascii_only else nfkc_items  # one Arrow function for each array, as Python can't run inside array functions
    named = {"_expected": "expected", "_pred": "pred", "_any": "expected_any"}
    cases = cases.withColumns({new: form(F.col(old)) for new, old in named.items()})
    norm = lambda xs: F.transform(F.coalesce(xs, F.array().cast("array<string>")), lambda x: comparable(x, ascii_only=True))
    e, p, a = norm(F.col("_expected")), norm(F.col("_pred")), norm(F.col("_any"))
    first = lambda xs: F.coalesce(F.get(xs, F.lit(0)), F.lit(""))
    m = F.col("match_type")
    numbers = lambda xs: F.transform(F.coalesce(xs, F.array().cast("array<string>")), loose_number)
    ok = (
        F.when(m.isin("string_exact", "date_exact"), first(p) == first(e)).when(m == "string_contains", F.contains(first(p), first(e)))
        .when(m == "string_contains_any", F.exists(a, lambda x: F.contains(first(p), x)))
        .when(m == "number_exact", F.coalesce(loose_number(F.get("pred", F.lit(0))) == F.get("expected", F.lit(0)).try_cast("double"), F.lit(False)))
        .when(m == "array_string_subset", F.forall(e, lambda x: F.exists(p, lambda y: F.contains(y, x) | F.contains(x, y))))
        .when(m == "array_date_exact", F.array_sort(p) == F.array_sort(e))
        .when(m == "array_number_exact", F.coalesce(numbers(F.col("pred")) == numbers(F.col("expected")), F.lit(False))).otherwise(False)
    )
    return cases.withColumn("match_pass", F.when(F.col("expected_found") != F.col("found"), False).when(~F.col("expected_found"), True).otherwise(ok)).drop(*named)


def summary(rows: DataFrame) -> DataFrame:
    """Counts and rates overall, for each doc_name and for each output_type (bucket, name), in one pass of grouping sets.

    rows: doc_name, output_type, match_pass, found_match, type_valid, source_valid, latency_sec.
    """
    sets = rows.groupingSets([[], ["doc_name"], ["output_type"]], "doc_name", "output_type")
    count = lambda c: F.count_if(F.col(c))
    out = sets.agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), count("match_pass").alias("passed"), F.count_if(~F.col("match_pass")).alias("failed"), count("found_match").alias("found_match_pass"),
        count("type_valid").alias("type_valid_pass"), count("source_valid").alias("source_valid_pass"), F.sum("latency_sec").alias("latency_total_sec"),
    )
    rate = lambda c: F.round(F.col(c) / F.greatest("n", F.lit(1)), 4)
    bucket = F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, "document").otherwise("type")
    return out.select(
        bucket.alias("bucket"), F.coalesce("doc_name", "output_type", F.lit("")).alias("name"), "n", "passed", "failed", "found_match_pass", "type_valid_pass", "source_valid_pass", "latency_total_sec",
        rate("passed").alias("pass_rate"), rate("failed").alias("fail_rate"), rate("found_match_pass").alias("found_match_rate"), rate("type_valid_pass").alias("type_valid_rate"),
        rate("source_valid_pass").alias("source_valid_rate"), rate("latency_total_sec").alias("avg_latency_sec"),
    )


def coverage(cases: DataFrame) -> DataFrame:
    """One row: cases, distinct documents, cases given as bytes, with examples, expected to be absent."""
    return cases.agg(F.count("*").alias("n_cases"), F.count_distinct("doc_name").alias("n_documents"), F.count_if(F.col("input_mode") == "bytes").alias("n_bytes"), F.count_if(F.size("examples") > 0).alias("n_few_shot"), F.count_if(~F.col("expected_found")).alias("n_not_found"))
