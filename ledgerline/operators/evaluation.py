"""Metrics of extraction, matching and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .numbering import dense_numbers

from ..functions.normalise import same


def field_accuracy(predicted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Per field: correct, incorrect, missing, and the accuracy to 4 places."""
    joined = truth.join(predicted.withColumnRenamed("value", "_value"), keys, "left")
    right = F.coalesce(same(F.col("_value"), F.col("value")), F.lit(False))
    found = joined.groupBy("field").agg(F.count_if(right).alias("correct"), F.count_if(~right & F.col("_value").isNotNull()).alias("incorrect"), F.count_if(F.col("_value").isNull() & F.col("value").isNotNull()).alias("missing"), F.count("*").alias("total"))
    return found.withColumn("accuracy", F.round(F.col("correct") / F.col("total"), 4))


def false_passes(predicted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Verdicts against the truth: agreement, and the passes that should not be."""
    joined = truth.join(predicted.withColumnRenamed("status", "_status"), keys)
    return joined.agg(F.count("*").alias("total"), F.count_if(F.col("status") == F.col("_status")).alias("agreed"), F.count_if((F.col("_status") == "passed") & (F.col("status") != "passed")).alias("false_passes"))


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """Recall at 1, 3 and 5, precision at 5, MRR, nDCG at 5 (ideal from what came back), not found."""
    joined = ranked.where("position <= 5").join(relevant.select("query_id", "doc_id", F.lit(1).alias("_rel")), ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("_rel", F.lit(0)))
    ideal = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rel").desc(), "position"))
    gain = lambda at: F.col("rel") / (F.log2(at + 1.0))
    each = joined.withColumn("_ideal", ideal).groupBy("query_id").agg(
        *[F.max(F.when(F.col("position") <= k, F.col("rel")).otherwise(0)).alias(f"hit{k}") for k in (1, 3, 5)], (F.sum("rel") / 5).alias("precision"),
        F.coalesce(F.max(F.when(F.col("rel") == 1, 1 / F.col("position"))), F.lit(0.0)).alias("rr"), F.sum(gain(F.col("position"))).alias("dcg"), F.sum(gain(F.col("_ideal"))).alias("best"),
    )
    every = relevant.select("query_id").distinct().join(each, "query_id", "left").fillna(0)
    ndcg = F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(0.0)
    return every.agg(F.count("*").alias("queries"), *[F.round(F.avg(f"hit{k}"), 4).alias(f"recall_at_{k}") for k in (1, 3, 5)], F.round(F.avg("precision"), 4).alias("precision_at_5"), F.round(F.avg("rr"), 4).alias("mrr"), F.round(F.avg(ndcg), 4).alias("ndcg_at_5"))


def medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median): the exact median of each key, whose values may be most of the rows.

    Values are numbered within their key by sorted ranges, and the middle one or two are picked; no
    task holds a key's values. Nulls don't count; a key with nulls only has a null median.
    """
    sizes = rows.groupBy(*keys).agg(F.count(value).alias("_n"))
    numbered = dense_numbers(rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")), keys, [F.col("_v")], "_k")
    named = sizes.select(F.struct(*keys).alias("_key") if keys else F.lit(0).alias("_key"), "_n")
    placed = numbered.withColumn("_key", F.struct(*keys) if keys else F.lit(0)).join(named, "_key")
    middle = (F.col("_k") * 2 >= F.col("_n")) & (F.col("_k") * 2 <= F.col("_n") + 2)
    found = placed.where(middle).groupBy("_key").agg(F.avg("_v").alias("median"))
    out = named.join(found, "_key", "left")
    return out.select("_key.*", "median") if keys else out.select("median")


def durations(runs: DataFrame) -> DataFrame:
    """Per kind: number, mean and median, and how many are over budget."""
    sums = runs.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("seconds"), 4).alias("mean"), F.count_if(F.col("seconds") > F.col("budget")).alias("over_budget"))
    middle = medians(runs, ["kind"], "seconds").select(F.col("kind").alias("_kind"), F.round("median", 4).alias("median"))
    return sums.join(middle, F.col("kind").eqNullSafe(F.col("_kind"))).select("kind", "n", "mean", "median", "over_budget")


def present_in_pages(declared: DataFrame, pages: DataFrame) -> DataFrame:
    """Declared values that literally stand in their document's blank-collapsed text."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    joined = declared.join(pages.select("doc_id", flat(F.col("text")).alias("_text")), "doc_id", "left")
    return joined.select("doc_id", "field", "value", F.coalesce(F.contains("_text", flat(F.col("value"))), F.lit(False)).alias("present"))


def shortfall(needs: DataFrame) -> DataFrame:
    return needs.select("run_id", F.greatest(F.col("estimate") - F.col("headroom"), F.lit(0)).alias("shortfall"))


def accuracy_summary(fields: DataFrame, matches: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: field and code accuracy, item matching, detection of mismatches, false passes.

    fields: field, expected, extracted, review; matches: case_id, place, expected, actual; cases:
    case_id, expected_status, actual_status, mismatch_expected, mismatch_detected.
    """
    bare = lambda c: F.when(F.col("field") == "pct_code", F.trim(F.replace(F.col(c), F.lit("."), F.lit("")))).otherwise(F.col(c))
    right = F.lower(F.trim(bare("expected"))) == F.lower(F.trim(bare("extracted")))
    outcome = F.when(F.col("review"), "manual_review").when(F.col("extracted").isNull(), F.when(F.col("expected").isNotNull(), "missing").otherwise("correct")).when(right, "correct").otherwise("incorrect")
    of = lambda name, only=F.lit(True): F.count_if((F.col("outcome") == name) & only)
    code = F.col("field") == "pct_code"
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 4)
    f = fields.select("field", outcome.alias("outcome")).agg(
        F.count("*").alias("total_fields"), *[of(n).alias(f"{n}_fields") for n in ("correct", "incorrect", "missing", "manual_review")],
        ratio(of("correct"), F.count("*")).alias("field_accuracy"), ratio(of("correct", code), F.count_if(code)).alias("pct_code_accuracy"),
    )
    m = matches.agg(ratio(F.count_if(F.col("expected").eqNullSafe(F.col("actual"))), F.count("*")).alias("item_matching_accuracy"))
    c = cases.agg(ratio(F.count_if(F.col("mismatch_expected") & F.col("mismatch_detected")), F.count_if("mismatch_expected")).alias("mismatch_detection_accuracy"), F.count_if((F.col("expected_status") != "passed") & (F.col("actual_status") == "passed")).alias("false_passes"))
    return f.crossJoin(m).crossJoin(c)  # one row each


def source_metrics(gold: DataFrame, ranked: DataFrame) -> DataFrame:
    """Rates over questions: right source first, expected page among the results, rightly nothing found.

    gold: query_id, expected_source, expected_page (null if none), should_exist; ranked: query_id,
    position, source, page.
    """
    joined = gold.join(ranked, "query_id", "left")
    each = joined.groupBy("query_id", "should_exist", "expected_page").agg(
        F.count("source").alias("n"), F.coalesce(F.bool_or((F.col("position") == 1) & (F.col("source") == F.col("expected_source"))), F.lit(False)).alias("first"),
        F.coalesce(F.bool_or(F.col("page") == F.col("expected_page")), F.lit(False)).alias("page"),
    )
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 4)
    there, paged = F.col("should_exist"), F.col("should_exist") & F.col("expected_page").isNotNull()
    return each.agg(
        F.count("*").alias("questions"), ratio(F.count_if(there & F.col("first")), F.count_if(there)).alias("source_document_rate"), ratio(F.count_if(paged & F.col("page")), F.count_if(paged)).alias("page_reference_rate"),
        ratio(F.count_if(~there & (F.col("n") == 0)), F.count_if(~there)).alias("evidence_not_found_accuracy"),
    )


def run_metrics(runs: DataFrame, fields: DataFrame) -> DataFrame:
    """(metric, value): percentages and counts over runs and their fields; runs that broke off count as attempts only.

    runs: run_id, broke, status, expected_status, items, expected_items, matched, strategy counts
    (line_reference, pct_code, product), failed_expected, failed_detected, failed_unexpected,
    state, review, review_expected, seconds; fields: run_id, field, correct, missing, review.
    """
    percent = lambda a, b: F.round(F.when(b > 0, 100.0 * a / b), 2)
    usable = runs.where("not broke")
    good = F.col("status") == F.col("expected_status")
    wrong = lambda s: F.count_if(~good & (F.col("status") == s)).cast("double")
    r = {
        "line_item_count_accuracy": percent(F.count_if(F.col("items") == F.col("expected_items")), F.count("*")), "match_accuracy": percent(F.count_if(F.col("matched") == F.col("expected_items")), F.count("*")),
        "line_reference_matches": F.sum("line_reference").cast("double"), "pct_code_matches": F.sum("pct_code").cast("double"), "product_name_matches": F.sum("product").cast("double"),
        "overall_status_accuracy": percent(F.count_if(good), F.count("*")), "expected_failed_checks_detected": percent(F.sum("failed_detected"), F.sum("failed_expected")),
        "unexpected_failed_checks": F.sum("failed_unexpected").cast("double"), "missed_failed_checks": F.sum(F.col("failed_expected") - F.col("failed_detected")).cast("double"),
        "false_pass_count": wrong("passed"), "false_failure_count": wrong("failed"), "false_manual_review_count": wrong("manual_review"), "evaluated": F.count("*").cast("double"),
    }
    a = {
        "attempted": F.count("*").cast("double"), "technical_failures": F.count_if("broke").cast("double"), "completed": F.count_if(F.col("state") == "completed").cast("double"),
        "awaiting_human_review": F.count_if(F.col("state") == "awaiting_human_review").cast("double"), "workflow_failed": F.count_if(F.col("state") == "failed").cast("double"),
        "human_review_accuracy": percent(F.count_if(F.col("state").isNotNull() & (F.col("review") == F.col("review_expected"))), F.count_if(F.col("state").isNotNull())),
        "average_duration_seconds": F.round(F.avg("seconds"), 2),
    }
    kept = fields.join(usable.select("run_id"), "run_id", "left_semi")
    f = {
        "exact_field_accuracy": percent(F.count_if("correct"), F.count("*")), "missing_field_rate": percent(F.count_if("missing"), F.count("*")),
        "incorrect_field_rate": percent(F.count_if(~F.col("correct") & ~F.col("missing")), F.count("*")), "manual_review_field_rate": percent(F.count_if("review"), F.count("*")),
    }
    tall = lambda df, ms: df.agg(*[v.alias(k) for k, v in ms.items()]).unpivot([], list(ms), "metric", "value")
    by_field = kept.groupBy("field").agg(percent(F.count_if("correct"), F.count("*")).alias("value")).select(F.concat("field", F.lit("_accuracy")).alias("metric"), "value")
    middle = medians(runs, [], "seconds").select(F.lit("median_duration_seconds").alias("metric"), F.round("median", 2).alias("value"))
    return tall(usable, r).unionByName(tall(runs, a)).unionByName(middle).unionByName(tall(kept, f)).unionByName(by_field)


#: Looser than the patterns of extraction, whether a field is printed at all.
PROBES = {
    "invoice_number": r"invoice\s*(?:no|num|#)", "invoice_date": r"date", "exporter_name": r"exporter|shipper|seller|consignor", "exporter_address": r"exporter\s+address|shipper\s+address", "exporter_ntn": r"\bntn\b|national\s+tax",
    "consignee_name": r"consignee|buyer|importer", "consignee_address": r"consignee\s+address|buyer\s+address", "country_of_origin": r"country\s+of\s+origin|origin", "country_of_destination": r"destination",
    "port_of_loading": r"port\s+of\s+(?:loading|lading|shipment)", "port_of_discharge": r"port\s+of\s+(?:discharge|delivery)", "incoterm": r"incoterm|delivery\s+terms|\b(?:FOB|CIF|CFR|EXW|DDP)\b", "currency": r"currency|\b(?:USD|PKR|EUR)\b",
    "total_invoice_value": r"total|grand\s+total", "gross_weight": r"gross\s+w", "net_weight": r"net\s+w", "number_of_packages": r"packages|cartons|bales", "bl_awb_number": r"bill\s+of\s+lading|b/l|awb", "gd_number": r"goods\s+declaration|gd\s*no", "form_e_number": r"form\s*-?\s*e",
}


def present_fields(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, field): fields that are printed somewhere, by their probes."""
    text = F.coalesce(text_col, F.lit(""))
    return documents.select(id_col, F.explode(F.array_compact(F.array(*[F.when(text.rlike(f"(?i){r}"), F.lit(f)) for f, r in PROBES.items()]))).alias("field"))


def presence_coverage(fields: DataFrame, present: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per field: documents that print it, those where it was resolved, and the share."""
    resolved = fields.where("value is not null and grade in ('high', 'medium')").select(id_col, "field", F.lit(True).alias("_ok"))
    joined = present.join(resolved, [id_col, "field"], "left").groupBy("field").agg(F.count("*").alias("present"), F.count("_ok").alias("resolved"))
    return joined.withColumn("coverage", F.round(F.col("resolved") / F.col("present"), 4))


def telemetry(runs: DataFrame, budget: int = 1) -> DataFrame:
    """One row over documents: coverage by patterns, calls, tokens, cache hits, documents over the budget of calls.

    runs: doc_id, fields_total, fields_from_patterns, prompt_tokens, completion_tokens, calls, cache_hit.
    """
    total = F.sum("fields_total")
    return runs.agg(
        F.count("*").alias("documents"), F.count_if("cache_hit").alias("cache_hits"), F.round(F.when(total > 0, F.sum("fields_from_patterns") / total).otherwise(0.0), 4).alias("pattern_coverage"),
        F.sum("calls").alias("calls"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.count_if(F.col("calls") > budget).alias("over_budget"),
    )


def evaluation_keys(scenarios: DataFrame, documents: DataFrame, versions: dict[str, str]) -> DataFrame:
    """(scenario_id, key): a digest over a scenario's inputs, its documents' digests in order, and all versions.

    scenarios: scenario_id, variant, inputs; documents: scenario_id, name, digest.
    """
    listed = documents.groupBy("scenario_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "name", "digest"))), ",").alias("_docs"))
    stated = F.concat_ws("\x1f", *[F.lit(f"{k}={v}") for k, v in sorted(versions.items())])
    key = F.sha2(F.concat_ws("\x1e", "scenario_id", "variant", F.coalesce("inputs", F.lit("")), F.coalesce("_docs", F.lit("")), stated), 256)
    return scenarios.join(listed, "scenario_id", "left").select("scenario_id", key.alias("key"))


def primary_sources(cases: DataFrame, ranked: DataFrame) -> DataFrame:
    """Each case with its first source, whether that holds the expected name, and whether all cases do."""
    first = ranked.where("position = 1").select("case_id", F.col("source").alias("primary_source"))
    joined = cases.join(first, "case_id", "left")
    ok = F.coalesce(F.contains(F.lower("primary_source"), F.lower("expected_primary")), F.lit(False))
    return joined.select("case_id", "primary_source", ok.alias("matched"))
