"""Sheet schemas: required columns, confidence, status and issues of what was detected; metric columns by their values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reckon.operators.bounded import sent
from reckon.operators.sheets import SHEET

#: Required and optional columns by sheet type.
REQUIREMENTS = {
    "ks6a": (("work_name", "unit"), ("position_code", "current_period_quantity", "cumulative_quantity", "current_period_cost", "cumulative_cost")),
    "ks2": (("work_name", "unit"), ("row_number", "position_code", "current_period_quantity", "unit_price", "current_period_cost")),
    "svvr": (("work_name", "current_period_quantity"), ("object_code", "subobject_code", "position_code", "unit")),
    "additional_report": (("document_index", "work_name", "unit"), ("stage", "limit_value")),
}
#: What a warning takes off the confidence, and the confidence under which a schema is doubtful.
PENALTIES = {"SCAN_CELL_LIMIT_REACHED": 0.12, "AMBIGUOUS_HEADER": 0.18, "AMBIGUOUS_COLUMNS": 0.12, "MISSING_REQUIRED_COLUMNS": 0.18, "DATA_START_NOT_FOUND": 0.06}
TYPE_PENALTIES = {"AMBIGUOUS_SHEET_TYPE": 0.18, "UNKNOWN_SHEET_TYPE": 0.24}
LEAST_CONFIDENCE = 0.70


def required_of(sheet_type: Column, requirements: dict[str, tuple] = REQUIREMENTS) -> Column:
    """The required columns of a sheet type; empty for a type without any."""
    out = F.array().cast("array<string>")
    for name, (required, _) in requirements.items():
        out = F.when(sheet_type == name, F.array(*map(F.lit, required))).otherwise(out)
    return out


def sheet_schemas(types: DataFrame, headers: DataFrame, columns: DataFrame, starts: DataFrame, bounds: DataFrame, requirements: dict[str, tuple] = REQUIREMENTS) -> DataFrame:
    """One row per sheet: type, header rows, data row, bounds, resolved columns, warnings, confidence, status, issues.

    types: file, sheet, sheet_type, confidence, status (classify_sheets). headers: file, sheet, start_row, end_row, score,
    rank (header_bands). columns: resolve_columns. starts: data_start. bounds: column_bounds. Bands within 0.04 of the best
    score that do not overlap it make the header ambiguous.
    """
    best = headers.filter("rank = 1").select(*SHEET, "start_row", "end_row", F.col("score").alias("header_score"))
    rival = headers.filter("rank > 1").join(best.select(*SHEET, F.col("start_row").alias("_a"), F.col("end_row").alias("_b"), "header_score"), SHEET)
    rival = rival.filter((F.col("header_score") - F.col("score") <= 0.04) & ((F.col("end_row") < F.col("_a")) | (F.col("start_row") > F.col("_b")))).select(*SHEET).distinct().withColumn("_rival", F.lit(True))
    bound = F.struct("logical", "col", "confidence", "status")
    cols = columns.groupBy(*SHEET).agg(F.array_sort(F.collect_list(bound)).alias("columns"))
    out = types.select(*SHEET, "sheet_type", F.col("confidence").alias("type_confidence"), F.col("status").alias("type_status"))
    for other in (best, rival, cols, starts.select(*SHEET, "data_row"), bounds):
        out = out.join(other, SHEET, "left")
    out = out.withColumn("columns", F.coalesce("columns", F.array().cast("array<struct<logical:string,col:int,confidence:double,status:string>>")))
    resolved = F.filter("columns", lambda x: x["status"] == "OK")
    names, places = F.transform(resolved, lambda x: x["logical"]), F.array_sort(F.transform(resolved, lambda x: x["col"]))
    missing = F.array_except(required_of(F.col("sheet_type"), requirements), names)
    gaps = F.exists(F.zip_with(places, F.slice(places, 2, F.greatest(F.size(places), F.lit(1))), lambda a, b: b - a), lambda d: d > 5)
    no_header, no_data = F.col("start_row").isNull(), F.col("data_row").isNull()
    warnings = F.array_compact(F.array(
        F.when(no_header, "HEADER_NOT_FOUND"), F.when(F.col("_rival"), "AMBIGUOUS_HEADER"), F.when(~no_header & no_data, "DATA_START_NOT_FOUND"), F.when(gaps, "TABLE_COLUMN_GAPS"),
        F.when(F.exists("columns", lambda x: x["status"] == "AMBIGUOUS_COLUMN"), "AMBIGUOUS_COLUMNS"), F.when(F.size(missing) > 0, "MISSING_REQUIRED_COLUMNS"),
    ))
    out = out.withColumn("warnings", warnings).withColumn("missing", missing).withColumn("resolved", names).withColumn("n_ok", F.size(resolved))
    n_required = F.size(required_of(F.col("sheet_type"), requirements))
    score = F.col("type_confidence") * 0.28 + F.coalesce("header_score", F.lit(0.0)) * 0.27 + F.least(F.col("n_ok") / 6, F.lit(1.0)) * 0.15
    score = score + F.when(n_required > 0, (n_required - F.size("missing")) / n_required * 0.30).otherwise(F.least(F.col("n_ok") / 5, F.lit(1.0)) * 0.20)
    for name, penalty in PENALTIES.items():
        score = score - F.when(F.array_contains("warnings", name), penalty).otherwise(0.0)
    for name, penalty in TYPE_PENALTIES.items():
        score = score - F.when(F.col("type_status") == name, penalty).otherwise(0.0)
    out = out.withColumn("confidence", F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 4))
    inside = F.col("first_col").isNull() | F.forall(resolved, lambda x: x["col"].between(F.col("first_col"), F.col("last_col")))
    twice = F.size(F.array_distinct(places)) < F.size(places)
    issues = F.array_compact(F.array(
        F.when(no_header, "HEADER_NOT_FOUND"), F.when(F.col("start_row") > F.col("end_row"), "INVALID_HEADER_RANGE"), F.when(F.col("data_row") <= F.col("end_row"), "INVALID_DATA_START"), F.when(twice, "DUPLICATE_PHYSICAL_COLUMN"),
        F.when(F.col("sheet_type").isin("title", "technical") & (F.col("n_ok") >= 3), "SHEET_TYPE_COLUMN_CONFLICT"), F.when(F.size("missing") > 0, "MISSING_REQUIRED_COLUMNS"), F.when(~inside, "COLUMN_OUTSIDE_TABLE_BOUNDS"),
        F.when(F.col("confidence") < LEAST_CONFIDENCE, "LOW_CONFIDENCE_SCHEMA"),
    ))
    status = (
        F.when(F.col("type_status") == "UNKNOWN_SHEET_TYPE", "UNKNOWN_SHEET_TYPE").when(no_header, "HEADER_NOT_FOUND").when(F.col("type_status") == "AMBIGUOUS_SHEET_TYPE", "AMBIGUOUS_SHEET_TYPE")
        .when(F.col("_rival"), "AMBIGUOUS_HEADER").when(F.size("missing") > 0, "MISSING_REQUIRED_COLUMNS").when(F.array_contains("warnings", "AMBIGUOUS_COLUMNS"), "AMBIGUOUS_COLUMNS")
        .when(F.col("confidence") < LEAST_CONFIDENCE, "LOW_CONFIDENCE_SCHEMA").otherwise("OK")
    )
    return out.select(*SHEET, "sheet_type", "start_row", "end_row", "data_row", "first_col", "last_col", "resolved", "missing", "warnings", "confidence", status.alias("status"), issues.alias("issues"))


def triplet_scores(samples: DataFrame, triplets: DataFrame) -> DataFrame:
    """(file, sheet, quantity_col, price_col, cost_col, score, ...): how well columns hold quantity x price = cost.

    samples: file, sheet, row, col, value (decimal), formula; triplets: quantity_col, price_col, cost_col (few). Agreement
    within max(1.01, 0.2 % of the cost) and subtracting formulas of the quantity raise the score; equal quantity and
    cost, and no formula at all, lower it.
    """
    cell = F.map_from_entries(F.collect_list(F.struct("col", F.struct("value", "formula"))))
    rows = samples.groupBy(*SHEET, "row").agg(cell.alias("cells")).join(sent(triplets, "column triplets"), F.lit(True))
    value = lambda c: F.try_element_at("cells", F.col(c))["value"]
    rows = rows.select(*SHEET, "quantity_col", "price_col", "cost_col", value("quantity_col").alias("q"), value("price_col").alias("p"), value("cost_col").alias("c"), F.try_element_at("cells", F.col("quantity_col"))["formula"].alias("f"))
    q, p, c = (F.col(x).cast("double") for x in "qpc")
    sampled = F.coalesce((q != 0) & (p != 0), F.lit(False)) & c.isNotNull()
    close = sampled & (F.abs(q * p - c) <= F.greatest(F.lit(1.01), F.abs(c) * 0.002))
    both = F.coalesce((q != 0) & (c != 0), F.lit(False))
    equal = both & (F.abs(q - c) <= F.greatest(F.lit(0.000001), F.abs(c) * 1e-9))
    out = rows.groupBy(*SHEET, "quantity_col", "price_col", "cost_col").agg(
        F.count_if(sampled).alias("relation_samples"), F.count_if(close).alias("relation_matches"), F.count_if(both).alias("comparable"), F.count_if(equal).alias("equal_nonzero"),
        F.count("f").alias("formulas"), F.count_if(F.col("f").contains("-")).alias("subtractions"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    score = share("relation_matches", "relation_samples") * 6 + share("subtractions", "formulas") * 4 + F.least(F.col("relation_samples"), F.lit(10)) * 0.1 - share("equal_nonzero", "comparable") * 5 - F.when(F.col("formulas") == 0, 3.0).otherwise(0.0)
    return out.withColumn("score", F.round(score, 6)).withColumn("relation_ratio", F.round(share("relation_matches", "relation_samples"), 6))


def metric_columns(scores: DataFrame, assigned: DataFrame) -> DataFrame:
    """(file, sheet, quantity_col, cost_col, verdict): the assigned pair, a better one, or no quantity at all.

    assigned: file, sheet, quantity_col, cost_col. A pair is suspicious if it is one column, or at least 3 comparable rows hold
    equal values in 45 % or more and 3 or more of them. Then the best other triplet takes over if it is strong (score 5, 3
    samples, 70 % agreement, 2 subtractions); else the quantity goes, since a wrong unit is worse than none.
    """
    pair = ["quantity_col", "cost_col"]
    stats = scores.groupBy(*SHEET, *pair).agg(F.max("comparable").alias("comparable"), F.max("equal_nonzero").alias("equal_nonzero"))
    now = assigned.join(stats, [*SHEET, *pair], "left")
    doubt = (F.col("quantity_col") == F.col("cost_col")) | F.coalesce((F.col("comparable") >= 3) & (F.col("equal_nonzero") >= 3) & (F.col("equal_nonzero") / F.col("comparable") >= 0.45), F.lit(False))
    now = now.select(*SHEET, *pair, doubt.alias("doubt"))
    others = scores.join(now.select(*SHEET, F.col("quantity_col").alias("_q"), F.col("cost_col").alias("_c")), SHEET).filter((F.col("quantity_col") != F.col("_q")) | (F.col("cost_col") != F.col("_c")))
    best = others.withColumn("_r", F.row_number().over(Window.partitionBy(*SHEET).orderBy(F.desc("score"), "quantity_col", "price_col"))).filter("_r = 1")
    strong = (F.col("score") >= 5) & (F.col("relation_samples") >= 3) & (F.col("relation_ratio") >= 0.7) & (F.col("subtractions") >= 2)
    best = best.filter(strong).select(*SHEET, F.col("quantity_col").alias("_bq"), F.col("cost_col").alias("_bc"))
    out = now.join(best, SHEET, "left")
    swap = F.col("doubt") & F.col("_bq").isNotNull()
    verdict = F.when(swap, "METRIC_COLUMNS_REPLACED").when(F.col("doubt"), "UNTRUSTED_QUANTITY_COLUMN_REMOVED").otherwise("KEPT")
    return out.select(*SHEET, F.when(swap, F.col("_bq")).when(~F.col("doubt"), F.col("quantity_col")).alias("quantity_col"), F.when(swap, F.col("_bc")).otherwise(F.col("cost_col")).alias("cost_col"), verdict.alias("verdict"))
