"""The gate before anything is written: issues of three severities, and one decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reckon.operators.calculation import TOLERANCE

#: Severities from least to most, and the decision that the worst one gives.
SEVERITY = {"warning": 1, "manual_review": 2, "blocking": 3}
DECISION = {0: "allow_write", 1: "allow_with_warnings", 2: "require_manual_review", 3: "block_write"}


def exceeds_tolerance(calculated: Column, selected: Column, ratio: str = TOLERANCE) -> Column:
    """|calculated - selected| / |selected| over the ratio; with selected 0 any other value; null without one."""
    wide = lambda c: c.cast("decimal(28,6)")
    return F.when(selected == 0, calculated != 0).otherwise(F.abs(wide(calculated) - wide(selected)) > F.abs(wide(selected)) * F.lit(ratio).cast("decimal(6,4)"))


def issues(rows: DataFrame) -> DataFrame:
    """One row per issue: target_row_id, code, severity.

    rows: target_row_id, status, writable, work_name, n_selected, n_contributions, calculation_status, cost,
    selected_cost, source_unit, target_unit, source_name, has_warnings, min_quantity, min_cost, sign_conflict.
    """
    c = F.col
    matched = c("status") == "matched"
    said = lambda when, code, severity: F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))
    has_cost = c("selected_cost").isNotNull()
    found = F.array_compact(F.array(
        said(c("status") == "unmatched", "UNMATCHED", "manual_review"), said(c("status") == "ambiguous", "AMBIGUOUS", "manual_review"),
        said(matched & ~c("writable"), "TARGET_NOT_WRITABLE", "blocking"), said(c("work_name").isNull() | (c("work_name") == ""), "MISSING_WORK_NAME", "manual_review"),
        said(matched & (c("source_unit").isNull() | c("target_unit").isNull()), "MISSING_UNIT", "manual_review"),
        said(matched & (c("source_unit") != c("target_unit")), "UNIT_CONFLICT", "manual_review"),
        said(c("calculation_status") == "no_values", "NO_VALUES", "blocking"), said(c("has_warnings"), "UPSTREAM_WARNING", "warning"),
        said(has_cost & c("cost").isNull(), "MISSING_REQUIRED_VALUE", "blocking"),
        said(has_cost & c("cost").isNotNull() & exceeds_tolerance(c("cost"), c("selected_cost")), "TOLERANCE_EXCEEDED", "manual_review"),
        said(matched & (c("n_contributions") != c("n_selected")), "CARDINALITY_MISMATCH", "blocking"),
        said((c("min_quantity") < 0) | (c("min_cost") < 0), "NEGATIVE_VALUE", "warning"), said(c("sign_conflict"), "SIGN_CONFLICT", "manual_review"),
    ))
    return rows.select("target_row_id", F.explode(found).alias("i")).select("target_row_id", "i.code", "i.severity")


#: Keys that the provenance of a source and of a target must have; the formulas that a trace must state.
SOURCE_PROVENANCE = ("source_file_id", "source_filename", "source_sheet", "source_row", "source_row_id")
TARGET_PROVENANCE = ("target_source_id", "sheet_name", "row_number", "target_row_id")
FORMULA_TOKENS = (
    "quantity=quantize(sum(included_period_quantity),rounding_quantum,ROUND_HALF_UP)",
    "cost_before_coefficient=sum(included_period_cost)",
    "cost=quantize(cost_before_coefficient*default_run_coefficient,rounding_quantum,ROUND_HALF_UP)",
)


def _issues(rows: DataFrame, *found: tuple[Column, str, str]) -> DataFrame:
    """(target_row_id, code, severity): one row for each condition that holds."""
    said = [F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for when, code, severity in found]
    return rows.select("target_row_id", F.explode(F.array_compact(F.array(*said))).alias("i")).select("target_row_id", "i.code", "i.severity")


def _lacks(provenance: str, keys: tuple[str, ...]) -> Column:
    gone = [F.coalesce(F.try_element_at(provenance, F.lit(k)), F.lit("")) == "" for k in keys]
    out = F.col(provenance).isNull()
    for g in gone:
        out = out | g
    return out


def candidate_issues(candidates: DataFrame) -> DataFrame:
    """Issues of selected pairs: target_row_id, source_name, source_unit, target_unit (normalized), provenance maps of both sides."""
    c = F.col
    lacks_target = _lacks("target_provenance", TARGET_PROVENANCE)
    return _issues(
        candidates, (F.coalesce(c("source_name"), F.lit("")) == "", "MISSING_WORK_NAME", "manual_review"), (_lacks("source_provenance", SOURCE_PROVENANCE), "MISSING_PROVENANCE", "blocking"),
        (lacks_target, "MISSING_PROVENANCE", "blocking"), (~lacks_target & (F.try_element_at("target_provenance", F.lit("target_row_id")) != c("target_row_id").cast("string")), "PROVENANCE_CONFLICT", "blocking"),
        (c("source_unit").isNull() | c("target_unit").isNull(), "MISSING_UNIT", "manual_review"), (c("source_unit") != c("target_unit"), "UNIT_CONFLICT", "manual_review"),
    )


def calculation_issues(rows: DataFrame) -> DataFrame:
    """Issues of calculations against their matches and traces.

    rows: target_row_id, match_result_id, calculation_target, trace_target, trace_match, rule_set_hash, formula_tokens,
    status, n_warnings, quantity, cost_before_coefficient, cost, coefficient, totals and trace_totals (arrays of structs of
    these four), selected_cost.
    """
    c = F.col
    total = lambda field: F.aggregate(F.filter(F.transform("totals", lambda x: x[field]), lambda v: v.isNotNull()), F.lit(None).cast("decimal(38,6)"), lambda a, v: F.coalesce(a, F.lit(0)).cast("decimal(38,6)") + v.cast("decimal(38,6)"), lambda a: a.cast("decimal(38,6)"))
    differs = F.lit(False)
    for field in ("quantity", "cost_before_coefficient", "cost"):
        differs = differs | ~total(field).eqNullSafe(c(field).cast("decimal(38,6)"))
    differs = differs | F.exists("totals", lambda x: x["coefficient"] != F.col("coefficient"))
    known = c("selected_cost").isNotNull()
    return _issues(
        rows, (~c("calculation_target").eqNullSafe(c("target_row_id")), "IDENTITY_MISMATCH", "blocking"), (c("status") == "no_values", "NO_VALUES", "blocking"), (c("status") == "manual_review", "AMBIGUOUS", "manual_review"),
        (c("status") == "no_match", "UNMATCHED", "manual_review"), (c("n_warnings") > 0, "UPSTREAM_WARNING", "warning"),
        (~c("trace_match").eqNullSafe(c("match_result_id")) | ~c("trace_target").eqNullSafe(c("target_row_id")), "TRACE_MISMATCH", "blocking"),
        ((c("rule_set_hash") == "") | ~c("trace_totals").eqNullSafe(c("totals")), "TRACE_MISMATCH", "blocking"), (~c("formula_tokens").eqNullSafe(F.array(*map(F.lit, FORMULA_TOKENS))), "FORMULA_MISMATCH", "blocking"),
        (differs, "TOTAL_DISCREPANCY", "blocking"), (known & c("cost").isNull(), "MISSING_REQUIRED_VALUE", "blocking"),
        (known & c("cost").isNotNull() & exceeds_tolerance(c("cost"), c("selected_cost")), "TOLERANCE_EXCEEDED", "manual_review"),
    )


def target_cell_issues(cells: DataFrame) -> DataFrame:
    """Issues of the numeric cells of targets (target_row_id, status, cache_state): the first of four that holds for a cell."""
    either = lambda mark: F.upper("status").contains(mark) | F.upper("cache_state").contains(mark)
    untrusted = F.upper("status").contains("FORMULA") & ~F.upper("cache_state").contains("CACHED")
    code = F.when(either("FORMULA_WITHOUT_CACH"), "FORMULA_WITHOUT_CACHE").when(either("EXCEL_ERROR"), "EXCEL_ERROR").when(either("VALUE_READ_FAILED"), "VALUE_READ_FAILED").when(untrusted, "UNTRUSTED_FORMULA_CACHE")
    return cells.select("target_row_id", code.alias("code"), F.lit("blocking").alias("severity")).filter("code is not null")


def contribution_issues(contributions: DataFrame, selected: DataFrame) -> DataFrame:
    """Issues of contributions (target_row_id, candidate_id, quantity, cost, has_provenance) against the selected candidates.

    Sets that differ are CARDINALITY_MISMATCH once a target; a contribution that was not selected is IDENTITY_MISMATCH.
    """
    odd = set_mismatch(contributions, selected, "target_row_id", "candidate_id").select("target_row_id", F.lit("CARDINALITY_MISMATCH").alias("code"), F.lit("blocking").alias("severity"))
    known = selected.select("target_row_id", "candidate_id", F.lit(True).alias("_there")).distinct()
    rows = contributions.join(known, ["target_row_id", "candidate_id"], "left")
    q, v = F.col("quantity"), F.col("cost")
    return odd.unionByName(_issues(
        rows, (F.col("_there").isNull(), "IDENTITY_MISMATCH", "blocking"), ((q < 0) | (v < 0), "NEGATIVE_VALUE", "warning"), ((q != 0) & (v != 0) & ((q < 0) != (v < 0)), "SIGN_CONFLICT", "manual_review"),
        (~F.col("has_provenance"), "MISSING_PROVENANCE", "blocking"),
    ))


def identity_issues(rows: DataFrame, selected: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(target_row_id, code, severity): duplicate identities (no target), sources selected by several targets, and no input."""
    none = F.lit(None).cast(dict(selected.dtypes)["target_row_id"])
    twice = duplicate_identities(rows, columns).select(none.alias("target_row_id"), F.lit("DUPLICATE_IDENTITY").alias("code"), F.lit("blocking").alias("severity"))
    reused = selected.join(source_reuse(selected).select("source_row_id"), "source_row_id").select("target_row_id", F.lit("SOURCE_ROW_REUSED").alias("code"), F.lit("manual_review").alias("severity"))
    empty = rows.agg(F.count("*").alias("n")).filter("n = 0").select(none.alias("target_row_id"), F.lit("INPUT_EMPTY").alias("code"), F.lit("blocking").alias("severity"))
    return twice.unionByName(reused).unionByName(empty)


def severity_rank(severity: Column) -> Column:
    out = F.lit(0)
    for name, rank in SEVERITY.items():
        out = F.when(severity == name, rank).otherwise(out)
    return out


def decide(rank: Column) -> Column:
    out = F.lit(None).cast("string")
    for value, name in DECISION.items():
        out = F.when(F.coalesce(rank, F.lit(0)) == value, name).otherwise(out)
    return out


def decision(found: DataFrame) -> DataFrame:
    """One row: the decision over all issues; no issues allow writing."""
    return found.agg(F.max(severity_rank(F.col("severity"))).alias("rank")).select(decide(F.col("rank")).alias("decision"))


def duplicate_identities(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(identity_kind, duplicate, n) of values that occur more than once in any of the identity columns."""
    kinds = F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*(F.col(c).cast("string") for c in columns)))).alias("identity_kind", "duplicate")
    return rows.select(kinds).groupBy("identity_kind", "duplicate").agg(F.count("*").alias("n")).filter("n > 1 and duplicate is not null")


def source_reuse(selected: DataFrame) -> DataFrame:
    """(source_row_id, n_targets) of sources that more than one target selected."""
    return selected.groupBy("source_row_id").agg(F.count_distinct("target_row_id").alias("n_targets")).filter("n_targets > 1")


def cardinality(matches: DataFrame, calculations: DataFrame) -> DataFrame:
    """Matches without, or with several, calculations, and calculations without a match: (match_result_id, code)."""
    a = matches.groupBy("match_result_id").agg(F.count("*").alias("n_matches"))
    b = calculations.groupBy("match_result_id").agg(F.count("*").alias("n_calculations"))
    code = F.when(F.col("n_calculations").isNull(), "MISSING_CALCULATION").when(F.col("n_matches").isNull(), "ORPHAN_CALCULATION").when(F.col("n_calculations") > 1, "CARDINALITY_MISMATCH")
    return a.join(b, "match_result_id", "full_outer").select("match_result_id", code.alias("code")).filter("code is not null")


def set_mismatch(left: DataFrame, right: DataFrame, key: str, member: str) -> DataFrame:
    """(key, n_left, n_right) of keys whose member sets differ; both sides are grouped once, nothing is paired."""
    tag = lambda df, side: df.select(key, member, F.lit(side).alias("side")).distinct()
    sides = tag(left, 1).unionByName(tag(right, 2)).groupBy(key, member).agg(F.sum("side").alias("sides"))
    out = sides.groupBy(key).agg(F.count_if(F.col("sides").isin(1, 3)).alias("n_left"), F.count_if(F.col("sides").isin(2, 3)).alias("n_right"), F.count_if(F.col("sides") < 3).alias("odd"))
    return out.filter("odd > 0").drop("odd")


def ordered_issues(found: DataFrame) -> DataFrame:
    """Issues numbered by severity (worst first), code and target."""
    return found.withColumn("place", F.row_number().over(Window.partitionBy("target_row_id").orderBy(severity_rank(F.col("severity")).desc(), "code")))
