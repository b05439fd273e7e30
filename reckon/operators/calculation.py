"""Exact totals over matched rows: sums of included values, one coefficient, one half-up rounding at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reckon.functions.numeric import MONEY, round_to_quantum

#: Default coefficient, rounding quantum, cost tolerance; cost categories by code.
COEFFICIENT, QUANTUM, TOLERANCE = "2.7", "0.01", "0.05"
UNCLASSIFIED = "unclassified"
SUM = "decimal(38,6)"


def rule_decision(clauses_hit: DataFrame) -> DataFrame:
    """One decision per (target_row_id, source_row_id) from the clauses that hold for it.

    Any exclude or review clause sends the pair to review; the include flags of include clauses are or-ed.
    """
    include = F.col("action") == "include"
    return clauses_hit.groupBy("target_row_id", "source_row_id").agg(
        F.bool_or(include & F.col("include_quantity")).alias("include_quantity"), F.bool_or(include & F.col("include_cost")).alias("include_cost"),
        F.bool_or(F.col("action") == "exclude").alias("excluded"), F.bool_or(F.col("action") == "needs_review").alias("manual_review"),
        F.array_sort(F.collect_set(F.concat_ws(":", "rule_id", "action"))).alias("decisions"),
    )


def contributions(selected: DataFrame, categories: dict[str, str] | None = None, allowed_units: tuple[str, ...] = ()) -> DataFrame:
    """Selected pairs with category, included values and warnings.

    selected: target_row_id, source_row_id, quantity, cost, source_unit, target_unit, cost_type_code, include_quantity,
    include_cost. A quantity counts only if the source unit is allowed and equals the target's (if it has one).
    """
    unit = F.col("source_unit")
    gate = F.col("target_unit").isNull() | F.coalesce(unit == F.col("target_unit"), F.lit(False))
    if allowed_units:
        gate = gate & F.coalesce(unit.isin(*allowed_units), F.lit(False))
    counted = F.col("include_quantity") & gate
    category = F.lit(UNCLASSIFIED)
    for code, name in (categories or {}).items():
        category = F.when(F.col("cost_type_code") == code, F.lit(name)).otherwise(category)
    warnings = F.array_compact(F.array(
        F.when(F.col("cost") < 0, "NEGATIVE_COST"), F.when(F.col("quantity") < 0, "NEGATIVE_QUANTITY"), F.when(F.col("include_quantity") & ~gate, "QUANTITY_UNIT_MISMATCH"),
    ))
    return selected.select(
        "target_row_id", "source_row_id", category.alias("category"), "quantity", "cost",
        F.when(counted, F.col("quantity")).alias("included_quantity"), F.when(F.col("include_cost"), F.col("cost")).alias("included_cost"),
        counted.alias("include_quantity"), "include_cost", warnings.alias("warnings"),
    )


def rounded_cost(raw: Column, coefficient: str = COEFFICIENT, quantum: str = QUANTUM) -> Column:
    return round_to_quantum(raw.cast("decimal(24,6)") * F.lit(coefficient).cast("decimal(10,4)"), quantum).cast(MONEY)


def target_totals(rows: DataFrame, coefficient: str = COEFFICIENT, quantum: str = QUANTUM) -> DataFrame:
    """One row per target: quantity, cost_before_coefficient, cost, calculation_status, n_contributions.

    A sum of nothing is null and an explicit 0 stays 0. Partial sums are taken before the shuffle.
    """
    grouped = rows.groupBy("target_row_id").agg(
        F.sum(F.col("included_quantity").cast(MONEY)).alias("q"), F.sum(F.col("included_cost").cast(MONEY)).alias("c"),
        F.count("*").alias("n_contributions"), F.bool_or(F.size("warnings") > 0).alias("warned"),
    )
    status = F.when(F.col("q").isNull() & F.col("c").isNull(), "no_values").when(F.col("warned"), "calculated_with_warnings").otherwise("calculated")
    return grouped.select("target_row_id", round_to_quantum(F.col("q"), quantum).cast(MONEY).alias("quantity"), F.col("c").cast(MONEY).alias("cost_before_coefficient"), rounded_cost(F.col("c"), coefficient, quantum).alias("cost"), status.alias("calculation_status"), "n_contributions")


def category_totals(rows: DataFrame, categories: tuple[str, ...], coefficient: str = COEFFICIENT, quantum: str = QUANTUM) -> DataFrame:
    """Totals of every category of every target; categories without rows have nulls."""
    names = F.explode(F.array(*map(F.lit, (*categories, UNCLASSIFIED)))).alias("category")
    every = rows.select("target_row_id").distinct().select("target_row_id", names)
    grouped = rows.groupBy("target_row_id", "category").agg(F.sum(F.col("included_quantity").cast(MONEY)).alias("q"), F.sum(F.col("included_cost").cast(MONEY)).alias("c"))
    out = every.join(grouped, ["target_row_id", "category"], "left")
    return out.select("target_row_id", "category", round_to_quantum(F.col("q"), quantum).cast(MONEY).alias("quantity"), F.col("c").cast(MONEY).alias("cost_before_coefficient"), rounded_cost(F.col("c"), coefficient, quantum).alias("cost"))


def sum_or_zero(column: str) -> Column:
    """Sum that starts at 0 and ignores nulls."""
    return F.coalesce(F.sum(F.col(column).cast(MONEY)), F.lit(0)).cast(SUM)
