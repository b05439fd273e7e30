"""The main pipeline: match, decide, calculate, gate; stages are DataFrame functions that a caller may replace."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon.operators import calculation, matching, quality_gate
from reckon.operators.bounded import sent


@dataclass(frozen=True)
class Stages:
    """The pluggable stages. resolve, if given, takes the place of match and select: (sources, targets) -> results."""

    match: Callable[..., DataFrame] = matching.candidates
    select: Callable[..., DataFrame] = matching.select_best
    totals: Callable[..., DataFrame] = calculation.target_totals
    issues: Callable[..., DataFrame] = quality_gate.issues
    resolve: Callable[..., DataFrame] | None = None


@dataclass(frozen=True)
class Reconciliation:
    results: DataFrame
    contributions: DataFrame
    totals: DataFrame
    issues: DataFrame
    decision: DataFrame
    parameters: dict = field(default_factory=dict)


def reconcile(sources: DataFrame, targets: DataFrame, clauses: DataFrame | None = None, *, fuzzy: str | None = None, categories: dict[str, str] | None = None, allowed_units: tuple[str, ...] = (), stages: Stages = Stages()) -> Reconciliation:  # noqa: B008
    """Match sources to targets and gate the calculated totals.

    sources: source_row_id, object_code, subobject_code, position_code, work_name, unit, document_index, quantity, cost,
    cost_type_code. targets: target_row_id, the same keys, stage, selected_cost, writable. Nothing is computed before the
    caller uses a result.
    """
    results = stages.resolve(sources, targets) if stages.resolve else stages.select(targets, stages.match(sources, targets, clauses, fuzzy))
    chosen = results.filter("status = 'matched'").select("target_row_id", "source_row_id")
    s = sources.select("source_row_id", "quantity", "cost", "cost_type_code", F.col("unit").alias("source_unit"), F.col("work_name").alias("source_name"))
    t = targets.select("target_row_id", F.col("unit").alias("target_unit"), "work_name", "selected_cost", "writable")
    if clauses is None:
        flags = chosen.select("*", F.lit(True).alias("include_quantity"), F.lit(True).alias("include_cost"))
    else:
        live = sent(clauses.filter("owner_approved and status = 'approved'"), "rule clauses").alias("c")
        hit = chosen.join(sources.alias("s"), "source_row_id").join(targets.alias("t"), "target_row_id").join(
            live, matching.clause_matches("c", F.col("s.work_name"), F.col("s.unit")) & matching.scope_matches("c", F.col("t.object_code"), F.col("t.stage"), F.col("t.work_name"), F.col("s.unit"))
        )
        decided = calculation.rule_decision(hit.select("target_row_id", "source_row_id", "c.rule_id", "c.action", "c.include_quantity", "c.include_cost"))
        flags = chosen.join(decided.select("target_row_id", "source_row_id", "include_quantity", "include_cost"), ["target_row_id", "source_row_id"], "left").na.fill({"include_quantity": True, "include_cost": True})
    rows = flags.join(s, "source_row_id").join(t.select("target_row_id", "target_unit"), "target_row_id")
    parts = calculation.contributions(rows, categories, allowed_units)
    totals = stages.totals(parts)
    facts = rows.groupBy("target_row_id").agg(F.min("source_unit").alias("source_unit"), F.min("source_name").alias("source_name"), F.min("quantity").alias("min_quantity"), F.min("cost").alias("min_cost"), F.bool_or((F.col("quantity") * F.col("cost")) < 0).alias("sign_conflict"))
    full = results.join(t, "target_row_id").join(totals, "target_row_id", "left").join(facts, "target_row_id", "left")
    checked = full.select(
        "target_row_id", "status", "writable", "work_name", F.when(F.col("status") == "matched", 1).alias("n_selected"), "n_contributions", "calculation_status", "cost", "selected_cost", "source_unit", "target_unit", "source_name",
        F.coalesce(F.col("calculation_status") != "calculated", F.lit(False)).alias("has_warnings"), "min_quantity", "min_cost", F.coalesce("sign_conflict", F.lit(False)).alias("sign_conflict"),
    )
    found = stages.issues(checked)
    return Reconciliation(results, parts, totals, found, quality_gate.decision(found), {"fuzzy": fuzzy, "allowed_units": allowed_units})
