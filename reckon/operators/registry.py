"""Pattern registry, replay and promotion: event logs in, metrics and verdicts out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Legal moves of a pattern; activation from approval needs a verified import and is refused here.
MOVES = (
    ("proposed", "shadow"), ("shadow", "owner_approved"), ("proposed", "retired"), ("shadow", "retired"), ("owner_approved", "retired"),
    ("active", "suspended"), ("active", "retired"), ("suspended", "retired"),
)
COUNTERS = ("review_candidates", "packets", "singleton_packets", "feedback_hits", "review_applies", "post_review_errors")
#: Least support of any pattern.
LEAST_RECORDS, LEAST_SETS = 3, 2


def heads(log: DataFrame) -> DataFrame:
    """The newest revision of every pattern (log: pattern_id, revision, state, fingerprint, ...)."""
    rest = [c for c in log.columns if c != "pattern_id"]
    return log.groupBy("pattern_id").agg(F.max_by(F.struct(*rest), "revision").alias("h")).select("pattern_id", "h.*")


def check_log(log: DataFrame) -> DataFrame:
    """(pattern_id, revision, error) of revisions that break the log: a gap, a stale expected head, or an illegal move.

    log: pattern_id, revision, state, fingerprint, expected_head (null for the first).
    """
    w = Window.partitionBy("pattern_id").orderBy("revision")
    legal = F.lit(False)
    for a, b in MOVES:
        legal = legal | ((F.col("_s") == a) & (F.col("state") == b))
    rows = log.select("*", F.row_number().over(w).alias("_n"), F.lag("state").over(w).alias("_s"), F.lag("fingerprint").over(w).alias("_f"))
    error = (
        F.when(F.col("revision") != F.col("_n"), "REVISION_GAP").when(~F.col("expected_head").eqNullSafe(F.col("_f")), "HEAD_STALE")
        .when((F.col("_n") == 1) & (F.col("state") != "proposed"), "STATE_TRANSITION_INVALID").when((F.col("_s") == "owner_approved") & (F.col("state") == "active"), "ACTIVATION_UNVERIFIED")
        .when((F.col("_n") > 1) & ~legal, "STATE_TRANSITION_INVALID")
    )
    return rows.select("pattern_id", "revision", error.alias("error")).filter("error is not null")


def replay_metrics(observed: DataFrame, rows: int, groups: int) -> DataFrame:
    """One row per split of distinct references by kind after a replay, with coverage and precision as fractions.

    observed: split, kind, ref. rows and groups are the snapshot's sizes.
    """
    n = lambda kind: F.count_distinct(F.when(F.col("kind") == kind, F.col("ref")))
    return observed.groupBy("split").agg(
        n("covered_row").alias("coverage_rows_numerator"), F.lit(rows).cast("long").alias("coverage_rows_denominator"), n("covered_group").alias("coverage_groups_numerator"), F.lit(groups).cast("long").alias("coverage_groups_denominator"),
        n("correct").alias("precision_numerator"), n("decided").alias("precision_denominator"), n("supporting_set").alias("support_document_sets"),
        *(n(k).alias(f"{k}_count") for k in ("contradiction", "forbidden_pair", "decision_mismatch", "calculation_mismatch", "xlsx_mismatch")),
    )


@dataclass(frozen=True)
class Policy:
    """Thresholds; fractions as (numerator, denominator)."""

    least_precision: tuple[int, int] = (99, 100)
    least_coverage_rows: tuple[int, int] = (0, 1)
    least_coverage_groups: tuple[int, int] = (0, 1)
    least_support_sets: int = 2
    least_holdout_sets: int = 1
    least_holdout_decisions: int = 1


def at_least(numerator: str, denominator: str, bound: tuple[int, int]) -> Column:
    """A fraction of columns compared by cross-multiplication; an empty denominator is below any bound over 0."""
    wide = "decimal(38,0)"
    return F.col(numerator).cast(wide) * bound[1] >= F.col(denominator).cast(wide) * bound[0]


def promotion(evidence: DataFrame, policy: Policy | None) -> DataFrame:
    """evidence (one row a pattern) with verdict and sorted reasons.

    evidence: pattern_id, state, confirmed_records, support_sets, contradictions, the holdout's replay_metrics columns.
    Without a policy, or with any reason, a pattern is not promoted.
    """
    p = policy or Policy()
    checks = [
        F.when(F.lit(policy is None), "THRESHOLDS_MISSING"), F.when(F.col("state").isin("suspended", "retired"), "REACTIVATION_UNSUPPORTED"),
        F.when(~F.col("state").isin("shadow", "owner_approved", "suspended", "retired"), "PATTERN_STATE_INVALID"),
    ]
    if policy is not None:
        checks += [
            F.when((F.col("confirmed_records") < LEAST_RECORDS) | (F.col("support_sets") < max(LEAST_SETS, p.least_support_sets)), "SUPPORT_INSUFFICIENT"),
            F.when((F.col("contradictions") > 0) | (F.col("contradiction_count") > 0), "CONTRADICTION_PRESENT"),
            F.when((F.col("support_document_sets") < p.least_holdout_sets) | (F.col("precision_denominator") < p.least_holdout_decisions), "HOLDOUT_INSUFFICIENT"),
            F.when(F.col("precision_denominator") == 0, "PRECISION_UNDEFINED").when(~at_least("precision_numerator", "precision_denominator", p.least_precision), "PRECISION_BELOW_THRESHOLD"),
            F.when(~at_least("coverage_rows_numerator", "coverage_rows_denominator", p.least_coverage_rows) | ~at_least("coverage_groups_numerator", "coverage_groups_denominator", p.least_coverage_groups), "COVERAGE_BELOW_THRESHOLD"),
            F.when(F.col("forbidden_pair_count") > 0, "FORBIDDEN_MERGE_PRESENT"), F.when(F.col("decision_mismatch_count") > 0, "DECISION_MISMATCH"),
            F.when(F.col("calculation_mismatch_count") > 0, "CALCULATION_NOT_EQUIVALENT"), F.when(F.col("xlsx_mismatch_count") > 0, "XLSX_NOT_EQUIVALENT"),
        ]
    reasons = F.array_sort(F.array_distinct(F.array_compact(F.array(*checks))))
    return evidence.withColumn("reasons", reasons).withColumn("verdict", F.when(F.size("reasons") == 0, "promote").otherwise("hold"))


def review_metrics(events: DataFrame) -> DataFrame:
    """One row of counters (events: counter, amount) and rates that are 0 over nothing."""
    sums = [F.coalesce(F.sum(F.when(F.col("counter") == k, F.col("amount"))), F.lit(0)).cast("long").alias(k) for k in COUNTERS]
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0)), 9)
    return events.agg(*sums).select("*", rate("singleton_packets", "packets").alias("singleton_share"), rate("feedback_hits", "review_candidates").alias("feedback_hit_rate"), rate("post_review_errors", "review_applies").alias("post_review_error_rate"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two relations hold the same rows as often (a recorded decision against its recomputation)."""
    cols = sorted(a.columns)
    tag = lambda df, n: df.select(F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256).alias("h"), F.lit(n).alias("n"))
    odd = tag(a, 1).unionByName(tag(b, -1)).groupBy("h").agg(F.sum("n").alias("n")).filter("n <> 0")
    return odd.agg((F.count("*") == 0).alias("same"))
