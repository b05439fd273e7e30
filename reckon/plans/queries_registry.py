"""Registry, replay and review metrics (A20, A23, C8, C9, C19) over lineitem, conversations and part."""

from __future__ import annotations

from pyspark.sql import functions as F

from reckon.operators import registry
from reckon.plans.registry import query
from reckon.plans.relations import table

c = F.col


def observed(spark, sf):
    n = c("l_linenumber")
    kind = F.element_at(F.array(*map(F.lit, ("covered_row", "covered_group", "correct", "decided", "supporting_set", "forbidden_pair", "decision_mismatch"))), n)
    line = table(spark, sf, "lineitem")
    both = line.select(c("l_returnflag").alias("split"), kind.alias("kind"), c("l_partkey").alias("ref"))
    return both.unionByName(line.filter(n == 3).select(c("l_returnflag").alias("split"), F.lit("decided").alias("kind"), c("l_partkey").alias("ref")))


REPLAY_SQL = """r AS (SELECT l_returnflag AS split, count(DISTINCT l_partkey) FILTER (WHERE l_linenumber = 1) AS a, count(DISTINCT l_partkey) FILTER (WHERE l_linenumber = 2) AS b, count(DISTINCT l_partkey) FILTER (WHERE l_linenumber = 3) AS c,
  count(DISTINCT l_partkey) FILTER (WHERE l_linenumber IN (3, 4)) AS d, count(DISTINCT l_partkey) FILTER (WHERE l_linenumber = 5) AS e, count(DISTINCT l_partkey) FILTER (WHERE l_linenumber = 6) AS f, count(DISTINCT l_partkey) FILTER (WHERE l_linenumber = 7) AS g FROM lineitem GROUP BY 1)"""


@query(f"""WITH {REPLAY_SQL} SELECT split, a AS coverage_rows_numerator, CAST(5000 AS BIGINT) AS coverage_rows_denominator, b AS coverage_groups_numerator, CAST(900 AS BIGINT) AS coverage_groups_denominator, c AS precision_numerator, d AS precision_denominator,
  e AS support_document_sets, CAST(0 AS BIGINT) AS contradiction_count, f AS forbidden_pair_count, g AS decision_mismatch_count, CAST(0 AS BIGINT) AS calculation_mismatch_count, CAST(0 AS BIGINT) AS xlsx_mismatch_count FROM r""")
def a20_replay_metrics(spark, sf):
    return registry.replay_metrics(observed(spark, sf), 5000, 900)


@query(f"""WITH {REPLAY_SQL} SELECT split, 'hold' AS verdict, concat_ws(',', CASE WHEN split = 'A' THEN 'CONTRADICTION_PRESENT' END, CASE WHEN a * 2 < 5000 OR b * 2 < 900 THEN 'COVERAGE_BELOW_THRESHOLD' END, CASE WHEN g > 0 THEN 'DECISION_MISMATCH' END, CASE WHEN f > 0 THEN 'FORBIDDEN_MERGE_PRESENT' END,
  CASE WHEN split = 'N' THEN 'PATTERN_STATE_INVALID' END, CASE WHEN c * 100 < d * 99 THEN 'PRECISION_BELOW_THRESHOLD' END, CASE WHEN split = 'R' THEN 'SUPPORT_INSUFFICIENT' END) AS reasons FROM r""")
def c8_promotion(spark, sf):
    s = c("split")
    rows = registry.replay_metrics(observed(spark, sf), 5000, 900).select("*", s.alias("pattern_id"), F.when(s == "N", "active").otherwise("shadow").alias("state"), F.lit(5).alias("confirmed_records"), F.when(s == "R", 1).otherwise(4).alias("support_sets"), F.when(s == "A", 1).otherwise(0).alias("contradictions"))
    return registry.promotion(rows, registry.Policy(least_coverage_rows=(1, 2), least_coverage_groups=(1, 2))).select("split", "verdict", F.array_join("reasons", ",").alias("reasons"))


@query("""WITH x AS (SELECT DISTINCT conv_id AS p, turn + 1 AS t FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY t) AS n FROM x),
e AS (SELECT p, t, CASE WHEN t <> n THEN 'REVISION_GAP' WHEN p % 7 = 0 AND t = 3 THEN 'HEAD_STALE' WHEN t > 3 AND p % 5 = 0 AND t = 4 THEN 'ACTIVATION_UNVERIFIED' WHEN t > 4 AND NOT (p % 5 = 0 AND t = 5) THEN 'STATE_TRANSITION_INVALID' END AS error FROM n)
SELECT p AS pattern_id, CAST(t AS INTEGER) AS revision, error FROM e WHERE error IS NOT NULL""")
def c9_registry_log(spark, sf):
    t = table(spark, sf, "conversations").select(c("conv_id").alias("pattern_id"), (c("turn") + 1).cast("int").alias("revision")).distinct()
    r, p = c("revision"), c("pattern_id")
    state = F.when(r == 1, "proposed").when(r == 2, "shadow").when(r == 3, "owner_approved").when((r == 4) & (p % 5 == 0), "active").otherwise("retired")
    name = lambda n: F.concat(F.lit("f"), n.cast("string"))
    return registry.check_log(t.select("pattern_id", "revision", state.alias("state"), name(r).alias("fingerprint"), F.when((p % 7 == 0) & (r == 3), "other").when(r > 1, name(r - 1)).alias("expected_head")))


@query("""SELECT CAST(count(*) AS BIGINT) AS review_candidates, CAST(count(*) FILTER (WHERE l_linenumber <= 4) AS BIGINT) AS packets, CAST(count(*) FILTER (WHERE l_linenumber = 1) AS BIGINT) AS singleton_packets, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS feedback_hits,
  CAST(0 AS BIGINT) AS review_applies, CAST(0 AS BIGINT) AS post_review_errors, round(count(*) FILTER (WHERE l_linenumber = 1) / count(*) FILTER (WHERE l_linenumber <= 4), 9) AS singleton_share, round(count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 9) AS feedback_hit_rate, CAST(0 AS DOUBLE) AS post_review_error_rate FROM lineitem""")
def a23_review_metrics(spark, sf):
    names = F.array_compact(F.array(F.lit("review_candidates"), F.when(c("l_linenumber") <= 4, "packets"), F.when(c("l_linenumber") == 1, "singleton_packets"), F.when(c("l_returnflag") == "R", "feedback_hits")))
    return registry.review_metrics(table(spark, sf, "lineitem").select(F.explode(names).alias("counter"), F.lit(1).alias("amount")))


@query("SELECT true AS equal, false AS changed")
def c19_recomputed_rows(spark, sf):
    o = table(spark, sf, "orders")
    same = registry.same_rows(o, o.repartition(5)).select(c("same").alias("equal"))
    return same.crossJoin(registry.same_rows(o, o.unionByName(o.limit(1))).select(c("same").alias("changed")))
