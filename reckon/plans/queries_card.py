"""Drawing cards (F9-F11, C4, C6, C18, J10-J12, J26, A4, A9, A11, K11) over part, lineitem and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reckon.operators import card
from reckon.plans.registry import query
from reckon.plans.relations import MONEY, SOURCE_SQL, source_rows, table

c = F.col
RULES = {
    "blue": {"any": ("blue",), "not": ("blue widget",), "units": ("STANDARD", "PROMO", "ECONOMY")},
    "large": {"any": ("large",), "units": ("STANDARD", "SMALL")},
    "green_gear": {"all": (("green", "gear"),)},
}
NEGATIVE = ("red bolt",)


@query("""SELECT p_partkey, regexp_matches(p_name, '(^|[^0-9a-z])blue') AS prefix, contains(p_name, 'blue widget') AS phrase,
  EXISTS (SELECT 1 FROM (SELECT unnest(regexp_extract_all(p_name, '[0-9a-z]+')) AS t) WHERE starts_with(t, 'widgot') OR (length(t) >= 6 AND levenshtein(t, 'widgot') <= 1)) AS near FROM part""")
def f9_masks(spark, sf):
    name = F.lower("p_name")
    return table(spark, sf, "part").select("p_partkey", card.contains_mask(name, "Blue").alias("prefix"), card.contains_mask(name, "blue  widget").alias("phrase"), card.contains_mask(name, "widgot").alias("near"))


def card_rows(spark, sf):
    rows = source_rows(spark, sf)
    return rows.select(
        c("source_row_id").alias("row_id"), c("object_code").alias("object_index"), F.concat_ws("-", "subobject_code", "cost_type_code").alias("drawing_key"), c("work_name").alias("text"), F.when(c("l_linenumber") % 5 != 0, c("unit")).alias("unit"),
        F.when(c("l_linenumber") % 3 == 0, F.lit(0)).otherwise(c("quantity")).cast(MONEY).alias("quantity"), F.when(c("l_linenumber") % 4 == 0, F.lit(None)).otherwise(c("cost")).cast(MONEY).alias("cost"), "l_linenumber",
    )


CARD_SQL = f"""{SOURCE_SQL},
r AS (SELECT source_row_id AS row_id, object_code AS object_index, subobject_code || '-' || cost_type_code AS drawing_key, work_name AS text, CASE WHEN l_linenumber % 5 <> 0 THEN unit END AS unit,
  CAST(CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE quantity END AS DECIMAL(20,6)) AS quantity, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE cost END AS cost, l_linenumber FROM src),
h AS (SELECT *, regexp_matches(text, '(^|[^0-9a-z])blue') AND NOT contains(text, 'blue widget') AS b, regexp_matches(text, '(^|[^0-9a-z])large') AS l, regexp_matches(text, '(^|[^0-9a-z])green') AND regexp_matches(text, '(^|[^0-9a-z])gear') AS g FROM r),
f AS (SELECT *, b AND (unit IS NULL OR unit IN ('STANDARD', 'PROMO', 'ECONOMY')) AS fb, l AND (unit IS NULL OR unit IN ('STANDARD', 'SMALL')) AS fl FROM h),
n AS (SELECT *, b::INT + l::INT + g::INT AS hits, fb::INT + fl::INT + g::INT AS fits, coalesce(quantity = 0, true) AND coalesce(cost = 0, true) AS idle FROM f),
s AS (SELECT *, CASE WHEN idle THEN 'deterministic_no_impact' WHEN contains(text, 'red bolt') THEN 'deterministic_negative' WHEN fits = 1 THEN 'deterministic_rules' WHEN hits > 0 THEN 'review' ELSE 'deterministic_irrelevant' END AS strategy FROM n),
d AS (SELECT *, CASE WHEN strategy = 'deterministic_rules' THEN CASE WHEN fb THEN 'blue' WHEN fl THEN 'large' ELSE 'green_gear' END WHEN strategy = 'review' AND hits = 1 THEN CASE WHEN b THEN 'blue' WHEN l THEN 'large' ELSE 'green_gear' END END AS category,
  CASE WHEN strategy = 'review' THEN 'review' WHEN strategy = 'deterministic_rules' AND coalesce(quantity <> 0, false) THEN 'include' ELSE 'exclude' END AS quantity_decision,
  CASE WHEN strategy = 'review' THEN 'review' WHEN strategy = 'deterministic_rules' AND coalesce(cost <> 0, false) THEN 'include' ELSE 'exclude' END AS cost_decision FROM s)"""


def classified(spark, sf):
    return card.classify(card_rows(spark, sf), RULES, NEGATIVE)


@query(f"WITH {CARD_SQL} SELECT row_id, category, strategy, quantity_decision, cost_decision, strategy = 'review' AS requires_review FROM d")
def c4_row_classification(spark, sf):
    return classified(spark, sf).select("row_id", "category", "strategy", "quantity_decision", "cost_decision", "requires_review")


def for_totals(spark, sf):
    return classified(spark, sf).select("*", c("row_id").alias("seq"), F.concat(F.lit("rules:"), "category").alias("rule_id"), F.when(c("l_linenumber") % 2 == 0, 0.99).otherwise(0.5).alias("confidence"))


TOTAL_SQL = f"""{CARD_SQL}, k AS (SELECT *, quantity_decision = 'include' AND quantity IS NOT NULL AS q, cost_decision = 'include' AND cost IS NOT NULL AS v, CASE WHEN l_linenumber % 2 = 0 THEN 0.99 ELSE 0.5 END AS conf FROM d WHERE category IS NOT NULL),
t AS (SELECT object_index, drawing_key, category, count(DISTINCT unit) FILTER (WHERE q) AS nu, min(unit) FILTER (WHERE q) AS u, sum(quantity) FILTER (WHERE q) AS sq, sum(cost) FILTER (WHERE v) AS sv, count(*) FILTER (WHERE q) AS nq, count(*) FILTER (WHERE v) AS nv,
  min(conf) FILTER (WHERE q) AS conf, bool_or(strategy = 'review') AS rev FROM k GROUP BY 1, 2, 3),
a AS (SELECT object_index, drawing_key, category, CASE WHEN nu = 1 THEN u END AS unit, CAST(CASE WHEN nu > 1 THEN NULL ELSE coalesce(sq, CASE WHEN sv IS NOT NULL THEN 0 END) END AS DECIMAL(20,6)) AS quantity, CAST(sv AS DECIMAL(20,6)) AS total_cost, nq AS n_quantity_rows, nv AS n_cost_rows,
  CASE WHEN nq > 0 THEN 'rules:' || category END AS quantity_rule_id, CAST(conf AS DOUBLE) AS quantity_confidence, CASE WHEN nq > 0 THEN 'deterministic_rules' ELSE '' END AS strategies, nu > 1 OR rev AS requires_review, CASE WHEN nu > 1 THEN 'UNIT_MISMATCH' WHEN rev THEN 'WARNING' ELSE 'OK' END AS status FROM t)"""


@query(f"WITH {TOTAL_SQL} SELECT * FROM a")
def a4_card_totals(spark, sf):
    out = card.aggregate(for_totals(spark, sf))
    return out.withColumn("strategies", F.array_join("quantity_strategies", ",")).drop("quantity_strategies").withColumn("quantity_confidence", c("quantity_confidence").cast("double"))


@query(f"""WITH {TOTAL_SQL}, e AS (SELECT DISTINCT object_index, drawing_key, x.category FROM r, (VALUES ('blue'), ('large'), ('green_gear'), ('none')) x(category))
SELECT e.object_index, e.drawing_key, e.category, coalesce(unit, CASE e.category WHEN 'blue' THEN 'm' WHEN 'none' THEN 't' END) AS unit, quantity, total_cost, CASE WHEN a.category IS NOT NULL THEN status WHEN e.category IN ('blue', 'none') THEN 'UNIT_FROM_TEMPLATE' ELSE 'VALUE_NOT_FOUND' END AS status,
  coalesce(requires_review, false) AS requires_review FROM e LEFT JOIN a USING (object_index, drawing_key, category)""")
def j11_complete_cards(spark, sf):
    rows = for_totals(spark, sf)
    return card.complete(card_rows(spark, sf), card.aggregate(rows), ("blue", "large", "green_gear", "none"), {"blue": "m", "none": "t"})


@query(f"""WITH {TOTAL_SQL} SELECT object_index, category, CASE WHEN count(DISTINCT unit) = 1 AND count(*) = count(unit) THEN min(unit) END AS unit, CAST(sum(quantity) AS DECIMAL(38,6)) AS quantity, CAST(sum(total_cost) / 1000 AS DECIMAL(38,6)) AS total_cost FROM a GROUP BY 1, 2""".replace("CAST(sum(total_cost) / 1000 AS DECIMAL(38,6))", "CAST(sum(total_cost) * 0.001 AS DECIMAL(38,6))"))
def a11_card_summary(spark, sf):
    return card.summary(card.aggregate(for_totals(spark, sf)), cost_scale=1000)


@query(f"""WITH {CARD_SQL}, z AS (SELECT CASE WHEN l_linenumber = 7 THEN 'HIERARCHY_AGGREGATE_EXCLUDED' WHEN strategy = 'review' THEN 'MANUAL_REVIEW' WHEN category IS NOT NULL THEN 'MATCHED' ELSE 'UNCLASSIFIED' END AS disposition FROM d),
m AS (SELECT count(*) AS total, count(*) FILTER (WHERE disposition LIKE 'HIERARCHY%') AS ex FROM z)
SELECT x.disposition, (SELECT count(*) FROM z WHERE z.disposition = x.disposition) AS n, round(ex / total, 6) AS exclusion_share, ex / total > 0.5 AS anomalous
FROM (VALUES ('HIERARCHY_AGGREGATE_EXCLUDED'), ('HIERARCHY_RESOURCE_DETAIL_EXCLUDED'), ('MANUAL_REVIEW'), ('MATCHED'), ('UNCLASSIFIED')) x(disposition), m""")
def a9_funnel(spark, sf):
    rows = classified(spark, sf).select(F.when(c("l_linenumber") == 7, "HIERARCHY_AGGREGATE_EXCLUDED").otherwise(card.disposition(c("requires_review"), c("category"))).alias("disposition"))
    return card.funnel(rows)


def halves(spark, sf):
    o = table(spark, sf, "orders")
    rows = o.groupBy("o_custkey", "o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.sum(c("o_totalprice").cast(MONEY)).cast(MONEY).alias("total_cost"), F.count("*").cast(MONEY).alias("quantity"), F.min("o_orderstatus").alias("unit"))
    one = lambda y: rows.filter(c("y") == y).select("o_custkey", "o_orderpriority", "unit", F.when(c("quantity") > 1, c("quantity")).alias("quantity"), "total_cost")
    return one(1995), one(1994)


HALF_SQL = """g AS (SELECT o_custkey, o_orderpriority, year(o_orderdate) AS y, CAST(sum(CAST(o_totalprice AS DECIMAL(20,6))) AS DECIMAL(20,6)) AS total_cost, CASE WHEN count(*) > 1 THEN CAST(count(*) AS DECIMAL(20,6)) END AS quantity, min(o_orderstatus) AS unit FROM orders GROUP BY 1, 2, 3),
b AS (SELECT coalesce(n.o_custkey, o.o_custkey) AS o_custkey, coalesce(n.o_orderpriority, o.o_orderpriority) AS o_orderpriority, n.unit AS nu, o.unit AS ou, n.quantity AS nq, o.quantity AS oq, n.total_cost AS nc, o.total_cost AS oc, n.o_custkey IS NULL AS preserved
  FROM (SELECT * FROM g WHERE y = 1995) n FULL JOIN (SELECT * FROM g WHERE y = 1994) o ON n.o_custkey = o.o_custkey AND n.o_orderpriority = o.o_orderpriority)"""


@query(f"WITH {HALF_SQL} SELECT o_custkey, o_orderpriority, coalesce(nu, ou) AS unit, coalesce(nq, oq) AS quantity, coalesce(nc, oc) AS total_cost, preserved, '' AS conflicts FROM b")
def j12_merge_overwrite(spark, sf):
    new, old = halves(spark, sf)
    return card.merge_update(new, old, ["o_custkey", "o_orderpriority"], ["unit", "quantity", "total_cost"], "overwrite").withColumn("conflicts", F.array_join("conflicts", ","))


@query(f"""WITH {HALF_SQL} SELECT o_custkey, o_orderpriority, coalesce(ou, nu) AS unit, coalesce(oq, nq) AS quantity, coalesce(oc, nc) AS total_cost, preserved,
  concat_ws(',', CASE WHEN nu <> ou THEN 'unit' END, CASE WHEN nq <> oq THEN 'quantity' END, CASE WHEN nc <> oc THEN 'total_cost' END) AS conflicts FROM b""")
def j12_merge_conflicts_to_review(spark, sf):
    new, old = halves(spark, sf)
    return card.merge_update(new, old, ["o_custkey", "o_orderpriority"], ["unit", "quantity", "total_cost"], "conflicts_to_review").withColumn("conflicts", F.array_join("conflicts", ","))


@query(f"WITH {HALF_SQL} SELECT o_custkey, o_orderpriority, coalesce(ou, nu) AS unit, coalesce(oq, nq) AS quantity, coalesce(oc, nc) AS total_cost, preserved, '' AS conflicts FROM b")
def j12_merge_fill_empty_only(spark, sf):
    new, old = halves(spark, sf)
    return card.merge_update(new, old, ["o_custkey", "o_orderpriority"], ["unit", "quantity", "total_cost"], "fill_empty_only").withColumn("conflicts", F.array_join("conflicts", ","))


@query(f"WITH {HALF_SQL} SELECT o_custkey, o_orderpriority, coalesce(ou, nu) AS unit, coalesce(oq, nq) AS quantity, coalesce(oc, nc) AS total_cost, preserved, '' AS conflicts FROM b")
def j12_merge_keep_existing(spark, sf):
    new, old = halves(spark, sf)
    return card.merge_update(new, old, ["o_custkey", "o_orderpriority"], ["unit", "quantity", "total_cost"], "keep_existing").withColumn("conflicts", F.array_join("conflicts", ","))


@query("""WITH x AS (SELECT l_orderkey, sum(CAST(l_quantity AS DECIMAL(20,2))) AS q, sum(CASE WHEN l_linenumber > 1 THEN CAST(l_extendedprice AS DECIMAL(20,2)) ELSE 0 END) AS k, sum(CAST(l_extendedprice AS DECIMAL(20,2))) AS p FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN q <> 0 AND k = 0 THEN 'contract_quantity_without_cost' ELSE 'performed_cost_exceeds_contract' END AS issue_code, CAST(CASE WHEN NOT (q <> 0 AND k = 0) THEN p - k END AS DECIMAL(38,2)) AS difference FROM x WHERE (q <> 0 AND k = 0) OR p - k > 1000""")
def c6_contract_violations(spark, sf):
    line = table(spark, sf, "lineitem")
    m = lambda x: F.sum(x.cast("decimal(20,2)"))
    rows = line.groupBy("l_orderkey").agg(m(c("l_quantity")).alias("contract_quantity"), m(F.when(c("l_linenumber") > 1, c("l_extendedprice")).otherwise(0)).alias("contract_cost"), m(c("l_extendedprice")).alias("performed_cost"))
    return card.contract_violations(rows, ["l_orderkey"]).withColumn("difference", c("difference").cast("decimal(38,2)"))


@query("""WITH d AS (SELECT conv_id, max_by(role, turn) AS role FROM conversations GROUP BY 1) SELECT doc_id, role AS category FROM documents JOIN d ON conv_id = doc_id WHERE role <> 'user'""")
def j10_last_decisions(spark, sf):
    docs = table(spark, sf, "documents").select(c("doc_id").alias("row_id"))
    decisions = table(spark, sf, "conversations").select(c("conv_id").alias("row_id"), c("turn").alias("seq"), F.when(c("role") != "user", c("role")).alias("category"))
    return card.last_decisions(docs, decisions).select(c("row_id").alias("doc_id"), "category")


@query("SELECT l_partkey AS row_id, CAST(max(l_orderkey) AS BIGINT) AS target_row_id, max_by(l_returnflag, (l_orderkey, l_linenumber, l_returnflag)) AS category FROM lineitem GROUP BY 1")
def j26_category_of_last_target(spark, sf):
    return table(spark, sf, "lineitem").groupBy(c("l_partkey").alias("row_id")).agg(F.max("l_orderkey").alias("target_row_id"), F.max_by("l_returnflag", F.struct("l_orderkey", "l_linenumber", "l_returnflag")).alias("category"))


@query("""WITH x AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, dense_rank() OVER (ORDER BY o_custkey) AS b FROM orders)
SELECT o_orderkey, CAST((b - 1) // 4 + 1 AS BIGINT) AS sheet, CAST((b - 1) % 4 * 5 + 1 AS BIGINT) AS first_column, CAST(r + 3 AS BIGINT) AS row_number FROM x""")
def k11_layout_plan(spark, sf):
    o = table(spark, sf, "orders")
    blocks = o.select("o_custkey").distinct().withColumn("b", F.row_number().over(Window.orderBy("o_custkey")))
    rows = o.select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("r")).join(blocks, "o_custkey")
    return rows.select("o_orderkey", (F.floor((c("b") - 1) / 4) + 1).cast("long").alias("sheet"), ((c("b") - 1) % 4 * 5 + 1).cast("long").alias("first_column"), (c("r") + 3).cast("long").alias("row_number"))
