"""Canonical rows, schemas, gate codes, writing plans and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from reckon.functions import rules
from reckon.operators import card, matching, quality_gate, retrieval, rows, schema, writing
from reckon.plans import lifecycle, plugins
from reckon.plans.registry import query
from reckon.plans.relations import MONEY, table

c = F.col


def order_rows(spark, sf):
    """An order as a row with four cells: a name (some empty or unread), a quantity (some no number), a cost (some errors), a unit."""
    k = c("o_orderkey")
    unread, empty, broken = k % 17 == 0, k % 11 == 0, k % 19 == 0

    def cell(logical, at, effective, status):
        source = F.when(status == "OK", "LITERAL").otherwise(status)
        value = F.when(status == "OK", effective)
        return F.struct(F.lit(logical).alias("logical"), F.lit(at).alias("coordinate"), F.lit(None).cast("string").alias("formula"), F.lit(None).cast("string").alias("cached"), value.alias("effective"), source.alias("source"), status.alias("status"), F.array().cast("array<string>").alias("warnings"))

    name = cell("name", "A1", F.concat(F.lit("  Work "), "o_orderstatus", F.lit(" ")), F.when(unread, "VALUE_READ_FAILED").when(empty, "EMPTY").otherwise("OK"))
    quantity = cell("quantity", "B1", F.when(k % 13 == 0, "abc").otherwise(F.concat((c("o_custkey") % 100).cast("string"), F.lit(",5"))), F.lit("OK"))
    cost = cell("cost", "C1", c("o_totalprice").cast("decimal(20,2)").cast("string"), F.when(broken, "EXCEL_ERROR").otherwise("OK"))
    unit = cell("unit", "D1", F.lit("шт"), F.lit("OK"))
    return table(spark, sf, "orders").select(
        F.concat(F.lit("f"), (c("o_custkey") % 7).cast("string")).alias("source_file_id"), F.lit("book").alias("filename"), F.when(k % 23 == 0, "архив").otherwise(c("o_orderpriority")).alias("sheet"),
        k.alias("row_number"), F.lit(None).cast("string").alias("document_index"), F.lit("2026-01").alias("document_period"), F.array(name, quantity, cost, unit).alias("cells"),
    )


ORDER_SQL = """r AS (SELECT o_orderkey AS k, 'f' || (o_custkey % 7) AS f, CASE WHEN o_orderkey % 23 = 0 THEN 'архив' ELSE o_orderpriority END AS sheet, o_orderkey % 17 = 0 AS unread, o_orderkey % 11 = 0 AS empty, o_orderkey % 19 = 0 AS broken, o_orderkey % 13 = 0 AS odd,
  CASE WHEN o_orderkey % 17 <> 0 AND o_orderkey % 11 <> 0 THEN 'Work ' || o_orderstatus END AS name, CASE WHEN o_orderkey % 13 <> 0 THEN (o_custkey % 100) + 0.5 END AS q, CASE WHEN o_orderkey % 19 <> 0 THEN CAST(o_totalprice AS DECIMAL(20,2)) END AS v FROM orders)"""


@query(f"""WITH {ORDER_SQL} SELECT k AS row_number, sha256(f || chr(31) || sheet || chr(31) || k) AS row_id, name AS work_name, 'шт' AS unit, CAST(q AS DOUBLE) AS quantity, CAST(v AS DOUBLE) AS cost,
  CASE WHEN name IS NULL THEN 'ERROR' WHEN odd OR broken THEN 'PARTIAL' ELSE 'OK' END AS status,
  CASE WHEN odd THEN 2 ELSE 0 END + CASE WHEN unread THEN 1 ELSE 0 END + CASE WHEN broken THEN 1 ELSE 0 END + CASE WHEN name IS NULL THEN 1 ELSE 0 END AS n_warnings FROM r""")
def s9_form_rows(spark, sf):
    out = rows.form_rows(order_rows(spark, sf), "ks2")
    return out.select("row_number", "row_id", "work_name", "unit", c("current_period_quantity").cast("double").alias("quantity"), c("current_period_cost").cast("double").alias("cost"), "status", F.size("warnings").alias("n_warnings"))


@query(f"""WITH {ORDER_SQL} SELECT code, severity, count(*) AS n FROM (SELECT unnest(list_concat(CASE WHEN unread THEN [['VALUE_READ_FAILED', 'error'], ['REQUIRED_CELL_READ_FAILED', 'error']] ELSE [] END, CASE WHEN broken THEN [['EXCEL_ERROR', 'warning']] ELSE [] END,
  CASE WHEN k < 1 THEN [['SOURCE_LOCATION_INVALID', 'error']] ELSE [] END)) AS i FROM r) x, LATERAL (SELECT i[1] AS code, i[2] AS severity) GROUP BY 1, 2""")
def m21_row_issues(spark, sf):
    return rows.row_issues(rows.form_rows(order_rows(spark, sf), "ks2")).groupBy("code", "severity").agg(F.count("*").alias("n"))


@query(f"WITH {ORDER_SQL} SELECT k AS row_number, name AS work_name, CAST(q AS DOUBLE) AS quantity, CASE WHEN v IS NOT NULL THEN CAST(v AS DOUBLE) END AS cost, 4 AS n_cells, CASE WHEN unread THEN 'VALUE_READ_FAILED' WHEN empty THEN 'EMPTY' ELSE 'OK' END AS first_status FROM r")
def m30_payload_round_trip(spark, sf):
    made = rows.form_rows(order_rows(spark, sf), "ks6a")
    back = rows.decoded(rows.encoded(made), made)
    return back.select("row_number", "work_name", c("current_period_quantity").cast("double").alias("quantity"), c("current_period_cost").cast("double").alias("cost"), F.size("cells").alias("n_cells"), c("cells")[0]["status"].alias("first_status"))


FRAME = "unhex(printf('%08x', octet_length(encode({0})))) || encode({0})"


@query(f"""WITH x AS (SELECT p_partkey, 'ks2' AS t, '2026-01' AS d, 'No 5' AS raw, CAST(p_partkey AS VARCHAR) AS pos, lower(p_name) AS name, lower(p_type) AS unit FROM part)
SELECT p_partkey, '№ 5' AS object_code, name AS work_name, unit, len(regexp_extract_all(name, '\\w+')) AS n_name_tokens, 2 AS n_code_tokens,
  sha256({' || '.join(FRAME.format(v) for v in ("t", "d", "'№ 5'", "''", "pos", "''", "''", "''", "name", "unit"))}) AS line_id FROM x""")
def n13_normalized_rows(spark, sf):
    none = F.lit(None).cast("string")
    part = table(spark, sf, "part").select(
        "p_partkey", F.lit("KS2").alias("source_type"), F.lit(" 2026-01 ").alias("document_period"), F.lit("no. 5;").alias("object_code"), none.alias("subobject_code"), c("p_partkey").cast("string").alias("position_code"),
        none.alias("cost_type_code"), none.alias("drawing_code"), none.alias("basis_code"), F.concat(F.lit(" "), F.upper("p_name"), F.lit("  ")).alias("work_name"), c("p_type").alias("unit"),
    )
    return rows.normalized(part).select("p_partkey", "object_code", "work_name", "unit", F.size("work_name_tokens").alias("n_name_tokens"), F.size("code_tokens").alias("n_code_tokens"), "line_id")


@query(f"""WITH {ORDER_SQL}, s AS (SELECT *, CASE WHEN name IS NULL THEN 'non_detail' WHEN sheet = 'архив' THEN 'outdated' WHEN broken THEN 'formula_error' END AS left_at, dense_rank() OVER (ORDER BY f, name) AS line FROM r),
o AS (SELECT line, count(*) AS n, count(DISTINCT (q, v)) FILTER (WHERE q IS NOT NULL OR v IS NOT NULL) AS d, count(*) AS rows, count(DISTINCT coalesce(CAST(q AS VARCHAR), '') || '|' || coalesce(CAST(v AS VARCHAR), '')) AS contents FROM s WHERE left_at IS NULL GROUP BY 1)
SELECT count(*) AS input_rows, 0 AS excluded_hierarchy, count(*) FILTER (WHERE left_at = 'non_detail') AS skipped_non_detail, count(*) FILTER (WHERE left_at = 'outdated') AS skipped_outdated, count(*) FILTER (WHERE left_at = 'formula_error') AS skipped_formula_errors,
  (SELECT CAST(sum(rows - contents) AS BIGINT) FROM o) AS exact_duplicates, (SELECT CAST(sum(contents - 1) AS BIGINT) FROM o) AS collisions, (SELECT CAST(sum(contents) AS BIGINT) FROM o) AS output_rows FROM s""")
def f4_training_chain(spark, sf):
    return rows.chain_counts(rows.training_chain(rows.form_rows(order_rows(spark, sf), "ks2")))


@query("""WITH l AS (SELECT l_suppkey AS s, l_orderkey AS r, max(CASE WHEN l_linenumber = 1 THEN CAST(l_partkey AS VARCHAR) END) AS no, max(CASE WHEN l_linenumber = 2 THEN CAST(l_partkey AS VARCHAR) END) AS name, max(CASE WHEN l_linenumber = 3 THEN CAST(l_partkey AS VARCHAR) END) AS stage,
  max(CASE WHEN l_linenumber = 4 THEN l_partkey END) AS cost FROM lineitem WHERE l_linenumber <= 4 AND l_orderkey >= 5 GROUP BY 1, 2)
SELECT CAST(s AS VARCHAR) AS sheet, CAST(r AS INTEGER) AS row, CASE WHEN no IS NULL THEN 'SUMMARY' ELSE 'OBJECT_PROCESS' END AS row_kind, CASE WHEN stage IS NULL THEN 'UNSCOPED' ELSE 'SELECTED_STAGE' END AS scope, name AS work_name, CAST(cost AS DOUBLE) AS cost,
  CASE WHEN cost IS NOT NULL THEN 'FORMULA_WITH_CACHED_VALUE' END AS cache, no IS NOT NULL AS writable FROM l""")
def s10_target_rows(spark, sf):
    value, n = c("l_partkey").cast("string"), c("l_linenumber")
    cells = table(spark, sf, "lineitem").groupBy(c("l_suppkey").cast("string").alias("sheet"), c("l_orderkey").cast("int").alias("row"), n.cast("int").alias("col")).agg(F.max("l_partkey").alias("p"), F.max(value).alias("v"))
    number = F.when(c("col") == 4, c("p").cast("string")).otherwise(c("v"))
    cells = cells.select(F.lit("f").alias("file"), "sheet", "row", "col", F.when(c("col") == 4, "=A1").alias("formula"), number.alias("value"), number.alias("lexeme"), F.when(c("col") == 4, "n").otherwise("s").alias("cell_type"))
    names = F.create_map(*(F.lit(x) for p in {1: "row_number", 2: "work_name", 3: "stage", 4: "current_period_cost"}.items() for x in p))
    bindings = cells.select("file", "sheet").distinct().select("*", F.explode(names).alias("col", "logical"), F.lit(5).alias("data_row"))
    return rows.target_rows(cells, bindings).select("sheet", "row", "row_kind", "scope", "work_name", c("selected_cost.number").cast("double").alias("cost"), c("selected_cost.cache_state").alias("cache"), "writable")


@query("""SELECT p_brand AS sheet, CAST(CASE WHEN min(p_partkey) % 2 = 0 THEN 5 ELSE 2 END AS INTEGER) AS quantity_col, CAST(CASE WHEN min(p_partkey) % 2 = 0 THEN 7 ELSE 4 END AS INTEGER) AS cost_col,
  CASE WHEN min(p_partkey) % 2 = 0 THEN 'METRIC_COLUMNS_REPLACED' ELSE 'KEPT' END AS verdict FROM part GROUP BY 1 HAVING count(*) >= 3""")
def c15_metric_columns(spark, sf):
    """Columns 2 to 4 hold equal values in every second sheet; 5 to 7 hold a true product and subtracting formulas."""
    part = table(spark, sf, "part")
    even = part.groupBy("p_brand").agg((F.min("p_partkey") % 2 == 0).alias("even"), F.count("*").alias("n")).filter("n >= 3")
    own = part.join(even, "p_brand").select(c("p_brand").alias("sheet"), c("p_partkey").alias("row"), (c("p_size") + 1).cast("decimal(38,6)").alias("q"), c("p_retailprice").cast("decimal(20,2)").cast("decimal(38,6)").alias("p"), "even")
    total = (c("q").cast("decimal(18,6)") * c("p").cast("decimal(18,6)")).cast("decimal(38,6)")
    of = lambda col, v, f=None: F.struct(F.lit(col).alias("col"), v.alias("value"), (F.lit(f) if f else F.lit(None)).cast("string").alias("formula"))
    cells = own.select(F.lit("f").alias("file"), "sheet", "row", F.explode(F.array(of(2, c("q")), of(3, c("p")), of(4, F.when(c("even"), c("q")).otherwise(total)), of(5, c("q"), "=A-B"), of(6, c("p")), of(7, total))).alias("x")).select("file", "sheet", "row", "x.*")
    triplets = spark.createDataFrame([(2, 3, 4), (5, 6, 7)], "quantity_col int, price_col int, cost_col int")
    assigned = even.select(F.lit("f").alias("file"), c("p_brand").alias("sheet"), F.lit(2).alias("quantity_col"), F.lit(4).alias("cost_col"))
    return schema.metric_columns(schema.triplet_scores(cells, triplets), assigned).select("sheet", "quantity_col", "cost_col", "verdict")


@query("""WITH b AS (SELECT p_brand AS sheet, min(p_partkey) AS m FROM part GROUP BY 1), x AS (SELECT *, m % 3 = 0 AS nounit, m % 4 = 0 AS nodata FROM b)
SELECT sheet, CASE WHEN nounit THEN 'unit' ELSE '' END AS missing, concat_ws(',', CASE WHEN nodata THEN 'DATA_START_NOT_FOUND' END, CASE WHEN nounit THEN 'MISSING_REQUIRED_COLUMNS' END) AS warnings,
  round(0.9 * 0.28 + 0.8 * 0.27 + (CASE WHEN nounit THEN 2 ELSE 3 END) / 6.0 * 0.15 + (CASE WHEN nounit THEN 0.5 ELSE 1 END) * 0.30 - CASE WHEN nodata THEN 0.06 ELSE 0 END - CASE WHEN nounit THEN 0.18 ELSE 0 END, 4) AS confidence,
  CASE WHEN nounit THEN 'MISSING_REQUIRED_COLUMNS' ELSE 'OK' END AS status FROM x""")
def c13_sheet_schemas(spark, sf):
    books = table(spark, sf, "part").groupBy(c("p_brand").alias("sheet")).agg(F.min("p_partkey").alias("m")).withColumn("file", F.lit("f"))
    types = books.select("file", "sheet", F.lit("ks2").alias("sheet_type"), F.lit(0.9).alias("confidence"), F.lit("OK").alias("status"))
    headers = books.select("file", "sheet", F.explode(F.array(F.struct(F.lit(2).alias("start_row"), F.lit(3).alias("end_row"), F.lit(0.8).alias("score"), F.lit(1).alias("rank")), F.struct(F.lit(3).alias("start_row"), F.lit(3).alias("end_row"), F.lit(0.79).alias("score"), F.lit(2).alias("rank")))).alias("h")).select("file", "sheet", "h.*")
    names = {1: "position_code", 2: "work_name", 3: "unit"}
    columns = books.select("file", "sheet", "m", F.explode(F.create_map(*(F.lit(x) for p in names.items() for x in p))).alias("col", "logical")).select("file", "sheet", "logical", "col", F.lit(1.0).alias("confidence"), F.when((c("m") % 3 == 0) & (c("logical") == "unit"), "COLUMN_NOT_FOUND").otherwise("OK").alias("status"))
    starts = books.filter(c("m") % 4 != 0).select("file", "sheet", F.lit(4).alias("data_row"))
    bounds = books.select("file", "sheet", F.lit(1).alias("first_col"), F.lit(9).alias("last_col"))
    out = schema.sheet_schemas(types, headers, columns, starts, bounds)
    return out.select("sheet", F.array_join("missing", ",").alias("missing"), F.array_join("warnings", ",").alias("warnings"), "confidence", "status")


def order_decisions(spark, sf):
    o = table(spark, sf, "orders")
    targets = o.select(c("o_orderkey").alias("target_row_id"), F.lit("f").alias("file"), c("o_orderpriority").alias("sheet"), F.concat(F.lit("H"), c("o_orderkey").cast("string")).alias("quantity_cell"), F.when(c("o_orderkey") % 7 != 0, F.concat(F.lit("I"), c("o_orderkey").cast("string"))).alias("cost_cell"), (c("o_orderstatus") != "P").alias("writable"))
    totals = o.select(c("o_orderkey").alias("target_row_id"), F.when(c("o_orderkey") % 5 != 0, (c("o_custkey") / 4).cast(MONEY)).alias("quantity"), c("o_totalprice").cast("decimal(20,2)").cast(MONEY).alias("cost"))
    decisions = o.select(c("o_orderkey").alias("target_row_id"), F.when(c("o_orderkey") % 3 == 0, "block_write").when(c("o_orderkey") % 3 == 1, "allow_with_warnings").otherwise("allow_write").alias("decision"))
    return targets, totals, decisions


@query("""WITH x AS (SELECT o_orderkey AS k, o_orderpriority AS sheet, unnest([struct_pack(coordinate := 'H' || o_orderkey, v := CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey / 4 AS DECIMAL(20,6)) END), struct_pack(coordinate := CASE WHEN o_orderkey % 7 <> 0 THEN 'I' || o_orderkey END, v := CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS DECIMAL(20,6)))]) AS p
  FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 3 <> 0)
SELECT 'f' AS file, sheet, p.coordinate AS coordinate, regexp_replace(CAST(p.v AS VARCHAR), '\\.?0+$', '') AS value, k AS target_row_id FROM x WHERE p.coordinate IS NOT NULL AND p.v IS NOT NULL""")
def k8_number_patches(spark, sf):
    return writing.number_patches(*order_decisions(spark, sf))


@query("""WITH h AS (SELECT l_suppkey AS s, CAST(l_linenumber * 2 - 1 AS INTEGER) AS a, '2026-0' || l_linenumber AS p, min(l_linenumber) AS n FROM lineitem WHERE l_linenumber <> 4 AND l_suppkey % 3 <> 0 OR l_linenumber = 4 AND l_suppkey % 2 = 0 GROUP BY 1, 2, 3),
e AS (SELECT s, a + d AS col, p, CASE WHEN d = 0 THEN 'quantity' ELSE 'cost' END AS metric FROM h, (VALUES (0), (1)) t(d)),
l AS (SELECT s, max_by(col, p || lpad(CAST(col AS VARCHAR), 4, '0')) FILTER (WHERE p < '2026-04') AS place, bool_or(p = '2026-04') AS there FROM e GROUP BY 1),
g AS (SELECT * FROM l WHERE place IS NOT NULL AND NOT there)
SELECT CAST(s AS VARCHAR) AS sheet, CAST(col AS INTEGER) AS old_col, CAST(col + CASE WHEN col > place THEN 2 ELSE 0 END AS INTEGER) AS new_col, CASE WHEN col > place THEN 'move' ELSE 'keep' END AS action, p AS period, metric FROM e JOIN g USING (s)
UNION ALL SELECT CAST(s AS VARCHAR), NULL, CAST(place + d AS INTEGER), 'insert', '2026-04', CASE WHEN d = 1 THEN 'quantity' ELSE 'cost' END FROM g, (VALUES (1), (2)) t(d)""")
def k9_period_columns(spark, sf):
    n, s = c("l_linenumber"), c("l_suppkey")
    line = table(spark, sf, "lineitem").filter(((n != 4) & (s % 3 != 0)) | ((n == 4) & (s % 2 == 0))).select(s.cast("string").alias("sheet"), n).distinct()
    pair = F.explode(F.array(F.struct(F.lit(0).alias("d"), F.lit("quantity").alias("metric")), F.struct(F.lit(1).alias("d"), F.lit("cost").alias("metric")))).alias("x")
    headers = line.select(F.lit("f").alias("file"), "sheet", "l_linenumber", pair).select("file", "sheet", (c("l_linenumber") * 2 - 1 + c("x.d")).cast("int").alias("col"), F.concat(F.lit("2026-0"), c("l_linenumber").cast("string")).alias("period"), "x.metric")
    return writing.period_columns(headers, "2026-04").drop("file")


@query("""SELECT 'f' AS file, o_orderpriority AS sheet, CAST(o_orderkey AS INTEGER) AS row, CASE WHEN o_orderstatus = 'P' AND o_custkey % 2 = 0 THEN 'NO_VALUES,UNMATCHED' WHEN o_orderstatus = 'P' THEN 'UNMATCHED' ELSE 'NO_VALUES' END AS codes FROM orders WHERE o_orderstatus = 'P' OR o_custkey % 2 = 0""")
def k10_failed_marks(spark, sf):
    o = table(spark, sf, "orders")
    issue = lambda df, code, severity: df.select(c("o_orderkey").alias("target_row_id"), F.lit(code).alias("code"), F.lit(severity).alias("severity"))
    found = issue(o.filter("o_orderstatus = 'P'"), "UNMATCHED", "manual_review").unionByName(issue(o.filter("o_custkey % 2 = 0"), "NO_VALUES", "blocking")).unionByName(issue(o, "UPSTREAM_WARNING", "warning"))
    targets = o.select(c("o_orderkey").alias("target_row_id"), F.lit("f").alias("file"), c("o_orderpriority").alias("sheet"), c("o_orderkey").cast("int").alias("row"))
    return writing.failed_marks(found, targets).withColumn("codes", F.array_join("codes", ","))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '100' WHEN s_suppkey % 3 = 1 THEN '0.5' ELSE '-12.34' END AS text FROM supplier""")
def k19_exact_texts(spark, sf):
    v = F.when(c("s_suppkey") % 3 == 0, F.lit("100.000000")).when(c("s_suppkey") % 3 == 1, "0.500000").otherwise("-12.340000").cast(MONEY)
    return table(spark, sf, "supplier").select("s_suppkey", writing.exact_text(v).alias("text"))


@query("""SELECT n_name AS source_collection, CASE WHEN n_nationkey % 4 <> 0 THEN 'confirmed_examples_v' || (n_nationkey % 4) END AS target_collection, CASE WHEN n_nationkey % 4 <> 0 THEN 'confirmed_examples_current' END AS alias_name,
  CASE WHEN n_nationkey % 4 <> 0 THEN n_name END AS rollback_collection, 'm' AS model_id, '1' AS model_revision, 't' AS taxonomy_version, CASE WHEN n_nationkey % 4 = 0 THEN 'INVALID_COLLECTION_VERSION' END AS error FROM nation""")
def k20_reindex_plan(spark, sf):
    return writing.reindex_plan(table(spark, sf, "nation").select(c("n_name").alias("source_collection"), (c("n_nationkey") % 4).alias("collection_version"), F.lit("m").alias("model_id"), F.lit("1").alias("model_revision"), F.lit("t").alias("taxonomy_version")))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS row_id, CASE WHEN s_suppkey % 5 = 0 THEN 'maybe' WHEN s_suppkey % 2 = 0 THEN 'rejected' ELSE 'confirmed' END AS review_decision, CASE WHEN s_suppkey % 7 = 0 THEN 'other' ELSE 'cable' END AS review_category,
  CASE WHEN s_suppkey % 9 = 0 THEN 'UNKNOWN_ROW' WHEN s_suppkey % 5 = 0 THEN 'UNKNOWN_DECISION' WHEN s_suppkey % 2 = 1 AND s_suppkey % 7 = 0 THEN 'UNKNOWN_CATEGORY' END AS code FROM supplier WHERE s_suppkey % 4 <> 1""")
def k16_review_import(spark, sf):
    k = c("s_suppkey")
    s = table(spark, sf, "supplier")
    answers = s.select(k.cast("string").alias("row_id"), F.when(k % 4 == 1, " ").when(k % 5 == 0, "Maybe").when(k % 2 == 0, " Rejected").otherwise("confirmed").alias("review_decision"), F.when(k % 7 == 0, "other").otherwise(" cable ").alias("review_category"))
    return writing.review_import(answers, s.filter(k % 9 != 0).select(k.cast("string").alias("row_id")), ("cable", "pipe"))


@query("""WITH n AS (SELECT sha256(concat(CAST(c_nationkey AS VARCHAR), chr(0), CAST(c_custkey AS VARCHAR))) AS id, c_nationkey, c_custkey FROM customer WHERE c_custkey % 3 = 0), o AS (SELECT 'old' || c_custkey AS id, c_nationkey, c_custkey FROM customer)
SELECT id AS example_id, CAST(c_nationkey AS VARCHAR) AS tenant_id, true AS active FROM n UNION ALL SELECT id, CAST(c_nationkey AS VARCHAR), NOT (c_custkey % 3 = 0) FROM o""")
def k17_confirmed_vectors(spark, sf):
    k, t = c("c_custkey").cast("string"), c("c_nationkey").cast("string")
    customer = table(spark, sf, "customer")
    stored = customer.select(F.concat(F.lit("old"), k).alias("example_id"), t.alias("tenant_id"), F.array(F.lit(1.0)).alias("vector"), F.lit(True).alias("active"))
    outcomes = customer.select(t.alias("tenant_id"), k.alias("audit_reference"), F.array(F.lit(2.0)).alias("vector"), (c("c_custkey") % 3 == 0).alias("confirmed"), F.array(F.concat(F.lit("old"), k)).alias("replaces"))
    return writing.confirmed_vectors(stored, outcomes).drop("vector")


@query("""WITH r AS (SELECT p_partkey AS k, 'r' || (p_partkey // 2) AS rule_id, p_brand AS literal, CASE WHEN p_size % 3 = 0 THEN [] ELSE [p_type] END AS objects, p_partkey % 4 < 2 AS exclusive FROM part WHERE p_partkey < 400),
d AS (SELECT DISTINCT rule_id, literal, objects FROM r WHERE exclusive)
SELECT 'DUPLICATE_RULE_ID' AS kind, rule_id || ',' || rule_id AS rule_ids FROM r GROUP BY rule_id HAVING count(DISTINCT k) > 1
UNION ALL SELECT DISTINCT 'EXCLUSIVE_SCOPE_OVERLAP', a.rule_id || ',' || b.rule_id FROM d a JOIN d b ON a.literal = b.literal AND a.rule_id < b.rule_id WHERE len(a.objects) = 0 OR len(b.objects) = 0 OR list_has_any(a.objects, b.objects)""")
def a29_rule_conflicts(spark, sf):
    k = c("p_partkey")
    clauses = table(spark, sf, "part").filter(k < 400).select(
        F.concat(F.lit("r"), F.floor(k / 2).cast("string")).alias("rule_id"), k.cast("string").alias("definition"), (k % 4 < 2).alias("exclusive"), F.lit("include").alias("action"), F.lit("exact").alias("match_kind"), F.upper("p_brand").alias("literal"),
        F.when(c("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("p_type")).alias("object_scopes"), F.array().cast("array<string>").alias("stages"),
    )
    return rules.conflicts(clauses).withColumn("rule_ids", F.array_join("rule_ids", ","))


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id % 20 = 0), n AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v)
SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])), 6) AS similarity FROM n a JOIN n b ON a.label = b.label AND a.vec_id < b.vec_id""")
def r13_assist_pairs(spark, sf):
    groups = table(spark, sf, "embeddings").filter("vec_id % 20 = 0").select(c("vec_id").alias("group_id"), "label", c("embedding").alias("vector"))
    return retrieval.assist_pairs(groups, ["label"]).withColumn("similarity", F.round("similarity", 6))


@query("""SELECT o.o_orderkey AS query_id, p.p_partkey AS evidence_id FROM orders o JOIN part p ON o.o_custkey % 50 = p.p_partkey % 50 AND p.p_size % 4 = o.o_orderkey % 4 WHERE o.o_orderkey % 10 = 0 AND p.p_partkey % 3 <> 0 AND p.p_partkey % 7 <> 0 AND (o.o_orderkey % 20 <> 0 OR p.p_size % 5 = o.o_custkey % 5)""")
def f13_eligible_evidence(spark, sf):
    same = lambda df: df.select("*", *(F.lit("x").alias(k) for k in retrieval.CONTEXT if k not in ("project", "scope", "tenant")), F.lit(None).cast("string").alias("tenant"))
    o = table(spark, sf, "orders").filter("o_orderkey % 10 = 0").select(c("o_orderkey").alias("query_id"), (c("o_custkey") % 50).alias("project"), (c("o_orderkey") % 4).alias("scope"), (c("o_orderkey") % 20 == 0).alias("exact_only"), (c("o_custkey") % 5).alias("full_term"))
    p = table(spark, sf, "part").select(c("p_partkey").alias("evidence_id"), (c("p_partkey") % 50).alias("project"), (c("p_size") % 4).alias("scope"), (c("p_partkey") % 3 != 0).alias("confirmed"), F.lit(True).alias("unit_compatible"), F.lit(True).alias("slots_compatible"), F.when(c("p_partkey") % 7 == 0, 1).otherwise(0).alias("contradictions"), (c("p_size") % 5).alias("full_term"))
    return retrieval.eligible_evidence(same(o), same(p))


@query("""WITH x AS (SELECT l_orderkey AS s, l_suppkey AS item, l_partkey % 5 = 0 AS stale, l_partkey % 7 = 0 AS old, l_suppkey % 6 = 0 AS held, l_partkey % 2 = 0 AS act FROM (SELECT l_orderkey, l_suppkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2)),
w AS (SELECT *, CASE WHEN stale THEN 'STALE_QUEUE' WHEN old THEN 'STALE_ITEM' WHEN held THEN 'ROW_OVERRIDES' WHEN act THEN 'ACTION_NOT_ALLOWED' END AS why FROM x)
SELECT s AS sequence, item AS item_id, coalesce(why, CASE WHEN s = max(CASE WHEN why IS NULL THEN s END) OVER (PARTITION BY item) THEN 'current' ELSE 'replaced' END) AS verdict FROM w""")
def t6_shadow_intents(spark, sf):
    p = c("p")
    line = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_partkey").alias("p"))
    items = table(spark, sf, "supplier").select(
        F.lit("q").alias("queue_id"), F.lit("v1").alias("queue_fingerprint"), c("s_suppkey").alias("item_id"), F.lit("f1").alias("item_fingerprint"), F.when(c("s_suppkey") % 6 == 0, 1).otherwise(0).alias("row_override_count"),
        F.array(F.lit("accept"), F.lit("split")).alias("allowed_actions"), F.array(F.lit("a"), F.lit("b")).alias("member_refs"),
    )
    intents = line.select(
        c("l_orderkey").alias("sequence"), F.lit("q").alias("queue_id"), F.when(p % 5 == 0, "v0").otherwise("v1").alias("expected_queue_fingerprint"), c("l_suppkey").alias("item_id"), F.when(p % 7 == 0, "f0").otherwise("f1").alias("expected_item_fingerprint"),
        F.when(p % 2 == 0, "drop").otherwise("split").alias("action"), F.array(F.lit("b"), F.lit("a")).alias("split_member_refs"),
    )
    return lifecycle.fold_intents(items, intents).select("sequence", "item_id", "verdict")


@query("""SELECT p_partkey AS case_id, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS actual, CASE WHEN p_partkey % 7 <> 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE p_brand END END AS expected,
  CASE WHEN p_partkey % 7 = 0 THEN 'unknown' WHEN p_partkey % 5 = 0 THEN 'abstained' WHEN p_partkey % 3 = 0 THEN 'disagree' ELSE 'agree' END AS verdict FROM part""")
def p5_replay(spark, sf):
    cases = table(spark, sf, "part").select(c("p_partkey").alias("case_id"), "p_brand")
    executor = lambda df: df.filter("case_id % 5 <> 0").select("case_id", c("p_brand").alias("outcome"))
    oracle = lambda df: df.filter("case_id % 7 <> 0").select("case_id", F.when(c("case_id") % 3 == 0, "x").otherwise(c("p_brand")).alias("outcome"))
    return plugins.replayed(cases, executor, oracle)


@query("""SELECT p_name, count(*) AS n, CAST(len(list_filter(string_split(min(p_name), ' '), lambda w: w <> '')) % 2 AS INTEGER) AS parity FROM part GROUP BY 1""")
def p3_embedded_names(spark, sf):
    """The stand-in encoder adds one, with a sign, for each word: the sum's parity is that of the number of words."""
    out = plugins.embedded(table(spark, sf, "part"), "p_name", plugins.hashed_encoder())
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return out.groupBy("p_name").agg(F.count("*").alias("n"), F.max(F.pmod(total.cast("int"), F.lit(2))).alias("parity"))


@query("""WITH x AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders)
SELECT code, severity, count(*) AS n FROM (
  SELECT unnest(list_concat(CASE WHEN k % 3 = 0 THEN [['MISSING_WORK_NAME', 'manual_review']] ELSE [] END, CASE WHEN k % 5 = 0 THEN [['MISSING_PROVENANCE', 'blocking']] ELSE [] END, CASE WHEN k % 7 = 0 THEN [['PROVENANCE_CONFLICT', 'blocking']] ELSE [] END,
    CASE WHEN k % 4 = 0 THEN [['MISSING_UNIT', 'manual_review']] WHEN c % 4 <> 1 THEN [['UNIT_CONFLICT', 'manual_review']] ELSE [] END)) AS i FROM x) y, LATERAL (SELECT i[1] AS code, i[2] AS severity) GROUP BY 1, 2""")
def c1_candidate_issues(spark, sf):
    k, text = c("o_orderkey"), c("o_orderkey").cast("string")
    filled = lambda keys, last: F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*(F.lit("x") for _ in keys[:-1]), last))
    pairs = table(spark, sf, "orders").select(
        k.alias("target_row_id"), F.when(k % 3 != 0, "name").alias("source_name"), F.when(k % 4 != 0, F.concat(F.lit("u"), (c("o_custkey") % 4).cast("string"))).alias("source_unit"), F.lit("u1").alias("target_unit"),
        filled(quality_gate.SOURCE_PROVENANCE, F.when(k % 5 != 0, "id")).alias("source_provenance"), filled(quality_gate.TARGET_PROVENANCE, F.when(k % 7 == 0, "other").otherwise(text)).alias("target_provenance"),
    )
    return quality_gate.candidate_issues(pairs).groupBy("code", "severity").agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(20,2)) AS v FROM orders)
SELECT code, severity, count(*) AS n FROM (SELECT unnest(list_concat(CASE WHEN k % 3 = 0 THEN [['IDENTITY_MISMATCH', 'blocking']] ELSE [] END, CASE WHEN k % 4 = 0 THEN [['NO_VALUES', 'blocking']] WHEN k % 4 = 1 THEN [['AMBIGUOUS', 'manual_review']] WHEN k % 4 = 2 THEN [['UNMATCHED', 'manual_review']] ELSE [] END,
  CASE WHEN k % 5 = 0 THEN [['TRACE_MISMATCH', 'blocking']] ELSE [] END, CASE WHEN k % 6 = 0 THEN [['TRACE_MISMATCH', 'blocking']] ELSE [] END, CASE WHEN k % 7 = 0 THEN [['FORMULA_MISMATCH', 'blocking']] ELSE [] END, CASE WHEN k % 8 = 0 THEN [['TOTAL_DISCREPANCY', 'blocking']] ELSE [] END,
  CASE WHEN k % 9 = 0 THEN [['TOLERANCE_EXCEEDED', 'manual_review']] ELSE [] END, CASE WHEN k % 10 = 0 THEN [['UPSTREAM_WARNING', 'warning']] ELSE [] END)) AS i FROM x) y, LATERAL (SELECT i[1] AS code, i[2] AS severity) GROUP BY 1, 2""")
def c1_calculation_issues(spark, sf):
    k, v = c("o_orderkey"), c("o_totalprice").cast("decimal(20,2)").cast(MONEY)
    half = F.struct(F.lit(1).cast(MONEY).alias("quantity"), v.alias("cost_before_coefficient"), v.alias("cost"), F.lit(1).cast("decimal(4,1)").alias("coefficient"))
    calculated = table(spark, sf, "orders").select(
        k.alias("target_row_id"), k.alias("match_result_id"), F.when(k % 3 == 0, -1).otherwise(k).alias("calculation_target"), k.alias("trace_target"), F.when(k % 5 == 0, -1).otherwise(k).alias("trace_match"),
        F.when(k % 6 == 0, "").otherwise("h").alias("rule_set_hash"), F.when(k % 7 == 0, F.array(F.lit("x"))).otherwise(F.array(*map(F.lit, quality_gate.FORMULA_TOKENS))).alias("formula_tokens"),
        F.when(k % 4 == 0, "no_values").when(k % 4 == 1, "manual_review").when(k % 4 == 2, "no_match").otherwise("calculated").alias("status"), F.when(k % 10 == 0, 1).otherwise(0).alias("n_warnings"), F.lit(2).cast(MONEY).alias("quantity"),
        (v * 2).cast(MONEY).alias("cost_before_coefficient"), F.when(k % 8 == 0, v * 2 + F.lit("0.01").cast(MONEY)).otherwise(v * 2).cast(MONEY).alias("cost"), F.lit(1).cast("decimal(4,1)").alias("coefficient"), F.array(half, half).alias("totals"), F.array(half, half).alias("trace_totals"),
        F.when(k % 9 == 0, v).otherwise(v * 2).cast(MONEY).alias("selected_cost"),
    )
    return quality_gate.calculation_issues(calculated).groupBy("code", "severity").agg(F.count("*").alias("n"))


@query("""SELECT CASE o_orderkey % 6 WHEN 0 THEN 'FORMULA_WITHOUT_CACHE' WHEN 1 THEN 'EXCEL_ERROR' WHEN 2 THEN 'VALUE_READ_FAILED' ELSE 'UNTRUSTED_FORMULA_CACHE' END AS code, count(*) AS n FROM orders WHERE o_orderkey % 6 < 4 GROUP BY 1""")
def c1_target_cell_issues(spark, sf):
    k = c("o_orderkey") % 6
    status = F.when(k == 1, "EXCEL_ERROR").when(k == 3, "FORMULA").when(k == 4, "FORMULA").otherwise("OK")
    cache = F.when(k == 0, "FORMULA_WITHOUT_CACHED_VALUE").when(k == 2, "VALUE_READ_FAILED").when(k == 3, "CACHE_UNTRUSTED").when(k == 4, "FORMULA_WITH_CACHED_VALUE").otherwise("NOT_FORMULA")
    cells = table(spark, sf, "orders").select(c("o_orderkey").alias("target_row_id"), status.alias("status"), cache.alias("cache_state"))
    return quality_gate.target_cell_issues(cells).groupBy("code").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS t, l_suppkey AS m FROM lineitem WHERE l_linenumber < 4), b AS (SELECT DISTINCT l_orderkey AS t, l_suppkey AS m FROM lineitem WHERE l_linenumber < 3), s AS (SELECT DISTINCT t FROM (SELECT t, m FROM a EXCEPT SELECT t, m FROM b UNION ALL (SELECT t, m FROM b EXCEPT SELECT t, m FROM a)))
SELECT 'CARDINALITY_MISMATCH' AS code, count(*) AS n FROM s UNION ALL SELECT 'IDENTITY_MISMATCH', count(*) FROM (SELECT l_orderkey AS t, l_suppkey AS m FROM lineitem WHERE l_linenumber < 4) x WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.t = x.t AND b.m = x.m)
UNION ALL SELECT 'NEGATIVE_VALUE', count(*) FROM lineitem WHERE l_linenumber < 4 AND l_partkey % 5 = 0 UNION ALL SELECT 'SIGN_CONFLICT', count(*) FROM lineitem WHERE l_linenumber < 4 AND l_partkey % 5 = 0 UNION ALL SELECT 'MISSING_PROVENANCE', count(*) FROM lineitem WHERE l_linenumber < 4 AND l_partkey % 9 = 0""")
def c1_contribution_issues(spark, sf):
    line = table(spark, sf, "lineitem")
    made = line.filter("l_linenumber < 4").select(c("l_orderkey").alias("target_row_id"), c("l_suppkey").alias("candidate_id"), (c("l_quantity") + 1).alias("quantity"), (F.when(c("l_partkey") % 5 == 0, -1).otherwise(1) * (c("l_extendedprice") + 1)).alias("cost"), (c("l_partkey") % 9 != 0).alias("has_provenance"))
    picked = line.filter("l_linenumber < 3").select(c("l_orderkey").alias("target_row_id"), c("l_suppkey").alias("candidate_id"))
    return quality_gate.contribution_issues(made, picked).groupBy("code").agg(F.count("*").alias("n"))


@query("""SELECT 'DUPLICATE_IDENTITY' AS code, count(*) AS n FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'SOURCE_ROW_REUSED', count(*) FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1)""")
def c1_identity_issues(spark, sf):
    line = table(spark, sf, "lineitem")
    return quality_gate.identity_issues(line, line.select(c("l_orderkey").alias("target_row_id"), c("l_partkey").alias("source_row_id")), ("l_orderkey",)).groupBy("code").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT p_brand, min(p_partkey) AS m FROM part GROUP BY 1)
SELECT p_brand AS object_index, CASE WHEN m % 2 = 0 THEN 'BLOCKS_OVERLAP:B' ELSE 'DRAWING_COUNT:1!=2' END AS error FROM b UNION ALL SELECT p_brand, 'FORMULA_ERROR:7:#REF!' FROM b WHERE m % 3 = 0 UNION ALL SELECT p_brand, 'BINARY_FLOAT_SERIALIZATION:8:0.30000000000000004' FROM b WHERE m % 3 = 1""")
def c17_layout_issues(spark, sf):
    b = table(spark, sf, "part").groupBy(c("p_brand").alias("object_index")).agg(F.min("p_partkey").alias("m"))
    even = c("m") % 2 == 0
    layouts = b.select("object_index", F.lit(1).alias("start_row"), F.lit(4).alias("end_row"), F.lit("A").alias("drawing_code")).unionByName(b.select("object_index", F.when(even, 4).otherwise(5).alias("start_row"), F.lit(9).alias("end_row"), F.lit("B").alias("drawing_code")))
    drawn = b.select("object_index", F.explode(F.when(even, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("A")))).alias("drawing_code"))
    one = lambda row, kind, value: F.struct(F.lit(row).alias("row"), F.lit(kind).alias("kind"), F.lit(value).alias("value"))
    cell = F.when(c("m") % 3 == 0, one(7, "error", "#REF!")).when(c("m") % 3 == 1, one(8, "number", "0.30000000000000004")).otherwise(one(9, "number", "0.3"))
    return card.layout_issues(layouts, b.select("object_index", cell.alias("x")).select("object_index", "x.*"), drawn)


@query("""WITH d AS (SELECT DISTINCT p_name FROM part) SELECT a.p_name AS source_name, b.p_name AS target_name, CAST(1 AS BIGINT) AS n FROM d a JOIN d b ON a.p_name <> b.p_name AND length(a.p_name) = length(b.p_name) AND hamming(a.p_name, b.p_name) = 1 AND 2 * (length(a.p_name) - 1) >= 0.9 * 2 * length(a.p_name)""")
def j8_one_letter_apart(spark, sf):
    """Of names scored 0.9 or more, those of one length with one letter changed; their score is known: 1 - 1/n."""
    found = matching.fuzzy_names(*(table(spark, sf, "part").select(c("p_name").alias("work_name")) for _ in range(2)), "0.900000")
    same = F.length("source_name") == F.length("target_name")
    changed = F.size(F.filter(F.zip_with(F.split("source_name", ""), F.split("target_name", ""), lambda x, y: x != y), lambda z: z))
    return found.filter(same & (changed == 1)).groupBy("source_name", "target_name").agg(F.count("*").alias("n"))


