"""Sheet operators (A28, A31, C10, C11, F3, F5, M20, M22, S7, S8, S22, W3-W6) over lineitem and part seen as cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from reckon.operators import sheets
from reckon.plans.registry import query
from reckon.plans.relations import table

c = F.col


def line_cells(spark, sf):
    """A sheet per supplier, a row per order, a column per line number."""
    n = c("l_linenumber")
    return table(spark, sf, "lineitem").select(
        F.lit("book").alias("file"), c("l_suppkey").cast("string").alias("sheet"), c("l_orderkey").cast("int").alias("row"), n.cast("int").alias("col"), F.when(n == 4, "=A1").when(n == 5, "=B1").alias("formula"),
        F.when(n == 5, F.lit(None)).when(n == 6, "#REF!").otherwise(c("l_quantity").cast("int").cast("string")).alias("value"), F.when(n == 6, "error").otherwise("number").alias("kind"), F.lit(None).cast("string").alias("merged"),
    )


@query("""WITH r AS (SELECT DISTINCT l_suppkey AS s, l_orderkey AS r FROM lineitem WHERE l_orderkey >= 1), g AS (SELECT s, r, r - coalesce(lag(r) OVER (PARTITION BY s ORDER BY r), 0) - 1 AS gap FROM r), x AS (SELECT s, min(r) AS stop FROM g WHERE gap >= 100 GROUP BY 1)
SELECT CAST(l_suppkey AS VARCHAR) AS sheet, count(*) AS n, CAST(max(l_orderkey) AS INTEGER) AS last_row FROM lineitem LEFT JOIN x ON s = l_suppkey WHERE l_orderkey >= 1 AND (stop IS NULL OR l_orderkey < stop) GROUP BY 1""")
def w3_until_empty(spark, sf):
    return sheets.until_empty(line_cells(spark, sf), 100).groupBy("sheet").agg(F.count("*").alias("n"), F.max("row").alias("last_row"))


@query("""WITH d AS (SELECT l_suppkey AS s, l_orderkey AS r, l_linenumber AS k FROM lineitem WHERE l_orderkey BETWEEN 1 AND 3000 AND l_linenumber <= 5), r AS (SELECT DISTINCT s, r FROM d), g AS (SELECT s, r, r - coalesce(lag(r) OVER (PARTITION BY s ORDER BY r), 0) - 1 AS gap FROM r),
x AS (SELECT s, min(r) AS stop FROM g WHERE gap >= 300 GROUP BY 1), y AS (SELECT d.*, row_number() OVER (PARTITION BY d.s ORDER BY d.r, d.k) AS n FROM d LEFT JOIN x USING (s) WHERE stop IS NULL OR d.r < stop)
SELECT CAST(s AS VARCHAR) AS sheet, count(*) AS n FROM y WHERE n <= 50 GROUP BY 1""")
def s22_scan_window(spark, sf):
    return sheets.scan_window(line_cells(spark, sf), rows=3000, columns=5, most=50, empty=300).groupBy("sheet").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN l_linenumber = 6 THEN 'EXCEL_ERROR' WHEN l_linenumber = 4 THEN 'FORMULA_WITH_CACHED_VALUE' WHEN l_linenumber = 5 THEN 'FORMULA_WITHOUT_CACHED_VALUE' ELSE 'OK' END AS status,
  CASE WHEN l_linenumber = 6 THEN 'EXCEL_ERROR' WHEN l_linenumber = 4 THEN 'CACHED_FORMULA_VALUE' WHEN l_linenumber = 5 THEN 'FORMULA_WITHOUT_CACHE' ELSE 'LITERAL' END AS source, count(*) AS n,
  CAST(sum(CASE WHEN l_linenumber NOT IN (5, 6) THEN l_quantity END) AS BIGINT) AS total FROM lineitem GROUP BY 1, 2""")
def m20_cell_values(spark, sf):
    v = sheets.cell_value(c("formula"), c("value"), c("kind"))
    return line_cells(spark, sf).select(v.alias("v")).groupBy("v.status", "v.source").agg(F.count("*").alias("n"), F.sum(c("v.effective").cast("long")).alias("total"))


@query("""WITH x AS (SELECT l_suppkey AS s, l_orderkey AS r, max(CASE WHEN l_linenumber = 1 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END) AS quantity, max(CASE WHEN l_linenumber = 4 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END) AS cost,
  bool_or(l_linenumber = 6) AS e, bool_or(l_linenumber = 5) AS f FROM lineitem WHERE l_linenumber IN (1, 4, 5, 6) GROUP BY 1, 2)
SELECT CAST(s AS VARCHAR) AS sheet, CAST(r AS INTEGER) AS row, quantity, cost, CASE WHEN e THEN 'EXCEL_ERROR' WHEN f THEN 'FORMULA_WITHOUT_CACHE' ELSE 'NONE' END AS formula_error FROM x""")
def s8_canonical_rows(spark, sf):
    names = {"quantity": 1, "cost": 4, "price": 5, "unit": 6}
    books = line_cells(spark, sf).select("file", "sheet").distinct()
    columns = books.select("*", F.explode(F.create_map(*(F.lit(x) for p in names.items() for x in p))).alias("logical", "col")).withColumn("status", F.lit("OK"))
    out = sheets.canonical_rows(line_cells(spark, sf), columns, ("quantity", "cost"))
    return out.select("sheet", "row", "quantity", "cost", sheets.formula_error(c("statuses")).alias("formula_error"))


@query("""WITH x AS (SELECT l_suppkey AS s, l_orderkey * 100000 + l_linenumber * 10000 + l_partkey AS o, max(l_returnflag) AS v FROM lineitem GROUP BY 1, 2), y AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY o) - row_number() OVER (PARTITION BY s, v ORDER BY o) AS g FROM x)
SELECT s AS sheet, v AS object_code, min(o) AS start_row, max(o) AS end_row, count(*) AS n FROM y GROUP BY s, v, g""")
def a28_object_blocks(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(c("l_suppkey").alias("sheet"), (c("l_orderkey") * 100000 + c("l_linenumber") * 10000 + c("l_partkey")).alias("row")).agg(F.max("l_returnflag").alias("object_code"))
    return sheets.object_blocks(rows)


@query("""WITH x AS (SELECT l_suppkey AS s, l_orderkey AS r, min(l_partkey) AS p, min(l_linenumber) AS k FROM lineitem GROUP BY 1, 2), y AS (SELECT *, CASE WHEN p % 3 = 0 THEN 'code-' || p END AS code, CASE WHEN k = 2 THEN '1000 (' || (p % 9) || ')' WHEN k = 3 THEN ' - ' END AS idx FROM x),
z AS (SELECT *, last_value(code IGNORE NULLS) OVER w AS cc, last_value(idx IGNORE NULLS) OVER w AS ci FROM y WINDOW w AS (PARTITION BY s ORDER BY r ROWS UNBOUNDED PRECEDING))
SELECT CAST(s AS VARCHAR) AS sheet, r AS row, cc AS carried_code, CASE WHEN trim(ci) = '-' THEN NULL ELSE ci END AS carried_index FROM z""")
def w4_carry_forward(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(c("l_suppkey").cast("string").alias("sheet"), c("l_orderkey").alias("row")).agg(F.min("l_partkey").alias("p"), F.min("l_linenumber").alias("k"))
    rows = rows.select(F.lit("f").alias("file"), "sheet", "row", F.when(c("p") % 3 == 0, F.concat(F.lit("code-"), "p")).alias("drawing_code"), F.when(c("k") == 2, F.concat(F.lit("1000 ("), c("p") % 9, F.lit(")"))).when(c("k") == 3, " - ").alias("document_index"))
    return sheets.carry_forward(rows).select("sheet", "row", "carried_code", "carried_index")


@query("""SELECT CAST(l_suppkey AS VARCHAR) AS sheet, count(*) AS scanned, count(*) FILTER (WHERE l_linenumber < 6) AS extracted, count(*) FILTER (WHERE l_linenumber = 6) AS skipped, count(*) FILTER (WHERE l_linenumber = 7) AS failed,
  CASE WHEN count(*) FILTER (WHERE l_linenumber = 7) > 0 THEN 'PARTIAL' ELSE 'OK' END AS status FROM lineitem GROUP BY 1""")
def a31_extraction_counts(spark, sf):
    rows = line_cells(spark, sf).withColumn("outcome", F.when(c("col") < 6, "extracted").when(c("col") == 6, "skipped").otherwise("failed"))
    return sheets.extraction_counts(rows).drop("file")


@query("""WITH p AS (SELECT DISTINCT p_brand AS b, p_size * 2 AS k FROM part), n AS (SELECT *, CASE WHEN k - lag(k) OVER (PARTITION BY b ORDER BY k) > 3 THEN 1 ELSE 0 END AS new FROM p), i AS (SELECT *, sum(new) OVER (PARTITION BY b ORDER BY k) AS g FROM n),
c AS (SELECT b, g, count(*) AS n, min(k) AS lo, max(k) AS hi FROM i GROUP BY 1, 2) SELECT b AS sheet, CAST(lo AS INTEGER) AS first_col, CAST(hi AS INTEGER) AS last_col FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY n DESC, lo) AS r FROM c) WHERE r = 1""")
def w6_column_bounds(spark, sf):
    heads = table(spark, sf, "part").select(F.lit("f").alias("file"), c("p_brand").alias("sheet"), (c("p_size") * 2).cast("int").alias("col"))
    return sheets.column_bounds(heads).select("sheet", "first_col", "last_col")


@query("""WITH d AS (SELECT l_suppkey % 7 AS col, CAST(l_suppkey % 11 AS VARCHAR) || CASE WHEN l_linenumber = 1 THEN '' ELSE '.' || l_linenumber END AS code, l_partkey % 5 AS s FROM lineitem), n AS (SELECT s, col, count(*) AS n FROM d GROUP BY 1, 2),
p AS (SELECT a.s, a.col, count(*) AS p FROM d a JOIN d b ON a.s = b.s AND a.col = b.col AND a.code <> b.code AND starts_with(a.code, b.code || '.') GROUP BY 1, 2), z AS (SELECT s, col, n + 3 * p AS v FROM n JOIN p USING (s, col) WHERE n >= 4 AND p >= 2),
r AS (SELECT *, rank() OVER (PARTITION BY s ORDER BY v DESC) AS r FROM z) SELECT CAST(s AS VARCHAR) AS sheet, CAST(min(col) AS INTEGER) AS col FROM r WHERE r = 1 GROUP BY s HAVING count(*) = 1""")
def c11_position_column(spark, sf):
    n = c("l_linenumber")
    cells = table(spark, sf, "lineitem").select(F.lit("f").alias("file"), (c("l_partkey") % 5).cast("string").alias("sheet"), c("l_orderkey").alias("row"), (c("l_suppkey") % 7).cast("int").alias("col"), F.concat((c("l_suppkey") % 11).cast("string"), F.when(n == 1, "").otherwise(F.concat(F.lit("."), n.cast("string")))).alias("value"))
    return sheets.position_column(cells).select("sheet", "col")


@query("""SELECT p_brand AS sheet, 'work_name' AS logical, CAST(2 AS INTEGER) AS col, 'OK' AS status FROM part GROUP BY 1 UNION ALL SELECT p_brand, 'unit', 3, 'OK' FROM part GROUP BY 1 UNION ALL SELECT p_brand, 'quantity', NULL, 'AMBIGUOUS_COLUMN' FROM part GROUP BY 1 UNION ALL SELECT p_brand, 'price', NULL, 'COLUMN_NOT_FOUND' FROM part GROUP BY 1""")
def c10_column_resolution(spark, sf):
    books = table(spark, sf, "part").select(F.lit("f").alias("file"), c("p_brand").alias("sheet")).distinct()
    heads = {1: "номер п п", 2: "наименование работ", 3: "единица измерения", 4: "количество по договору", 5: "количество за период"}
    headers = books.select("*", F.explode(F.create_map(*(F.lit(x) for p in heads.items() for x in p))).alias("col", "normalized"))
    rules = spark.createDataFrame([("work_name", ["наименование работ"], ["наименование"], ["работ"], [], 90), ("unit", [], ["единица"], ["измерения"], [], 80), ("quantity", [], ["количество"], ["период", "договору"], [], 80), ("price", [], ["цена"], [], [], 80)], "logical string, exact array<string>, required array<string>, optional array<string>, forbidden array<string>, priority int")
    return sheets.resolve_columns(headers, rules).select("sheet", "logical", "col", "status")
