"""The driver tables seen as the relations that the operators work on, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(20,6)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as source rows: supplier as object, flag as subobject, order as position, part name and type."""
    c = F.col
    line = table(spark, sf_dir, "lineitem")
    key = F.md5(F.concat_ws("|", *(c(x).cast("string") for x in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), *(c(x).cast("decimal(14,2)").cast("string") for x in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")), c("l_shipdate").cast("date").cast("string"), "l_returnflag", "l_linestatus"))
    rows = line.select(
        key.alias("source_row_id"), c("l_suppkey").cast("string").alias("object_code"), c("l_returnflag").alias("subobject_code"), c("l_orderkey").cast("string").alias("position_code"),
        "l_partkey", "l_orderkey", "l_linenumber", c("l_quantity").cast(MONEY).alias("quantity"), c("l_extendedprice").cast(MONEY).alias("cost"), c("l_linestatus").alias("cost_type_code"),
    )
    part = table(spark, sf_dir, "part").select(c("p_partkey").alias("l_partkey"), c("p_name").alias("work_name"), c("p_type").alias("unit"))
    return rows.join(part, "l_partkey")


SOURCE_SQL = """src AS (SELECT md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
    CAST(CAST(l_quantity AS DECIMAL(14,2)) AS VARCHAR), CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS VARCHAR), CAST(CAST(l_discount AS DECIMAL(14,2)) AS VARCHAR),
    CAST(CAST(l_tax AS DECIMAL(14,2)) AS VARCHAR), CAST(CAST(l_shipdate AS DATE) AS VARCHAR), l_returnflag, l_linestatus)) AS source_row_id,
  CAST(l_suppkey AS VARCHAR) AS object_code, l_returnflag AS subobject_code, CAST(l_orderkey AS VARCHAR) AS position_code, l_partkey, l_orderkey, l_linenumber,
  CAST(l_quantity AS DECIMAL(20,6)) AS quantity, CAST(l_extendedprice AS DECIMAL(20,6)) AS cost, l_linestatus AS cost_type_code, p_name AS work_name, p_type AS unit
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def order_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as target rows, matched by position alone."""
    c = F.col
    return table(spark, sf_dir, "orders").select(
        c("o_orderkey").alias("target_row_id"), F.lit("all").alias("object_code"), F.lit("all").alias("subobject_code"), c("o_orderkey").cast("string").alias("position_code"),
        F.lit(None).cast("string").alias("work_name"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("document_index"), F.lit(None).cast("string").alias("stage"),
        c("o_totalprice").cast(MONEY).alias("selected_cost"), (c("o_orderstatus") != "P").alias("writable"),
    )


def part_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (supplier, part name, type) of returned lines as target rows with names and units."""
    rows = source_rows(spark, sf_dir).filter("subobject_code = 'R'").groupBy("object_code", "work_name", "unit").agg(F.min("position_code").alias("p"))
    ident = F.md5(F.concat_ws("|", "object_code", "work_name", "unit"))
    return rows.select(ident.alias("target_row_id"), "object_code", F.lit("R").alias("subobject_code"), F.col("p").alias("position_code"), "work_name", "unit", F.lit(None).cast("string").alias("document_index"), F.lit("main").alias("stage"))


PART_TARGET_SQL = """tgt AS (SELECT md5(concat_ws('|', object_code, work_name, unit)) AS target_row_id, object_code, 'R' AS subobject_code, min(position_code) AS position_code,
  work_name, unit, 'main' AS stage FROM src WHERE subobject_code = 'R' GROUP BY object_code, work_name, unit)"""


def hierarchy_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and suppliers as a dotted tree; nations with an even key have their own metrics."""
    c = F.col
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    money = lambda x: x.cast("decimal(18,2)").alias("amount")
    top = r.select(F.concat(F.lit("r"), c("r_regionkey")).alias("row_id"), c("r_regionkey").cast("string").alias("position_code"), money(F.lit(100)), F.lit(False).alias("is_transactional"))
    mid = n.select(F.concat(F.lit("n"), c("n_nationkey")).alias("row_id"), F.concat_ws(".", "n_regionkey", "n_nationkey").alias("position_code"), money(c("n_nationkey") * 1000), (c("n_nationkey") % 2 == 0).alias("is_transactional"))
    low = s.join(n, c("s_nationkey") == c("n_nationkey")).select(F.concat(F.lit("s"), c("s_suppkey")).alias("row_id"), F.concat_ws(".", "n_regionkey", "n_nationkey", c("s_suppkey") % 40).alias("position_code"), money(F.when(c("s_suppkey") % 7 != 0, c("s_acctbal"))), F.lit(True).alias("is_transactional"))
    return top.unionByName(mid).unionByName(low).withColumn("context", F.array(F.lit("file"), F.lit("sheet")))


HIERARCHY_SQL = """h AS (SELECT 'r' || r_regionkey AS row_id, CAST(r_regionkey AS VARCHAR) AS code, CAST(100 AS DECIMAL(18,2)) AS amount, false AS t FROM region
  UNION ALL SELECT 'n' || n_nationkey, n_regionkey || '.' || n_nationkey, CAST(n_nationkey * 1000 AS DECIMAL(18,2)), n_nationkey % 2 = 0 FROM nation
  UNION ALL SELECT 's' || s_suppkey, n_regionkey || '.' || n_nationkey || '.' || (s_suppkey % 40), CASE WHEN s_suppkey % 7 <> 0 THEN CAST(s_acctbal AS DECIMAL(18,2)) END, true
    FROM supplier JOIN nation ON s_nationkey = n_nationkey),
dup AS (SELECT code FROM h GROUP BY code HAVING count(*) > 1),
pairs AS (SELECT c.row_id, p.row_id AS ancestor_id, len(string_split(c.code, '.')) - len(string_split(p.code, '.')) AS steps FROM h c JOIN h p ON starts_with(c.code, p.code || '.')),
heads AS (SELECT * FROM h WHERE code NOT IN (SELECT code FROM dup) AND row_id IN (SELECT ancestor_id FROM pairs WHERE steps = 1)),
details AS (SELECT DISTINCT row_id FROM pairs WHERE ancestor_id IN (SELECT row_id FROM heads WHERE t) AND row_id IN (SELECT row_id FROM h WHERE code NOT IN (SELECT code FROM dup))),
roles AS (SELECT row_id, CASE WHEN row_id IN (SELECT row_id FROM details) THEN 'resource_detail' WHEN row_id IN (SELECT row_id FROM heads WHERE NOT t) THEN 'parent' ELSE 'leaf' END AS role FROM h)"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as file entries with made-up names that hold an index, a period, a type and marks."""
    c = F.col
    d = table(spark, sf_dir, "documents").filter("doc_id is not null")
    kind = F.element_at(F.array(*map(F.lit, ("КС-2", "КС-6а", "КС-3", "СВВР", "отчет"))), (c("doc_id") % 5 + 1).cast("int"))
    name = F.concat(
        F.lpad((c("doc_id") % 40 + 1000).cast("string"), 4, "0"), F.lit(" ("), (c("doc_id") % 7 + 600).cast("string"), F.lit(")_"), kind, F.lit("_"),
        F.lpad((c("doc_id") % 12 + 1).cast("string"), 2, "0"), F.lit(".2026"), F.when(c("doc_id") % 3 == 0, F.concat(F.lit(" ред. "), (c("doc_id") % 4).cast("string"))).otherwise(""),
        F.when(c("doc_id") % 11 == 0, " финал").otherwise(""), F.when(c("doc_id") % 13 == 0, " черновик").otherwise(""), F.when(c("doc_id") % 17 == 0, " копия").otherwise(""), F.when(c("doc_id") % 19 == 0, ".pdf").otherwise(".xlsx"),
    )
    return d.select(c("doc_id").alias("file_id"), name.alias("filename"), F.concat(c("source"), F.lit("/"), name).alias("relative_path"), c("n_chars").alias("size_bytes"), c("lang"))


MANIFEST_SQL = """m AS (SELECT doc_id AS file_id, n_chars AS size_bytes, source, lang,
  (doc_id % 40 + 1000) || ' (' || (doc_id % 7 + 600) || ')_' || ['КС-2','КС-6а','КС-3','СВВР','отчет'][doc_id % 5 + 1] || '_' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '.2026'
  || CASE WHEN doc_id % 3 = 0 THEN ' ред. ' || (doc_id % 4) ELSE '' END || CASE WHEN doc_id % 11 = 0 THEN ' финал' ELSE '' END || CASE WHEN doc_id % 13 = 0 THEN ' черновик' ELSE '' END
  || CASE WHEN doc_id % 17 = 0 THEN ' копия' ELSE '' END || CASE WHEN doc_id % 19 = 0 THEN '.pdf' ELSE '.xlsx' END AS filename FROM documents WHERE doc_id IS NOT NULL)"""
