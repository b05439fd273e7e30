"""Hierarchy, duplicates, selection, store."""

from __future__ import annotations

from pyspark.sql import functions as F

from reckon.functions import metadata, text
from reckon.operators import dedup, hierarchy, selection, store
from reckon.plans.registry import query
from reckon.plans.relations import HIERARCHY_SQL, MANIFEST_SQL, MONEY, SOURCE_SQL, hierarchy_entries, manifest, source_rows, table

c = F.col


@query(f"WITH {HIERARCHY_SQL} SELECT row_id, role FROM roles")
def c5_hierarchy_frontier(spark, sf):
    return hierarchy.frontier(hierarchy_entries(spark, sf)).select("row_id", "role")


@query(f"WITH {HIERARCHY_SQL} SELECT row_id, ancestor_id, CAST(steps AS INTEGER) AS steps FROM pairs")
def j24_ancestors(spark, sf):
    return hierarchy.ancestor_pairs(hierarchy_entries(spark, sf)).select("row_id", "ancestor_id", "steps")


@query(f"WITH {HIERARCHY_SQL} SELECT code, count(*) AS n FROM h GROUP BY code HAVING count(*) > 1")
def c5_duplicate_positions(spark, sf):
    return hierarchy.duplicate_positions(hierarchy_entries(spark, sf)).select(F.array_join("segments", ".").alias("code"), "n")


@query(f"""WITH {HIERARCHY_SQL}, l AS (SELECT DISTINCT regexp_replace(code, '\\.[0-9]+$', '') AS parent, CAST(regexp_extract(code, '([0-9]+)$', 1) AS BIGINT) AS n FROM h WHERE contains(code, '.')),
g AS (SELECT parent, n - lag(n) OVER (PARTITION BY parent ORDER BY n) AS step FROM l) SELECT DISTINCT parent FROM g WHERE step > 1""")
def w1_position_gaps(spark, sf):
    return hierarchy.gaps(hierarchy_entries(spark, sf)).select(F.array_join("parent", ".").alias("parent"))


@query(f"""WITH {HIERARCHY_SQL}, p AS (SELECT h.* FROM h JOIN roles USING (row_id) WHERE role = 'parent'),
k AS (SELECT p.row_id, p.amount, count(*) FILTER (WHERE c.t) AS nt, sum(c.amount) FILTER (WHERE c.t) AS st, count(*) FILTER (WHERE c.t AND c.amount IS NULL) AS zt, sum(c.amount) FILTER (WHERE steps = 1) AS sd, count(*) FILTER (WHERE steps = 1 AND c.amount IS NULL) AS zd
  FROM p JOIN pairs ON ancestor_id = p.row_id JOIN h c ON c.row_id = pairs.row_id GROUP BY 1, 2),
z AS (SELECT row_id, amount, CASE WHEN nt > 0 THEN st ELSE sd END AS s, amount IS NULL OR CASE WHEN nt > 0 THEN zt ELSE zd END > 0 AS gone FROM k)
SELECT row_id, amount, CAST(CASE WHEN NOT gone THEN s END AS DECIMAL(38,2)) AS children_amount, CASE WHEN gone THEN 'HIERARCHY_MISSING_DIRECT_CHILD_COST' ELSE 'HIERARCHY_COST_MISMATCH' END AS code FROM z WHERE gone OR abs(amount - s) > 0.01""")
def c5_parent_costs(spark, sf):
    return hierarchy.parent_costs(hierarchy_entries(spark, sf)).withColumn("children_amount", c("children_amount").cast("decimal(38,2)"))


@query(f"WITH {HIERARCHY_SQL} SELECT row_id, amount FROM h JOIN roles USING (row_id) WHERE role = 'leaf'")
def u2_hierarchy_exclusion(spark, sf):
    entries = hierarchy_entries(spark, sf)
    gone = hierarchy.frontier(entries).filter("role <> 'leaf'").select("row_id")
    return entries.join(gone, "row_id", "left_anti").select("row_id", "amount")


@query(f"WITH {MANIFEST_SQL} SELECT file_id, count(*) OVER (PARTITION BY lower(replace(regexp_replace(filename, '\\.[a-z]+$', ''), '_', ' ')), size_bytes, regexp_extract(filename, '\\.[a-z]+$')) > 1 AS is_possible_duplicate FROM m")
def d1_possible_duplicates(spark, sf):
    rows = manifest(spark, sf).withColumn("name", text.normalize_filename(c("filename"))).withColumn("ext", text.file_extension(c("filename")))
    return dedup.flag_duplicates(rows, ["name", "size_bytes", "ext"]).select("file_id", "is_possible_duplicate")


@query("SELECT l_partkey AS row_id, count(*) AS n, count(DISTINCT l_shipdate) AS n_digests, CASE WHEN count(DISTINCT l_shipdate) > 1 THEN 'conflict' WHEN count(*) > 1 THEN 'repeated' ELSE 'unique' END AS status FROM lineitem GROUP BY 1")
def d2_identity_batch(spark, sf):
    return dedup.identity_batch(table(spark, sf, "lineitem").select(c("l_partkey").alias("row_id"), c("l_shipdate").alias("digest")), "row_id", "digest")


@query(f"""WITH {SOURCE_SQL}, x AS (SELECT source_row_id AS row_id, l_orderkey || '.' || l_linenumber AS line_id, l_partkey AS sig FROM src),
y AS (SELECT *, row_number() OVER (PARTITION BY line_id, sig ORDER BY row_id) AS seen, row_number() OVER (PARTITION BY line_id ORDER BY row_id) AS pos FROM x)
SELECT row_id, line_id, pos > 1 AS is_collision, CASE WHEN pos = 1 THEN line_id ELSE 'hashed' END AS final_line_id FROM y WHERE seen = 1""")
def d3_line_id_collisions(spark, sf):
    rows = source_rows(spark, sf).select(c("source_row_id").alias("row_id"), F.concat_ws(".", "l_orderkey", "l_linenumber").alias("line_id"), c("l_partkey").alias("signature"))
    return dedup.line_ids(rows).select("row_id", "line_id", "is_collision", F.when(F.length("final_line_id") == 64, "hashed").otherwise(c("final_line_id")).alias("final_line_id"))


@query("""WITH x AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, text DESC) AS r FROM conversations) SELECT conv_id, role, turn, text FROM x WHERE r = 1""")
def d6_latest_records(spark, sf):
    return dedup.latest(table(spark, sf, "conversations").select("conv_id", "role", "turn", "text"), ["conv_id", "role"], [c("turn"), c("text")])


@query("""WITH f AS (SELECT l_orderkey, l_shipdate, l_linenumber, l_returnflag FROM lineitem), g AS (SELECT l_orderkey, l_returnflag, min(strftime(l_shipdate, '%Y-%m-%d') || l_linenumber) AS o FROM f GROUP BY 1, 2)
SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY o, l_returnflag) AS flags FROM g GROUP BY 1""")
def d4_ordered_distinct(spark, sf):
    order = F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), c("l_linenumber").cast("string"))
    return dedup.ordered_distinct(table(spark, sf, "lineitem"), ["l_orderkey"], order, "l_returnflag", "flags").withColumn("flags", F.array_join("flags", ","))


@query("SELECT CAST(sum(n - 1) AS BIGINT) AS collisions FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def a6_collision_count(spark, sf):
    return dedup.collision_count(table(spark, sf, "lineitem").withColumn("k", F.struct("l_orderkey", "l_linenumber")), "k")


@query("""WITH x AS (SELECT *, l_linenumber % 2 = 1 AS detail, l_returnflag = 'A' AS outdated, l_linestatus = 'F' AND l_linenumber = 3 AS broken FROM lineitem),
y AS (SELECT count(*) AS a, count(*) FILTER (WHERE NOT detail) AS b, count(*) FILTER (WHERE detail AND outdated) AS d, count(*) FILTER (WHERE detail AND NOT outdated AND broken) AS e FROM x)
SELECT a AS input_rows, b AS skipped_non_detail, d AS skipped_outdated, e AS skipped_formula_errors, a - b - d - e AS output_rows FROM y""")
def f4_filter_chain_counts(spark, sf):
    detail, outdated, broken = c("l_linenumber") % 2 == 1, c("l_returnflag") == "A", (c("l_linestatus") == "F") & (c("l_linenumber") == 3)
    return table(spark, sf, "lineitem").agg(
        F.count("*").alias("input_rows"), F.count_if(~detail).alias("skipped_non_detail"), F.count_if(detail & outdated).alias("skipped_outdated"), F.count_if(detail & ~outdated & broken).alias("skipped_formula_errors"),
        F.count_if(detail & ~outdated & ~broken).alias("output_rows"),
    )


@query("""SELECT p_partkey, p_partkey % 3 = 0 AS is_total, p_partkey % 4 = 1 AS is_outdated, p_partkey % 3 <> 0 AND p_size > 10 AS is_detail FROM part""")
def f2_row_predicates(spark, sf):
    name = text.normalize_text(F.when(c("p_partkey") % 3 == 0, F.concat(F.lit("ИТОГО: "), c("p_name"))).otherwise(F.concat(F.lit("Итоговый "), c("p_name"))))
    total = metadata.is_total_row(name)
    old = metadata.is_outdated(F.when(c("p_partkey") % 4 == 1, "лист (не актуален)").otherwise("лист"), F.lit("file"))
    evidence = F.coalesce(F.when(c("p_size") > 10, c("p_type")), F.lit("")) != ""
    return table(spark, sf, "part").select("p_partkey", total.alias("is_total"), old.alias("is_outdated"), (~total & evidence).alias("is_detail"))


REQUEST = selection.Request(index="1005 (605)", period="2026-06", preferred=("ks6a", "ks2"), allowed=("ks2", "ks6a", "ks3", "svvr"), outdated=True, drafts=True)


def entries(spark, sf):
    m = manifest(spark, sf)
    kind, rev = metadata.file_class(c("filename")), metadata.document_revision(c("filename"))
    rows = m.select("file_id", "relative_path", "size_bytes", "filename", kind.alias("k"), rev.alias("r"), metadata.document_index(c("filename"))["value"].alias("document_index"), metadata.document_period(c("filename"))["value"].alias("document_period"))
    return rows.select(
        "file_id", "relative_path", "size_bytes", "document_index", "document_period", F.lit("file").alias("source_type"), text.file_extension(c("filename")).alias("extension"), "k.document_type", "k.is_temporary", "k.is_probable_copy",
        "k.is_probably_outdated", c("r.number").alias("revision_number"), "r.is_final", "r.is_approved", "r.is_draft", F.timestamp_seconds(F.lit(1_700_000_000) + c("file_id") % 3).alias("modified_at"),
    )


ENTRY_SQL = f"""{MANIFEST_SQL}, e AS (SELECT *, (file_id % 40 + 1000) || ' (' || (file_id % 7 + 600) || ')' AS idx, '2026-' || lpad(CAST(file_id % 12 + 1 AS VARCHAR), 2, '0') AS per, ['ks2','ks6a','ks3','svvr','unknown'][file_id % 5 + 1] AS kind,
  CASE WHEN file_id % 3 = 0 THEN file_id % 4 END AS rev, file_id % 11 = 0 AS fin, file_id % 13 = 0 AS dr, file_id % 17 = 0 AS cp, file_id % 19 = 0 AS pdf FROM m)"""


@query(f"""WITH {ENTRY_SQL} SELECT 'INDEX_MISMATCH' AS reason, count(*) AS n FROM e WHERE idx <> '1005 (605)' UNION ALL SELECT 'UNSUPPORTED_EXTENSION', count(*) FROM e WHERE pdf
UNION ALL SELECT 'DOCUMENT_TYPE_NOT_ALLOWED', count(*) FROM e WHERE kind = 'unknown' UNION ALL SELECT 'PROBABLE_COPY', count(*) FROM e WHERE cp""")
def f1_rejection_counts(spark, sf):
    return selection.filter_counts(entries(spark, sf), REQUEST)


OPEN = selection.Request(index="", period="2026-06", preferred=("ks6a", "ks2"), allowed=("ks2", "ks6a", "ks3", "svvr"), outdated=True, drafts=True, copies=True)


@query(f"""WITH {ENTRY_SQL}, a AS (SELECT * FROM e WHERE NOT pdf AND kind <> 'unknown'),
p AS (SELECT *, 100 AS pi, CASE WHEN per = '2026-06' THEN 40 ELSE -40 END AS pp, CASE kind WHEN 'ks6a' THEN 30 WHEN 'ks2' THEN 25 ELSE 0 END AS pt, coalesce(rev, 0) AS pr, CASE WHEN fin AND NOT dr THEN 8 ELSE 0 END AS pf, CASE WHEN cp THEN -20 ELSE 0 END AS pc, CASE WHEN dr THEN -130 ELSE 0 END AS pd FROM a),
s AS (SELECT *, pi + pp + pt + pr + pf + pc + pd AS score FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY score DESC, pt DESC, per = '2026-06' DESC, coalesce(rev, -1) DESC, fin DESC, file_id % 3 DESC, lower(source || '/' || filename), file_id) AS rank,
  rank() OVER (PARTITION BY idx ORDER BY score DESC, pt DESC, per = '2026-06' DESC, coalesce(rev, -1) DESC, fin DESC) AS br FROM s)
SELECT file_id, idx AS document_index, CAST(score AS INTEGER) AS score, CAST(rank AS INTEGER) AS rank, count(*) FILTER (WHERE br = 1) OVER (PARTITION BY idx) > 1 AS ambiguous FROM r""")
def r2_ranked_sources(spark, sf):
    import dataclasses

    rows = entries(spark, sf).withColumn("own", c("document_index")).withColumn("document_index", F.lit("x"))
    out = selection.ranked(rows, dataclasses.replace(OPEN, index="x"), by=("own",))
    return out.select("file_id", c("own").alias("document_index"), "score", "rank", "ambiguous")


@query(f"""WITH {ENTRY_SQL}, a AS (SELECT * FROM e WHERE idx = '1005 (605)' AND NOT pdf AND kind <> 'unknown' AND NOT cp)
SELECT file_id, 'index: 100,period: ' || CASE WHEN per = '2026-06' THEN '40' ELSE '-40' END || CASE kind WHEN 'ks6a' THEN ',type: 30' WHEN 'ks2' THEN ',type: 25' ELSE '' END || CASE WHEN coalesce(rev, 0) > 0 THEN ',revision: ' || rev ELSE '' END
  || CASE WHEN fin AND NOT dr THEN ',final: 8' ELSE '' END || CASE WHEN dr THEN ',outdated: -100,draft: -30' ELSE '' END AS explanation FROM a""")
def r16_selection_explanation(spark, sf):
    return selection.ranked(entries(spark, sf), REQUEST).select("file_id", F.array_join(selection.explanation(), ",").alias("explanation"))


@query(f"""WITH {ENTRY_SQL}, p AS (SELECT source AS obj, per, file_id, cp, size_bytes % 5 AS score, max(per) OVER (PARTITION BY source) AS mp FROM e),
t AS (SELECT *, rank() OVER (PARTITION BY obj ORDER BY cp, score DESC) AS r FROM p WHERE per = mp)
SELECT obj AS object_code, per AS period, CASE WHEN count(*) = 1 THEN min(file_id) END AS file_id, count(*) AS n_top FROM t WHERE r = 1 GROUP BY 1, 2""")
def r5_latest_inspections(spark, sf):
    e = entries(spark, sf)
    rows = e.select(F.substring_index("relative_path", "/", 1).alias("object_code"), c("document_period").alias("period"), "file_id", c("is_probable_copy").alias("is_copy"), (c("size_bytes") % 5).alias("score"))
    return selection.latest_inspections(rows)


@query(f"""WITH {ENTRY_SQL} SELECT count(*) AS total, CAST(0 AS BIGINT) AS temporary, count(*) FILTER (WHERE cp) AS copies, count(*) FILTER (WHERE dr) AS outdated, count(*) FILTER (WHERE kind = 'unknown') AS unknown, count(DISTINCT idx) AS distinct_indexes,
  CAST(sum(size_bytes) AS BIGINT) AS size_bytes, count(*) FILTER (WHERE kind = 'ks2') AS ks2, count(*) FILTER (WHERE pdf) AS pdfs FROM e""")
def a5_manifest_summary(spark, sf):
    out = selection.manifest_summary(entries(spark, sf).withColumn("is_possible_duplicate", F.lit(False)))
    return out.select("total", "temporary", "copies", "outdated", "unknown", "distinct_indexes", "size_bytes", F.col("by_document_type")["ks2"].alias("ks2"), F.col("by_extension")[".pdf"].alias("pdfs"))


def order_table(spark, sf, part):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", c("o_totalprice").cast(MONEY).alias("price"), "o_orderpriority", F.md5(F.concat_ws("|", c("o_totalprice").cast(MONEY).cast("string"), "o_orderpriority")).alias("digest"), c("o_orderdate").alias("d")).filter(part).drop("d")


ORDER_SQL = "o AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(20,6)) AS price, o_orderpriority, o_orderdate AS d FROM orders)"


@query(f"""WITH {ORDER_SQL}, t AS (SELECT o_orderkey, price, o_orderpriority FROM o WHERE year(d) < 1996), b AS (SELECT o_orderkey, CASE WHEN year(d) = 1995 THEN price + 1 ELSE price END AS price, o_orderpriority FROM o WHERE year(d) >= 1994)
SELECT coalesce(t.o_orderkey, b.o_orderkey) AS o_orderkey, CAST(CASE WHEN b.o_orderkey IS NULL THEN t.price ELSE b.price END AS DECIMAL(20,6)) AS price, CASE WHEN b.o_orderkey IS NULL THEN 'kept' WHEN t.o_orderkey IS NULL THEN 'inserted' WHEN t.price = b.price THEN 'unchanged' ELSE 'updated' END AS change
FROM t FULL JOIN b ON t.o_orderkey = b.o_orderkey""")
def k1_upsert(spark, sf):
    old, new = order_table(spark, sf, "year(d) < 1996"), order_table(spark, sf, "year(d) >= 1994")
    moved = order_table(spark, sf, "year(d) = 1995").select("o_orderkey", F.lit(1).alias("m"))
    new = new.join(moved, "o_orderkey", "left").withColumn("price", (c("price") + F.coalesce("m", F.lit(0))).cast(MONEY)).drop("m").withColumn("digest", F.md5(F.concat_ws("|", c("price").cast("string"), "o_orderpriority")))
    return store.upsert(old, new, "o_orderkey", "digest").select("o_orderkey", "price", "change")


@query(f"WITH {ORDER_SQL} SELECT o_orderkey, price FROM o WHERE year(d) >= 1996")
def k2_insert_or_fail(spark, sf):
    return store.insert_or_fail(order_table(spark, sf, "year(d) < 1996"), order_table(spark, sf, "year(d) >= 1994"), "o_orderkey", "digest").select("o_orderkey", "price")


@query(f"WITH {SOURCE_SQL} SELECT source_row_id, position_code AS line_id, object_code AS source_file_id, cost FROM src WHERE object_code = '7' ORDER BY source_row_id LIMIT 1000")
def s19_named_query(spark, sf):
    rows = source_rows(spark, sf).select("source_row_id", c("position_code").alias("line_id"), c("object_code").alias("source_file_id"), "cost")
    return store.named_query(rows, "source_rows", {"source_file_id": "7"}, limit=1000)


@query("""SELECT 'order' AS entity_type, o_orderkey AS entity_id, CAST(i - 1 AS BIGINT) AS warning_index, ['LATE', o_orderpriority][i] AS warning FROM orders, (VALUES (1), (2)) v(i) WHERE i = 1 OR o_orderstatus = 'P'""")
def k5_diagnostics(spark, sf):
    o = table(spark, sf, "orders").withColumn("warnings", F.when(c("o_orderstatus") == "P", F.array(F.lit("LATE"), c("o_orderpriority"))).otherwise(F.array(F.lit("LATE"))))
    return store.diagnostics(o, "order", "o_orderkey")


@query("SELECT count(*) AS n, CAST(64 AS INTEGER) AS digest_length, true AS same_in_any_order FROM orders")
def k6_snapshot_hash(spark, sf):
    o = table(spark, sf, "orders")
    a = store.snapshot_hash(o, o.columns)
    b = store.snapshot_hash(o.orderBy(F.desc("o_totalprice")), o.columns[::-1]).select(c("digest").alias("d2"))
    return a.crossJoin(b).select("n", F.length("digest").alias("digest_length"), (c("digest") == c("d2")).alias("same_in_any_order"))


@query("SELECT o_orderkey, 'first' AS half FROM orders WHERE year(o_orderdate) < 1995 UNION ALL SELECT o_orderkey, 'second' FROM orders WHERE year(o_orderdate) >= 1995")
def u1_union_of_books(spark, sf):
    o = table(spark, sf, "orders")
    return o.filter("year(o_orderdate) < 1995").select("o_orderkey", F.lit("first").alias("half")).unionByName(o.filter("year(o_orderdate) >= 1995").select(F.lit("second").alias("half"), "o_orderkey"))
