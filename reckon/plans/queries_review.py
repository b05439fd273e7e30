"""Review, retrieval, mining, packages and audit (A12-A24, J13-J23, J25, M18, R6-R14, C7, W2, T3, T4) over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reckon.operators import audit, mining, packages, retrieval, review
from reckon.plans.registry import query
from reckon.plans.relations import SOURCE_SQL, source_rows, table

c = F.col


def review_rows(spark, sf):
    return source_rows(spark, sf).select(c("source_row_id").alias("row_id"), F.when(c("l_linenumber") == 7, " ").otherwise(F.upper("work_name")).alias("display_name"), F.concat(c("unit"), F.lit(".")).alias("unit"), F.when(c("l_linenumber") % 3 != 0, c("cost_type_code")).alias("proposed_category"))


REVIEW_SQL = f"""{SOURCE_SQL}, one AS (SELECT source_row_id AS row_id, l_linenumber, work_name, unit, cost_type_code FROM src),
g AS (SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE work_name END AS name, lower(unit) AS unit, CASE WHEN l_linenumber = 7 THEN row_id END AS own, string_agg(row_id, chr(31) ORDER BY row_id) AS ids, count(*) AS n_members,
  CASE WHEN count(DISTINCT CASE WHEN l_linenumber % 3 <> 0 THEN cost_type_code END) = 1 THEN min(CASE WHEN l_linenumber % 3 <> 0 THEN cost_type_code END) END AS category FROM one GROUP BY 1, 2, 3),
v AS (SELECT *, sha256(coalesce(name, '') || chr(31) || coalesce(unit, '') || chr(31) || ids) AS version FROM g)"""


@query(f"WITH {REVIEW_SQL} SELECT 'reconciliation-group-' || version[1:24] AS group_id, version, name, unit, n_members, category FROM v")
def a12_review_groups(spark, sf):
    return review.review_groups(review_rows(spark, sf)).drop("members")


def feedback(spark, sf):
    t = table(spark, sf, "conversations")
    return t.select(F.concat(F.lit(" Conv  "), (c("conv_id") % 50).cast("string")).alias("name_key"), F.when(c("conv_id") % 2 == 0, "M.").alias("unit_key"), c("role").alias("action"), (c("conv_id") * 100 + c("turn")).alias("sequence"))


@query("""WITH x AS (SELECT 'conv ' || (conv_id % 50) AS name_key, CASE WHEN conv_id % 2 = 0 THEN 'm' END AS unit_key, role AS action, conv_id * 100 + turn AS sequence FROM conversations)
SELECT name_key, unit_key, max_by(action, sequence) AS action, max(sequence) AS sequence FROM x GROUP BY 1, 2""")
def d6_latest_feedback(spark, sf):
    return review.latest_feedback(feedback(spark, sf))


@query("""WITH x AS (SELECT DISTINCT 'conv ' || (conv_id % 50) AS k, CASE WHEN conv_id % 2 = 0 THEN 'm' END AS u FROM conversations), g AS (SELECT doc_id, 'conv ' || (doc_id % 70) AS name, CASE WHEN doc_id % 4 < 2 THEN 'm' END AS unit FROM documents)
SELECT doc_id FROM g WHERE NOT EXISTS (SELECT 1 FROM x WHERE k = name AND u IS NOT DISTINCT FROM unit)""")
def j21_suppress_resolved(spark, sf):
    groups = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("conv "), (c("doc_id") % 70).cast("string")).alias("name"), F.when(c("doc_id") % 4 < 2, "m").alias("unit"))
    return review.suppress_resolved(groups, feedback(spark, sf)).select("doc_id")


@query("""WITH g AS (SELECT o_custkey AS group_id, o_orderkey AS row_id FROM orders), d AS (SELECT c_custkey AS group_id, CASE WHEN c_custkey % 7 = 0 THEN 'reject' ELSE 'accept' END AS action, c_mktsegment AS cat FROM customer WHERE c_custkey % 2 = 0),
r AS (SELECT o_orderkey AS row_id, CASE WHEN o_orderstatus = 'F' THEN 'accept' ELSE 'reject' END AS action, o_orderpriority AS cat FROM orders WHERE o_orderkey % 5 = 0),
x AS (SELECT coalesce(r.row_id, g.row_id) AS row_id, coalesce(r.action, d.action) AS action, coalesce(r.cat, d.cat) AS cat, r.row_id IS NULL AS q FROM (SELECT g.row_id, d.action, d.cat FROM g JOIN d USING (group_id)) d FULL JOIN r ON r.row_id = d.row_id LEFT JOIN g ON g.row_id = d.row_id)
SELECT row_id, cat AS target_category, q AS include_quantity FROM x WHERE action <> 'reject'""")
def j13_overrides(spark, sf):
    o = table(spark, sf, "orders")
    groups = o.groupBy(c("o_custkey").alias("group_id")).agg(F.collect_list("o_orderkey").alias("members"))
    none = F.lit(None).cast("long")
    by_group = table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(c("c_custkey").alias("group_id"), none.alias("row_id"), F.when(c("c_custkey") % 7 == 0, "reject").otherwise("accept").alias("action"), c("c_mktsegment").alias("target_category"), F.lit("quantity_cost").alias("mode"))
    by_row = o.filter("o_orderkey % 5 = 0").select(none.alias("group_id"), c("o_orderkey").alias("row_id"), F.when(c("o_orderstatus") == "F", "accept").otherwise("reject").alias("action"), c("o_orderpriority").alias("target_category"), F.lit("cost").alias("mode"))
    return review.apply_overrides(groups, by_group.unionByName(by_row))


@query("SELECT count(*) FILTER (WHERE NOT z) AS visible, count(*) FILTER (WHERE z) AS hidden FROM (SELECT coalesce(l_discount = 0 AND CASE WHEN l_linenumber <> 1 THEN l_tax END = 0, false) AS z FROM lineitem)")
def f6_zero_activity(spark, sf):
    z = review.zero_activity(c("l_discount"), F.when(c("l_linenumber") != 1, c("l_tax")))
    return table(spark, sf, "lineitem").agg(F.count_if(~z).alias("visible"), F.count_if(z).alias("hidden"))


WORDS = ("Монтаж кабеля", "Демонтаж трубопровода DN 50", "Прокладка силового кабеля 10 кВ", "Сварка труб Диаметр 159 мм", "Испытание оборудования")
WORD_SQL = "['монтаж кабеля', 'демонтаж трубопровода dn 50', 'прокладка силового кабеля 10 кв', 'сварка труб диаметр 159 мм', 'испытание оборудования'][p_partkey % 5 + 1]"


def part_groups(spark, sf):
    name = F.concat(F.element_at(F.array(*map(F.lit, WORDS)), (c("p_partkey") % 5 + 1).cast("int")), F.lit(" ("), c("p_name"), F.lit(")"))
    return table(spark, sf, "part").select(c("p_partkey").alias("group_id"), name.alias("name"), F.when(c("p_partkey") % 3 == 0, "М2").otherwise("шт").alias("unit"), c("p_brand").alias("category"), F.when(c("p_partkey") % 2 == 0, "quantity_cost").otherwise("cost").alias("mode"))


def feature_rows(spark, sf):
    return review.features(part_groups(spark, sf))


@query(f"""SELECT p_partkey AS group_id, {WORD_SQL} || ' ' || p_name AS name, ['installation', 'dismantling', 'laying', 'welding', 'testing'][p_partkey % 5 + 1] AS action, nullif(['cable', 'pipeline', 'cable', '', 'equipment'][p_partkey % 5 + 1], '') AS object_kind,
  ['', 'dismantling', 'power', '', 'testing'][p_partkey % 5 + 1] AS critical, ['', 'dismantling', '', '', 'testing'][p_partkey % 5 + 1] AS negative, ['', 'diameter_dn:50', 'voltage_kv:10', 'diameter_mm:159', ''][p_partkey % 5 + 1] AS typed,
  CASE WHEN p_partkey % 3 = 0 THEN 'area' ELSE 'count' END AS unit_family, len(list_distinct(list_transform(range(1, length(replace({WORD_SQL} || p_name, ' ', '')) - 1), lambda i: substr(replace({WORD_SQL} || p_name, ' ', ''), i, 3)))) AS n_ngrams FROM part""")
def m18_features(spark, sf):
    join = lambda x: F.array_join(x, ",").alias(x)
    return feature_rows(spark, sf).select("group_id", "name", "action", "object_kind", join("critical"), join("negative"), join("typed"), "unit_family", F.size("ngrams").cast("long").alias("n_ngrams"))


PAIR_SQL = f"""f AS (SELECT p_partkey AS id, p_brand AS cat, CASE WHEN p_partkey % 2 = 0 THEN 'quantity_cost' ELSE 'cost' END AS mode, CASE WHEN p_partkey % 3 = 0 THEN 'area' ELSE 'count' END AS fam, CASE WHEN p_partkey % 3 = 0 THEN 'м2' ELSE 'шт' END AS unit, p_partkey % 5 AS w FROM part),
p AS (SELECT a.id AS left_id, b.id AS right_id, a.mode AS ma, b.mode AS mb, a.fam AS fa, b.fam AS fb, least(a.w, b.w) AS x, greatest(a.w, b.w) AS y FROM f a JOIN f b ON a.cat = b.cat AND a.id < b.id)"""


@query(f"""WITH {PAIR_SQL} SELECT left_id, right_id, CASE WHEN ma <> mb THEN 'accounting_mode_mismatch' WHEN ma = 'quantity_cost' AND fa <> fb THEN 'quantity_cost_unit_mismatch' WHEN fa <> fb THEN 'unit_family_mismatch'
  WHEN x = 0 AND y = 4 THEN 'hard_installation_vs_testing' WHEN x = 2 AND y = 4 THEN 'hard_laying_vs_testing' WHEN x = 0 AND y = 1 THEN 'hard_dismantling_vs_installation' END AS reason FROM p
  WHERE ma <> mb OR fa <> fb OR (x = 0 AND y IN (1, 4)) OR (x = 2 AND y = 4)""")
def j22_pair_conflicts(spark, sf):
    # Features take far longer than reading, so groups are dealt over all tasks first, however few files hold them.
    return review.pair_conflicts(review.features(part_groups(spark, sf).repartition("group_id")), ["category"])


@query("""SELECT min(l_orderkey * 10 + l_linenumber) AS first_row, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_suppkey, CASE WHEN l_linenumber = 7 THEN l_orderkey * 10 + l_linenumber END""")
def a13_review_clusters(spark, sf):
    line = table(spark, sf, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("row_id"), "l_returnflag", "l_linestatus", "l_suppkey", "l_linenumber", c("l_discount").alias("confidence"))
    return review.clusters(line, ["l_returnflag", "l_linestatus", "l_suppkey"], c("l_linenumber") != 7).select(c("pivot_row_id").alias("first_row"), c("n_members").alias("n"))


@query("""WITH i AS (SELECT p_brand, p_type, p_size, count(*) AS n, bool_or(p_partkey % 50 = 0) AS e FROM part GROUP BY 1, 2, 3) SELECT p_brand, p_type, count(*) AS n_families, CAST(sum(n) AS BIGINT) AS n_groups, NOT bool_or(e) AS safe FROM i GROUP BY 1, 2""")
def a14_families_and_packages(spark, sf):
    rows = table(spark, sf, "part").select(c("p_partkey").cast("string").alias("group_id"), "p_brand", "p_type", "p_size", (c("p_partkey") % 50 == 0).alias("has_exception"))
    return review.families(rows, ["p_brand", "p_type", "p_size"], ["p_brand", "p_type"]).drop("package_digest")


@query("""SELECT p_brand AS boundary, p_type AS critical_signature, p_size AS typed_signature, count(*) AS n_atoms, CASE WHEN bool_or(p_partkey % 40 = 0) THEN 'manual' WHEN count(*) = 1 THEN 'outlier' ELSE 'candidate' END AS route FROM part GROUP BY 1, 2, 3""")
def a15_atom_clusters(spark, sf):
    atoms = table(spark, sf, "part").select(c("p_partkey").alias("atom_id"), c("p_brand").alias("boundary"), c("p_type").alias("critical_signature"), c("p_size").alias("typed_signature"), (c("p_partkey") % 40 == 0).alias("blocked"))
    return packages.atom_clusters(atoms).drop("atoms")


def nation_families(spark, sf):
    n = table(spark, sf, "nation")
    rows = n.select(c("n_regionkey").alias("boundary"), c("n_nationkey").alias("family_id"), (c("n_nationkey") % 3 + 1).alias("n_atoms"))
    a, b = n.select(c("n_regionkey").alias("ra"), c("n_nationkey").alias("left_id")), table(spark, sf, "nation").select(c("n_regionkey").alias("rb"), c("n_nationkey").alias("right_id"))
    pairs = a.join(b, (c("ra") == c("rb")) & (c("left_id") < c("right_id")) & ((c("left_id") + c("right_id")) % 3 != 0)).select(c("ra").alias("boundary"), "left_id", "right_id")
    return rows, pairs


@query()
def a16_optimal_packages(spark, sf):
    families, pairs = nation_families(spark, sf)
    return packages.optimal_packages(families, pairs)


@query("""WITH a AS (SELECT o_custkey AS p, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1), k AS (SELECT x.o_custkey AS p, count(*) AS n, bool_and(x.o_orderkey % 50 <> 0) AS ok FROM orders x JOIN orders y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey AND (x.o_orderkey + y.o_orderkey) % 40 <> 0 GROUP BY 1)
SELECT a.p AS package_id, a.n AS n_atoms, coalesce(k.n, 0) AS n_pairs, coalesce(k.n, 0) = a.n * (a.n - 1) / 2 AND coalesce(ok, a.n = 1) AND a.n <= 128 AND coalesce(k.n, 0) <= 8192 AS safe FROM a LEFT JOIN k USING (p)""")
def a32_complete_pairs(spark, sf):
    atoms = table(spark, sf, "orders").select(c("o_custkey").alias("package_id"), c("o_orderkey").alias("atom_id"))
    pairs = atoms.alias("x").join(atoms.alias("y"), "package_id").filter("x.atom_id < y.atom_id and (x.atom_id + y.atom_id) % 40 <> 0").select("package_id", c("x.atom_id").alias("left_id"), c("y.atom_id").alias("right_id"), (c("x.atom_id") % 50 != 0).alias("compatible"))
    return packages.complete_pairs(atoms, pairs)


# Retrieval


def benchmark_queries(spark, sf):
    return table(spark, sf, "benchmark").select(c("item_id").alias("query_id"), "text", F.when(c("item_id") % 2 == 0, "en").otherwise("fr").alias("unit"), F.lit("src1").alias("source_type"))


LEX_SQL = """tok AS (SELECT item_id AS id, text, list_distinct(list_filter(string_split_regex(lower(trim(regexp_replace(replace(replace(coalesce(text, ''), '/', ' '), 'ё', 'е'), '[\\s\\x{00A0}]+', ' ', 'g'))), ' +'), lambda t: length(t) > 1)) AS tk FROM benchmark),
dok AS (SELECT doc_id AS id, lang, source, list_distinct(list_filter(string_split_regex(lower(trim(regexp_replace(replace(replace(coalesce(text, ''), '/', ' '), 'ё', 'е'), '[\\s\\x{00A0}]+', ' ', 'g'))), ' +'), lambda t: length(t) > 1)) AS tk FROM documents),
sh AS (SELECT q, d, count(*) AS s FROM (SELECT id AS q, unnest(tk) AS t FROM tok) JOIN (SELECT id AS d, unnest(tk) AS t FROM dok) USING (t) GROUP BY 1, 2),
al AS (SELECT tok.id AS q, dok.id AS d, coalesce(s, 0) AS s, len(tok.tk) AS a, len(dok.tk) AS b, lang = CASE WHEN tok.id % 2 = 0 THEN 'en' ELSE 'fr' END AS u, source = 'src1' AS k FROM tok JOIN dok ON true LEFT JOIN sh ON sh.q = tok.id AND sh.d = dok.id),
sc AS (SELECT q, d, least(CASE WHEN a + b - s > 0 THEN s / (a + b - s) ELSE 0 END + (CASE WHEN u THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN k THEN 0.04::DOUBLE ELSE 0 END), 1.0) AS score FROM al)"""


@query(f"""WITH {LEX_SQL}, r AS (SELECT q, d, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS r FROM sc WHERE score > 0) SELECT q AS query_id, CAST(r AS INTEGER) AS rank, d AS example_id, round(score, 9) AS score FROM r WHERE r <= 5""")
def r6_lexical_top_k(spark, sf):
    examples = table(spark, sf, "documents").select(c("doc_id").alias("example_id"), "text", c("lang").alias("unit"), c("source").alias("source_type"))
    return retrieval.lexical_top_k(benchmark_queries(spark, sf), examples, 5)


VEC_SQL = """v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v),
d AS (SELECT q.id AS q, x.id AS d, q.label AS ql, x.label AS xl, round(list_sum(list_transform(list_zip(q.e, x.e), lambda p: p[1] * p[2])), 9) AS score FROM n q JOIN n x ON q.id <> x.id WHERE q.id % 20 = 0)"""


def vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.filter("vec_id % 20 = 0").select(c("vec_id").alias("query_id"), "label", c("embedding").alias("vector")), e.select(c("vec_id").alias("example_id"), "label", c("embedding").alias("vector"))


@query(f"WITH {VEC_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS r FROM d) SELECT q AS query_id, CAST(r AS INTEGER) AS rank, d AS example_id, round(score, 6) AS score FROM r WHERE r <= 3")
def r7_dense_top_k(spark, sf):
    return retrieval.dense_top_k(*vectors(spark, sf), 3).withColumn("score", F.round("score", 6))


@query(f"WITH {VEC_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS r FROM d WHERE ql = xl) SELECT q AS query_id, CAST(r AS INTEGER) AS rank, d AS example_id, round(score, 6) AS score FROM r WHERE r <= 3")
def r14_dense_in_context(spark, sf):
    q, e = vectors(spark, sf)
    return retrieval.dense_top_k(q, e, 3, ["label"]).withColumn("score", F.round("score", 6))


def signals(spark, sf):
    line = table(spark, sf, "lineitem")
    return line.select(c("l_suppkey").alias("query_id"), c("l_partkey").alias("identity"), c("l_returnflag").alias("channel"), c("l_linenumber").alias("rank"))


#: 1 / (60 + rank) to 18 places, halves up, for the ranks that line numbers take.
PARTS = {r: f"0.{(2 * 10**18 + 60 + r) // (2 * (60 + r)):018d}" for r in range(1, 8)}
RRF_SQL = f"""b AS (SELECT l_suppkey AS q, l_partkey AS i, l_returnflag AS ch, min(l_linenumber) AS r FROM lineitem GROUP BY 1, 2, 3),
f AS (SELECT q, i, CAST(sum(CASE r {" ".join(f"WHEN {r} THEN CAST('{v}' AS DECIMAL(38,18))" for r, v in PARTS.items())} END) AS DECIMAL(38,18)) AS score, count(*) AS n FROM b GROUP BY 1, 2)"""


@query(f"WITH {RRF_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, n DESC, i) AS r FROM f WHERE i % 10 <> 0) SELECT q AS query_id, CAST(r AS INTEGER) AS rank, i AS identity, score, n AS n_channels FROM x WHERE r <= 5")
def r8_rank_fusion(spark, sf):
    s = signals(spark, sf)
    return retrieval.rank_fusion(s, 5, s.filter("identity % 10 = 0").select("query_id", "identity").distinct())


@query("""WITH n AS (SELECT l_suppkey AS q, l_partkey AS i, max(l_quantity) FILTER (WHERE l_returnflag = 'R') AS s, max(l_quantity) FILTER (WHERE l_returnflag = 'N') AS p FROM lineitem GROUP BY 1, 2) SELECT q AS query_id, i AS identity, p AS similarity, coalesce(s >= p, false) AS near_negative FROM n WHERE p IS NOT NULL""")
def r9_hard_negatives(spark, sf):
    line = table(spark, sf, "lineitem").select(c("l_suppkey").alias("query_id"), c("l_partkey").alias("identity"), c("l_quantity").alias("similarity"), "l_returnflag")
    ranked = line.filter("l_returnflag = 'N'").groupBy("query_id", "identity").agg(F.max("similarity").alias("similarity"))
    return retrieval.hard_negative_flags(ranked, line.filter("l_returnflag = 'R'")).select("query_id", "identity", "similarity", "near_negative")


@query(f"""WITH {VEC_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS r FROM d), w AS (SELECT q.id AS q, min(x.id) AS d FROM n q JOIN n x ON q.label = x.label AND q.id <> x.id WHERE q.id % 20 = 0 GROUP BY 1),
h AS (SELECT w.q, min(r.r) AS r FROM w LEFT JOIN r ON r.q = w.q AND r.d = w.d AND r.r <= 50 GROUP BY 1)
SELECT count(*) AS n_queries, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END), 9) AS recall, round(avg(coalesce(1.0 / r, 0.0)), 9) AS mrr, round(avg(CASE WHEN r = 1 THEN 0.0 ELSE 1.0 END), 9) AS top1_error FROM h""")
def a22_retrieval_evaluation(spark, sf):
    q, e = vectors(spark, sf)
    expected = q.join(e.select("label", "example_id"), "label").filter("query_id <> example_id").groupBy("query_id").agg(F.min("example_id").alias("example_id"))
    return retrieval.evaluate(retrieval.dense_top_k(q, e, 50), expected)


@query("""WITH x AS (SELECT l_suppkey, l_orderkey, max(CASE WHEN l_linenumber = 5 THEN l_returnflag END) AS f, count(DISTINCT l_linestatus) AS n, min(l_linestatus) AS s FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey * 1000000 + l_suppkey AS query_id, CASE WHEN f IS NOT NULL THEN 'feedback' WHEN n = 1 THEN 'pattern' ELSE 'manual' END AS source, CASE WHEN f IS NOT NULL THEN f WHEN n = 1 THEN s END AS outcome FROM x""")
def c7_authority(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy((c("l_orderkey") * 1000000 + c("l_suppkey")).alias("query_id")).agg(F.max(F.when(c("l_linenumber") == 5, c("l_returnflag"))).alias("feedback"), F.collect_set("l_linestatus").alias("outcomes"))
    return retrieval.authority(rows)


EX_SQL = """ex AS (SELECT p_partkey AS id, p_name AS text, CASE WHEN p_size % 3 > 0 THEN p_type END AS unit, CASE WHEN p_size % 5 > 0 THEN p_type END AS cat, p_brand AS st, p_size = 7 AS fb FROM part),
ro AS (SELECT DISTINCT p_name || '|' || p_type AS row_id, p_name AS text, p_type AS unit FROM part),
pr AS (SELECT row_id, id, cat, st, fb, CASE WHEN ex.unit = ro.unit THEN 0 WHEN ex.unit IS NULL AND cat IS NOT NULL THEN 1 END AS t FROM ro JOIN ex USING (text)),
b1 AS (SELECT *, min(t) OVER (PARTITION BY row_id) AS m FROM pr WHERE t IS NOT NULL), b2 AS (SELECT *, bool_or(fb) OVER (PARTITION BY row_id) AS af FROM b1 WHERE t = m), b3 AS (SELECT * FROM b2 WHERE fb = af)"""


@query(f"""WITH {EX_SQL} SELECT row_id, CASE WHEN count(DISTINCT coalesce(cat, '-')) = 1 THEN min(id) END AS example_id, CASE WHEN count(DISTINCT coalesce(cat, '-')) = 1 THEN min(cat) END AS category, count(DISTINCT coalesce(cat, '-')) > 1 AS conflict FROM b3 GROUP BY 1""")
def j18_exact_examples(spark, sf):
    p = table(spark, sf, "part")
    examples = p.select(c("p_partkey").alias("example_id"), c("p_name").alias("normalized_text"), F.when(c("p_size") % 3 > 0, c("p_type")).alias("unit"), F.when(c("p_size") % 5 > 0, c("p_type")).alias("category"), F.lit("include").alias("quantity_decision"), F.lit("include").alias("cost_decision"), c("p_brand").alias("source_type"), (c("p_size") == 7).alias("is_feedback"))
    rows = p.select(F.concat_ws("|", "p_name", "p_type").alias("row_id"), c("p_name").alias("text"), c("p_type").alias("unit"), F.lit("none").alias("source_type")).distinct()
    return retrieval.exact_example(rows, examples)


CONS_SQL = """rc AS (SELECT p_name AS text, CASE WHEN p_size % 2 = 0 THEN p_type END AS unit, CASE WHEN p_size % 4 > 1 THEN p_brand END AS st, CASE WHEN p_partkey % 9 = 0 THEN 'v1' ELSE 'v2' END AS ver, p_type || (p_partkey % 2) AS fp, p_type AS outcome FROM part),
o1 AS (SELECT text, unit, st, ver, count(DISTINCT fp) AS n, min(outcome) AS outcome FROM rc GROUP BY 1, 2, 3, 4),
o2 AS (SELECT text, unit, st, max(CASE WHEN ver = 'v2' AND n = 1 THEN outcome END) AS outcome, bool_or(CASE WHEN ver = 'v2' THEN n > 1 ELSE n = 1 END) AS rev FROM o1 GROUP BY 1, 2, 3)"""


@query(f"""WITH {CONS_SQL} SELECT p_partkey, outcome, coalesce(rev, false) AS needs_review FROM part LEFT JOIN o2 ON o2.text = p_name AND o2.unit IS NOT DISTINCT FROM CASE WHEN p_size % 2 = 1 THEN NULL ELSE p_type END AND o2.st IS NOT DISTINCT FROM CASE WHEN p_size % 3 = 0 THEN p_brand END""")
def j19_consensus(spark, sf):
    p = table(spark, sf, "part")
    records = p.select(c("p_name").alias("text"), F.when(c("p_size") % 2 == 0, c("p_type")).alias("unit"), F.when(c("p_size") % 4 > 1, c("p_brand")).alias("source_type"), F.when(c("p_partkey") % 9 == 0, "v1").otherwise("v2").alias("rules_version"), F.concat(c("p_type"), (c("p_partkey") % 2).cast("string")).alias("fingerprint"), c("p_type").alias("outcome"))
    rows = p.select("p_partkey", c("p_name").alias("text"), F.when(c("p_size") % 2 == 0, c("p_type")).alias("unit"), F.when(c("p_size") % 3 == 0, c("p_brand")).alias("source_type"))
    return retrieval.consensus(rows, records, "v2").select("p_partkey", "outcome", "needs_review")


# Mining


@query("""WITH t AS (SELECT p_partkey, p_brand, p_type, unnest(string_split(p_name, ' ')) AS key FROM part), a AS (SELECT key, p_brand, p_type, count(*) AS n FROM t GROUP BY 1, 2, 3),
g AS (SELECT key, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS atoms, count(DISTINCT p_type) AS documents FROM a GROUP BY 1) SELECT *, CAST(row_number() OVER (ORDER BY atoms DESC, occurrences DESC, key) AS INTEGER) AS rank FROM g QUALIFY rank <= 10""")
def a17_token_profile(spark, sf):
    corpus = table(spark, sf, "part").select(c("p_name").alias("text"), c("p_brand").alias("identity"), c("p_type").alias("document_set"))
    return mining.ngram_profile(corpus, 10)


@query("""WITH n AS (SELECT DISTINCT p_name AS t FROM part), w AS (SELECT t, string_split(t, ' ') AS w FROM n),
p AS (SELECT a.t AS l, b.t AS r, a.w AS x, b.w AS y FROM w a JOIN w b ON a.t < b.t AND len(a.w) = len(b.w)), d AS (SELECT l, r, list_filter(list_zip(x, y), lambda p: p[1] <> p[2]) AS d FROM p)
SELECT l AS "left", r AS "right" FROM d WHERE len(d) = 1 AND (length(d[1][1]) = 1 OR length(d[1][2]) = 1 OR (least(length(d[1][1]), length(d[1][2])) >= 8 AND levenshtein(d[1][1], d[1][2]) <= 1))""")
def j23_near_variants(spark, sf):
    return mining.near_variants(table(spark, sf, "part").select(c("p_name").alias("text")))


CORPUS_SQL = """co AS (SELECT p_brand AS scope, p_name AS skeleton, p_partkey // 3 AS identity, p_type AS ds, CASE WHEN p_partkey % 97 = 0 THEN 'x' ELSE 'y' END AS outcome, CASE WHEN p_partkey % 4 = 0 THEN 'manual_unresolved' ELSE 'confirmed' END AS res FROM part),
atom AS (SELECT scope, skeleton, identity, ds, min(outcome) AS outcome FROM co WHERE res = 'confirmed' GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT outcome) = 1),
ca AS (SELECT scope, skeleton, count(*) AS support_atoms, count(DISTINCT ds) AS documents, min(outcome) AS outcome FROM atom GROUP BY 1, 2 HAVING count(*) >= 2 AND count(DISTINCT outcome) = 1)"""


def corpus(spark, sf):
    return table(spark, sf, "part").select(c("p_brand").alias("scope"), c("p_name").alias("skeleton"), F.floor(c("p_partkey") / 3).cast("long").alias("identity"), c("p_type").alias("document_set"), F.when(c("p_partkey") % 97 == 0, "x").otherwise("y").alias("outcome"), F.when(c("p_partkey") % 4 == 0, "manual_unresolved").otherwise("confirmed").alias("resolution"))


@query(f"WITH {CORPUS_SQL} SELECT * FROM ca")
def a18_pattern_candidates(spark, sf):
    return mining.candidates(corpus(spark, sf), ["scope"], 2)


@query(f"""WITH {CORPUS_SQL}, f AS (SELECT scope, skeleton, identity, ds, min(outcome) AS a, bool_or(res = 'confirmed') AS ok FROM co GROUP BY 1, 2, 3, 4)
SELECT ca.scope, ca.skeleton, count(*) AS matched, count(*) FILTER (WHERE ok AND a = outcome) AS support, count(*) FILTER (WHERE ok AND a <> outcome) AS contradictions, count(*) FILTER (WHERE ok AND a = outcome) AS agreement_numerator,
  count(*) FILTER (WHERE ok) AS agreement_denominator FROM ca JOIN f ON f.scope = ca.scope AND f.skeleton = ca.skeleton GROUP BY 1, 2""")
def a19_candidate_evaluation(spark, sf):
    rows = corpus(spark, sf)
    return mining.evaluate_candidates(rows, mining.candidates(rows, ["scope"], 2), ["scope"])


@query("""WITH x AS (SELECT l_returnflag, l_quantity AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, min(v) FILTER (WHERE r = ceil(n * 50 / 100.0)) AS p50, min(v) FILTER (WHERE r = ceil(n * 95 / 100.0)) AS p95, min(v) FILTER (WHERE r = n) AS p100 FROM x GROUP BY 1""")
def a21_nearest_rank(spark, sf):
    return mining.nearest_rank(table(spark, sf, "lineitem"), "l_quantity", (50, 95, 100), ["l_returnflag"])


@query("""WITH e AS (SELECT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b, l_returnflag AS f FROM lineitem) SELECT a AS "left", b AS "right" FROM e GROUP BY 1, 2 HAVING bool_or(f = 'N') AND bool_or(f = 'R')""")
def a24_contradictions(spark, sf):
    edges = table(spark, sf, "lineitem").select(c("l_suppkey").alias("left"), c("l_partkey").alias("right"), F.when(c("l_returnflag") == "N", "must_link").when(c("l_returnflag") == "R", "cannot_link").otherwise("other").alias("relation"))
    return mining.contradictions(edges)


@query("SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS INTEGER) AS place FROM part")
def r10_active_learning_queue(spark, sf):
    return mining.queue_order(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], "p_partkey").select("p_partkey", "place")


# Packages


def facts(spark, sf):
    line = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_returnflag").alias("f"), F.min("l_quantity").alias("q"))
    row = c("l_orderkey") * 10 + c("l_linenumber")
    code = F.when(c("l_linenumber") <= 2, (c("l_orderkey") % 50).cast("string")).otherwise(F.concat_ws(".", c("l_orderkey") % 50, c("l_linenumber"), c("p") % 3))
    return line.select(c("l_suppkey").cast("string").alias("sheet"), row.alias("row_number"), code.alias("work_code"), F.when((c("l_linenumber") <= 2) & (c("f") != "A"), F.concat(F.lit("AB-12."), (c("p") % 10).cast("string"), F.lit("/C3"))).alias("drawing_code"), c("p"), c("q"))


FACT_SQL = """fa AS (SELECT CAST(l_suppkey AS VARCHAR) AS sheet, l_orderkey * 10 + l_linenumber AS row_number, l_linenumber AS ln, l_orderkey % 50 AS base, min(l_partkey) AS p, min(l_returnflag) AS f, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3, 4),
fc AS (SELECT *, CASE WHEN ln <= 2 THEN CAST(base AS VARCHAR) ELSE base || '.' || ln || '.' || (p % 3) END AS work_code, CASE WHEN ln <= 2 AND f <> 'A' THEN 'AB-12.' || (p % 10) || '/C3' END AS drawing FROM fa),
ih AS (SELECT a.sheet, a.row_number, max_by(b.drawing, (length(b.work_code), b.row_number)) AS code FROM fc a JOIN fc b ON a.sheet = b.sheet AND b.row_number < a.row_number AND b.drawing IS NOT NULL AND starts_with(a.work_code, b.work_code || '.') WHERE a.drawing IS NULL GROUP BY 1, 2)"""


@query(f"WITH {FACT_SQL} SELECT fc.sheet, fc.row_number, coalesce(drawing, ih.code) AS code FROM fc LEFT JOIN ih USING (sheet, row_number)")
def j14_inherited_codes(spark, sf):
    return packages.inherited_codes(facts(spark, sf)).select("sheet", "row_number", "code")


@query("""SELECT p_partkey, p_size % 3 <> 0 AS project, len(list_intersect(string_split(p_name, ' '), ['blue', 'large', 'widget'])) * 10 >= 12 AS names, CASE WHEN p_size % 4 = 0 THEN 'NOT_COMPARABLE' WHEN p_size % 4 = 1 THEN 'MATCH' WHEN p_size = 10 THEN 'MATCH' ELSE 'MISMATCH' END AS quantity FROM part""")
def j16_evidence_signals(spark, sf):
    p = table(spark, sf, "part")
    left = F.concat(F.lit("Шифр ABCD-1200/C"), (c("p_size") % 3).cast("string"), F.lit(" и др."))
    q = F.lit(10).cast("decimal(20,6)")
    unit = F.when(c("p_size") % 4 == 0, "ft").when(c("p_size") % 4 == 1, "км").otherwise("м.")
    other = F.when(c("p_size") % 4 == 1, F.lit(10000)).otherwise(c("p_size")).cast("decimal(20,6)")
    stop = F.concat(c("p_name"), F.lit(" работы"))
    two = F.lit("blue large widget")
    return p.select("p_partkey", packages.project_signal(left, F.when(c("p_size") % 3 == 1, "abcd-1200/c1-x9").when(c("p_size") % 3 == 2, "abcd-1200-c2").otherwise("abcd-1200-d0-x9")).alias("project"), packages.similar_names(stop, two).alias("names"), packages.compare_quantity(q, unit, other, F.lit("м")).alias("quantity"))


@query("""WITH s AS (SELECT s_suppkey AS row_id, s_suppkey % 12 AS k FROM supplier) SELECT CASE k WHEN 0 THEN 'NEEDS_REVIEW' WHEN 1 THEN 'NO_EVIDENCE' WHEN 2 THEN 'NEEDS_REVIEW' WHEN 3 THEN 'AMBIGUOUS' WHEN 4 THEN 'NEEDS_REVIEW' WHEN 5 THEN 'AMBIGUOUS' WHEN 6 THEN 'NEEDS_REVIEW' WHEN 7 THEN 'MISMATCH' ELSE 'MATCH' END AS status, count(*) AS n FROM s GROUP BY 1""")
def j15_evidence_reconciliation(spark, sf):
    k = c("s_suppkey") % 12
    rows = table(spark, sf, "supplier").select(
        c("s_suppkey").alias("row_id"), F.when(k != 0, F.concat(F.lit("w"), c("s_suppkey").cast("string"))).alias("work_code"), F.lit("ABCD-1200/C3").alias("code"), F.lit("pipe cable").alias("name"), F.lit(5).cast("decimal(20,6)").alias("quantity"), F.lit("м").alias("unit"),
    )
    make = lambda n, when, kind, codes, q, readable: rows.filter(when).select((c("row_id") * 10 + n).alias("pdf_id"), F.coalesce("work_code", F.lit("none")).alias("work_code"), F.lit(codes).alias("project_codes"), F.lit("other words").alias("description"), F.lit(q).cast("decimal(20,6)").alias("quantity"), F.lit("м").alias("unit"), F.lit(kind).alias("document_type"), F.lit(readable).alias("readable"))
    m = c("row_id") % 12
    parts = [make(1, m == 2, "other", "", 5, True), make(1, m == 3, "other", "", 5, True), make(2, m == 3, "other", "", 5, True), make(1, m == 4, "aosr", "zzzz-9900/q1", 5, True), make(1, m == 5, "aosr", "abcd-1200/c3", 5, True), make(2, m == 5, "aosr", "abcd-1200/c3/x", 5, True), make(1, m == 6, "aosr", "abcd-1200/c3", 5, False), make(1, m == 7, "aosr", "abcd-1200/c3", 6, True), make(1, m > 7, "aosr", "abcd-1200/c3", 5, True), make(2, m > 9, "aosr", "zzzz-9900/q1", 5, True)]
    evidence = parts[0]
    for p in parts[1:]:
        evidence = evidence.unionByName(p)
    return packages.status_counts(packages.reconcile(rows, evidence))


# Audit


def events(spark, sf):
    e = table(spark, sf, "events")
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = F.row_number().over(w)
    last = F.count("*").over(Window.partitionBy("user_id"))
    state = F.when(n == 1, "PENDING").when((n == last) & (last > 3) & (c("user_id") % 3 == 0), "EXPORT_VERIFIED").when((n == last - 1) & (last > 3) & (c("user_id") % 3 == 0), "EXPORT_PREPARED").otherwise("DATA_COMMITTED")
    return e.select(c("user_id").alias("run_id"), n.cast("long").alias("event_sequence"), state.alias("state"), c("event_type").alias("payload"))


@query("""WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id AS run_id, n AS n_events, CASE WHEN n > 2 AND user_id % 5 = 0 THEN 'HASH_CHAIN_INVALID' WHEN n > 2 AND user_id % 5 = 1 THEN 'SEQUENCE_GAP' END AS error FROM n""")
def w2_chain_validation(spark, sf):
    rows = audit.chain(events(spark, sf))
    tampered = (c("run_id") % 5 == 0) & (c("event_sequence") == 2) & (c("n") > 2)
    gap = (c("run_id") % 5 == 1) & (c("event_sequence") == 3) & (c("n") > 2)
    from pyspark.sql import Window

    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("run_id")))
    rows = rows.withColumn("payload", F.when(tampered, "changed").otherwise(c("payload"))).withColumn("event_sequence", F.when(gap, 1_000_000).otherwise(c("event_sequence"))).drop("n")
    return audit.validate(rows)


@query("""WITH n AS (SELECT user_id AS u, count(*) AS n FROM events GROUP BY 1) SELECT u AS run_id, n AS n_events, 'PENDING' AS first_state, CASE WHEN n > 3 AND u % 3 = 0 THEN 'EXPORT_VERIFIED' WHEN n = 1 THEN 'PENDING' ELSE 'DATA_COMMITTED' END AS last_state FROM n""")
def a30_run_reports(spark, sf):
    return audit.run_report(audit.chain(events(spark, sf))).select("run_id", "n_events", "first_state", "last_state")


@query("""WITH d AS (SELECT turn, conv_id FROM conversations WHERE turn % 3 = 2) SELECT conv_id, turn FROM conversations c WHERE turn % 3 <> 2 AND NOT EXISTS (SELECT 1 FROM d WHERE d.conv_id = c.conv_id AND d.turn = c.turn + 1)""")
def k15_ledger_without_invalidated(spark, sf):
    key = lambda t: F.concat_ws("/", "conv_id", t)
    t = table(spark, sf, "conversations").select("conv_id", "turn", key(c("turn")).alias("event_id"), F.when(c("turn") % 3 == 2, key(c("turn") - 1)).alias("invalidates"))
    return audit.without_invalidated(t).select("conv_id", "turn")


@query("""WITH n AS (SELECT user_id AS u, count(*) AS n FROM events GROUP BY 1), v AS (SELECT o_orderkey AS id, o_custkey AS u, o_orderstatus AS r, o_orderpriority AS s FROM orders) SELECT id AS rule_version_id FROM v JOIN n USING (u) WHERE n > 3 AND u % 3 = 0 AND r = 'F' AND s = '1-URGENT' AND id % 7 <> 0""")
def t4_active_feedback(spark, sf):
    runs = audit.run_report(audit.chain(events(spark, sf))).select("run_id", "last_state", F.lit("F").alias("rule_hash"), F.lit("1-URGENT").alias("source_hash"))
    o = table(spark, sf, "orders")
    versions = o.select(c("o_orderkey").alias("rule_version_id"), c("o_custkey").alias("run_id"), c("o_orderstatus").alias("rule_hash"), c("o_orderpriority").alias("source_hash"))
    return audit.active_rules(versions, runs, o.filter("o_orderkey % 7 = 0").select(c("o_orderkey").alias("rule_version_id"))).select("rule_version_id")
