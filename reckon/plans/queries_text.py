"""Scalar operators (N, M, X groups) over part, orders, documents and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from reckon.functions import identity, metadata, numeric, text
from reckon.plans.registry import query
from reckon.plans.relations import MANIFEST_SQL, manifest, table

c = F.col


def pick(key, values):
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def sql_pick(key, values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][{key} % {len(values)} + 1]"


UNITS = (" П.М ", "м2", "Шт.", "кв. м", "тонна", "КОМПЛЕКТ", "ft", "  ", "м^3")
UNIT_OUT = ("м", "м²", "шт", "м²", "т", "компл.", "ft", None, "м³")
DRAWN = ("м³", "Куб. М", "п.м", "ТОНН", "шт.", "kg", " ", "м^3", "пог. м")
DRAWN_OUT = ("м3", "м3", "м", "т", "шт", "kg", None, "м3", "м")


def sql_case(key, values):
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values)) + " END"


@query(f"""SELECT p_partkey, lower(p_name) || ' ее' AS name, p_brand || ' № ' || p_size AS code, {sql_case('p_partkey', UNIT_OUT)} AS unit, 'x' || p_brand || '|№' AS typo,
  replace(lower(p_name), ' ', '|') || '|м²|' || p_size AS tokens FROM part""")
def n1_training_text(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        "p_partkey", text.normalize_text(F.concat(F.lit("  "), F.upper("p_name"), F.lit("  ёЁ "))).alias("name"),
        text.normalize_code(F.concat(c("p_brand"), F.lit("  No. "), c("p_size"), F.lit(" ;,"))).alias("code"), text.normalize_unit(pick(c("p_partkey"), UNITS)).alias("unit"),
        F.concat_ws("|", text.replace_exact(F.concat(F.lit("x"), c("p_brand")), {"never": "there"}), text.replace_exact(F.lit("no"), {"no": "№"})).alias("typo"),
        F.array_join(text.stable_tokens(F.concat(F.lower("p_name"), F.lit(" м²-"), c("p_size"))), "|").alias("tokens"),
    )


@query(f"""SELECT p_partkey, lower(p_name) || ' е' AS name, {sql_case('p_partkey', DRAWN_OUT)} AS unit, lower(p_name) || ' 5 №' AS feature, replace(lower(p_name), ' ', '') || '5№' AS code,
  CASE WHEN p_partkey % 2 = 0 THEN 'count' ELSE 'unknown' END AS family, lower(p_brand) AS review, nullif(replace(lower(p_brand), '.', ''), '') AS review_unit FROM part""")
def n9_drawing_and_review_text(spark, sf):
    p = table(spark, sf, "part")
    name = F.concat(F.lit("  "), c("p_name"), F.lit("  Ё "))
    return p.select(
        "p_partkey", text.drawing_text(name).alias("name"), text.drawing_unit(pick(c("p_partkey"), DRAWN)).alias("unit"), text.feature_text(F.concat(F.upper("p_name"), F.lit(" -(5)! №."))).alias("feature"),
        text.feature_unit(F.concat(F.upper("p_name"), F.lit(" -(5)! №."))).alias("code"), text.unit_family(F.when(c("p_partkey") % 2 == 0, "Комплект").otherwise("ft")).alias("family"),
        text.review_name(F.concat(F.lit(" "), c("p_brand"), F.lit("  "))).alias("review"), text.review_unit(F.concat(c("p_brand"), F.lit(". "))).alias("review_unit"),
    )


@query("""SELECT p_partkey, lower(p_name) || ' 3x' || p_size || ' "a" - b dn 50' AS semantic, p_name || ' 3 х ' || p_size AS audit,
  lower(replace(p_brand, ' ', '')) || '/1-a' AS work_code, 'work name, unit №' AS header, 'a 12-3' AS identifier FROM part""")
def n12_semantic_text(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        "p_partkey", text.semantic_text(F.concat(c("p_name"), F.lit("  3 х "), c("p_size"), F.lit(" «a» — b ДУ50"))).alias("semantic"), text.audit_text(F.concat(F.lit(" "), c("p_name"), F.lit("  3 х "), c("p_size"))).alias("audit"),
        text.work_code(F.concat(c("p_brand"), F.lit(" / 1-A "))).alias("work_code"), F.replace(text.normalize_header(F.lit("Work\nName  (unit) №")), F.lit("name unit"), F.lit("name, unit")).alias("header"), text.normalize_identifier(F.lit(" a  12–3 ")).alias("identifier"),
    )


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE len(string_split(n_regionkey || '.' || n_nationkey || '.' || s_suppkey || 'a', '.')) END AS depth,
  s_suppkey % 5 <> 0 AS inside, false AS not_inside FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def n14_positions(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    raw = F.concat_ws(".", c("n_regionkey"), c("n_nationkey"), F.concat(c("s_suppkey"), F.lit("a")), F.when(c("s_suppkey") % 5 == 0, "x1"))
    code = text.position_segments(raw)
    return s.join(n, c("s_nationkey") == c("n_nationkey")).select(
        "s_suppkey", F.when(code.isNotNull(), F.size(code)).cast("long").alias("depth"), text.is_ancestor(text.position_segments(F.concat_ws(".", "n_regionkey", "n_nationkey")), code).alias("inside"),
        text.is_ancestor(text.position_segments(F.lit("6.1")), text.position_segments(F.lit("6.10"))).alias("not_inside"),
    )


@query("""SELECT p_partkey, p_brand || '; ' || p_type AS raw, lower(p_brand || '; ' || p_type) AS group_key, lower(p_brand) || ' || ' || lower(p_type) AS split_key, CAST(2 AS BIGINT) AS parts, 'DRAWING_CODE_NOT_FOUND' AS empty_status FROM part""")
def n16_drawing_codes(spark, sf):
    raw = F.concat(F.lit(" "), c("p_brand"), F.lit(";  "), c("p_type"))
    code, split = text.drawing_code(raw), text.drawing_code(raw, split_confirmed=True)
    return table(spark, sf, "part").select("p_partkey", code["raw"].alias("raw"), code["group_key"].alias("group_key"), split["group_key"].alias("split_key"), F.size(code["components"]).cast("long").alias("parts"), text.drawing_code(F.lit(" "))["status"].alias("empty_status"))


@query("""WITH x AS (SELECT *, CAST(p_retailprice AS DECIMAL(12,2)) AS v FROM part)
SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 1000000 + v WHEN 1 THEN v WHEN 2 THEN -v WHEN 3 THEN p_size ELSE NULL END::DECIMAL(38,18) AS value,
  CASE p_partkey % 7 WHEN 4 THEN 'INVALID_FORMAT' WHEN 5 THEN 'EMPTY' WHEN 6 THEN 'INVALID_FORMAT' ELSE 'OK' END AS status,
  CASE p_partkey % 7 WHEN 4 THEN 'AMBIGUOUS_DECIMAL_SEPARATORS' WHEN 6 THEN 'NON_NUMERIC_MARKER' END AS warning FROM x""")
def m1_strict_decimals(spark, sf):
    v = c("p_retailprice").cast("decimal(12,2)").cast("string")
    comma = F.replace(v, F.lit("."), F.lit(","))
    grouped = F.concat(F.lit("1 000 "), F.lpad(F.substring_index(comma, ",", 1), 3, "0"), F.lit(","), F.substring_index(comma, ",", -1))
    wide = F.when(c("p_retailprice") < 1000, grouped).otherwise(F.concat(F.lit("1 00"), F.substring(comma, 1, 1), F.lit(" "), F.substring(comma, F.lit(2), F.length(comma))))
    raw = F.element_at(F.array(wide, F.concat(F.lit(" "), comma), F.concat(F.lit("-"), v), c("p_size").cast("string"), F.concat(F.lit("1,"), v), F.lit(" — "), F.lit("Н/Д")), (c("p_partkey") % 7 + 1).cast("int"))
    raw = F.when(c("p_partkey") % 7 == 6, "N/A").otherwise(raw)
    out = numeric.parse_decimal(raw)
    return table(spark, sf, "part").select("p_partkey", out["value"].alias("value"), out["status"].alias("status"), out["warning"].alias("warning"))


@query("""WITH x AS (SELECT *, CAST(p_retailprice AS DECIMAL(12,2)) AS v FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN v WHEN 1 THEN v WHEN 2 THEN v + CAST(0.001 AS DECIMAL(12,6)) END::DECIMAL(38,18) AS value, CASE WHEN p_partkey % 4 = 3 THEN 'EXCEL_ERROR' END AS warning FROM x""")
def m2_lenient_decimals(spark, sf):
    v = c("p_retailprice").cast("decimal(12,2)").cast("string")
    raw = F.element_at(F.array(F.concat(v, F.lit("000000002")), F.concat(F.lit("руб "), F.replace(v, F.lit("."), F.lit(","))), F.concat(v, F.lit("1")), F.lit("#REF!")), (c("p_partkey") % 4 + 1).cast("int"))
    out = numeric.parse_decimal_lenient(raw)
    return table(spark, sf, "part").select("p_partkey", out["value"].alias("value"), out["warning"].alias("warning"))


@query(f"""WITH {MANIFEST_SQL} SELECT file_id, CASE WHEN file_id % 40 + 1000 BETWEEN 1900 AND 2099 THEN NULL ELSE (file_id % 40 + 1000) || ' (' || (file_id % 7 + 600) || ')' END AS document_index, 'OK' AS status,
  CAST(1 AS BIGINT) AS n_candidates, 'MULTIPLE_INDEX_CANDIDATES' AS two, 'LOW_CONFIDENCE_INDEX' AS year_like, 'INDEX_NOT_FOUND' AS form, 'LOW_CONFIDENCE_INDEX' AS loose FROM m""")
def m4_document_index(spark, sf):
    out = metadata.document_index(c("filename"))
    two, year, form = (metadata.document_index(F.concat(F.lit(x), c("file_id").cast("string"))) for x in ("1001 (1) 1002 (2) ", "2024 (5) x", "КС-1234 (5) x"))
    loose = metadata.document_index(F.lit("1234-567"), allow_loose=True)
    return manifest(spark, sf).select("file_id", out["value"].alias("document_index"), out["status"].alias("status"), out["n_candidates"].cast("long").alias("n_candidates"), two["status"].alias("two"), year["status"].alias("year_like"), form["status"].alias("form"), loose["status"].alias("loose"))


@query(f"""WITH {MANIFEST_SQL} SELECT file_id, '2026-' || lpad(CAST(file_id % 12 + 1 AS VARCHAR), 2, '0') AS period, 'OK' AS status, CASE WHEN file_id % 5 IN (0, 2) THEN 0.9 ELSE 0.98 END AS confidence, '2069-12' AS pivot_low, '1970-01' AS pivot_high,
  '2026-07' AS named, 'INVALID_PERIOD' AS invalid, 'MULTIPLE_PERIOD_CANDIDATES' AS several, CASE WHEN file_id % 12 + 1 = 7 THEN 'OK' ELSE 'MULTIPLE_PERIOD_CANDIDATES' END AS path_status FROM m""")
def m6_document_period(spark, sf):
    out = metadata.document_period(c("filename"))
    of = lambda x: metadata.document_period(F.lit(x))
    return manifest(spark, sf).select(
        "file_id", out["value"].alias("period"), out["status"].alias("status"), out["confidence"].cast("double").alias("confidence"), of("31.12.69")["value"].alias("pivot_low"), of("01.01.70")["value"].alias("pivot_high"),
        of("КС-6а за июль месяц 2026 года")["value"].alias("named"), of("13.2026")["status"].alias("invalid"), of("июнь 2026 и 07.2026")["status"].alias("several"),
        metadata.path_period(F.concat(F.lit("июль 2026/"), c("filename")))["status"].alias("path_status"),
    )


@query(f"""WITH {MANIFEST_SQL}, x AS (SELECT *, file_id % 11 = 0 AS fin, file_id % 13 = 0 AS dr FROM m)
SELECT file_id, CASE WHEN file_id % 3 = 0 THEN CAST(file_id % 4 AS INTEGER) END AS number, CASE WHEN fin AND dr THEN 'CONFLICTING_VERSION_MARKERS' WHEN file_id % 3 = 0 OR fin OR dr THEN 'OK' ELSE 'REVISION_NOT_FOUND' END AS status,
  fin AS is_final, dr AS is_draft, CASE file_id % 5 WHEN 0 THEN 'ks2' WHEN 1 THEN 'ks6a' WHEN 2 THEN 'ks3' WHEN 3 THEN 'svvr' ELSE 'unknown' END AS document_type,
  file_id % 17 = 0 AS is_copy, dr AS is_outdated, CASE WHEN file_id % 19 = 0 THEN '.pdf' ELSE '.xlsx' END AS extension FROM x""")
def m7_revision_and_class(spark, sf):
    rev, kind = metadata.document_revision(c("filename")), metadata.file_class(c("filename"))
    return manifest(spark, sf).select("file_id", rev["number"].alias("number"), rev["status"].alias("status"), rev["is_final"].alias("is_final"), rev["is_draft"].alias("is_draft"), kind["document_type"].alias("document_type"), kind["is_probable_copy"].alias("is_copy"), kind["is_probably_outdated"].alias("is_outdated"), text.file_extension(c("filename")).alias("extension"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10000 BETWEEN 1900 AND 2099 THEN '0042' ELSE lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || CASE WHEN o_orderkey % 10000 = 42 THEN '' ELSE ',0042' END END AS candidates,
  CASE WHEN o_orderkey % 10000 BETWEEN 1900 AND 2099 OR o_orderkey % 10000 = 42 THEN '0042' END AS object_code FROM orders""")
def m10_object_candidates(spark, sf):
    found = metadata.object_candidates(F.concat(F.lit("x"), F.lpad((c("o_orderkey") % 10000).cast("string"), 4, "0"), F.lit("_0042_12345_2026")))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(found, ",").alias("candidates"), F.when(F.size(found) == 1, F.get(found, F.lit(0))).alias("object_code"))


@query("""SELECT p_partkey, sha256(concat(p_brand, chr(31), '', chr(31), p_type)) AS joined, sha256(p_brand || p_type) AS plain, sha256('["target","' || p_brand || '",' || p_size || ']') AS json,
  CAST(64 AS INTEGER) AS framed_length, true AS frames_differ, CASE WHEN p_size % 2 = 0 THEN '12' ELSE '1.5' END AS decimal_text FROM part""")
def m23_identities(spark, sf):
    frame = identity.framed_id(c("p_brand"), F.lit(None), c("p_type"))
    return table(spark, sf, "part").select(
        "p_partkey", identity.joined_id(c("p_brand"), F.lit(None), c("p_type")).alias("joined"), identity.plain_id(c("p_brand"), c("p_type")).alias("plain"), identity.json_id(F.lit("target"), c("p_brand"), c("p_size"), numbers=(2,)).alias("json"),
        F.length(frame).alias("framed_length"), (frame != identity.framed_id(F.concat(c("p_brand"), c("p_type")))).alias("frames_differ"),
        identity.plain_decimal(F.when(c("p_size") % 2 == 0, F.lit("12.000").cast("decimal(10,3)")).otherwise(F.lit("1.500").cast("decimal(10,3)"))).alias("decimal_text"),
    )


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, CAST(l_extendedprice AS DECIMAL(14,2)) AS v, CAST(round(CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * 2.7 AS DECIMAL(24,6)), 2) AS DECIMAL(20,6)) AS cents,
  CAST(round(CAST(l_extendedprice AS DECIMAL(14,2)) * 20, 0) / 20 AS DECIMAL(20,6)) AS twentieths, CAST(CAST(l_extendedprice AS DECIMAL(14,2)) / 1000000 AS DECIMAL(38,12)) AS millions FROM lineitem""")
def x1_rounding(spark, sf):
    v = c("l_extendedprice").cast("decimal(14,2)")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", v.alias("v"), numeric.round_to_quantum(v.cast("decimal(20,6)") * F.lit("2.7").cast("decimal(10,4)")).cast("decimal(20,6)").alias("cents"),
        numeric.round_to_quantum(v.cast("decimal(20,6)"), "0.05").alias("twentieths"), numeric.to_millions(v).alias("millions"),
    )
