"""Plug-ins, lifecycle, blocks of searches, and checks of sizes, on literal rows."""

import io
import random
import struct
import subprocess
import zipfile
import zlib
from difflib import SequenceMatcher

import pytest

from reckon.functions import rules
from reckon.operators import bounded, matching, mining, retrieval, rows, writing
from reckon.plans import lifecycle, plugins
from reckon.sources import cells, files, packages


def test_lifecycle_is_monotone_and_cancels(spark):
    seen = []
    run = lifecycle.Lifecycle("t1", seen.append)
    assert run.run(spark, "reading", lambda: spark.range(3).count()) == 3
    run.emit("matching", 1, 5)
    for bad in (lambda: run.emit("reading"), lambda: run.emit("matching", 6, 5), lambda: run.emit("matching", cause="x")):
        with pytest.raises(ValueError):
            bad()
    run.cancel(spark)
    with pytest.raises(lifecycle.Cancelled):
        run.emit("writing")
    assert run.emit("cancelled", cause="asked").cause == "asked" and [p.phase for p in seen] == ["reading", "matching", "cancelled"]
    assert all(a.updated_at <= b.updated_at for a, b in zip(seen, seen[1:]))
    with pytest.raises(ValueError):
        run.emit("cancelled")


def test_suggestions_are_never_applied(spark):
    rows_in = spark.createDataFrame([(str(i), f"text {i}", "m", ["e1", "e2"]) for i in range(5)], "row_id string, text string, unit string, evidence array<string>")

    def classify(row):
        n = row["text"][-1]
        if n == "4":
            raise TimeoutError
        return {"category": "other" if n == "1" else "cable", "evidence_ids": ["e9"] if n == "2" else ["e1"], "requires_confirmation": n != "3", "confidence": 0.9, "reason": "like e1"}

    got = {r.row_id: (r.status, r.category, r.reason) for r in plugins.suggestions(rows_in, classify, ("cable", "pipe")).collect()}
    assert got == {"0": ("needs_review", "cable", "like e1"), "1": ("rejected", None, "UNKNOWN_CATEGORY"), "2": ("rejected", None, "UNKNOWN_EVIDENCE"), "3": ("rejected", None, "SELF_CONFIRMED"), "4": ("rejected", None, "UNAVAILABLE:TimeoutError")}


def test_commands(spark):
    assert plugins.run_command(["echo", "a b"], 5).stdout == "a b\n"
    with pytest.raises(subprocess.TimeoutExpired):
        plugins.run_command(["sleep", "5"], 0.2)
    with pytest.raises(ValueError):
        plugins.run_command([], 1)
    files = spark.createDataFrame([("one",), ("two",), ("none",)], "path string")
    got = {r.path: (r.text, r.status) for r in plugins.recognised(files, lambda p: ["echo", p] if p == "one" else ["false"] if p == "two" else ["/no/such/command"], 5).collect()}
    assert got == {"one": ("one\n", "ok"), "two": (None, "failed"), "none": (None, "unavailable")}


def test_encoders_must_give_whole_vectors(spark):
    names = spark.createDataFrame([("a b",), ("a b",), (None,)], "name string")
    out = plugins.embedded(names, "name", plugins.hashed_encoder(4)).collect()
    assert len(out) == 3 and sum(r.vector is None for r in out) == 1 and {len(r.vector) for r in out if r.vector} == {4}
    with pytest.raises(Exception, match="width"):
        plugins.embedded(names, "name", plugins.Encoder(lambda t: [[1.0]] * len(t), "bad", "1", 2)).collect()


def test_configuration_has_a_bound(spark):
    with pytest.raises(ValueError, match="more than 3 rows"):
        bounded.sent(spark.range(4), "things", 3)
    assert bounded.sent(spark.range(3), "things", 3).count() == 3


def test_fuzzy_names_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(matching, "NAME_BLOCK", 7)
    rng = random.Random(2)
    names = ["".join(rng.choice("abcde ") for _ in range(rng.choice([1, 2, 5, 9, 10, 14, 40]))).strip() for _ in range(70)] + ["монтаж кабеля", "монтаж кабелей"]
    names += [n[:-1] + "z" for n in names[:20]]
    a, b = names, names[5:]
    frame = lambda x: spark.createDataFrame([(n,) for n in x] + [(None,), ("",)], "work_name string")
    want = set()
    for x in set(a) - {""}:
        for y in set(b) - {"", x}:
            same = sum(m.size for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
            if 2 * same / (len(x) + len(y)) >= 0.75 - 5e-7:
                want.add((x, y))
    got = matching.fuzzy_names(frame(a), frame(b)).collect()
    assert {(r.source_name, r.target_name) for r in got} == want and len(got) == len(want) > 5


def test_dense_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SHARD_ROWS", 16)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    rng = random.Random(1)
    vectors = [(i, [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(4)], "ab"[i % 2]) for i in range(60)] + [(70, [0.0] * 4, "a"), (71, None, "a"), (72, [1.0, None, 0.0, 0.0], "b"), (73, [1.0, 2.0], "a"), (74, [1.0] * 4, None)]
    e = spark.createDataFrame(vectors, "example_id long, vector array<double>, label string")
    q = e.filter("example_id % 5 = 0").withColumnRenamed("example_id", "query_id")
    unit = {i: [x / n for x in v] for i, v, _ in vectors if v and None not in v and (n := sum(x * x for x in v) ** 0.5)}
    label = {i: k for i, _, k in vectors}
    for context in (None, ["label"]):
        want = set()
        for i in (i for i in unit if i % 5 == 0 and not (context and label[i] is None)):
            near = sorted((-round(sum(a * b for a, b in zip(unit[i], v)), 9), j) for j, v in unit.items() if j != i and len(v) == len(unit[i]) and (not context or label[j] == label[i]))
            want |= {(i, r + 1, j) for r, (_, j) in enumerate(near[:3])}
        assert {(r.query_id, r["rank"], r.example_id) for r in retrieval.dense_top_k(q, e, 3, context).collect()} == want


def test_lexical_fillers(spark):
    """Examples that share no token still count by their bonus, the smallest ids first."""
    q = spark.createDataFrame([(1, "alpha beta", "m", "s"), (2, "", "m", None), (3, "alpha", None, "t")], "query_id long, text string, unit string, source_type string")
    e = spark.createDataFrame([(i, "alpha beta" if i == 9 else "gamma", "m" if i % 2 else "kg", "s" if i % 3 else "t") for i in range(12)], "example_id long, text string, unit string, source_type string")
    got = {}
    for r in retrieval.lexical_top_k(q, e, 3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.example_id, r.score))
    assert sorted(got[1]) == [(1, 9, 1.0), (2, 1, 0.12), (3, 5, 0.12)]
    assert sorted(got[2]) == [(1, 1, 0.08), (2, 3, 0.08), (3, 5, 0.08)]
    assert sorted(got[3]) == [(1, 9, 0.54), (2, 0, 0.04), (3, 3, 0.04)]


def test_near_variants_of_single_words(spark):
    words = ["abcdefgh", "abcdefgx", "abcdefg", "abcdefghi", "zzzzzzzzz", "q", "r", "abc", "a bcdefghij x", "a bcdefghix x", "one, two", "one two"]
    texts = spark.createDataFrame([(w,) for w in words], "text string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    bare = lambda t: "".join(c for c in t if c.isalnum() or c == "_")
    want = set()
    for a in words:
        for b in words:
            if a < b:
                x, y = a.split(), b.split()
                odd = [(u, v) for u, v in zip(x, y) if u != v]
                one = len(x) == len(y) and len(odd) == 1 and (min(map(len, odd[0])) == 1 or (min(map(len, odd[0])) >= 8 and distance(*odd[0]) <= 1))
                if bare(a) == bare(b) or one:
                    want.add((a, b))
    assert {(r.left, r.right) for r in mining.near_variants(texts).collect()} == want


def test_places_follow_the_order(spark):
    rng = random.Random(3)
    items = [(rng.randint(0, 5), rng.random(), i) for i in range(500)]
    got = {r.k: r.place for r in mining.queue_order(spark.createDataFrame(items, "a int, b double, k long"), ["a", "b"], "k").collect()}
    assert got == {k: n for n, (_, _, k) in enumerate(sorted(items, key=lambda x: (-x[0], -x[1], x[2])), 1)}


def test_rows_with_edge_cells(spark):
    cell = "array<" + rows.CELL + ">"
    made = spark.createDataFrame([("f", "b", "s", 1, None, None, []), (None, None, None, 0, None, None, [("name", "A1", "=B1", "x", "x", "CACHED_FORMULA_VALUE", "FORMULA_WITH_CACHED_VALUE", ["W"]), ("quantity", "B1", None, None, "nan", "ODD", "OK", None)])], f"source_file_id string, filename string, sheet string, row_number long, document_index string, document_period string, cells {cell}")
    out = {r.row_number: r for r in rows.form_rows(made, "svvr").collect()}
    assert out[1].status == "ERROR" and out[1].warnings == ["REQUIRED_VALUE_MISSING:work_name", "REQUIRED_VALUE_MISSING:current_period_quantity"]
    assert out[0].work_name == "x" and out[0].warnings[0] == "W" and out[0].status == "ERROR"
    found = {(r.row_id == "", r.code) for r in rows.row_issues(rows.form_rows(made, "svvr")).collect()}
    assert found == {(False, "SOURCE_LOCATION_INVALID"), (False, "VALUE_SOURCE_INVALID"), (False, "NON_FINITE_SOURCE_VALUE")}
    assert rows.training_chain(rows.form_rows(made.limit(0), "ks2")).count() == 0
    assert [r.row_id for r in rows.scan(spark.createDataFrame([("b", 1), ("a", 1), ("c", None)], "row_id string, k int"), {"k": 1}).collect()] == ["a", "b"]


def test_patches_conflict_and_rules_overlap(spark):
    patches = spark.createDataFrame([("f", "s", "A1", "1", 1), ("f", "s", "A1", "2", 2), ("f", "s", "B1", "1", 3), ("f", "s", "B1", "1", 4)], "file string, sheet string, coordinate string, value string, target_row_id long")
    assert [r.coordinate for r in writing.patch_conflicts(patches).collect()] == ["A1"]
    schema = "rule_id string, definition string, exclusive boolean, action string, match_kind string, literal string, object_scopes array<string>, stages array<string>"
    clauses = spark.createDataFrame([("a", "1", True, "include", "exact", "Pipe", [], ["x"]), ("b", "2", True, "include", "exact", "pipe", ["o"], ["x", "y"]), ("c", "3", True, "include", "exact", "pipe", ["o"], ["z"]), ("d", "4", False, "include", "exact", "pipe", [], []), ("a", "5", True, "exclude", "exact", "wire", [], [])], schema)
    assert sorted((r.kind, r.rule_ids) for r in rules.conflicts(clauses).collect()) == [("DUPLICATE_RULE_ID", ["a", "a"]), ("EXCLUSIVE_SCOPE_OVERLAP", ["a", "b"])]


def record(number, data):
    out = bytes([number]) if number < 128 else bytes([(number & 0x7F) | 0x80, number >> 7])
    size = len(data)
    while True:
        part, size = size & 0x7F, size >> 7
        out += bytes([part | (0x80 if size else 0)])
        if not size:
            return out + data


def wide(text):
    return struct.pack("<I", len(text)) + text.encode("utf-16-le")


def test_binary_workbooks(spark, tmp_path):
    at = lambda col: struct.pack("<II", col, 0)
    big = "x" * 300
    sheet = record(packages.ROW, struct.pack("<I", 0)) + record(packages.SHARED, at(0) + struct.pack("<I", 1)) + record(packages.RK, at(1) + struct.pack("<I", 1234 << 2 | 3)) + record(packages.RK, at(2) + struct.pack("<i", -7 << 2 | 2)) + record(packages.BLANK, at(3))
    sheet += record(packages.ROW, struct.pack("<I", 4)) + record(packages.F_REAL, at(0) + struct.pack("<d", 0.1) + b"tokens") + record(packages.ERROR, at(1) + b"\x17") + record(packages.BOOL, at(2) + b"\x01") + record(packages.TEXT, at(27) + wide(big)) + record(packages.REAL, at(5) + struct.pack("<d", 2.0))
    sheet += record(packages.MERGED, struct.pack("<4I", 0, 1, 0, 2))
    (half,) = struct.unpack("<Q", struct.pack("<d", 0.5))
    sheet += record(packages.ROW, struct.pack("<I", 9)) + record(packages.RK, at(0) + struct.pack("<I", half >> 32))
    with zipfile.ZipFile(tmp_path / "b.xlsb", "w") as z:
        z.writestr("xl/workbook.bin", record(packages.SHEET, struct.pack("<II", 0, 1) + wide("rId1") + wide("Лист")) + record(packages.SHEET, struct.pack("<II", 1, 2) + wide("rId2") + wide("hidden")))
        z.writestr("xl/_rels/workbook.bin.rels", '<R><a Id="rId1" Target="worksheets/sheet1.bin"/><a Id="rId2" Target="/xl/worksheets/sheet2.bin"/></R>')
        z.writestr("xl/sharedStrings.bin", record(packages.STRING, b"\0" + wide("zero")) + record(packages.STRING, b"\0" + wide("one")))
        z.writestr("xl/worksheets/sheet1.bin", sheet)
        z.writestr("xl/worksheets/sheet2.bin", b"")
    read = cells.read_cells(spark, str(tmp_path / "b.xlsb"))
    got = {(r.row, r.col): (r.formula, r.value, r.kind, r.merged) for r in read.collect()}
    assert got == {
        (1, 1): (None, "one", "text", "A1:C2"), (1, 2): (None, "12.34", "number", None), (1, 3): (None, "-7", "number", None), (1, 4): (None, None, "empty", None), (5, 1): ("=", "0.1", "number", None),
        (5, 2): (None, "#REF!", "error", None), (5, 3): (None, "1", "boolean", None), (5, 28): (None, big, "text", None), (5, 6): (None, "2", "number", None), (10, 1): (None, "0.5", "number", None),
    }
    meta = cells.sheet_metadata(read).first()
    assert (meta.sheet, meta.n_cells, meta.n_formulas, meta.n_errors, meta.first_row, meta.last_row, meta.last_col, meta.n_merged) == ("Лист", 9, 1, 1, 1, 10, 28, 1)
    assert {(r.row, r.col) for r in cells.read_cells(spark, str(tmp_path / "b.xlsb"), max_row=5, max_col=3).collect()} == {(1, 1), (1, 2), (1, 3), (5, 1), (5, 2), (5, 3)}


def test_open_documents(spark, tmp_path):
    names = " ".join(f'xmlns:{k}="urn:oasis:names:tc:opendocument:xmlns:{k}:1.0"' for k in ("office", "table", "text"))
    body = f'''<office:document-content {names}><office:body><office:spreadsheet><table:table table:name="S">
      <table:table-row table:number-rows-repeated="2"><table:table-cell table:number-columns-repeated="2"/><table:table-cell office:value-type="float" office:value="1.50" table:formula="of:=[.A1]+1"><text:p>1,5</text:p></table:table-cell></table:table-row>
      <table:table-row table:number-rows-repeated="1000000"><table:table-cell table:number-columns-repeated="500"/></table:table-row>
      <table:table-row><table:table-cell office:value-type="string" table:number-columns-spanned="2"><text:p>a</text:p><text:p>b</text:p></table:table-cell><table:covered-table-cell/><table:table-cell office:value-type="date" office:date-value="2026-01-02"/></table:table-row>
    </table:table></office:spreadsheet></office:body></office:document-content>'''
    with zipfile.ZipFile(tmp_path / "o.ods", "w") as z:
        z.writestr("content.xml", body)
    got = {(r.row, r.col): (r.formula, r.value, r.kind, r.merged) for r in cells.read_cells(spark, str(tmp_path / "o.ods")).collect()}
    assert got == {(1, 3): ("=[.A1]+1", "1.50", "number", None), (2, 3): ("=[.A1]+1", "1.50", "number", None), (1000003, 1): (None, "a\nb", "text", "A1000003:B1000003"), (1000003, 3): (None, "2026-01-02", "date", None)}


def test_materialized_copies(spark, tmp_path):
    body = b"some text " * 100
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("in/файл.txt", body)
    path = str(tmp_path / "a.zip")
    one = lambda **kw: files.materialized(spark, path, **kw).first()
    r = one(member="in/файл.txt", expected=(len(body), zlib.crc32(body)))
    assert (r.status, bytes(r.content), r.size_bytes, r.crc32) == ("ok", body, len(body), zlib.crc32(body))
    assert [one(member="in/файл.txt", expected=(1, None)).status, one(member="no").status, one(member="../x").status, one(member="in/файл.txt", most_bytes=10).status, one(most_bytes=10).status] == ["changed", "not_found", "unsafe", "too_large", "too_large"]
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    raw[raw.index(b"some text") + 3] ^= 1
    (tmp_path / "a.zip").write_bytes(bytes(raw))
    r = one(member="in/файл.txt")
    assert r.status == "damaged" and r.content is None and one().status == "ok" and io.BytesIO(bytes(one().content)).read() == bytes(raw)


def test_discrepancies_are_numbered_and_manifests_enriched(spark):
    violations = spark.createDataFrame([(2, "b", 1.0), (1, "a", 2.0), (1, "b", 3.0)], "object_index int, issue_code string, difference double")
    places = spark.createDataFrame([("f", 1, "C4", "D4"), ("f", 2, "C9", "D9")], "file string, object_index int, quantity_cell string, cost_cell string")
    got = [(r.line, r.object_index, r.issue_code, r.cost_cell) for r in writing.discrepancy_lines(violations, places, ["object_index"]).orderBy("line").collect()]
    assert got == [(1, 1, "a", "D4"), (2, 1, "b", "D4"), (3, 2, "b", "D9")]
    files_in = spark.createDataFrame([("1", "2026-01/КС-2 1005 (605) 01.2026 ред. 2.xlsx", "КС-2 1005 (605) 01.2026 ред. 2.xlsx"), ("2", "черновик.xlsx", "черновик.xlsx")], "file_id string, path string, filename string")
    one, two = rows.enriched_manifest(files_in).orderBy("file_id").collect()
    assert (one["index"].value, one.period.value, one.revision.number, one["class"].document_type, one.is_outdated_or_draft, one.needs_index) == ("1005 (605)", "2026-01", 2, "ks2", False, False)
    assert two.is_outdated_or_draft and two.needs_index
