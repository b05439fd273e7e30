"""Canonical rows: forms, cell lookup, validation, normalization, the training chain, and a lossless text codec.

A row carries its cells as an array of structs (CELL), so lookups by logical name are expressions inside one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reckon.functions import metadata, text
from reckon.functions.identity import framed_id, joined_id
from reckon.functions.numeric import parse_decimal
from reckon.operators import dedup, hierarchy

CELL = "struct<logical: string, coordinate: string, formula: string, cached: string, effective: string, source: string, status: string, warnings: array<string>>"
#: Canonical fields with the logical names that may fill them, in order.
TEXT_FIELDS = {
    "object_code": ("object_code",), "object_name": ("object_name", "object"), "subobject_code": ("subobject_code",), "subobject_name": ("subobject_name", "subobject"),
    "position_code": ("position_code", "position", "order", "row_number"), "work_name": ("work_name", "name"), "unit": ("unit",), "basis_code": ("basis_code",),
    "drawing_code": ("drawing_code",), "cost_type_code": ("cost_type_code",),
}
NUMBER_FIELDS = (
    "contract_quantity", "current_period_quantity", "cumulative_quantity", "remaining_quantity", "unit_price", "contract_cost", "current_period_cost", "cumulative_cost", "total_cost",
)
#: The numbers of each form with their logical names, and the fields that a row must have.
FORMS = {
    "ks2": ({"current_period_quantity": ("current_period_quantity", "quantity"), "unit_price": ("unit_price",), "current_period_cost": ("current_period_cost", "cost", "total_cost")}, ("work_name",)),
    "ks6a": ({n: {"current_period_quantity": (n, "quantity"), "current_period_cost": (n, "cost")}.get(n, (n,)) for n in NUMBER_FIELDS}, ("work_name",)),
    "svvr": ({n: {"current_period_quantity": (n, "quantity"), "current_period_cost": (n, "cost")}.get(n, (n,)) for n in NUMBER_FIELDS}, ("work_name", "current_period_quantity")),
}
#: Statuses that warn, where an effective value may come from, and statuses that mean an error.
PROBLEMS = ("FORMULA_WITHOUT_CACHED_VALUE", "EXCEL_ERROR", "UNSUPPORTED_VALUE_TYPE", "VALUE_READ_FAILED")
VALUE_SOURCES = ("LITERAL", "CACHED_FORMULA_VALUE", "FORMULA_WITHOUT_CACHE", "EMPTY", "EXCEL_ERROR", "VALUE_READ_FAILED")
ERRORS = ("EXCEL_ERROR", "VALUE_READ_FAILED")
NO_TEXTS = "array<string>"


def find_cell(cells: Column, *names: str) -> Column:
    """The first cell of the first of the names that a row has; null without one."""
    named = lambda name: F.filter(cells, lambda c: c["logical"] == name)
    return F.coalesce(*(F.get(named(n), F.lit(0)) for n in names))


def text_value(value: Column) -> Column:
    """struct(value, status) of a text cell: white space collapsed; empty is EMPTY."""
    plain = F.nullif(text.collapse(value), F.lit(""))
    return F.struct(plain.alias("value"), F.when(plain.isNull(), "EMPTY").otherwise("OK").alias("status"))


def _number(cell: Column) -> Column:
    return parse_decimal(cell["effective"])


def _cell_warnings(cell: Column, number: bool) -> Column:
    own = F.coalesce(cell["warnings"], F.array().cast(NO_TEXTS))
    if not number:
        return own
    parsed = _number(cell)
    bad = ~parsed["status"].isin("OK", "EMPTY")
    more = F.when(bad, F.array(F.concat_ws(":", cell["coordinate"], parsed["status"]), F.concat_ws(":", cell["coordinate"], parsed["warning"]))).otherwise(F.array().cast(NO_TEXTS))
    return F.concat(own, more)


def form_rows(rows: DataFrame, form: str) -> DataFrame:
    """Canonical rows of one form: identity, text and number fields (null where the form has none), status, warnings, cells.

    rows: source_file_id, filename, sheet, row_number, document_index, document_period, cells (array of CELL). A missing
    required value is ERROR, any warning PARTIAL, else OK.
    """
    numbers, required = FORMS[form]
    cells = F.col("cells")
    found = {name: find_cell(cells, *aliases) for name, aliases in {**TEXT_FIELDS, **numbers}.items()}
    cell = lambda name: F.col(f"_{name}")
    base = rows.select("*", *(c.alias(f"_{n}") for n, c in found.items()))
    values = {n: text_value(cell(n)["effective"])["value"] for n in TEXT_FIELDS} | {n: _number(cell(n))["value"] if n in numbers else F.lit(None).cast("decimal(38,18)") for n in NUMBER_FIELDS}
    each = [F.when(cell(n).isNotNull(), _cell_warnings(cell(n), n in numbers)).otherwise(F.array().cast(NO_TEXTS)) for n in found]
    problems = F.transform(F.filter(cells, lambda c: c["status"].isin(*PROBLEMS)), lambda c: F.concat_ws(":", c["coordinate"], c["status"]))
    raw = F.array_distinct(F.concat(*each, problems))
    gone = F.array_compact(F.array(*(F.when(F.col(n).isNull(), F.lit(f"REQUIRED_VALUE_MISSING:{n}")) for n in required)))
    out = base.select("source_file_id", "filename", "sheet", "row_number", "document_index", "document_period", *(v.alias(n) for n, v in values.items()), raw.alias("_raw"), "cells")
    status = F.when(F.size(gone) > 0, "ERROR").when(F.size("_raw") > 0, "PARTIAL").otherwise("OK")
    row_id = joined_id(F.col("source_file_id"), F.col("sheet"), F.col("row_number"))
    return out.select(row_id.alias("row_id"), F.lit(form).alias("source_type"), *[c for c in out.columns if c not in ("_raw", "cells")], status.alias("status"), F.array_distinct(F.concat("_raw", gone)).alias("warnings"), "cells")


def row_issues(rows: DataFrame) -> DataFrame:
    """(row_id, code, severity, coordinate) of what is wrong with canonical rows, cell by cell."""
    issue = lambda when, code, severity="error", at=None: F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), (at if at is not None else F.lit(None).cast("string")).alias("coordinate")))
    c = F.col
    of_row = [
        issue(c("row_id").isNull() | (c("row_id") == ""), "ROW_ID_MISSING"),
        issue((c("row_number") < 1) | (F.coalesce("sheet", F.lit("")) == "") | (F.coalesce("source_file_id", F.lit("")) == ""), "SOURCE_LOCATION_INVALID"),
    ]
    required = F.array(F.lit("work_name"), F.lit("name"), *(F.when(c("source_type") == "svvr", F.lit(n)) for n in ("current_period_quantity", "quantity")))

    def of_cell(x: Column) -> Column:
        status, at, formula = x["status"], x["coordinate"], x["formula"]
        empty, is_error = status == "EMPTY", status.isin(*ERRORS)
        return F.array(
            issue(~x["source"].isin(*VALUE_SOURCES), "VALUE_SOURCE_INVALID", at=at), issue(empty & x["effective"].isNotNull(), "EMPTY_VALUE_CONTRADICTION", at=at),
            issue((x["source"] == "EXCEL_ERROR") != (status == "EXCEL_ERROR"), "ERROR_STATUS_CONTRADICTION", at=at),
            issue(formula.isNotNull() & ~formula.startswith("="), "FORMULA_RAW_VALUE_INVALID", at=at),
            issue(formula.isNotNull() & ((x["source"] == "CACHED_FORMULA_VALUE") != (x["cached"].isNotNull() & ~is_error)), "CACHED_VALUE_FLAG_MISMATCH", at=at),
            issue(F.lower(x["effective"]).isin("nan", "inf", "infinity", "-inf", "-infinity"), "NON_FINITE_SOURCE_VALUE", at=at),
            issue(status == "VALUE_READ_FAILED", "VALUE_READ_FAILED", at=at), issue(status == "EXCEL_ERROR", "EXCEL_ERROR", "warning", at), issue(status == "FORMULA_WITHOUT_CACHED_VALUE", "FORMULA_WITHOUT_CACHED_VALUE", "warning", at),
            issue(status == "UNSUPPORTED_VALUE_TYPE", "UNSUPPORTED_VALUE_TYPE", "warning", at), issue(F.array_contains(required, x["logical"]) & (status == "VALUE_READ_FAILED"), "REQUIRED_CELL_READ_FAILED", at=at),
        )

    every = F.array_compact(F.concat(F.array(*of_row), F.flatten(F.transform("cells", of_cell))))
    return rows.select("row_id", F.explode(every).alias("i")).select("row_id", "i.*")


def encoded(rows: DataFrame) -> DataFrame:
    """(row_id, payload): each row as JSON; decimals as texts, so that nothing is lost. Null fields stay."""
    fields = [F.col(n).cast("string").alias(n) if kind.startswith("decimal") else F.col(n) for n, kind in rows.dtypes]
    return rows.select("row_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("payload"))


def decoded(payloads: DataFrame, like: DataFrame) -> DataFrame:
    """Rows with the columns and types of `like` from `encoded` payloads."""
    schema = ", ".join(f"`{n}` {'string' if kind.startswith('decimal') else kind}" for n, kind in like.dtypes)
    out = payloads.select(F.from_json("payload", schema).alias("p")).select("p.*")
    return out.select(*(F.col(n).cast(kind).alias(n) if kind.startswith("decimal") else F.col(n) for n, kind in like.dtypes))


CODES = ("object_code", "subobject_code", "position_code", "cost_type_code", "drawing_code", "basis_code")
#: Parts of a business key, in the order in which they are hashed.
KEY = ("document_type", "document_period", *CODES, "work_name", "unit")


def normalized(rows: DataFrame, typos: dict[str, str] | None = None) -> DataFrame:
    """rows with the normalized business key, the tokens of name, codes and unit, and line_id; no row goes.

    rows: source_type, document_period, CODES, work_name, unit. All other columns stay; the key's columns are replaced.
    """
    made = {"document_type": F.coalesce(text.normalize_text(F.col("source_type")), F.lit("")), "document_period": text.normalize_code(F.col("document_period"), typos), **{n: text.normalize_code(F.col(n), typos) for n in CODES}}
    made |= {"work_name": text.replace_exact(text.normalize_text(F.col("work_name")), typos), "unit": text.normalize_unit(F.col("unit"), typos)}
    out = rows.select(*[n for n in rows.columns if n not in made], *(v.alias(n) for n, v in made.items()))
    tokens = F.concat(*(text.stable_tokens(F.col(n)) for n in CODES))
    return out.select("*", text.stable_tokens(F.col("work_name")).alias("work_name_tokens"), tokens.alias("code_tokens"), text.stable_tokens(F.col("unit")).alias("unit_tokens"), framed_id(*(F.col(n) for n in KEY)).alias("line_id"))


def assessed(rows: DataFrame) -> DataFrame:
    """Canonical rows with is_total, is_outdated, is_detail and formula_error."""
    name = text.normalize_text(F.col("work_name"))
    total = metadata.is_total_row(F.coalesce(name, F.lit("")))
    evidence = F.coalesce(*(F.nullif(F.trim(F.col(n)), F.lit("")) for n in ("position_code", "basis_code", "drawing_code", "unit")), *(F.col(n).cast("string") for n in NUMBER_FIELDS))
    statuses = F.transform("cells", lambda c: c["status"])
    broken = F.when(F.array_contains(statuses, "VALUE_READ_FAILED"), "VALUE_READ_FAILED").when(F.array_contains(statuses, "EXCEL_ERROR"), "EXCEL_ERROR").when(F.array_contains(statuses, "FORMULA_WITHOUT_CACHED_VALUE"), "FORMULA_WITHOUT_CACHE").otherwise("NONE")
    old = metadata.is_outdated(F.coalesce(text.normalize_text(F.col("sheet")), F.lit("")), F.coalesce(text.normalize_text(F.col("filename")), F.lit("")))
    return rows.select("*", total.alias("is_total"), old.alias("is_outdated"), (~total & name.isNotNull() & evidence.isNotNull()).alias("is_detail"), broken.alias("formula_error"))


def training_chain(rows: DataFrame, non_detail: bool = False, outdated: bool = False, broken: bool = False) -> DataFrame:
    """Every canonical row with the stage that it leaves at (left_at; null if it stays), final_line_id and is_collision.

    Stages: hierarchy (parents and resource details), non_detail, outdated, formula_error (read failures and Excel errors),
    duplicate (a line id with a content seen before, in the order of row ids). A new content of a known line id stays
    under an id of its own. The flags keep what a stage would drop.
    """
    context = F.concat_ws("\u001f", *(F.coalesce(F.col(n), F.lit("")) for n in ("source_file_id", "sheet", "document_period", "document_index", "object_code", "subobject_code")))
    entries = rows.select("row_id", context.alias("context"), "position_code", F.col("current_period_cost").alias("amount"), F.lit(False).alias("is_transactional"))
    roles = hierarchy.frontier(entries).filter("role <> 'leaf'").select("row_id", "role").distinct()
    marked = assessed(rows).join(roles, "row_id", "left")
    stage = (
        F.when(F.col("role").isNotNull(), "hierarchy").when(~F.col("is_detail") & F.lit(not non_detail), "non_detail").when(F.col("is_outdated") & F.lit(not outdated), "outdated")
        .when(F.col("formula_error").isin("EXCEL_ERROR", "VALUE_READ_FAILED") & F.lit(not broken), "formula_error")
    )
    marked = marked.withColumn("left_at", stage)
    line = framed_id(*(F.col(n) for n in ("source_file_id", "source_type", "document_period", *CODES, "unit", "work_name")))
    content = F.xxhash64(*(F.col(n) for n in ("source_type", "document_period", *TEXT_FIELDS, *NUMBER_FIELDS, "formula_error")))
    open_rows = marked.filter("left_at is null").withColumn("line_id", line).withColumn("signature", content)
    kept = dedup.line_ids(open_rows).select("row_id", "final_line_id", "is_collision")
    out = marked.join(kept, "row_id", "left")
    return out.withColumn("left_at", F.coalesce("left_at", F.when(F.col("final_line_id").isNull(), "duplicate"))).withColumn("is_collision", F.coalesce("is_collision", F.lit(False)))


def chain_counts(chain: DataFrame) -> DataFrame:
    """One row: rows in, left at each stage, collisions, and rows out."""
    at = lambda name: F.count_if(F.col("left_at") == name)
    return chain.agg(
        F.count("*").alias("input_rows"), at("hierarchy").alias("excluded_hierarchy"), at("non_detail").alias("skipped_non_detail"), at("outdated").alias("skipped_outdated"),
        at("formula_error").alias("skipped_formula_errors"), at("duplicate").alias("exact_duplicates"), F.count_if("is_collision").alias("collisions"), F.count_if(F.col("left_at").isNull()).alias("output_rows"),
    )


def target_rows(cells: DataFrame, bindings: DataFrame, trusted: bool = True) -> DataFrame:
    """Rows of a target report: kind, scope, texts, numbers with cache state and status, writable.

    cells: file, sheet, row, col, formula, value, lexeme, cell_type. bindings: file, sheet, logical, col, data_row. Numbers come
    from the raw lexeme only. A row with a row number is OBJECT_PROCESS, others SUMMARY; it is writable if caches are trusted.
    """
    bound = cells.join(bindings, ["file", "sheet", "col"]).filter("row >= data_row")
    numeric = F.coalesce(F.col("cell_type"), F.lit("n")) == "n"
    number = F.when(numeric, F.col("lexeme").try_cast("decimal(38,18)"))
    cache = F.when(F.col("formula").isNull(), "NOT_FORMULA").when(~F.lit(trusted), "CACHE_UNTRUSTED").when(F.col("value").isNotNull(), "FORMULA_WITH_CACHED_VALUE").otherwise("FORMULA_WITHOUT_CACHED_VALUE")
    status = F.when(numeric & F.col("lexeme").isNotNull() & number.isNull(), "INVALID_NUMERIC_LEXEME").otherwise("OK")
    cell = F.struct(F.coalesce("formula", "value").alias("raw"), number.alias("number"), F.col("lexeme").alias("lexeme"), cache.alias("cache_state"), status.alias("status"))
    of = lambda name: F.max(F.when(F.col("logical") == name, cell))
    texts = ("row_number", "object_code", "object_name", "subobject_code", "subobject_name", "position_code", "work_name", "unit", "document_index", "stage")
    numbers = {"document_quantity": "cumulative_quantity", "selected_quantity": "current_period_quantity", "document_cost": "cumulative_cost", "selected_cost": "current_period_cost"}
    grouped = bound.groupBy("file", "sheet", "row").agg(F.count_if(F.coalesce("formula", "value").isNotNull()).alias("_n"), *(of(n).alias(f"_{n}") for n in texts), *(of(v).alias(k) for k, v in numbers.items()))
    kind = F.when(F.col("_row_number.raw").isNotNull(), "OBJECT_PROCESS").otherwise("SUMMARY")
    plain = [text_value(F.col(f"_{n}.raw"))["value"].alias(n) for n in texts if n != "row_number"]
    scope = F.when(F.col("_stage.raw").isNotNull(), "SELECTED_STAGE").otherwise("UNSCOPED")
    return grouped.filter("_n > 0").select("file", "sheet", "row", kind.alias("row_kind"), scope.alias("scope"), *plain, *numbers, ((kind == "OBJECT_PROCESS") & F.lit(trusted)).alias("writable"))


def enriched_manifest(files: DataFrame) -> DataFrame:
    """A manifest (file_id, path, filename) with document index, period, revision, class, and the OR of status flags."""
    index, period = metadata.document_index(F.col("filename")), metadata.path_period(F.col("path"))
    out = files.select("*", index.alias("index"), period.alias("period"), metadata.document_revision(F.col("filename")).alias("revision"), metadata.file_class(F.col("filename")).alias("class"))
    draft = F.col("revision.is_draft") | F.col("class.is_probably_outdated")
    return out.select("*", draft.alias("is_outdated_or_draft"), (F.col("index.status") != "OK").alias("needs_index"))


def scan(rows: DataFrame, equal: dict[str, object] | None = None, limit: int | None = None) -> DataFrame:
    """Stored rows that equal the given values (None is null), in the order of row_id, as many as asked for."""
    for name, value in (equal or {}).items():
        rows = rows.filter(F.col(name).eqNullSafe(F.lit(value)))
    rows = rows.orderBy("row_id")
    return rows if limit is None else rows.limit(limit)


def header_runs(rows: DataFrame) -> DataFrame:
    """rows (file, sheet, row) with the length of the run of consecutive rows that each lies in."""
    w = Window.partitionBy("file", "sheet").orderBy("row")
    island = F.col("row") - F.row_number().over(w)
    return rows.withColumn("_i", island).withColumn("run", F.count("*").over(Window.partitionBy("file", "sheet", "_i"))).drop("_i")
