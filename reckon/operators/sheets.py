"""From cells to rows: statuses, scan windows, headers, columns, sheet types, boundaries, carried values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reckon.functions.text import normalize_header, position_segments
from reckon.operators.bounded import sent

#: Bounds of a scan; empty rows that end one, and a data area; rows read at most.
SCAN_ROWS, SCAN_COLUMNS, SCAN_CELLS, SCAN_EMPTY = 60, 120, 5000, 15
DATA_EMPTY, MOST_ROWS = 20, 200_000
#: Words that mark a missing carried index.
RESET = ("-", "—", "нет")
MONTH = r"(?iU)\b(?:январ|феврал|март|апрел|ма[йя]|июн|июл|август|сентябр|октябр|ноябр|декабр)\w*\b|\b20[0-9]{2}\b"

SHEET = ["file", "sheet"]


def cell_value(formula: Column, value: Column, kind: Column) -> Column:
    """struct(effective, status, source, warning) of a cell with its formula and cached (or literal) value."""
    error = kind == "error"
    has_formula = formula.isNotNull()
    status = (
        F.when(error, "EXCEL_ERROR").when(has_formula & value.isNotNull(), "FORMULA_WITH_CACHED_VALUE").when(has_formula, "FORMULA_WITHOUT_CACHED_VALUE")
        .when(value.isNull(), "EMPTY").when(~kind.isin("number", "text", "boolean", "date"), "UNSUPPORTED_VALUE_TYPE").otherwise("OK")
    )
    source = F.when(status == "OK", "LITERAL").when(status == "FORMULA_WITH_CACHED_VALUE", "CACHED_FORMULA_VALUE").when(status == "FORMULA_WITHOUT_CACHED_VALUE", "FORMULA_WITHOUT_CACHE").when(status == "UNSUPPORTED_VALUE_TYPE", "LITERAL").otherwise(status)
    warning = F.when(error, "EXCEL_ERROR_VALUE").when(status.isin("FORMULA_WITHOUT_CACHED_VALUE", "UNSUPPORTED_VALUE_TYPE"), status)
    return F.struct(F.when(~status.isin("EXCEL_ERROR", "EMPTY", "FORMULA_WITHOUT_CACHED_VALUE"), value).alias("effective"), status.alias("status"), source.alias("source"), warning.alias("warning"))


def until_empty(cells: DataFrame, limit: int = DATA_EMPTY, first_row: int = 1, by: list[str] = SHEET) -> DataFrame:
    """Cells before the first run of `limit` empty rows (rows without cells), counted from first_row."""
    rows = cells.filter(F.col("row") >= first_row).select(*by, "row").distinct()
    w = Window.partitionBy(*by).orderBy("row")
    gap = F.col("row") - F.coalesce(F.lag("row").over(w), F.lit(first_row - 1)) - 1
    stop = rows.withColumn("gap", gap).filter(F.col("gap") >= limit).groupBy(*by).agg(F.min("row").alias("_stop"))
    return cells.filter(F.col("row") >= first_row).join(stop, by, "left").filter("_stop is null or row < _stop").drop("_stop")


def scan_window(cells: DataFrame, rows: int = SCAN_ROWS, columns: int = SCAN_COLUMNS, most: int = SCAN_CELLS, empty: int = SCAN_EMPTY) -> DataFrame:
    """The head of every sheet: bounded rows and columns, ended by empty rows, and at most `most` cells in row order."""
    few = until_empty(cells.filter((F.col("row") <= rows) & (F.col("col") <= columns)), empty)
    return few.withColumn("_n", F.row_number().over(Window.partitionBy(*SHEET).orderBy("row", "col"))).filter(F.col("_n") <= most).drop("_n")


def spread_merged(cells: DataFrame) -> DataFrame:
    """Cells with every merged range's anchor value at each of its places (other cells win)."""
    corner = lambda part: F.regexp_extract(F.substring_index("merged", ":", part), "([A-Z]+)", 1)
    number = lambda letters: F.aggregate(F.split(letters, ""), F.lit(0), lambda a, ch: a * 26 + F.ascii(ch) - 64)
    line = lambda part: F.regexp_extract(F.substring_index("merged", ":", part), "([0-9]+)", 1).cast("int")
    wide = cells.filter("merged is not null").select(*SHEET, "value", "kind", F.explode(F.sequence(line(1), line(-1))).alias("row"), number(corner(1)).alias("a"), number(corner(-1)).alias("b"))
    wide = wide.select(*SHEET, "row", F.explode(F.sequence("a", "b")).alias("col"), F.col("value").alias("mv"), F.col("kind").alias("mk"))
    out = cells.join(wide, [*SHEET, "row", "col"], "full_outer")
    return out.withColumn("value", F.coalesce("value", "mv")).withColumn("kind", F.coalesce("kind", "mk")).drop("mv", "mk")


def composed_headers(cells: DataFrame, bands: DataFrame) -> DataFrame:
    """One header per column of a band (file, sheet, start_row, end_row): stacked distinct texts joined by spaces."""
    spread = spread_merged(cells).filter("kind = 'text' and value is not null")
    rows = spread.join(bands, SHEET).filter("row between start_row and end_row")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("row", "value"))), lambda x: F.trim(x["value"]))
    joined = F.array_join(F.array_distinct(F.filter(parts, lambda x: (x != "") & ~x.rlike(r"^[0-9]+(\.[0-9]+)?$"))), " ")
    return rows.groupBy(*SHEET, "start_row", "end_row", "col").agg(joined.alias("header")).withColumn("normalized", normalize_header(F.col("header"))).filter("normalized <> ''")


def header_bands(cells: DataFrame, aliases: tuple[str, ...], depth: int = 4, most_start: int = 40, least_columns: int = 3) -> DataFrame:
    """Candidate header bands of every sheet with score and rank (score, alias hits, first row, last row).

    A band of 1 to `depth` rows scores by its headers, the known phrases they hold, its share of texts, and whether data
    follow it; bands of mostly numbers are marked down.
    """
    per_row = cells.groupBy(*SHEET, "row").agg(F.count_if(F.col("kind") == "number").alias("numbers"), F.count_if((F.col("kind") == "text") & F.col("formula").isNull()).alias("texts"))
    starts = per_row.filter(F.col("row") <= most_start).select(*SHEET, F.col("row").alias("start_row"))
    bands = starts.select("*", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("d")).select(*SHEET, "start_row", (F.col("start_row") + F.col("d")).alias("end_row"))
    bands = bands.join(per_row.select(*SHEET, F.col("row").alias("end_row")), [*SHEET, "end_row"], "left_semi")
    inside = bands.join(per_row, SHEET).filter("row between start_row and end_row").groupBy(*SHEET, "start_row", "end_row").agg(F.sum("numbers").alias("numbers"), F.sum("texts").alias("texts"))
    after = bands.join(per_row, SHEET).filter("row between end_row + 1 and end_row + 3").groupBy(*SHEET, "start_row", "end_row").agg(F.min_by(F.struct("numbers", "texts"), "row").alias("next"))
    heads = composed_headers(cells, bands).groupBy(*SHEET, "start_row", "end_row").agg(F.count("*").alias("n_headers"), F.array_join(F.array_sort(F.collect_list("normalized")), " | ").alias("corpus"))
    rows = heads.join(inside, [*SHEET, "start_row", "end_row"]).join(after, [*SHEET, "start_row", "end_row"], "left").filter(F.col("n_headers") >= least_columns)
    hits = sum((F.when(F.col("corpus").contains(a), 1).otherwise(0) for a in aliases), F.lit(0))
    share = F.col("texts") / F.greatest(F.col("texts") + F.col("numbers"), F.lit(1))
    follow = F.when((F.col("next.numbers") > 0) & (F.col("next.texts") > 0), 1.0).when(F.col("next.numbers") >= 2, 0.65).when(F.col("next.texts") >= 2, 0.35).otherwise(0.0)
    score = 0.08 + F.least(F.col("n_headers") / 10, F.lit(0.24)) + F.least(hits / 7, F.lit(0.36)) + share * 0.16 + follow * 0.12 - F.when(share < 0.5, 0.18).otherwise(0.0)
    out = rows.withColumn("alias_hits", hits).withColumn("score", F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 4))
    w = Window.partitionBy(*SHEET).orderBy(F.desc("score"), F.desc("alias_hits"), "start_row", "end_row")
    return out.withColumn("rank", F.row_number().over(w)).drop("next")


def token_in(text: Column, token: Column) -> Column:
    """A phrase anywhere; a word of 4 or more letters as the start of a word; a shorter one as a word."""
    words = F.split(text, " ")
    return F.when(token.contains(" "), text.contains(token)).when(F.length(token) >= 4, F.exists(words, lambda w: w.startswith(token))).otherwise(F.array_contains(words, token))


def resolve_columns(headers: DataFrame, rules: DataFrame, context: tuple[str, ...] = ()) -> DataFrame:
    """One row per sheet and logical column: col, confidence, status (OK, COLUMN_NOT_FOUND, AMBIGUOUS_COLUMN).

    rules: logical, exact, required, optional, forbidden (arrays of normalized texts), priority; all of them count, and ValueError beyond bounded.MOST_ROWS. An exact
    alias scores 1; else all required words must be there, and optional ones, priority and forbidden words decide. The
    best must reach 0.64; another column within 0.045 of it is a tie; two logical columns on one physical column keep the
    better if it leads by 0.08, else neither.
    """
    pairs = headers.join(sent(rules, "column rules"), F.lit(True))
    text = F.col("normalized")
    count = lambda name: F.size(F.filter(name, lambda t: token_in(text, t)))
    exact = F.array_contains("exact", text)
    optional = count("optional")
    need = F.col("logical").isin(*context) if context else F.lit(False)
    loose = 0.58 + F.coalesce(F.try_divide(optional, F.size("optional")), F.lit(0.0)) * 0.25 + F.least(F.col("priority") / 1000, F.lit(0.1)) - F.when(need & (optional == 0), 0.24).otherwise(0.0)
    score = F.when(exact, 1.0).when(count("required") == F.size("required"), loose)
    lost = count("forbidden")
    score = score - F.when(lost > 0, F.least(0.20 + lost * 0.16, F.lit(0.62))).otherwise(0.0)
    scored = pairs.select(*SHEET, "logical", "col", "priority", F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 4).alias("s")).filter("s >= 0.45")
    best = Window.partitionBy(*SHEET, "logical").orderBy(F.desc("s"), "col", F.desc("priority"))
    top = scored.withColumn("n", F.row_number().over(best)).withColumn("t", F.first(F.struct("s", "col")).over(best))
    one = top.groupBy(*SHEET, "logical").agg(
        F.max("t").alias("t"), F.bool_or((F.col("col") != F.col("t.col")) & (F.col("t.s") - F.col("s") <= 0.045 + 1e-9) & (F.col("s") >= 0.72)).alias("tie")
    )
    status = F.when(F.col("t.s") < 0.64, "COLUMN_NOT_FOUND").when(F.col("tie"), "AMBIGUOUS_COLUMN").otherwise("OK")
    found = one.select(*SHEET, "logical", F.col("t.col").alias("col"), F.col("t.s").alias("confidence"), status.alias("status"))
    every = headers.select(*SHEET).distinct().join(sent(rules.select("logical").distinct(), "logical columns"), F.lit(True))
    out = every.join(found, [*SHEET, "logical"], "left").withColumn("status", F.coalesce("status", F.lit("COLUMN_NOT_FOUND"))).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    same = Window.partitionBy(*SHEET, F.when(F.col("status") == "OK", F.col("col").cast("string")).otherwise(F.concat(F.lit("-"), "logical")))
    ranked = out.withColumn("_k", F.count("*").over(same)).withColumn("_r", F.row_number().over(same.orderBy(F.desc("confidence"), "logical"))).withColumn("_m", F.max("confidence").over(same)).withColumn("_2", F.max(F.when(F.col("_r") == 2, F.col("confidence"))).over(same))
    clear = (F.col("_r") == 1) & (F.col("_m") - F.col("_2") >= 0.08)
    ok = (F.col("status") == "OK") & ((F.col("_k") == 1) | clear)
    return ranked.select(*SHEET, "logical", F.when(ok, F.col("col")).alias("col"), "confidence", F.when((F.col("status") == "OK") & ~ok, "AMBIGUOUS_COLUMN").otherwise(F.col("status")).alias("status"))


def apply_overrides(columns: DataFrame, overrides: DataFrame) -> DataFrame:
    """Bindings that a user gave (file, sheet, logical, col) win over detected ones."""
    given = overrides.select(*SHEET, "logical", F.col("col").alias("_col"))
    out = columns.join(given, [*SHEET, "logical"], "left")
    return out.withColumn("status", F.when(F.col("_col").isNotNull(), "OK").otherwise(F.col("status"))).withColumn("confidence", F.when(F.col("_col").isNotNull(), 1.0).otherwise(F.col("confidence"))).withColumn("col", F.coalesce("_col", "col")).drop("_col")


def position_column(cells: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(file, sheet, col) of the one column whose content is a numbering hierarchy: 4 codes, 2 ancestor pairs, a clear lead.

    Equal codes of a column are counted first; a pair of codes stands for as many ancestor pairs as the product of the counts.
    """
    codes = cells.withColumn("seg", position_segments(F.col("value"))).filter("seg is not null").select(*SHEET, "col", "row", "seg")
    if excluded is not None:
        codes = codes.join(excluded, [*SHEET, "col"], "left_anti")
    codes = codes.groupBy(*SHEET, "col", "seg").agg(F.count("*").alias("n"))
    n = codes.groupBy(*SHEET, "col").agg(F.sum("n").alias("n"))
    above = codes.filter(F.size("seg") > 1).select(*SHEET, "col", F.explode(F.transform(F.sequence(F.lit(1), F.size("seg") - 1), lambda k: F.slice("seg", F.lit(1), k))).alias("seg"), F.col("n").alias("below"))
    above = above.groupBy(*SHEET, "col", "seg").agg(F.sum("below").alias("below"))
    pairs = above.join(codes, [*SHEET, "col", "seg"]).groupBy(*SHEET, "col").agg(F.sum(F.col("below") * F.col("n")).alias("p"))
    scored = n.join(pairs, [*SHEET, "col"]).filter("n >= 4 and p >= 2").withColumn("s", F.col("n") + 3 * F.col("p"))
    r = F.rank().over(Window.partitionBy(*SHEET).orderBy(F.desc("s")))
    return scored.withColumn("r", r).filter("r = 1").groupBy(*SHEET).agg(F.count("*").alias("k"), F.min("col").alias("col")).filter("k = 1").drop("k")


def classify_sheets(sheets: DataFrame, name_rules: DataFrame, signatures: DataFrame) -> DataFrame:
    """One row per sheet: sheet_type, confidence, status.

    sheets: file, sheet, name (normalized), corpus (normalized texts joined by ' | '). name_rules: sheet_type, pattern,
    score. signatures: sheet_type, strong, weak, negative (arrays), min_score. Both scores: 0.45 name + 0.55 content; one
    alone: 0.85 or 0.90 of it. Strong but different tops are a conflict; under 0.28 the type is unknown.
    """
    key = SHEET
    names = sheets.join(sent(name_rules, "name rules"), F.regexp_like("name", F.col("pattern"))).groupBy(*key, "sheet_type").agg(F.max("score").alias("ns"))
    count = lambda c: F.size(F.filter(c, lambda m: F.col("corpus").contains(m)))
    raw = F.least(count("strong") * 0.34, F.lit(0.68)) + F.least(count("weak") * 0.08, F.lit(0.32)) - F.least(count("negative") * 0.18, F.lit(0.45))
    score = F.round(F.least(F.greatest(F.when(count("strong") == 0, F.least(raw, F.lit(0.58))).otherwise(raw), F.lit(0.0)), F.lit(1.0)), 4)
    content = sheets.join(sent(signatures, "sheet signatures"), F.lit(True)).select(*key, "sheet_type", score.alias("cs"), "min_score").filter(F.col("cs") >= F.greatest(F.col("min_score") * 0.55, F.lit(0.12))).drop("min_score")
    both = names.join(content, [*key, "sheet_type"], "full_outer")
    total = F.round(F.when(F.col("ns").isNotNull() & F.col("cs").isNotNull(), 0.45 * F.col("ns") + 0.55 * F.col("cs")).when(F.col("ns").isNotNull(), 0.85 * F.col("ns")).otherwise(0.90 * F.col("cs")), 4)
    both = both.withColumn("t", total)
    order = lambda c: F.struct(F.coalesce(-F.col(c), F.lit(9.0)), "sheet_type")
    top = both.groupBy(*key).agg(F.min_by(F.struct("sheet_type", F.col("t").alias("s")), order("t")).alias("a"), F.min_by(F.struct("sheet_type", F.col("ns").alias("s")), order("ns")).alias("n"), F.min_by(F.struct("sheet_type", F.col("cs").alias("s")), order("cs")).alias("c"))
    out = sheets.select(*key).join(top, key, "left")
    conflict = F.coalesce((F.col("n.sheet_type") != F.col("c.sheet_type")) & (F.col("n.s") >= 0.72) & (F.col("c.s") >= 0.62), F.lit(False))
    known = F.coalesce(F.col("a.s") >= 0.28, F.lit(False))
    status = F.when(~known, "UNKNOWN_SHEET_TYPE").when(conflict, "AMBIGUOUS_SHEET_TYPE").when(F.col("a.s") < 0.55, "LOW_CONFIDENCE_SHEET_TYPE").otherwise("OK")
    sure = F.when(known & conflict, F.greatest("n.s", "c.s")).otherwise(F.coalesce("a.s", F.lit(0.0)))
    return out.select(*key, F.when(known, F.col("a.sheet_type")).otherwise("unknown").alias("sheet_type"), sure.alias("confidence"), status.alias("status"))


def data_start(cells: DataFrame, header_end: DataFrame, gap: int = 3) -> DataFrame:
    """(file, sheet, data_row): the first row after the header with a number and a text, or two texts of which one has digits.

    Rows of small counting numbers alone are numbering; more than `gap` empty rows end the search.
    """
    text = F.col("kind") == "text"
    small = F.coalesce(F.col("value").try_cast("double").between(0, 500), F.lit(False))
    rows = cells.join(header_end, SHEET).filter(F.col("row").between(F.col("end_row") + 1, F.col("end_row") + gap + 5)).groupBy(*SHEET, "row", "end_row").agg(
        F.count_if(F.col("kind") == "number").alias("numbers"), F.count_if(text & (F.trim("value") != "")).alias("texts"), F.count_if(text & F.col("value").rlike("[0-9]")).alias("coded"), F.bool_and(small).alias("numbering"), F.count("*").alias("n")
    )
    is_data = ~(F.col("numbering") & (F.col("n") >= 2)) & (((F.col("numbers") > 0) & (F.col("texts") > 0)) | ((F.col("texts") >= 2) & (F.col("coded") > 0)))
    empty_before = F.col("row") - F.col("end_row") - F.row_number().over(Window.partitionBy(*SHEET).orderBy("row"))
    return rows.withColumn("_e", empty_before).filter(is_data & (F.col("_e") <= gap)).groupBy(*SHEET).agg(F.min("row").alias("data_row"))


def column_bounds(columns: DataFrame, most_gap: int = 3) -> DataFrame:
    """(file, sheet, first_col, last_col): the largest cluster of header columns with gaps up to most_gap; ties go left."""
    w = Window.partitionBy(*SHEET).orderBy("col")
    step = columns.select(*SHEET, "col").distinct().withColumn("_new", F.when(F.col("col") - F.lag("col").over(w) > most_gap, 1).otherwise(0))
    islands = step.withColumn("_part", F.sum("_new").over(w)).groupBy(*SHEET, "_part").agg(F.count("*").alias("n"), F.min("col").alias("first_col"), F.max("col").alias("last_col"))
    return islands.groupBy(*SHEET).agg(F.max_by(F.struct("first_col", "last_col"), F.struct("n", -F.col("first_col"))).alias("b")).select(*SHEET, "b.*")


def canonical_rows(cells: DataFrame, columns: DataFrame, logical: tuple[str, ...], data_rows: DataFrame | None = None) -> DataFrame:
    """One row per sheet row with a column per logical name and the cells' statuses; unresolved names are null.

    Only cells of resolved columns are kept before the shuffle.
    """
    value = cell_value(F.col("formula"), F.col("value"), F.col("kind"))
    bound = columns.filter("status = 'OK'").select(*SHEET, "logical", "col")
    rows = cells.join(bound, [*SHEET, "col"]).select(*SHEET, "row", "logical", value.alias("v"))
    if data_rows is not None:
        rows = rows.join(data_rows, SHEET).filter("row >= data_row").drop("data_row")
    of = lambda name: F.max(F.when(F.col("logical") == name, F.col("v.effective"))).alias(name)
    return rows.groupBy(*SHEET, "row").agg(*map(of, logical), F.array_sort(F.collect_set("v.status")).alias("statuses"), F.array_sort(F.collect_set("v.warning")).alias("warnings"))


def formula_error(statuses: Column) -> Column:
    """The worst cell status of a row: read failure, then error, then a formula without a value."""
    return F.when(F.array_contains(statuses, "VALUE_READ_FAILED"), "VALUE_READ_FAILED").when(F.array_contains(statuses, "EXCEL_ERROR"), "EXCEL_ERROR").when(F.array_contains(statuses, "FORMULA_WITHOUT_CACHED_VALUE"), "FORMULA_WITHOUT_CACHE").otherwise("NONE")


def repeated_header(values: Column, headers: Column) -> Column:
    """A row of mostly texts that repeat the headers of their columns (aligned arrays of normalized texts, null if empty)."""
    filled = F.filter(values, lambda v: v.isNotNull() & (v != ""))
    texts = F.filter(filled, lambda v: ~v.rlike(r"^[0-9 .,\-]+$"))
    same = F.size(F.filter(F.arrays_zip(values.alias("v"), headers.alias("h")), lambda p: F.coalesce((p["v"] != "") & (p["h"] != "") & (p["v"].contains(p["h"]) | p["h"].contains(p["v"])), F.lit(False))))
    return (F.size(filled) >= 2) & (F.size(texts) >= 0.7 * F.size(filled)) & (same >= F.greatest(F.lit(2), F.floor(F.size(filled) / 2)))


def carry_forward(rows: DataFrame, code: str = "drawing_code", index: str = "document_index", plausible: Column | None = None) -> DataFrame:
    """rows with carried_code (the last plausible code above) and carried_index (the last index, which a reset mark clears).

    A reset is a value too: a struct is carried, so that null means 'no change' and a struct of null means 'cleared'.
    """
    w = Window.partitionBy(*SHEET).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    fine = F.col(code).isNotNull() if plausible is None else F.coalesce(plausible, F.lit(False))
    text = F.trim(F.lower(index))
    change = F.when(text.isin(*RESET), F.struct(F.lit(None).cast("string").alias("v"))).when(F.col(index).isNotNull() & (text != ""), F.struct(F.col(index).alias("v")))
    return rows.withColumn("carried_code", F.last(F.when(fine, F.col(code)), ignorenulls=True).over(w)).withColumn("carried_index", F.last(change, ignorenulls=True).over(w)["v"])


def object_blocks(rows: DataFrame, order: str = "row", by: tuple[str, ...] = ("sheet",), value: str = "object_code") -> DataFrame:
    """Runs of consecutive rows with one value: (by, value, start_row, end_row, n)."""
    w = Window.partitionBy(*by).orderBy(order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return marked.groupBy(*by, "_run", value).agg(F.min(order).alias("start_row"), F.max(order).alias("end_row"), F.count("*").alias("n")).drop("_run")


def extraction_counts(rows: DataFrame) -> DataFrame:
    """Per sheet: scanned, extracted, skipped and failed rows, and the status they give (rows: outcome)."""
    out = rows.groupBy(*SHEET).agg(F.count("*").alias("scanned"), *(F.count_if(F.col("outcome") == k).alias(k) for k in ("extracted", "skipped", "failed")))
    status = F.when(F.col("extracted") == 0, F.when(F.col("failed") > 0, "FAILED").otherwise("NO_ROWS")).when(F.col("failed") > 0, "PARTIAL").otherwise("OK")
    return out.withColumn("status", status)
