"""Labels and units under an ontology given as data; identities; evidence fields; privacy."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reckon.functions.metadata import object_candidates

#: Sources of an object identity with their confidence, best first.
IDENTITY_SOURCES = {"explicit": 1.0, "mapping": 0.98, "column": 0.94, "structured_cell": 0.90, "filename": 0.80, "path": 0.70}


def labels_in_order(tokens: Column, entries: Mapping[str, Mapping[str, tuple]]) -> Column:
    """Labels by the first place where a token equals the label or an alias, starts with a stem, or a phrase begins.

    entries: label -> {'aliases': words, 'stems': beginnings, 'phrases': word tuples}. Words of 8 letters or more may
    differ from an alias by one edit.
    """
    def places(test) -> Column:
        """Positions of the tokens that pass."""
        return F.filter(F.transform(tokens, lambda t, i: F.when(test(t, i), i)), lambda i: i.isNotNull())

    def one_word(words: list[str], stems: tuple):
        def test(t, i):
            out = t.isin(*words)
            for s in stems:
                out = out | t.startswith(s)
            for w in words:
                if len(w) >= 8:
                    out = out | ((F.length(t) >= 8) & (F.levenshtein(t, F.lit(w), 1) >= 0))
            return out

        return test

    def phrase(words: tuple):
        want = F.array(*map(F.lit, words))
        return lambda t, i: F.slice(tokens, i + 1, F.lit(len(words))) == want

    found = []
    for label, e in entries.items():
        at = F.concat(places(one_word([label, *e.get("aliases", ())], e.get("stems", ()))), *(places(phrase(p)) for p in e.get("phrases", ())))
        found.append(F.when(F.size(at) > 0, F.struct(F.array_min(at).alias("at"), F.lit(label).alias("label"))))
    return F.transform(F.array_sort(F.array_compact(F.array(*found))), lambda x: x["label"])


def unit_identity(unit: Column, units: Mapping[str, Mapping]) -> Column:
    """struct(canonical, family, scale, exact_only) of a normalized unit; unknown units are exact only.

    units: canonical -> {'family', 'scale' (decimal text), 'aliases'}.
    """
    scale = "decimal(20,9)"
    out = F.struct(unit.alias("canonical"), F.lit("unknown").alias("family"), F.lit(None).cast(scale).alias("scale"), F.lit(True).alias("exact_only"))
    for name, e in units.items():
        known = F.struct(F.lit(name).alias("canonical"), F.lit(e["family"]).alias("family"), F.lit(e["scale"]).cast(scale).alias("scale"), F.lit(False).alias("exact_only"))
        out = F.when(unit.isin(name, *e["aliases"]), known).otherwise(out)
    return out


def units_compatible(a: Column, b: Column, forbidden: tuple[tuple[str, str], ...] = ()) -> Column:
    """One family and no forbidden conversion; exact-only units only with themselves."""
    banned = F.lit(False)
    for x, y in forbidden:
        banned = banned | ((a["canonical"] == x) & (b["canonical"] == y)) | ((a["canonical"] == y) & (b["canonical"] == x))
    exact = a["exact_only"] | b["exact_only"]
    return F.when(exact, a["exact_only"] & b["exact_only"] & a["canonical"].eqNullSafe(b["canonical"])).otherwise(~banned & (a["family"] == b["family"]))


def object_identity(candidates: DataFrame) -> DataFrame:
    """One row per file: object_code (null on conflict), source, confidence, status. candidates: file_id, source, text.

    The best source's first code wins, but any other code from any source is a conflict.
    """
    order = F.lit(len(IDENTITY_SOURCES))
    sure = F.lit(0.0)
    for i, (name, value) in enumerate(IDENTITY_SOURCES.items()):
        order = F.when(F.col("source") == name, i).otherwise(order)
        sure = F.when(F.col("source") == name, value).otherwise(sure)
    codes = F.when(F.col("source").isin("explicit", "mapping"), F.array(F.lpad("text", 4, "0"))).otherwise(object_candidates(F.col("text")))
    rows = candidates.select("file_id", "source", order.alias("o"), sure.alias("s"), F.posexplode_outer(codes).alias("at", "code"))
    out = rows.groupBy("file_id").agg(F.min(F.when(F.col("code").isNotNull(), F.struct("o", "at", "code", "source", "s"))).alias("b"), F.count_distinct("code").alias("n"))
    one = F.col("n") == 1
    return out.select("file_id", F.when(one, F.col("b.code")).alias("object_code"), F.when(one, F.col("b.source")).alias("source"), F.coalesce("b.s", F.lit(0.0)).alias("confidence"), F.when(F.col("n") == 0, "OBJECT_NOT_FOUND").when(one, "OK").otherwise("OBJECT_CONFLICT").alias("status"))


def workbook_periods(filename_periods: DataFrame, cell_periods: DataFrame) -> DataFrame:
    """Distinct periods of file names and of cells whose year is within one of some file name's year."""
    years = filename_periods.select(F.substring("period", 1, 4).cast("int").alias("y")).distinct()
    near = years.select(F.explode(F.array(F.col("y") - 1, F.col("y"), F.col("y") + 1)).alias("y")).distinct()
    cells = cell_periods.select("period", F.substring("period", 1, 4).cast("int").alias("y")).join(near, "y", "left_semi").select("period")
    return filename_periods.select("period").unionByName(cells).distinct()


def terminal_identity(value: Column) -> Column:
    """A bare four-digit code that is no year, or the last part (three or four digits, no year) of a dotted code."""
    text = F.trim(value)
    bare = F.regexp_extract(text, r"^([0-9]{4})$", 1)
    dotted = F.regexp_extract(text, r"(?U)^[\w-]+(?:\.[\w-]+)*\.([0-9]{3,4})$", 1)
    code = F.when(bare != "", bare).when(dotted != "", dotted)
    return F.when(code.rlike("^(?:19|20)[0-9]{2}$"), F.lit(None)).otherwise(code)


def resolve_terminal(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """(source_id, identity) of sources of whose candidates exactly one is a target."""
    hit = candidates.join(targets.select("identity").distinct(), "identity", "left_semi").distinct()
    return hit.groupBy("source_id").agg(F.count("*").alias("n"), F.min("identity").alias("identity")).filter("n = 1").drop("n")


def act_fields(text: Column) -> Column:
    """struct(act_number, act_date, project_codes, quantities, units) of an act's text, only what it says outright."""
    flat = F.trim(F.regexp_replace(text, r"[\s ]+", " "))
    head = r"(?iU)\bакт\s+освидетельствования\s+(?:скрытых\s+)?работ\s*№\s*([\w./-]{1,48})(.{0,180})"
    number, near = F.regexp_extract(flat, head, 1), F.regexp_extract(flat, head, 2)
    date = F.regexp_extract(near, r"(?<![0-9])((?:0?[1-9]|[12][0-9]|3[01])\.(?:0?[1-9]|1[0-2])\.[0-9]{4})(?![0-9])", 1)
    codes = F.array_distinct(F.filter(F.regexp_extract_all(flat, F.lit(r"(?iU)(?<!\w)([a-zа-яё0-9]{1,24}(?:[./-][a-zа-яё0-9]{1,24}){2,})(?!\w)"), F.lit(1)), lambda x: x.rlike("(?iu)[a-zа-яё]") & x.rlike("[0-9]") & (x != number)))
    amount = r"(?iU)(?<![\w.,])([0-9]+(?:[.,][0-9]+)?)\s*(км|мп|м2|м²|м3|м|шт|т|кг)\.?(?!\w)"
    return F.struct(
        F.nullif(number, F.lit("")).alias("act_number"), F.nullif(date, F.lit("")).alias("act_date"), codes.alias("project_codes"),
        F.transform(F.regexp_extract_all(flat, F.lit(amount), F.lit(1)), lambda x: F.translate(x, ",", ".")).alias("quantities"), F.transform(F.regexp_extract_all(flat, F.lit(amount), F.lit(2)), lambda x: F.lower(x)).alias("units"),
    )


def looks_private(text: Column) -> Column:
    """Paths, file names, cell references, formulas: text that must not leave the corpus."""
    return text.contains("/") | text.contains("\\") | text.rlike(r"^[A-Za-z]:|(?iU)\w\.(?:xlsx?|xlsm|xlsb|ods|pdf|docx?)\b|(?<![\w])\$?[A-Z]{1,3}\$?[0-9]{1,6}(?![\w])|^=|#REF!")


def outcome_check(calculations: DataFrame, cells: DataFrame) -> DataFrame:
    """(row_id, reason) of rows that fail verification: not authorized, or written values that differ from the target's.

    calculations: row_id, target_row_id, quantity, cost, authorized; cells: target_row_id, quantity, cost.
    """
    t = cells.select("target_row_id", F.col("quantity").alias("tq"), F.col("cost").alias("tc"))
    differs = ~F.col("quantity").eqNullSafe(F.col("tq")) | ~F.col("cost").eqNullSafe(F.col("tc"))
    reason = F.when(~F.col("authorized"), "UNAUTHORIZED").when(F.col("tq").isNull() & F.col("tc").isNull(), "TARGET_MISSING").when(differs, "VALUE_MISMATCH")
    return calculations.join(t, "target_row_id", "left").select("row_id", reason.alias("reason")).filter("reason is not null")
