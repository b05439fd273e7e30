"""Exact decimal scalars: half-up rounding to a quantum, scaling, parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reckon.functions.text import SPACE

MONEY = "decimal(20,6)"
PARSED = "decimal(38,18)"


def round_to_quantum(value: Column, quantum: str = "0.01") -> Column:
    """Nearest multiple of quantum, halves away from zero. value: DECIMAL; quantum: a positive decimal literal."""
    digits = quantum.rstrip("0").split(".")
    if set(quantum) <= set("0.1") and quantum.replace(".", "").lstrip("0").rstrip("0") == "1":
        places = len(digits[1]) if len(digits) > 1 else 1 - len(quantum.split(".")[0])
        return F.round(value, places)
    q = F.lit(quantum).cast("decimal(12,6)")
    return (F.round(value / q, 0).cast("decimal(26,0)") * q).cast(MONEY)


def to_millions(value: Column, scale: int = 1) -> Column:
    """value / scale / 1 000 000, exact to 12 places; null stays null."""
    return (value.cast("decimal(24,6)") / F.lit(scale * 1_000_000).cast("decimal(12,0)")).cast("decimal(38,12)")


def parse_decimal(value: Column) -> Column:
    """Strict text number: struct(value, status, warning).

    Thousands may be grouped by single spaces in threes; the decimal mark is a comma or a dot, not both.
    """
    text = F.trim(F.regexp_replace(value, SPACE, " "))
    low = F.lower(text)
    plain = F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit(","), F.lit("."))
    status = (
        F.when(value.isNull() | low.isin("", "—", "–", "-"), "EMPTY")
        .when(low.isin("n/a", "na", "нет", "#name?", "#n/a"), "INVALID_FORMAT")
        .when(text.contains(",") & text.contains("."), "INVALID_FORMAT")
        .when(~text.rlike(r"^[+-]?(?:[0-9]{1,3}(?: [0-9]{3})+|[0-9]+)(?:[.,][0-9]+)?$"), "INVALID_FORMAT")
        .otherwise("OK")
    )
    warning = (
        F.when(low.isin("n/a", "na", "нет", "#name?", "#n/a"), "NON_NUMERIC_MARKER")
        .when(text.contains(",") & text.contains("."), "AMBIGUOUS_DECIMAL_SEPARATORS")
        .when(status == "INVALID_FORMAT", "INVALID_NUMBER_FORMAT")
    )
    return F.struct(F.when(status == "OK", plain.try_cast(PARSED)).alias("value"), status.alias("status"), warning.alias("warning"))


def snap_binary_tail(value: Column) -> Column:
    """The value at the fewest decimal places (up to 6) that lie within 5e-9 of it, else the value itself."""
    out = value
    for places in range(6, -1, -1):
        near = F.round(value, places)
        out = F.when(F.abs(value - near) <= F.lit("0.000000005").cast("decimal(12,9)"), near.cast(PARSED)).otherwise(out.cast(PARSED))
    return out


def parse_decimal_lenient(value: Column) -> Column:
    """struct(value, warning) of a free cell text: spaces and letters are dropped, binary tails snapped."""
    text = F.trim(value)
    clean = F.regexp_replace(F.replace(F.regexp_replace(text, r"[  ]", ""), F.lit(","), F.lit(".")), r"[^0-9eE+\-.]", "")
    parsed = clean.try_cast(PARSED)
    error = F.coalesce(text.startswith("#"), F.lit(False))
    empty = value.isNull() | (value == "")
    warning = F.when(empty, F.lit(None)).when(error, "EXCEL_ERROR").when((clean == "") | parsed.isNull(), "INVALID_NUMBER")
    return F.struct(F.when(~empty & ~error & (clean != ""), snap_binary_tail(parsed)).alias("value"), warning.alias("warning"))
