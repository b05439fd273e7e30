"""Content identities: SHA-256 over framed, joined or JSON-coded parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _frame(value: Column) -> Column:
    """Four bytes of big-endian length, then the UTF-8 bytes; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(text)), 8, "0")), F.encode(text, "UTF-8"))


def framed_id(*values: Column) -> Column:
    """SHA-256 (hex) of the framed values: the line identity, and of (line id, row id) its disambiguation."""
    return F.sha2(F.concat(*map(_frame, values)), 256)


def joined_id(*values: Column) -> Column:
    """SHA-256 (hex) of the values joined by U+001F, null as empty."""
    return F.sha2(F.concat_ws("\u001f", *(F.coalesce(v.cast("string"), F.lit("")) for v in values)), 256)


def plain_id(*values: Column) -> Column:
    """SHA-256 (hex) of the values' bare concatenation (the analytical target-row identity)."""
    return F.sha2(F.concat(*(F.coalesce(v.cast("string"), F.lit("")) for v in values)), 256)


def json_string(value: Column) -> Column:
    """A JSON string literal; null is null."""
    text = value.cast("string")
    for raw, short in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(short))
    return F.coalesce(F.concat(F.lit('"'), text, F.lit('"')), F.lit("null"))


def json_id(*values: Column, numbers: tuple[int, ...] = ()) -> Column:
    """SHA-256 (hex) of the compact JSON array of the values; positions in `numbers` stay unquoted."""
    parts = [F.coalesce(v.cast("string"), F.lit("null")) if i in numbers else json_string(v) for i, v in enumerate(values)]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")), 256)


def plain_decimal(value: Column) -> Column:
    """A decimal's shortest plain text: no exponent, no trailing zeros."""
    text = value.cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
