"""Text normalizers. Each keeps its own contract: they differ on purpose and must not be merged.

All are column expressions that stay in the JVM. Java has no built-in compatibility composition; texts that may hold
compatibility characters go through functions.unicode.nfkc first (exact), clean ones need not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Any white space, no-break spaces included (Java's \s alone is ASCII).
SPACE = r"[\s   -     　\u0085\u001C-\u001F]+"

#: Unit aliases of the training contract.
TRAINING_UNITS = {
    "м": "м", "м.": "м", "пм": "м", "п.м": "м", "п.м.": "м", "пог м": "м", "пог. м": "м",
    "м2": "м²", "м^2": "м²", "м²": "м²", "кв м": "м²", "кв. м": "м²",
    "м3": "м³", "м^3": "м³", "м³": "м³", "куб м": "м³", "куб. м": "м³",
    "шт": "шт", "шт.": "шт", "штука": "шт", "штук": "шт",
    "кг": "кг", "кг.": "кг", "т": "т", "т.": "т", "тонна": "т", "тонн": "т", "л": "л", "л.": "л",
    "компл": "компл.", "компл.": "компл.", "комплект": "компл.", "ед": "ед.", "ед.": "ед.", "%": "%",
}
#: Unit aliases of the drawing contract.
DRAWING_UNITS = {
    "м³": "м3", "м^3": "м3", "куб.м": "м3", "куб м": "м3", "м.п.": "м", "п.м": "м", "пог.м": "м",
    "тонн": "т", "тонна": "т", "тонны": "т", "штук": "шт", "шт.": "шт",
}
#: Unit families of the feature contract.
UNIT_FAMILIES = {
    "count": ("шт", "штука", "комплект", "ед"),
    "length": ("м", "метр", "пм", "км"),
    "area": ("м2", "м²", "квм", "квадратныйметр"),
    "volume": ("м3", "м³", "кубм", "кубическийметр"),
    "mass": ("кг", "т", "тонна"),
}
DASHES = "‐‑‒–—―−﹘﹣－"


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def lookup(values: dict[str, str], key: Column) -> Column:
    """values[key], null where absent."""
    return F.try_element_at(literal_map(values), key) if values else F.lit(None).cast("string")


def collapse(value: Column) -> Column:
    """White-space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(value, SPACE, " "))


def _no_yo(value: Column) -> Column:
    return F.translate(value, "ёЁ", "еЕ")


def normalize_text(value: Column, fold: bool = True) -> Column:
    """Training text: ё to е, white space collapsed, empty to null, lower case unless fold is False."""
    text = F.nullif(collapse(_no_yo(value)), F.lit(""))
    return F.lower(text) if fold else text


def normalize_code(value: Column, typos: dict[str, str] | None = None) -> Column:
    """Training code: case kept; number signs unified; spaces, semicolons and commas at the ends dropped."""
    text = F.regexp_replace(normalize_text(value, fold=False), r"(?iu)(?:\b(?:no\.?|n°)|№)[\s ]*", "№ ")
    text = F.nullif(F.regexp_replace(text, "^[ ;,]+|[ ;,]+$", ""), F.lit(""))
    return replace_exact(text, typos)


def normalize_unit(value: Column, typos: dict[str, str] | None = None) -> Column:
    """Training unit: alias of the text, else of the text with small digits made plain, else the text."""
    text = normalize_text(value)
    compact = collapse(F.translate(text, "²³", "23"))
    return replace_exact(F.coalesce(lookup(TRAINING_UNITS, text), lookup(TRAINING_UNITS, compact), text), typos)


def replace_exact(value: Column, typos: dict[str, str] | None) -> Column:
    return F.coalesce(lookup(typos, value), value) if typos else value


def stable_tokens(value: Column) -> Column:
    """Runs of word characters and small digits; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(value, F.lit(r"(?U)[\w²³]+"), F.lit(0)), F.array().cast("array<string>"))


def normalize_filename(name: Column) -> Column:
    """Stem in lower case, ё to е, dashes unified, separators to single spaces."""
    base = F.regexp_replace(name, r"^.*[/\\]", "")
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]+$", "")
    text = F.translate(_no_yo(F.lower(stem)), DASHES, "-" * len(DASHES))
    return F.trim(F.regexp_replace(text, r"[\s _.\-]+", " "))


def file_extension(name: Column) -> Column:
    """Lower-case last suffix with its dot, '' if none."""
    return F.lower(F.regexp_extract(F.regexp_replace(name, r"^.*[/\\]", ""), r"(?<=.)(\.[^.]+)$", 1))


def normalize_identifier(value: Column) -> Column:
    """Dashes to '-', white space to single spaces, empty to null."""
    return F.nullif(collapse(F.translate(value, DASHES, "-" * len(DASHES))), F.lit(""))


def normalize_header(value: Column) -> Column:
    """Header text: lower case, ё to е, punctuation and line breaks to spaces."""
    return F.trim(F.regexp_replace(_no_yo(F.lower(F.coalesce(value, F.lit("")))), r"(?U)[^\w№%²³]+", " "))


def drawing_text(value: Column) -> Column:
    """Drawing text: '' for null, ё to е, trimmed, lower case (not case-folded), white space collapsed."""
    return F.lower(collapse(_no_yo(F.coalesce(value, F.lit("")))))


def drawing_unit(value: Column) -> Column:
    """Drawing unit: alias of the text, else of the text without spaces, else that; null for empty."""
    text = drawing_text(value)
    compact = F.replace(text, F.lit(" "), F.lit(""))
    return F.nullif(F.coalesce(lookup(DRAWING_UNITS, text), lookup(DRAWING_UNITS, compact), compact), F.lit(""))


def feature_text(value: Column) -> Column:
    """Feature text: lower case, ё to е, everything but word characters and № to single spaces."""
    return F.trim(F.regexp_replace(_no_yo(F.lower(F.coalesce(value, F.lit("")))), r"(?U)[^\w№]+", " "))


def feature_unit(value: Column) -> Column:
    return F.replace(feature_text(value), F.lit(" "), F.lit(""))


def unit_family(value: Column) -> Column:
    unit, out = feature_unit(value), F.lit("unknown")
    for family, aliases in UNIT_FAMILIES.items():
        out = F.when(unit.isin(*aliases), F.lit(family)).otherwise(out)
    return out


def review_name(value: Column) -> Column:
    """Review name: lower case, white space collapsed, '' for null."""
    return F.lower(collapse(F.coalesce(value, F.lit(""))))


def review_unit(value: Column) -> Column:
    """Review unit: the review name without dots, null for empty."""
    return F.nullif(F.replace(review_name(value), F.lit("."), F.lit("")), F.lit(""))


def audit_text(value: Column) -> Column:
    """Audit text: collapsed white space only."""
    return collapse(F.coalesce(value, F.lit("")))


def semantic_text(value: Column) -> Column:
    """Semantic text: audit text in lower case, ё to е, dashes and quotes unified, x between digits made Latin."""
    text = _no_yo(F.lower(F.translate(audit_text(value), DASHES + "«»“”„", "-" * len(DASHES) + '"""""')))
    text = F.regexp_replace(text, r"(?<=[0-9])\s*[хx×]\s*(?=[0-9])", "x")
    return F.regexp_replace(text, r"(?U)\b(?:ду|dn|dy)\s*(?=[0-9])", "dn ")


def work_code(value: Column) -> Column:
    """Work code: all white space dropped, lower case, punctuation kept, empty to null."""
    return F.nullif(F.lower(F.regexp_replace(value, SPACE, "")), F.lit(""))


def position_segments(value: Column) -> Column:
    """Dot segments of a position code, null unless every one is digits with optional letters after them."""
    raw = F.replace(F.trim(value), F.lit(" "), F.lit(""))
    return F.when(raw.rlike(r"^(?i)[0-9]+[a-zа-яё]*(\.[0-9]+[a-zа-яё]*)*$"), F.split(raw, r"\."))


def is_ancestor(parent: Column, child: Column) -> Column:
    """Whether one segment array is a proper prefix of the other; false for null."""
    return F.coalesce((F.size(parent) < F.size(child)) & (F.slice(child, F.lit(1), F.size(parent)) == parent), F.lit(False))


def drawing_code(value: Column, split_confirmed: bool = False) -> Column:
    """struct(raw, normalized, group_key, components, status, warnings) of a drawing code cell."""
    clean = collapse(F.coalesce(value, F.lit("")))
    parts = F.filter(F.transform(F.split(clean, ";"), lambda x: F.trim(x)), lambda x: x != "")
    several = F.size(parts) > 1
    key = F.when(several, F.array_join(F.transform(parts, lambda x: drawing_text(x)), " || ")).otherwise(drawing_text(clean)) if split_confirmed else drawing_text(clean)
    none = F.array().cast("array<string>")
    kept = none if split_confirmed else F.when(several, F.array(F.lit("DRAWING_CODE_GROUP_PRESERVED"))).otherwise(none)
    return F.struct(
        clean.alias("raw"), drawing_text(clean).alias("normalized"), F.when(clean == "", "").otherwise(key).alias("group_key"), parts.alias("components"),
        F.when(clean == "", "DRAWING_CODE_NOT_FOUND").otherwise("OK").alias("status"), F.when(clean == "", none).otherwise(kept).alias("warnings"),
    )


def character_ngrams(value: Column, n: int = 3) -> Column:
    """Sorted distinct n-grams of the text without spaces; the text itself if it is shorter, nothing if empty."""
    compact = F.replace(value, F.lit(" "), F.lit(""))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(compact) - (n - 1), F.lit(1))), lambda i: F.substring(compact, i, F.lit(n)))
    return F.filter(F.array_sort(F.array_distinct(grams)), lambda x: x != "")
