"""Versioned tables on Parquet: upsert, insert-or-fail, named scans, diagnostics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The named queries, with the columns they may filter on and their order; the row limit.
NAMED = {
    "source_rows": (("source_row_id", "line_id", "source_file_id"), ("source_row_id",)),
    "target_rows": (("target_row_id", "target_source_id", "target_fingerprint", "sheet_name"), ("target_source_id", "target_fingerprint", "sheet_name", "row_number", "target_row_id")),
    "rule_clauses": (("content_hash", "rule_id"), ("content_hash", "rule_id", "clause_index")),
    "diagnostics": (("entity_type", "entity_id"), ("entity_type", "entity_id", "warning_index")),
}
MOST_ROWS = 10_000


def upsert(table: DataFrame, batch: DataFrame, key: str, digest: str) -> DataFrame:
    """The table after the batch, with change: 'inserted', 'updated', 'unchanged' or 'kept' (not in the batch).

    One full outer join on the key; the batch wins where digests differ.
    """
    rest = [c for c in batch.columns if c != key]
    t, b = table.select(key, F.struct(*rest).alias("t")), batch.select(key, F.struct(*rest).alias("b"))
    both = t.join(b, key, "full_outer")
    change = F.when(F.col("b").isNull(), "kept").when(F.col("t").isNull(), "inserted").when(F.col(f"t.{digest}") == F.col(f"b.{digest}"), "unchanged").otherwise("updated")
    row = F.when(change.isin("kept", "unchanged"), F.col("t")).otherwise(F.col("b"))
    return both.select(key, row.alias("r"), change.alias("change")).select(key, *(F.col("r")[c].alias(c) for c in rest), "change")


def insert_or_fail(table: DataFrame, batch: DataFrame, key: str, digest: str) -> DataFrame:
    """The batch's new rows. A key that is there with another digest fails the whole batch when the plan runs."""
    known = table.select(key, F.col(digest).alias("_old"))
    joined = batch.join(known, key, "left")
    wrong = F.col("_old").isNotNull() & (F.col("_old") != F.col(digest))
    guarded = joined.withColumn("_ok", F.when(wrong, F.raise_error(F.concat(F.lit("key with another payload: "), F.col(key).cast("string")))).otherwise(F.col("_old").isNull().cast("string")))
    return guarded.filter("_ok = 'true'").drop("_old", "_ok")


def rule_clauses(rule_sets: DataFrame) -> DataFrame:
    """One row a clause with clause_index; content_hash must be the SHA-256 of canonical_json, else the plan fails.

    rule_sets: content_hash, canonical_json, rules array<struct<rule_id, clauses array<struct<...>>>>.
    """
    right = F.col("content_hash") == F.sha2("canonical_json", 256)
    checked = rule_sets.withColumn("content_hash", F.when(right, F.col("content_hash")).otherwise(F.raise_error(F.lit("content hash differs"))))
    rules = checked.select("content_hash", F.explode("rules").alias("r"))
    return rules.select("content_hash", "r.rule_id", F.posexplode("r.clauses").alias("clause_index", "c")).select("content_hash", "rule_id", F.col("clause_index").cast("long").alias("clause_index"), "c.*")


def named_query(table: DataFrame, name: str, filters: Mapping[str, object] | None = None, limit: int = 1000) -> DataFrame:
    """Rows of a named relation: equality filters on its own columns only, its own order, 1 to MOST_ROWS rows."""
    allowed, order = NAMED[name]
    if unknown := set(filters or {}) - set(allowed):
        raise ValueError(f"{name} does not filter on {sorted(unknown)}")
    if not 1 <= limit <= MOST_ROWS:
        raise ValueError(f"limit must be 1 to {MOST_ROWS}")
    for column, value in sorted((filters or {}).items()):
        table = table.filter(F.col(column) == value)
    return table.orderBy(*order).limit(limit)


def diagnostics(rows: DataFrame, entity_type: str, id_col: str, warnings_col: str = "warnings") -> DataFrame:
    """One row a warning: entity_type, entity_id, warning_index, warning."""
    return rows.select(F.lit(entity_type).alias("entity_type"), F.col(id_col).alias("entity_id"), F.posexplode(warnings_col).alias("i", "warning")).select("entity_type", "entity_id", F.col("i").cast("long").alias("warning_index"), "warning")


def snapshot_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: n and a digest that does not depend on row order or partitioning.

    Rows are hashed as JSON with sorted columns; the hashes are hashed together, in order, by their first six digits,
    those by three, those at last: no group gathers more than 4096 hashes or a sixteen-millionth of the rows.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    level = rows.select(F.lit(1).cast("long").alias("n"), row.alias("h"), row.alias("b"))
    for digits in (6, 3, 0):
        prefix = F.substring("b", 1, digits) if digits else F.lit("")
        both = F.array_sort(F.collect_list(F.concat_ws(":", "b", "h")))
        level = level.groupBy(prefix.alias("b")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(both, "\n"), 256).alias("h"))
    return level.select("n", F.col("h").alias("digest"))


def export(rows: DataFrame, path: str, fmt: str = "json") -> None:
    """Write rows in a total order (by their JSON) without overwriting; fmt: json, csv or parquet."""
    ordered = rows.orderBy(F.to_json(F.struct(*sorted(rows.columns))))
    writer = ordered.select(*sorted(rows.columns)).write.mode("errorifexists")
    (writer.option("header", True).csv if fmt == "csv" else writer.json if fmt == "json" else writer.parquet)(path)
