"""What is to be written, as rows: patches of cells, new period columns, marks, versioned targets. A sink applies them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reckon.functions.identity import plain_decimal

#: Name of a versioned collection and of the alias that points to the current one; review decisions.
COLLECTION, ALIAS = "confirmed_examples_v", "confirmed_examples_current"
REVIEW_DECISIONS = ("confirmed", "rejected", "changed")


def exact_text(value: Column) -> Column:
    """A decimal as it is written into a cell: plain, without a binary tail, exponent or trailing zeros."""
    return plain_decimal(value)


def number_patches(targets: DataFrame, totals: DataFrame, decisions: DataFrame) -> DataFrame:
    """(file, sheet, coordinate, value, target_row_id) of the numeric cells to replace.

    targets: target_row_id, file, sheet, quantity_cell, cost_cell, writable. totals: target_row_id, quantity, cost. decisions:
    target_row_id, decision. Only writable targets whose decision allows writing are patched, and only with numbers.
    """
    fine = decisions.filter(F.col("decision").isin("allow_write", "allow_with_warnings")).select("target_row_id")
    rows = targets.filter("writable").join(fine, "target_row_id", "left_semi").join(totals.select("target_row_id", "quantity", "cost"), "target_row_id")
    cells = F.array(F.struct(F.col("quantity_cell").alias("coordinate"), F.col("quantity").alias("number")), F.struct(F.col("cost_cell").alias("coordinate"), F.col("cost").alias("number")))
    return rows.select("target_row_id", "file", "sheet", F.explode(cells).alias("p")).filter("p.coordinate is not null and p.number is not null").select("file", "sheet", "p.coordinate", exact_text(F.col("p.number")).alias("value"), "target_row_id")


def patch_conflicts(patches: DataFrame) -> DataFrame:
    """(file, sheet, coordinate, n_values) of cells that are patched with different values."""
    return patches.groupBy("file", "sheet", "coordinate").agg(F.count_distinct("value").alias("n_values")).filter("n_values > 1")


def period_columns(headers: DataFrame, period: str) -> DataFrame:
    """(file, sheet, old_col, new_col, action, period, metric): where the columns of a sheet go when a month's pair is put in.

    headers: file, sheet, col, period ('YYYY-MM' or null), metric. The pair (quantity, then cost) follows the last column of the
    latest earlier period; columns after it move by two. A sheet that has the period, or no earlier one, gets no rows.
    """
    place = headers.groupBy("file", "sheet").agg(
        F.max(F.when(F.col("period") < period, F.struct("period", "col"))).alias("last"), F.bool_or(F.coalesce(F.col("period") == period, F.lit(False))).alias("there")
    ).filter("last is not null and not there").select("file", "sheet", F.col("last.col").alias("after"))
    moved = headers.join(place, ["file", "sheet"]).select(
        "file", "sheet", F.col("col").alias("old_col"), (F.col("col") + F.when(F.col("col") > F.col("after"), 2).otherwise(0)).cast("int").alias("new_col"),
        F.when(F.col("col") > F.col("after"), "move").otherwise("keep").alias("action"), "period", "metric",
    )
    pair = F.explode(F.array(F.struct(F.lit(1).alias("d"), F.lit("quantity").alias("metric")), F.struct(F.lit(2).alias("d"), F.lit("cost").alias("metric")))).alias("p")
    made = place.select("file", "sheet", "after", pair).select("file", "sheet", F.lit(None).cast("int").alias("old_col"), (F.col("after") + F.col("p.d")).cast("int").alias("new_col"), F.lit("insert").alias("action"), F.lit(period).alias("period"), "p.metric")
    return moved.unionByName(made)


def failed_marks(issues: DataFrame, targets: DataFrame) -> DataFrame:
    """(file, sheet, row, codes): rows to mark, with their blocking and review codes in order."""
    bad = issues.filter(F.col("severity").isin("blocking", "manual_review"))
    codes = F.array_sort(F.collect_set("code")).alias("codes")
    return bad.join(targets.select("target_row_id", "file", "sheet", "row"), "target_row_id").groupBy("file", "sheet", "row").agg(codes)


def discrepancy_lines(violations: DataFrame, locations: DataFrame, keys: list[str]) -> DataFrame:
    """Numbered lines of a discrepancy sheet: keys, code, difference, and the cells that show quantity and cost."""
    order = Window.partitionBy("file").orderBy(*keys, "issue_code")
    return violations.join(locations, keys).withColumn("line", F.row_number().over(order))


def review_export(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows for review: row_id, display_name, unit, quantity, cost, status, category, and empty places for the reviewer."""
    out = rows.join(decisions.select("row_id", "status", "category"), "row_id").filter("status = 'manual_review'")
    empty = F.lit(None).cast("string")
    return out.select("row_id", "display_name", "unit", exact_text(F.col("quantity")).alias("quantity"), exact_text(F.col("cost")).alias("cost"), "status", "category", empty.alias("review_decision"), empty.alias("review_category"))


def review_import(answers: DataFrame, known: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """Every answer (row_id, review_decision, review_category) with code: null if it holds, else why it does not.

    Answers without a decision are left out. UNKNOWN_ROW, DUPLICATE_ROW, UNKNOWN_DECISION, UNKNOWN_CATEGORY (confirmed and
    changed rows need one of the categories).
    """
    said = answers.withColumn("review_decision", F.lower(F.trim("review_decision"))).withColumn("review_category", F.nullif(F.trim("review_category"), F.lit(""))).filter("review_decision <> ''")
    said = said.join(known.select("row_id", F.lit(True).alias("_known")).distinct(), "row_id", "left").withColumn("_n", F.count("*").over(Window.partitionBy("row_id")))
    category = F.coalesce(F.col("review_category").isin(*categories), F.lit(False))
    code = (
        F.when(F.col("_known").isNull(), "UNKNOWN_ROW").when(F.col("_n") > 1, "DUPLICATE_ROW").when(~F.col("review_decision").isin(*REVIEW_DECISIONS), "UNKNOWN_DECISION")
        .when((F.col("review_decision") != "rejected") & ~category, "UNKNOWN_CATEGORY")
    )
    return said.select("row_id", "review_decision", "review_category", code.alias("code"))


def reindex_plan(indexes: DataFrame) -> DataFrame:
    """Versioned targets of a new index: source, target, alias and rollback collection; error for what cannot be planned.

    indexes: source_collection, collection_version, model_id, model_revision, taxonomy_version.
    """
    named = [F.coalesce(F.trim(c), F.lit("")) != "" for c in ("source_collection", "model_id", "model_revision", "taxonomy_version")]
    whole = named[0] & named[1] & named[2] & named[3]
    error = F.when(F.col("collection_version").isNull() | (F.col("collection_version") < 1), "INVALID_COLLECTION_VERSION").when(~whole, "INVALID_TEXT")
    fine = error.isNull()
    target = F.concat(F.lit(COLLECTION), F.col("collection_version").cast("string"))
    return indexes.select("source_collection", F.when(fine, target).alias("target_collection"), F.when(fine, ALIAS).alias("alias_name"), F.when(fine, F.col("source_collection")).alias("rollback_collection"), "model_id", "model_revision", "taxonomy_version", error.alias("error"))


def confirmed_vectors(stored: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The vector table after an upsert: confirmed outcomes replace their example, and the examples they name are inactive.

    stored: example_id, tenant_id, vector, active. outcomes: tenant_id, audit_reference, vector, confirmed, replaces (array of
    example ids). Unconfirmed outcomes are not stored. An outcome never deactivates itself.
    """
    own = F.sha2(F.concat(F.encode("tenant_id", "UTF-8"), F.unhex(F.lit("00")), F.encode("audit_reference", "UTF-8")), 256)
    new = outcomes.filter("confirmed").select(own.alias("example_id"), "tenant_id", "vector", F.col("audit_reference").alias("_a"), "replaces")
    latest = new.groupBy("example_id", "tenant_id").agg(F.max_by("vector", "_a").alias("vector"))
    gone = new.select("tenant_id", "example_id", F.explode("replaces").alias("old")).filter("old <> example_id").select("tenant_id", F.col("old").alias("example_id")).distinct().withColumn("_gone", F.lit(True))
    rest = stored.join(latest.select("example_id", "tenant_id"), ["example_id", "tenant_id"], "left_anti").select("example_id", "tenant_id", "vector", "active")
    out = rest.unionByName(latest.withColumn("active", F.lit(True)))
    return out.join(gone, ["tenant_id", "example_id"], "left").select("example_id", "tenant_id", "vector", (F.col("active") & F.col("_gone").isNull()).alias("active"))
