"""Choosing a source file: rejection reasons, points, total order, ambiguity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Extensions of workbooks, and points.
EXTENSIONS = (".xlsx", ".xlsm", ".xls", ".xlsb", ".ods")
POINTS = {
    "exact_index": 100, "exact_period": 40, "type_first": 30, "type_step": 5, "final": 8, "approved": 6, "revision_step": 1, "revision_most": 20,
    "unknown_period": -10, "other_period": -40, "copy": -20, "outdated": -100, "draft": -30,
}


@dataclass(frozen=True)
class Request:
    index: str
    period: str | None = None
    preferred: tuple[str, ...] = ()
    allowed: tuple[str, ...] = ()
    exact_period: bool = False
    unknown_period: bool = True
    copies: bool = False
    outdated: bool = False
    drafts: bool = False


def rejection_reasons(r: Request) -> Column:
    """All reasons against a manifest entry; accepted if there are none.

    Columns: source_type, document_index, is_temporary, extension, document_type, is_probably_outdated, is_draft,
    is_probable_copy, document_period.
    """
    c = F.col
    period = [] if r.period is None else [
        F.when(c("document_period").isNull() & F.lit(not r.unknown_period), "UNKNOWN_PERIOD_NOT_ALLOWED"),
        F.when((c("document_period") != r.period) & F.lit(r.exact_period), "PERIOD_MISMATCH"),
    ]
    return F.array_compact(F.array(
        F.when(F.lower("source_type").isin("directory", "folder"), "DIRECTORY_ENTRY"),
        F.when(c("document_index").isNull(), "INDEX_NOT_AVAILABLE").when(c("document_index") != r.index, "INDEX_MISMATCH"),
        F.when(c("is_temporary"), "TEMPORARY_FILE"), F.when(~F.lower("extension").isin(*EXTENSIONS), "UNSUPPORTED_EXTENSION"),
        F.when(~F.lower("document_type").isin(*(r.allowed or ("",))), "DOCUMENT_TYPE_NOT_ALLOWED"),
        F.when(c("is_probably_outdated") & ~c("is_draft") & F.lit(not r.outdated), "PROBABLY_OUTDATED"),
        F.when(c("is_draft") & F.lit(not r.drafts), "DRAFT_FILE"), F.when(c("is_probable_copy") & F.lit(not r.copies), "PROBABLE_COPY"), *period,
    ))


def score(r: Request) -> dict[str, Column]:
    """Points of an accepted entry by component; columns as above with revision_number, is_final, is_approved."""
    c, p = F.col, POINTS
    kind = F.lower("document_type")
    types = F.lit(0)
    for i, name in enumerate(r.preferred):
        types = F.when(kind == name, max(p["type_first"] - i * p["type_step"], 0)).otherwise(types)
    conflict = c("is_draft") & (c("is_final") | c("is_approved"))
    period = F.lit(0) if r.period is None else F.when(c("document_period") == r.period, p["exact_period"]).when(c("document_period").isNull(), p["unknown_period"]).otherwise(p["other_period"])
    flag = lambda when, points: F.when(when, points).otherwise(0)
    return {
        "index_points": F.lit(p["exact_index"]), "period_points": period, "type_points": types,
        "revision_points": F.when(c("revision_number").isNull(), 0).otherwise(F.least(c("revision_number") * p["revision_step"], F.lit(p["revision_most"]))).cast("int"),
        "final_points": flag(c("is_final") & ~conflict, p["final"]), "approved_points": flag(c("is_approved") & ~conflict, p["approved"]),
        "copy_points": flag(c("is_probable_copy"), p["copy"]), "outdated_points": flag(c("is_probably_outdated"), p["outdated"]), "draft_points": flag(c("is_draft"), p["draft"]),
    }


def ranked(entries: DataFrame, r: Request, by: tuple[str, ...] = ()) -> DataFrame:
    """Accepted entries with points, score, rank (1-based, total order) and ambiguous within each `by` group.

    Ties of the business order (score, type points, exact period, revision, final, approved) make a group
    ambiguous, though time, path and id still order it. Without `by`, the whole manifest is one group, ordered once.
    """
    parts = score(r)
    rows = entries.withColumn("reasons", rejection_reasons(r)).filter(F.size("reasons") == 0).select("*", *(v.cast("int").alias(k) for k, v in parts.items()))
    rows = rows.withColumn("score", sum(F.col(k) for k in parts))
    exact = F.coalesce(F.col("document_period") == F.lit(r.period), F.lit(False))
    business = [F.desc("score"), F.desc("type_points"), exact.desc(), F.coalesce("revision_number", F.lit(-1)).desc(), F.desc("is_final"), F.desc("is_approved")]
    technical = [F.col("modified_at").desc_nulls_last(), F.lower(F.translate("relative_path", "\\", "/")), F.col("file_id")]
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    out = rows.withColumn("rank", F.row_number().over(group.orderBy(*business, *technical))).withColumn("_r", F.rank().over(group.orderBy(*business)))
    return out.withColumn("ambiguous", F.count_if(F.col("_r") == 1).over(group) > 1).drop("_r", "reasons")


def explanation() -> Column:
    """The components of a score that are not 0, as texts."""
    names = [k for k in score(Request(""))]
    return F.array_compact(F.array(*(F.when(F.col(k) != 0, F.concat(F.lit(f"{k.removesuffix('_points')}: "), F.col(k).cast("string"))) for k in names)))


def latest_inspections(rows: DataFrame, requested: str | None = None) -> DataFrame:
    """One decision per object: object_code, period, file_id (null if blocked), n_top.

    The requested period, or the object's latest; files that are no copies before copies; the top score; a tie
    blocks the object.
    """
    rows = rows.filter(F.col("period") == requested) if requested else rows.withColumn("_p", F.max("period").over(Window.partitionBy("object_code"))).filter("period = _p").drop("_p")
    order = Window.partitionBy("object_code").orderBy(F.col("is_copy").asc(), F.desc("score"))
    top = rows.withColumn("_r", F.rank().over(order)).filter("_r = 1")
    return top.groupBy("object_code", "period").agg(F.count("*").alias("n_top"), F.min("file_id").alias("f")).select("object_code", "period", F.when(F.col("n_top") == 1, F.col("f")).alias("file_id"), "n_top")


def manifest_summary(entries: DataFrame) -> DataFrame:
    """One row of counts over a manifest, with histograms as sorted maps."""
    def histogram(name: str) -> Column:
        return F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("_k") == name, F.struct("_v", "_n")))))

    kinds = ("document_type", "extension")
    counts = entries.agg(
        F.count("*").alias("total"), F.count_if("is_temporary").alias("temporary"), F.count_if("is_probable_copy").alias("copies"),
        F.count_if("is_probably_outdated").alias("outdated"), F.count_if("is_possible_duplicate").alias("duplicates"),
        F.count_if(F.col("document_type") == "unknown").alias("unknown"), F.count_distinct("document_index").alias("distinct_indexes"),
        F.sum("size_bytes").alias("size_bytes"),
    )
    long = entries.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, kinds)), F.array(*(F.col(k) for k in kinds)))).alias("_k", "_v")).groupBy("_k", "_v").agg(F.count("*").alias("_n"))
    maps = long.agg(*(histogram(k).alias(f"by_{k}") for k in kinds))
    return counts.crossJoin(maps)  # one row each


def filter_counts(entries: DataFrame, r: Request) -> DataFrame:
    """(reason, n) over all entries; an entry counts for each of its reasons."""
    return entries.select(F.explode(rejection_reasons(r)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
