"""Dot-path hierarchies: ancestors by exploded prefixes, the transactional frontier, gaps among siblings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reckon.functions.text import position_segments

#: Fixed value: cost difference that a parent may have from its children.
TOLERANCE = "0.01"


def coded(entries: DataFrame) -> DataFrame:
    """Entries whose position code parses, with its segments; entries: row_id, position_code, amount, context, is_transactional."""
    return entries.withColumn("segments", position_segments(F.col("position_code"))).filter("segments is not null")


def ancestor_pairs(entries: DataFrame) -> DataFrame:
    """(row_id, ancestor_id, steps): every entry with every entry of the same context on a proper prefix of its path.

    A path of n segments gives n - 1 keys, so this is one equi-join; nothing is compared pair by pair.
    """
    rows = coded(entries)
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.size("segments") - 1), lambda k: F.slice("segments", F.lit(1), k)))
    low = rows.filter(F.size("segments") > 1).select("row_id", "context", F.size("segments").alias("n"), prefix.alias("segments"))
    return low.join(rows.select("context", "segments", F.col("row_id").alias("ancestor_id")), ["context", "segments"]).select("row_id", "ancestor_id", (F.col("n") - F.size("segments")).alias("steps"))


def duplicate_positions(entries: DataFrame) -> DataFrame:
    """(context, segments, n) of codes that several entries of a context carry."""
    return coded(entries).groupBy("context", "segments").agg(F.count("*").alias("n")).filter("n > 1")


def gaps(entries: DataFrame) -> DataFrame:
    """(context, parent) of siblings whose distinct numeric last segments jump by more than one."""
    rows = coded(entries).filter(F.size("segments") > 1)
    last = F.element_at("segments", -1)
    siblings = rows.filter(last.rlike("^[0-9]+$")).select("context", F.slice("segments", F.lit(1), F.size("segments") - 1).alias("parent"), last.cast("long").alias("n")).distinct()
    step = F.col("n") - F.lag("n").over(Window.partitionBy("context", "parent").orderBy("n"))
    return siblings.select("context", "parent", step.alias("step")).filter("step > 1").select("context", "parent").distinct()


def frontier(entries: DataFrame) -> DataFrame:
    """Every entry with role: 'leaf', 'parent' (excluded) or 'resource_detail' (excluded).

    A code with direct children is a parent, unless the entry has its own metrics (is_transactional): then it stays
    and all its descendants are resource details. Codes that occur twice in a context exclude nothing and are
    never excluded. Entries without a readable code are leaves.
    """
    rows = coded(entries).withColumn("twice", F.count("*").over(Window.partitionBy("context", "segments")) > 1)
    pairs = ancestor_pairs(entries)
    single = rows.filter(~F.col("twice")).select("row_id", "is_transactional")
    with_children = pairs.filter("steps = 1").select(F.col("ancestor_id").alias("row_id")).distinct()
    heads = single.join(with_children, "row_id", "left_semi")
    parents = heads.filter(~F.col("is_transactional")).select("row_id", F.lit("parent").alias("role"))
    own = heads.filter("is_transactional").select(F.col("row_id").alias("ancestor_id"))
    details = pairs.join(own, "ancestor_id", "left_semi").select("row_id").distinct().join(single.select("row_id"), "row_id", "left_semi").select("row_id", F.lit("resource_detail").alias("role"))
    roles = parents.unionByName(details).groupBy("row_id").agg(F.max("role").alias("role"))
    return entries.join(roles, "row_id", "left").withColumn("role", F.coalesce("role", F.lit("leaf")))


def parent_costs(entries: DataFrame) -> DataFrame:
    """(row_id, amount, children_amount, code) of excluded parents whose direct children do not add up.

    Transactional descendants stand for the direct children where there are any. A missing amount on either side is
    HIERARCHY_MISSING_DIRECT_CHILD_COST, a difference over TOLERANCE is HIERARCHY_COST_MISMATCH.
    """
    kids = entries.select(F.col("row_id"), F.col("amount").alias("a"), F.col("is_transactional").alias("t"))
    pairs = ancestor_pairs(entries).join(kids, "row_id")
    sums = pairs.groupBy("ancestor_id").agg(
        F.count_if("t").alias("n_t"), F.sum(F.when(F.col("t"), F.col("a"))).alias("sum_t"), F.count_if(F.col("t") & F.col("a").isNull()).alias("null_t"),
        F.sum(F.when(F.col("steps") == 1, F.col("a"))).alias("sum_d"), F.count_if((F.col("steps") == 1) & F.col("a").isNull()).alias("null_d"),
    )
    own = F.col("n_t") > 0
    parents = frontier(entries).filter("role = 'parent'").select(F.col("row_id").alias("ancestor_id"), "amount")
    out = parents.join(sums, "ancestor_id").select(F.col("ancestor_id").alias("row_id"), "amount", F.when(own, F.col("sum_t")).otherwise(F.col("sum_d")).alias("children_amount"), F.when(own, F.col("null_t")).otherwise(F.col("null_d")).alias("gone"))
    missing = F.col("amount").isNull() | (F.col("gone") > 0)
    code = F.when(missing, "HIERARCHY_MISSING_DIRECT_CHILD_COST").when(F.abs(F.col("amount") - F.col("children_amount")) > F.lit(TOLERANCE).cast("decimal(4,2)"), "HIERARCHY_COST_MISMATCH")
    return out.select("row_id", "amount", F.when(~missing, F.col("children_amount")).alias("children_amount"), code.alias("code")).filter("code is not null")
