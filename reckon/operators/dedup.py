"""Duplicates: flags, identity conflicts, line-id collisions, latest records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reckon.functions.identity import framed_id


def flag_duplicates(df: DataFrame, keys: Sequence[str], name: str = "is_possible_duplicate") -> DataFrame:
    """df with a flag for rows whose keys occur more than once (nulls are values)."""
    return df.withColumn(name, F.count("*").over(Window.partitionBy(*keys)) > 1)


def identity_batch(df: DataFrame, key: str, digest: str) -> DataFrame:
    """One row per key: n rows, n_digests and status 'unique', 'repeated' (one digest) or 'conflict'."""
    out = df.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(digest).alias("n_digests"))
    return out.withColumn("status", F.when(F.col("n_digests") > 1, "conflict").when(F.col("n") > 1, "repeated").otherwise("unique"))


def line_ids(df: DataFrame, row_id: str = "row_id", line_id: str = "line_id", signature: str = "signature") -> DataFrame:
    """Rows that stay, with final_line_id and is_collision.

    In the order of row ids, the first row of a line id keeps it; a later one with a signature seen there goes; one
    with a new signature stays under the hash of line id and row id.
    """
    seen = F.row_number().over(Window.partitionBy(line_id, signature).orderBy(row_id))
    lead = F.row_number().over(Window.partitionBy(line_id).orderBy(row_id)) == 1
    out = df.withColumn("_seen", seen).withColumn("_lead", lead).filter("_seen = 1")
    return out.withColumn("is_collision", ~F.col("_lead")).withColumn("final_line_id", F.when(F.col("_lead"), F.col(line_id)).otherwise(framed_id(F.col(line_id), F.col(row_id)))).drop("_seen", "_lead")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row of each key group that comes last in `order`, all its columns from the same row (nulls are keys).

    One partial aggregate before the shuffle: a key with very many rows costs one row a task.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, *(F.col("_b")[c].alias(c) for c in rest))


def ordered_distinct(df: DataFrame, keys: Sequence[str], order: Column, value: str, name: str) -> DataFrame:
    """keys and `name`: the group's distinct non-null values by first appearance in `order` (ties by value).

    Values are made distinct before a group is gathered, so an array holds distinct values only, however many rows.
    """
    first = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("_o"))
    rows = F.array_sort(F.collect_list(F.struct("_o", F.col(value).alias("v"))))
    return first.groupBy(*keys).agg(F.transform(rows, lambda x: x["v"]).alias(name))


def collision_count(df: DataFrame, key: str) -> DataFrame:
    """One row: rows beyond the first of each key, summed."""
    return df.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("collisions"))
