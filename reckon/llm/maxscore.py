"""Operator 3, exact top-k search: MaxScore over shards of integer vectors.

Every dimension is a query term. A shard keeps, for each dimension, the smallest and largest component among its
rows; a query's contributions are counted from their smallest value in the shard, so none is negative and each has an
upper bound. The terms in order of bound split into essential ones, whose postings are traversed for all rows, and
non-essential ones, which are probed, largest bound first, only for rows whose partial score plus the bounds
still to come can reach the shard's k-th score. Shards' results are then merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reckon.llm.common import parquet

#: Rows of a shard, and queries that meet it in one task.
SHARD_ROWS = 16_384
QUERY_BLOCK = 2048
#: Shards of a table with rows enough, so that a small one keeps several tasks busy.
LEAST_SHARDS = 24


def maxscore(query: np.ndarray, rows: np.ndarray, ids: np.ndarray, own: int, k: int, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
    """The k best (score, id) of rows (dimensions x rows, ids ascending) for one query, leaving out id `own`."""
    least = np.where(query >= 0, query * low, query * high)
    bound = np.where(query >= 0, query * high, query * low) - least
    order = np.argsort(-bound, kind="stable")
    after = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # bounds of the terms from each place on
    base = least.sum()
    # A threshold to start with: full scores of a first few rows.
    first = rows[:, : 4 * k + 1].T @ query
    first = first[ids[: len(first)] != own]
    threshold = np.partition(first, len(first) - k)[len(first) - k] if len(first) >= k else -np.inf
    # Non-essential: the longest tail of terms that cannot lift a row by itself to the threshold.
    split = int(np.searchsorted(-after, -(threshold - base), side="right")) if np.isfinite(threshold) else len(order)
    split = min(max(split, 1), len(order))
    essential = order[:split]
    partial = query[essential] @ rows[essential] - least[essential].sum() + base
    at = np.flatnonzero((partial + after[split] >= threshold) & (ids != own))
    score = partial[at]
    for place in range(split, len(order)):
        if len(at) > k:  # rows' partial scores are lower bounds of their scores, so the threshold may rise
            threshold = max(threshold, np.partition(score, len(score) - k)[len(score) - k])
        still = score + after[place] >= threshold
        at, score = at[still], score[still]
        term = order[place]
        score = score + query[term] * rows[term, at] - least[term]
    best = np.lexsort((ids[at], -score))[:k]
    return [(int(score[i]), int(ids[at[i]])) for i in best]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products over all rows but its own id.

    Components become floor(scale * x). Ties go to the smaller id; a query with fewer other rows gets them all.
    Vectors that are null, empty, or hold null or non-finite components take no part, nor do null ids; vectors
    of another length than the query's are no candidates. Of rows that repeat an id the one with the smallest
    vector counts. Every block of queries meets every shard in one task of bounded size: a shard is sent once
    for each block of queries, nothing is broadcast. Exact while scores stay under 2^53.
    """

    def whole(df: DataFrame) -> DataFrame:
        v = F.col(vector_col)
        fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
        cells = F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
        return df.filter(fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), cells.alias("v")).groupBy("id").agg(F.min("v").alias("v"))

    rows, asked = whole(vectors), whole(queries)
    n_rows = vectors.count()
    n_shards = max(1, -(-n_rows // shard_rows), min(LEAST_SHARDS, n_rows // 512))
    n_blocks = max(1, -(-queries.count() // query_block))
    shard, block = F.pmod(F.xxhash64("id"), F.lit(n_shards)), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_blocks))
    left = asked.select("id", "v", block.alias("block"), F.size("v").alias("width"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))).alias("shard"))
    right = rows.select("id", "v", shard.alias("shard"), F.size("v").alias("width"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"))

    def search(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(r):
            r = r.sort_values("id")
            ids, matrix = r["id"].to_numpy(), np.stack(r["v"].to_numpy()).astype(float).T.copy()
            low, high = matrix.min(axis=1), matrix.max(axis=1)
            for own, v in zip(q["id"], q["v"]):
                out += [(own, i, s) for s, i in maxscore(np.asarray(v, dtype=float), matrix, ids, own, k, low, high)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")

    keys = ["block", "shard", "width"]
    found = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def op3_topk_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = parquet(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""
