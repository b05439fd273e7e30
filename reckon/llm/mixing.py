"""Operator 10, mixing sources to target weights: iterative proportional fitting. DataFrame functions only.

Documents are counted into cells (source, language, topic). Raking scales the cells' weights in words to the target
shares of each dimension in turn, sweep after sweep, until all shares are met. A cell's raked weight over its weight at first is its
documents' relative sampling rate. With a share of the tokens to keep, a probability is factor * rate, 1 at most, with
the factor that keeps this share, so a rare cell is kept whole and does not shrink the others; without one, the largest
rate becomes probability 1. A document stays if its hashed id, as a number in [0, 1), is under its cell's probability.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reckon.llm.common import cut, parquet

DIMENSIONS = ("source", "lang", "topic")
#: Target share of a value: its share of the tokens to this power, made to sum to 1. 0 is uniform, 1 is as it is.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.9}
#: Sweeps that are planned at once; more follow while a share is off by more than the tolerance, as often as stated.
SWEEPS, TOLERANCE, MOST_ROUNDS = 12, 1e-6, 8
#: Cells up to which their table is sent to all executors (about 100 bytes a cell); beyond it rows are joined by shuffle.
SENT_CELLS = 20_000
#: Decimal places of probabilities.
PLACES = 9
#: Share of the tokens that the pipeline keeps.
KEPT = 0.5


def n_words(text: Column) -> Column:
    """Words (runs of characters other than ASCII white space) of a text; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")), F.lit(0)).cast("long")


#: Topics told from a text's characters where documents name none: characters of a kind, and the share they must pass.
MARKUP, DIGITS, TALK = ("{}[]()<>=;|", 50), ("0123456789", 12), ("\"?!", 60)


def text_topic(text: Column) -> Column:
    """'markup', 'numbers', 'talk' or 'prose' by the share of marks, digits, and quotes and exclamations; 'none' without text."""
    size = F.length(text)
    kinds = (MARKUP, DIGITS, TALK)
    every = re.escape("".join(k for k, _ in kinds))
    few = F.regexp_replace(text, f"[^{every}]+", "")  # read once; what is left is short

    def told(found: Column) -> Column:
        many = lambda kind: (F.length(found) - F.length(F.translate(found, kind[0], ""))) * kind[1] > size
        return F.when(many(MARKUP), "markup").when(many(DIGITS), "numbers").when(many(TALK), "talk").otherwise("prose")

    return F.when(F.coalesce(size, F.lit(0)) == 0, "none").otherwise(F.get(F.transform(F.array(few), told), F.lit(0)))


def residuals(cells: DataFrame) -> DataFrame:
    """(dimension, value, target, reached, residual) of raked cells that carry want_* columns: how far each marginal is off."""
    out = None
    for name in DIMENSIONS:
        part = cells.groupBy(F.lit(name).alias("dimension"), F.col(name).alias("value")).agg(F.max(f"want_{name}").alias("target"), F.sum("share").alias("reached"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("residual", F.abs(F.col("target") - F.col("reached")))


def wanted(cells: DataFrame, powers: dict[str, float], targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """cells with share, first_share and the target share want_* of each dimension's value."""
    all_rows = Window.partitionBy(F.lit(1))
    out = cells.coalesce(1).withColumn("share", F.col("tokens") / F.sum("tokens").over(all_rows))
    for name in DIMENSIONS:
        if targets and name in targets:
            want = targets[name].groupBy(F.coalesce(F.col("value").cast("string"), F.lit("")).alias(name)).agg(F.sum("weight").cast("double").alias(f"want_{name}"))
            out = out.join(want, name, "left").coalesce(1).withColumn(f"want_{name}", F.coalesce(f"want_{name}", F.lit(0.0)))
        else:
            out = out.withColumn(f"want_{name}", F.pow(F.sum("share").over(Window.partitionBy(name)), F.lit(powers[name])))
        once = F.row_number().over(Window.partitionBy(name).orderBy(*DIMENSIONS)) == 1
        out = out.withColumn("_first", once).withColumn(f"want_{name}", F.col(f"want_{name}") / F.sum(F.when(F.col("_first"), F.col(f"want_{name}"))).over(all_rows)).drop("_first")
    return out.withColumn("first_share", F.col("share"))


def swept(cells: DataFrame, sweeps: int) -> DataFrame:
    out = cells.coalesce(1)
    for _ in range(sweeps):
        for name in DIMENSIONS:
            out = out.withColumn("share", F.coalesce(F.try_divide(F.col("share") * F.col(f"want_{name}"), F.sum("share").over(Window.partitionBy(name))), F.lit(0.0)))
    return out


def rates(cells: DataFrame, kept: float | None = None) -> DataFrame:
    """Raked cells with probability. kept: share of the tokens that the probabilities keep; cells of weight 0 are never kept."""
    all_rows = Window.partitionBy(F.lit(1))
    rate = F.col("share") / F.col("first_share")
    out = cells.coalesce(1)
    if kept is None:
        scaled = F.try_divide(rate, F.max(rate).over(all_rows))
    else:
        # With the cells before a row at 1, its factor gives the others the rest; of those that keep the row within 1, the largest.
        falling = all_rows.orderBy(F.desc("_rate"), *DIMENSIONS)
        out = out.withColumn("_rate", rate)
        before = F.sum("tokens").over(falling) - F.col("tokens")
        rest = F.sum(F.col("_rate") * F.col("tokens")).over(falling.rowsBetween(0, Window.unboundedFollowing))
        out = out.withColumn("_factor", F.try_divide(F.lit(kept) * F.sum("tokens").over(all_rows) - before, rest))
        factor = F.max(F.when(F.col("_factor") * F.col("_rate") <= 1, F.greatest("_factor", F.lit(0.0)))).over(all_rows)
        scaled = F.when(F.col("_rate") > 0, F.least(F.lit(1.0), F.coalesce(factor * F.col("_rate"), F.lit(1.0)))).otherwise(0.0)
    return out.withColumn("probability", F.round(scaled, PLACES)).select(*DIMENSIONS, "tokens", "share", *(f"want_{n}" for n in DIMENSIONS), "probability")


def raked(cells: DataFrame, powers: dict[str, float], sweeps: int, targets: dict[str, DataFrame] | None = None, kept: float | None = None) -> DataFrame:
    """cells with share (raked), want_* and probability. cells: DIMENSIONS, tokens (at least 1).

    The cells are one partition, so the windows need no shuffle; their number is that of sources times languages times
    topics. targets: dimension -> (value, weight) instead of a power; values without a target get weight 0, and what a
    dimension's present values have sums to 1. After `sweeps` sweeps the marginals are looked at, and as many follow while
    one is off by more than TOLERANCE; after MOST_ROUNDS rounds the shares stay as they are (targets that no weights
    meet, such as a value whose only cells have weight 0). `residuals` tells how far each marginal is off.
    """
    out = cut(swept(wanted(cells, powers, targets), sweeps))
    for _ in range(MOST_ROUNDS):
        if (residuals(out).agg(F.max("residual")).first()[0] or 0) <= TOLERANCE:
            break
        out = cut(swept(out, sweeps))
    return rates(out, kept)


def mix(docs: DataFrame, powers: dict[str, float] = POWERS, sweeps: int = SWEEPS, targets: dict[str, DataFrame] | None = None, topic: str | None = None, id_col: str = "doc_id", text_col: str = "text", kept: float | None = None) -> DataFrame:
    """All rows and columns of docs with n_words, probability and sampled.

    Words stand for tokens: counting a vocabulary's tokens takes Python, which has no place here. topic: a column of docs;
    without it text_topic tells one. Nulls in a dimension are the value ''. A text without words weighs 1, so its
    cell stays defined; a null id hashes as ''; rows of one id are kept or left together. kept: share of the words to
    keep (None: as many as leave the highest rate at probability 1). An empty table gives no rows. Columns of docs
    with one of the new names are replaced. A hot source is only a group with partial sums.
    """
    new = ("n_words", "probability", "sampled")
    names = [c for c in docs.columns if c not in new]
    key = {"source": F.col("source").cast("string"), "lang": F.col("lang").cast("string"), "topic": F.col(topic).cast("string") if topic else text_topic(F.col(text_col).cast("string"))}
    base = docs.select(*names, n_words(F.col(text_col)).alias("_n"))
    base = base.select(*names, "_n", *(F.coalesce(c, F.lit("")).alias(f"_{k}") for k, c in key.items()))
    cells = cut(base.groupBy(*(F.col(f"_{k}").alias(k) for k in DIMENSIONS)).agg(F.sum(F.greatest("_n", F.lit(1))).alias("tokens")))
    table = cut(raked(cells, powers, sweeps, targets, kept)).select(*(F.col(k).alias(f"_{k}") for k in DIMENSIONS), "probability")
    if cells.count() <= SENT_CELLS:
        table = F.broadcast(table)
    place = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / 2.0**32
    out = base.join(table, [f"_{k}" for k in DIMENSIONS], "left")
    return out.select(*names, F.col("_n").alias("n_words"), "probability", (place < F.col("probability")).alias("sampled"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(parquet(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")).select("doc_id", "n_words", "probability", "sampled")


def _sql() -> str:
    many = lambda kind: f"(length(text) - length(translate(text, '{kind[0]}', ''))) * {kind[1]} > length(text)"
    steps = [
        """b AS (SELECT doc_id, text, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
  CAST(coalesce(len(list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')), 0) AS BIGINT) AS n FROM documents)""",
        f"d AS (SELECT *, CASE WHEN coalesce(length(text), 0) = 0 THEN 'none' WHEN {many(MARKUP)} THEN 'markup' WHEN {many(DIGITS)} THEN 'numbers' WHEN {many(TALK)} THEN 'talk' ELSE 'prose' END AS topic FROM b)",
        "c AS (SELECT source, lang, topic, CAST(sum(greatest(n, 1)) AS DOUBLE) AS tokens FROM d GROUP BY ALL)",
        "s0 AS (SELECT *, tokens / sum(tokens) OVER () AS share FROM c)",
        "p AS (SELECT *, share AS first_share, " + ", ".join(f"pow(sum(share) OVER (PARTITION BY {k}), {POWERS[k]}) AS w_{k}, row_number() OVER (PARTITION BY {k} ORDER BY source, lang, topic) AS r_{k}" for k in DIMENSIONS) + " FROM s0)",
        "t0 AS (SELECT source, lang, topic, share, first_share, " + ", ".join(f"w_{k} / sum(CASE WHEN r_{k} = 1 THEN w_{k} END) OVER () AS want_{k}" for k in DIMENSIONS) + " FROM p)",
    ]
    at = 0
    for _ in range(SWEEPS):
        for k in DIMENSIONS:
            steps.append(f"t{at + 1} AS MATERIALIZED (SELECT * REPLACE (share * want_{k} / sum(share) OVER (PARTITION BY {k}) AS share) FROM t{at})")
            at += 1
    steps.append(f"f AS (SELECT source, lang, topic, round(share / first_share / max(share / first_share) OVER (), {PLACES}) AS probability FROM t{at})")
    return "WITH " + ",\n".join(steps) + """
SELECT doc_id, n AS n_words, probability, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 < probability AS sampled
FROM d JOIN f USING (source, lang, topic)"""


ORACLE_SQL = _sql()
