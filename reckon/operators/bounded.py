"""Configuration tables that are sent to every executor, behind a check of their size."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a table of rules, aliases or labels may have.
MOST_ROWS = 50_000


def sent(table: DataFrame, what: str, most: int = MOST_ROWS) -> DataFrame:
    """The table, marked to be broadcast. ValueError if it has more than `most` rows: it is no configuration then."""
    if table.limit(most + 1).count() > most:
        raise ValueError(f"{what}: more than {most} rows, too many to send to every executor")
    return F.broadcast(table)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the runs inside go at their ends; the session's setting for that is put back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
