"""Runs by content: the same inputs, versions and parameters are one run, which is found again and not repeated."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reckon.sources.files import canonical_json

SCHEMA = "run_key string, state string, output string, recorded_at timestamp"


def run_key(digests: dict[str, str], versions: dict[str, str], parameters: dict) -> str:
    """SHA-256 of the canonical JSON of everything that a run's result depends on."""
    return sha256(canonical_json({"digests": digests, "versions": versions, "parameters": parameters}).encode()).hexdigest()


def record(spark: SparkSession, path: str, key: str, state: str, output: str) -> None:
    """Append one line to the ledger (Parquet in any shared store)."""
    row = spark.createDataFrame([(key, state, output)], "run_key string, state string, output string").withColumn("recorded_at", F.current_timestamp())
    row.coalesce(1).write.mode("append").parquet(path)


def finished(spark: SparkSession, path: str, key: str) -> str | None:
    """The output of the newest line of a run, if that line says DONE."""
    try:
        rows: DataFrame = spark.read.schema(SCHEMA).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    last = rows.filter(F.col("run_key") == key).agg(F.max_by(F.struct("state", "output"), "recorded_at").alias("r")).first().r
    return last.output if last is not None and last.state == "DONE" else None
