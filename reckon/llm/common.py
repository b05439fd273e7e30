"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that str.split() knows besides the six ASCII ones.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
ASCII_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_words(text: str) -> list[str]:
    """Runs of characters other than the six ASCII white-space characters."""
    return ASCII_WORD.findall(text) if OTHER_SPACE.search(text) else text.split()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir. Only a session whose one machine does all the work (tests)
    gets a folder of its own where none is named; a cluster without one is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage (reliable, survives lost executors).

    Its rows are on shared storage then, so the shuffle files of the run that made them go at its end rather than at
    some later garbage collection; the session's setting for that is put back.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(_CLEANUP, before)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns the operators need; all other columns, whatever their names, are dropped."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def remainder(id_col: str, n: int):
    """crc32 of the id as text, modulo n. A null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % n


def parquet(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
