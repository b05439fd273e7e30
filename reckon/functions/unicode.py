"""Exact Unicode steps that the JVM lacks, as Arrow-batched functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Compatibility composition; null stays null."""
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def casefold(values: pd.Series) -> pd.Series:
    """Full case folding (ß to ss, and so on); null stays null."""
    return values.map(lambda x: None if x is None else x.casefold())
