"""Operators 4 (quality classifier) and 8 (quality rules): boosted trees over statistics of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reckon.llm import statistics, trees
from reckon.llm.common import ascii_words, parquet, remainder, texts

#: Labelled rows that a fit takes at most: those with the smallest hash of their id, so the same at any layout.
FIT_ROWS = 8000
#: Label 1 is predicted from this score on.
PREDICT_FROM = 0.7
#: Features of the rules by the sign their verdict must follow: more of each of these never helps a text.
RULE_NAMES = ("log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "distinct_words", "sentence_ends")
RULE_SIGNS = {2: -1, 3: -1, 4: -1, 5: -1}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def labelled(docs: DataFrame, labels: DataFrame, column: str, rows: int = FIT_ROWS) -> DataFrame:
    """At most `rows` texts with a non-null 0/1 label, one for each id: those whose hashed id is smallest.

    The labels are cut to the bound before texts are joined, so the join's small side is bounded by `rows` and the
    texts are read once, without a shuffle of theirs. An id with several labels counts as its largest.
    """
    few = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
        .filter("doc_id is not null and label in (0, 1)")
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    return texts(docs).join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def fitted(training: DataFrame, vector, width: int, **options) -> trees.Forest:
    """Fit on the vectors of `training` (doc_id, text, label); vectors are made by tasks, at most FIT_ROWS gathered."""

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "x": [vector(t) for t in b["text"]]})

    rows = sorted(training.mapInPandas(vectors, "doc_id long, label int, x array<double>").collect())
    x = np.array([r.x for r in rows], dtype=float).reshape(-1, width)
    return trees.fit(x, np.array([r.label for r in rows], dtype=float), **options)


def quality_scores(docs: DataFrame, labels: DataFrame, held_out_remainder: int = 2, modulus: int = 4):
    """Fit on the labelled rows that are not held out; returns a function from a text column to its score column."""
    model = fitted(labelled(docs, labels.filter(remainder("doc_id", modulus) != held_out_remainder), "quality"), statistics.features, len(statistics.NAMES))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            x = np.array([statistics.features(t or "") for t in b], dtype=float).reshape(-1, len(statistics.NAMES))
            yield pd.Series(model.score(x))

    return scored


def classify(docs: DataFrame, labels: DataFrame, held_out_remainder: int = 2, modulus: int = 4, predict_from: float = PREDICT_FROM) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Learns label `quality` only from rows whose crc32(doc_id as text) mod `modulus` differs from the held-out
    remainder, at most FIT_ROWS of them. Scores come from the text alone. A null text counts as empty; a text without
    words has all features 0 and is scored as such; a null id hashes as ''. Without usable labels every score is
    0.5. Repeated rows give repeated rows; other columns are ignored.
    """
    scored = quality_scores(docs, labels, held_out_remainder, modulus)
    out = texts(docs).select("doc_id", scored("text").alias("score"))
    return out.select("doc_id", (remainder("doc_id", modulus) == held_out_remainder).alias("held_out"), "score", (F.col("score") >= predict_from).cast("int").alias("predicted"))


def rule_vector(text: str, counts: tuple[int, ...] | None = None) -> list[float]:
    """The rules' inputs (RULE_NAMES) from the base counts and the text; all 0 for a text without words."""
    n_words, word_chars, n_symbols, n_dup, n_repeat = counts or statistics.base_counts(text)
    if not n_words:
        return [0.0] * len(RULE_NAMES)
    size = statistics.byte_counts(text)
    lines, distinct = statistics.repeated_lines(text.split("\n"))[0], len(set(ascii_words(text)))
    return [float(np.log1p(n_words)), word_chars / n_words, n_symbols / max(1, word_chars), n_dup / lines, n_repeat / n_words, statistics.share(size, "upper"), distinct / n_words, float(size[[33, 46, 63]].sum()) / n_words]


def quality_rules(docs: DataFrame, labels: DataFrame, keep_from: float = 0.5) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    base_failed: under 50 words, or more than half of the words repeated in three-word windows. kept: not
    base_failed, and the score of trees fitted on label `quality` (at most FIT_ROWS labelled rows) is keep_from or
    more. The score never rises with the shares of symbols, repeated lines, repeated words and capitals. Null text
    counts as empty (0 words, failed); null ids and repeated rows stay; without usable labels all scores are 0.5.
    """
    model = fitted(labelled(docs, labels, "quality"), rule_vector, len(RULE_NAMES), monotone=RULE_SIGNS)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts = [statistics.base_counts(t) for t in b["text"]]
            x = np.array([rule_vector(t, c) for t, c in zip(b["text"], counts)], dtype=float).reshape(-1, len(RULE_NAMES))
            out = pd.DataFrame(np.array(counts, dtype="int64").reshape(-1, len(BASE)), columns=BASE)
            yield out.assign(doc_id=b["doc_id"].astype("Int64").to_numpy(), score=model.score(x))

    out = texts(docs).mapInPandas(scored, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & (F.col("score") >= keep_from)).alias("kept"), "score")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "labels"))
