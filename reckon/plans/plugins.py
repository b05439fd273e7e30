"""Plug-ins: text encoders, replay executors, outside suggestions, and local commands. All are callables a caller brings."""

from __future__ import annotations

import hashlib
import subprocess
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Encoder:
    """Texts to vectors of one width; identity and revision go into what is stored."""

    encode: Callable[[Sequence[str]], Sequence[Sequence[float]]]
    model_id: str
    revision: str
    width: int


def hashed_encoder(width: int = 16) -> Encoder:
    """A deterministic stand-in for a model: vectors from the words' hashes. Like texts get like vectors."""

    def encode(texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * width
            for word in t.lower().split():
                digest = hashlib.sha256(word.encode()).digest()
                v[digest[0] % width] += 1.0 if digest[1] % 2 else -1.0
            out.append(v)
        return out

    return Encoder(encode, "hashed-words", "1", width)


def embedded(rows: DataFrame, text: str, encoder: Encoder, out: str = "vector") -> DataFrame:
    """rows with the text's vector (null for null); each distinct text is encoded once, in Arrow batches.

    A vector of another width than the encoder's fails the task: a half-encoded table is worse than none.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            vectors = [[float(x) for x in v] for v in encoder.encode(b["_text"].tolist())] if len(b) else []
            if len(vectors) != len(b) or any(len(v) != encoder.width for v in vectors):
                raise ValueError(f"{encoder.model_id}: not one vector of width {encoder.width} for each text")
            yield pd.DataFrame({"_text": b["_text"], out: vectors})

    texts = rows.select(F.col(text).cast("string").alias("_text")).filter("_text is not null").distinct()
    found = texts.mapInPandas(encode, f"_text string, {out} array<double>")
    return rows.join(found, rows[text] == found["_text"], "left").drop("_text").withColumn("model_id", F.lit(encoder.model_id)).withColumn("model_revision", F.lit(encoder.revision))


Executor = Callable[[DataFrame], DataFrame]
Oracle = Callable[[DataFrame], DataFrame]


def replayed(cases: DataFrame, executor: Executor, oracle: Oracle) -> DataFrame:
    """(case_id, actual, expected, verdict) of cases under an executor and an oracle, both (cases) -> (case_id, outcome).

    'agree', 'disagree', 'abstained' (no outcome), or 'unknown' (the oracle has none).
    """
    got = executor(cases).groupBy("case_id").agg(F.min("outcome").alias("actual"))
    want = oracle(cases).groupBy("case_id").agg(F.min("outcome").alias("expected"))
    rows = cases.select("case_id").distinct().join(got, "case_id", "left").join(want, "case_id", "left")
    verdict = F.when(F.col("expected").isNull(), "unknown").when(F.col("actual").isNull(), "abstained").when(F.col("actual") == F.col("expected"), "agree").otherwise("disagree")
    return rows.withColumn("verdict", verdict)


def suggestions(rows: DataFrame, classify: Callable[[dict], dict], categories: tuple[str, ...]) -> DataFrame:
    """(row_id, category, confidence, evidence_ids, reason, status) from an outside classifier; none is ever applied.

    rows: row_id, text, unit, evidence (array of example ids). classify gets a row and returns category, confidence,
    evidence_ids, reason, requires_confirmation. An answer that fails, names another category, cites what it was not given, or
    confirms itself is 'rejected' with the reason; all others are 'needs_review'.
    """
    schema = "row_id string, category string, confidence double, evidence_ids array<string>, reason string, status string"

    def answer(row: dict) -> tuple:
        given = [str(x) for x in (row["evidence"] if row["evidence"] is not None else [])]
        try:
            said = classify({"text": row["text"], "unit": row["unit"], "evidence": given, "allowed_categories": list(categories)})
            cited = [str(x) for x in said["evidence_ids"]]
            why = "UNKNOWN_CATEGORY" if said["category"] not in categories else "UNKNOWN_EVIDENCE" if not set(cited) <= set(given) else "SELF_CONFIRMED" if not said["requires_confirmation"] else None
            if why is None:
                return row["row_id"], said["category"], float(said["confidence"]), cited, str(said["reason"]), "needs_review"
        except Exception as error:  # an outside service may fail in any way; its row goes to review by hand
            why = f"UNAVAILABLE:{type(error).__name__}"
        return row["row_id"], None, None, [], why, "rejected"

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([answer(r) for r in b.to_dict("records")], columns=["row_id", "category", "confidence", "evidence_ids", "reason", "status"])

    return rows.select(F.col("row_id").cast("string").alias("row_id"), "text", "unit", "evidence").mapInPandas(ask, schema)


def run_command(args: Sequence[str], timeout_seconds: float) -> subprocess.CompletedProcess[str]:
    """A local command without a shell, its output as text; TimeoutExpired when it takes too long."""
    if not args or any(not isinstance(a, str) or "\0" in a for a in args):
        raise ValueError("a command is a list of texts")
    return subprocess.run(list(args), capture_output=True, text=True, timeout=timeout_seconds, check=False)


def recognised(files: DataFrame, command: Callable[[str], Sequence[str]], timeout_seconds: float = 60.0, run: Callable = run_command) -> DataFrame:
    """(path, text, status) of files by an outside command, one run a file, in the tasks.

    status: 'ok', 'failed' (a non-zero end), 'timeout' or 'unavailable'. files: path, as the command finds it on every executor.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path in b["path"]:
                try:
                    done = run(command(path), timeout_seconds)
                    out.append((path, done.stdout if done.returncode == 0 else None, "ok" if done.returncode == 0 else "failed"))
                except subprocess.TimeoutExpired:
                    out.append((path, None, "timeout"))
                except OSError:
                    out.append((path, None, "unavailable"))
            yield pd.DataFrame(out, columns=["path", "text", "status"])

    return files.select("path").mapInPandas(read, "path string, text string, status string")
