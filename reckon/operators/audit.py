"""Hash-chained audit journals: creation, validation, states, redaction, activation."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The states in order; DATA_COMMITTED may repeat. The first event's previous hash.
STATES = ("PENDING", "DATA_COMMITTED", "EXPORT_PREPARED", "EXPORT_VERIFIED")
GENESIS = "0" * 64


def event_digest(*names: str):
    """The digest of an event: run, sequence, state, previous hash and the named payload columns, joined by U+001F."""
    return F.sha2(F.concat_ws("\u001f", *(F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names)), 256)


CHAINED = ("run_id", "event_sequence", "state", "previous_event_hash", "payload")


def chain(events: DataFrame) -> DataFrame:
    """events (run_id, event_sequence, state, payload) with previous_event_hash and event_hash.

    Every hash needs the one before, so a run is a fold: runs are dealt by id and streamed in order, so that a run of
    any length needs one event of memory.
    """
    import hashlib

    def fold(batches):
        run, last = None, GENESIS
        for b in batches:
            previous, hashes = [], []
            for r, s, state, payload in zip(b["run_id"], b["event_sequence"], b["state"], b["payload"]):
                if r != run:
                    run, last = r, GENESIS
                previous.append(last)
                last = hashlib.sha256("\u001f".join((str(r), str(s), state or "", last, payload or "")).encode()).hexdigest()
                hashes.append(last)
            yield b.assign(previous_event_hash=previous, event_hash=hashes)

    rows = events.select(F.col("run_id").cast("long").alias("run_id"), F.col("event_sequence").cast("long").alias("event_sequence"), "state", "payload")
    return rows.repartition("run_id").sortWithinPartitions("run_id", "event_sequence").mapInPandas(fold, "run_id long, event_sequence long, state string, payload string, previous_event_hash string, event_hash string")


def validate(events: DataFrame) -> DataFrame:
    """One row per run: n_events and error (null, SEQUENCE_GAP, HASH_CHAIN_INVALID or INVALID_STAGE_TRANSITION), first found."""
    w = Window.partitionBy("run_id").orderBy("event_sequence")
    place = {s: i for i, s in enumerate(STATES)}
    rank = F.create_map(*(F.lit(x) for pair in place.items() for x in pair))
    rows = events.select("*", F.row_number().over(w).alias("_n"), F.lag("event_hash", 1, GENESIS).over(w).alias("_h"), F.lag("state").over(w).alias("_s"))
    now, before = F.try_element_at(rank, F.col("state")), F.coalesce(F.try_element_at(rank, F.col("_s")), F.lit(-1))
    legal = F.coalesce((now == before + 1) | ((now == before) & (F.col("state") == "DATA_COMMITTED")), F.lit(False))
    error = (
        F.when(F.col("event_sequence") != F.col("_n"), "SEQUENCE_GAP").when(F.col("previous_event_hash") != F.col("_h"), "HASH_CHAIN_INVALID")
        .when(F.col("event_hash") != event_digest(*CHAINED), "HASH_CHAIN_INVALID").when(~legal, "INVALID_STAGE_TRANSITION")
    )
    return rows.select("run_id", "_n", error.alias("e")).groupBy("run_id").agg(F.count("*").alias("n_events"), F.min(F.when(F.col("e").isNotNull(), F.struct("_n", "e"))).alias("x")).select("run_id", "n_events", F.col("x.e").alias("error"))


def run_report(events: DataFrame) -> DataFrame:
    """Per run: n_events, first and last state, number of distinct states, and the run's report id."""
    out = events.groupBy("run_id").agg(
        F.count("*").alias("n_events"), F.min_by("state", "event_sequence").alias("first_state"), F.max_by("state", "event_sequence").alias("last_state"),
        F.count_distinct("state").alias("n_states"), F.max_by("event_hash", "event_sequence").alias("last_hash"),
    )
    return out.withColumn("report_id", F.sha2(F.concat_ws("\u001f", F.col("run_id").cast("string"), "last_hash"), 256))


def redacted(rows: DataFrame, allowed: Iterable[str]) -> DataFrame:
    """rows, unless a column is outside the allow-list or holds nested values: then an error, nothing is dropped."""
    if extra := sorted(set(rows.columns) - set(allowed)):
        raise ValueError(f"columns outside the allow-list: {extra}")
    if nested := [f.name for f in rows.schema.fields if f.dataType.typeName() in ("array", "map", "struct", "variant", "binary")]:
        raise ValueError(f"nested values: {nested}")
    return rows


def active_rules(versions: DataFrame, runs: DataFrame, inactive: DataFrame) -> DataFrame:
    """Feedback rule versions whose run reached EXPORT_VERIFIED, whose hashes still hold, and that were not compacted away."""
    done = runs.filter("last_state = 'EXPORT_VERIFIED'").select("run_id", F.col("rule_hash").alias("_r"), F.col("source_hash").alias("_s"))
    return versions.join(done, "run_id").filter("rule_hash = _r and source_hash = _s").drop("_r", "_s").join(inactive.select("rule_version_id"), "rule_version_id", "left_anti")


def without_invalidated(ledger: DataFrame) -> DataFrame:
    """Entries of an append-only ledger (event_id, invalidates) that no entry invalidates, nor are invalidations."""
    gone = ledger.filter("invalidates is not null").select(F.col("invalidates").alias("event_id"))
    return ledger.filter("invalidates is null").join(gone, "event_id", "left_anti")


def pandas_chain(b: pd.DataFrame) -> pd.DataFrame:
    """chain() of one run held in pandas (for streaming state functions and tests)."""
    import hashlib

    last, previous, hashes = GENESIS, [], []
    for r, s, state, payload in zip(b["run_id"], b["event_sequence"], b["state"], b["payload"]):
        previous.append(last)
        last = hashlib.sha256("\u001f".join((str(r), str(s), state or "", last, payload or "")).encode()).hexdigest()
        hashes.append(last)
    return b.assign(previous_event_hash=previous, event_hash=hashes)
