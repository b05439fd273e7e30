"""Audit events as a stream: keyed state that checks transitions and extends each run's hash chain."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reckon.operators.audit import GENESIS, STATES

OUTPUT = "run_id long, event_sequence long, state string, payload string, accepted boolean, previous_event_hash string, event_hash string"
STATE = "event_sequence long, state string, event_hash string"


def legal(before: str | None, state: str) -> bool:
    """PENDING first, then each state in order; DATA_COMMITTED may repeat."""
    at = -1 if before is None else STATES.index(before)
    return state in STATES and (STATES.index(state) == at + 1 or (state == before == "DATA_COMMITTED"))


def extend(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState, kept_ms: int | None = None) -> Iterator[pd.DataFrame]:
    """Events of one run in arrival order (by `ts` within a batch); refused events change nothing and get no hash.

    With kept_ms, a run whose last state is reached is forgotten when so long has passed without an event; an open one never
    is, since its chain could not go on.
    """
    if group.hasTimedOut:
        group.remove()
        return
    sequence, before, last = group.get if group.exists else (0, None, GENESIS)
    for b in batches:
        out = []
        for state, payload in b.sort_values("ts")[["state", "payload"]].itertuples(index=False):
            ok = legal(before, state)
            previous = last
            if ok:
                sequence, before = sequence + 1, state
                last = hashlib.sha256("\u001f".join((str(key[0]), str(sequence), state, previous, payload or "")).encode()).hexdigest()
            out.append((key[0], sequence if ok else None, state, payload, ok, previous, last if ok else None))
        group.update((sequence, before, last))
        if kept_ms and before == STATES[-1]:
            group.setTimeoutDuration(kept_ms)
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])
        yield frame.astype({"event_sequence": "Int64"})


def audit_stream(events: DataFrame, kept_ms: int | None = None) -> DataFrame:
    """events (run_id, ts, state, payload), streaming: each with its place in the run's chain, or refused.

    kept_ms: how long a finished run's state stays, so that late events of it are still refused. A query that goes on needs
    it, or its state grows with the runs; one that ends with its input has none, since timeouts keep triggers going.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        yield from extend(key, batches, group, kept_ms)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if kept_ms else GroupStateTimeout.NoTimeout
    return events.groupBy("run_id").applyInPandasWithState(step, OUTPUT, STATE, "append", timeout)


def landing_stream(spark, schema: str, path: str, files_per_trigger: int = 1, watermark: tuple[str, str] | None = None) -> DataFrame:
    """Parquet files as they land, a bounded number a trigger. watermark: a time column and how late its rows may come."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withWatermark(*watermark) if watermark else rows
