"""Progress of a run with cooperative cancelling, and versioned review intents folded into a state."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Phases in the order in which a run passes them; the last three end it.
PHASES = ("queued", "discovering", "reading", "matching", "calculating", "writing", "validating", "completed", "failed", "cancelled")
TERMINAL = ("completed", "failed", "cancelled")


class Cancelled(RuntimeError):
    """The run was cancelled before its result was published."""


@dataclass(frozen=True)
class Progress:
    phase: str
    processed: int
    total: int | None
    started_at: float
    updated_at: float
    cause: str | None = None


@dataclass
class Lifecycle:
    """Snapshots of one attempt. Its Spark jobs carry the tag, so that cancelling interrupts them on the cluster too."""

    tag: str
    callback: Callable[[Progress], None] | None = None
    started_at: float = field(default_factory=time.time)
    last: Progress | None = None
    cancelled: bool = False

    def emit(self, phase: str, processed: int = 0, total: int | None = None, cause: str | None = None) -> Progress:
        """A snapshot; phases never go back, counters stay within their total, and a cause belongs to an end."""
        if self.cancelled and phase not in TERMINAL:
            raise Cancelled(self.tag)
        before = self.last
        if before and (before.phase in TERMINAL or PHASES.index(phase) < PHASES.index(before.phase)):
            raise ValueError(f"{before.phase} is not followed by {phase}")
        if processed < 0 or (total is not None and (total < 0 or processed > total)):
            raise ValueError("processed must lie within total")
        if cause is not None and phase not in TERMINAL:
            raise ValueError("only an end has a cause")
        now = max(time.time(), before.updated_at if before else self.started_at)
        self.last = Progress(phase, processed, total, self.started_at, now, cause)
        if self.callback:
            self.callback(self.last)
        return self.last

    def run(self, spark: SparkSession, phase: str, action: Callable[[], object]) -> object:
        """The action's result, its jobs tagged; Cancelled if the run was cancelled before or meanwhile."""
        self.emit(phase)
        spark.addTag(self.tag)
        try:
            out = action()
        except Exception as error:
            if self.cancelled:
                raise Cancelled(self.tag) from error
            raise
        finally:
            spark.removeTag(self.tag)
        if self.cancelled:
            raise Cancelled(self.tag)
        return out

    def cancel(self, spark: SparkSession) -> None:
        self.cancelled = True
        spark.interruptTag(self.tag)


def fold_intents(items: DataFrame, intents: DataFrame) -> DataFrame:
    """Every intent with its verdict: 'current' (the last valid one of its item), 'replaced', or why it was refused.

    items: queue_id, queue_fingerprint, item_id, item_fingerprint, row_override_count, allowed_actions, member_refs (sorted).
    intents: sequence, queue_id, expected_queue_fingerprint, item_id, expected_item_fingerprint, action, split_member_refs (flat).
    """
    i = items.select("queue_id", "item_id", "queue_fingerprint", "item_fingerprint", "row_override_count", "allowed_actions", "member_refs")
    rows = intents.join(i.withColumn("_there", F.lit(True)), ["queue_id", "item_id"], "left")
    queues = items.select("queue_id", F.col("queue_fingerprint").alias("_qf")).distinct()
    rows = rows.join(queues, "queue_id", "left")
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    why = (
        F.when(~same("expected_queue_fingerprint", "_qf"), "STALE_QUEUE").when(F.col("_there").isNull() | ~same("expected_item_fingerprint", "item_fingerprint"), "STALE_ITEM")
        .when(F.col("row_override_count") > 0, "ROW_OVERRIDES").when(~F.array_contains("allowed_actions", F.col("action")), "ACTION_NOT_ALLOWED")
        .when((F.col("action") == "split") & ~F.coalesce(F.array_sort("split_member_refs") == F.array_sort("member_refs"), F.lit(False)), "SPLIT_CHANGES_MEMBERS")
    )
    rows = rows.withColumn("_why", why)
    last = F.max(F.when(F.col("_why").isNull(), F.col("sequence"))).over(Window.partitionBy("queue_id", "item_id"))
    return rows.select("sequence", "queue_id", "item_id", "action", F.coalesce("_why", F.when(F.col("sequence") == last, "current").otherwise("replaced")).alias("verdict"))
