"""Streams of run records that write events beside their results, once each, and stop when they cost too much."""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.evaluation import HALT_AFTER, HALT_FACTOR

METRIC = "trajet_cost"
WAIT_S = 120


def side_events(records: DataFrame) -> DataFrame:
    """Run records -> the events of their turns: (bench, config_id, seed, task_id, turn_index, position, kind, payload).

    A turn gives its compactions and recalls in their order, then its class signal if it has one; payloads are JSON without
    the fields that are not given. Records without turns give nothing.
    """
    key = ["bench", "config_id", "seed", "task_id"]
    turns = records.select(*key, F.explode("turns").alias("t"))
    signal = F.when(F.col("t.class_signal").isNotNull(), F.array(F.struct(F.col("t.turn_index").alias("turn_index"), F.col("t.class_signal.class").alias("class"), F.col("t.class_signal.confidence").alias("confidence"))))
    parts = []
    for at, (kind, events) in enumerate((("compaction", F.col("t.compaction_events")), ("recall", F.col("t.recall_events")), ("class_signal", signal))):
        one = turns.select(*key, F.coalesce("t.turn_index", F.lit(0)).alias("turn_index"), F.posexplode(events).alias("place", "e"))
        parts.append(one.select(*key, "turn_index", (F.col("place") + F.lit(at) * 1_000_000).cast("long").alias("position"), F.lit(kind).alias("kind"), F.to_json("e").alias("payload")))
    return reduce(DataFrame.unionAll, parts)


def to_folders(root: str, before: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: a batch's records go to root/records/batch=<id>, their events to root/events/batch=<id>.

    A batch that comes again after a failure replaces what it wrote before, so nothing is there twice, whichever of the
    two outputs the failure left behind.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if before:
            before(batch_id)
        batch = batch.persist()
        try:
            batch.write.mode("overwrite").json(f"{root}/records/batch={batch_id}")
            side_events(batch).write.mode("overwrite").json(f"{root}/events/batch={batch_id}")
        finally:
            batch.unpersist()

    return write


class CostGuard(StreamingQueryListener):
    """Adds up the observed costs of a query's batches, each once, and stops the query when the mean cost of HALT_AFTER
    tasks or more, times all tasks, passes the budget by HALT_FACTOR. Works on one query."""

    def __init__(self, total_tasks: int, budget_usd: float, least: int = HALT_AFTER, factor: float = HALT_FACTOR):
        self.total_tasks, self.budget, self.least, self.factor = total_tasks, budget_usd, least, factor
        self.tasks, self.usd = 0, 0.0
        self.seen: set[int] = set()
        self.halted_at: int | None = None
        self.reason: str | None = None
        self._told = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(METRIC)
        self.observe(event.progress.batchId, found["tasks"] if found else 0, found["usd"] if found else 0.0)

    def observe(self, batch_id: int, tasks: int, usd: float | None) -> None:
        with self._told:
            if batch_id not in self.seen and self.halted_at is None:
                self.seen.add(batch_id)
                self.tasks += tasks or 0
                self.usd += usd or 0.0
                projected = self.usd / self.tasks * self.total_tasks if self.tasks else 0.0
                if self.tasks >= self.least and projected > self.factor * self.budget:
                    self.halted_at = batch_id
                    self.reason = f"projected ${projected:.2f} > {self.factor}× budget ${self.budget:.2f} after {self.tasks} tasks"
            self._told.notify_all()

    def let_pass(self, batch_id: int) -> None:
        """Called before a batch writes: waits until the one before has been counted, and refuses once the guard has
        halted. A refused batch is not committed, so a later start of the stream begins with it."""
        with self._told:
            if self.seen:
                self._told.wait_for(lambda: max(self.seen) >= batch_id - 1, WAIT_S)
            if self.halted_at is not None:
                raise Halted(self.reason)


class Halted(Exception):
    """The guard's refusal."""


def run_guarded(records: DataFrame, root: str, checkpoint: str, guard: CostGuard, cost: str = "cost_usd") -> int | None:
    """Runs a stream of records into to_folders until its input ends or the guard halts it; the batch at which it halted,
    which is written, or None. Costs that are null count as tasks without a cost."""
    spark = records.sparkSession
    seen = records.observe(METRIC, F.count(F.lit(1)).alias("tasks"), F.coalesce(F.sum(cost), F.lit(0.0)).alias("usd"))
    spark.streams.addListener(guard)
    try:
        query = seen.writeStream.foreachBatch(to_folders(root, guard.let_pass)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception:
            if guard.halted_at is None:
                raise
    finally:
        spark.streams.removeListener(guard)
    return guard.halted_at
