"""What a benchmark run is made of, as functions between DataFrames, and the run itself.

An adapter gives tasks; a baseline answers them turn by turn; a grader scores answers; a token counter and a price tell
what they cost. Each is a plain function, so any of them can be exchanged, and a run is one plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_tokens

#: Tasks of a seed: (task_id, turn_index, prompt, expected); expected stands with the last turn.
Adapter = Callable[[int], DataFrame]
#: (task_id, turn_index, prompt) -> + response, null where the turn failed.
Baseline = Callable[[DataFrame], DataFrame]
#: (response, expected) -> a score, null where it cannot be judged.
Grader = Callable[[Column, Column], Column]
Counter = Callable[[Column], Column]


def echo(turns: DataFrame) -> DataFrame:
    """The stub baseline: every prompt comes back."""
    return turns.withColumn("response", F.col("prompt"))


def exact(response: Column, expected: Column) -> Column:
    """The stub grader: 1 for the same text but for case and outer blanks."""
    plain = lambda c: F.lower(F.trim(c))
    return (plain(response) == plain(expected)).cast("double")


@dataclass(frozen=True)
class Bench:
    """A run's parts. rate_in, rate_out: US dollars a million tokens."""

    adapter: Adapter
    baseline: Baseline = echo
    grader: Grader = exact
    counter: Counter = char_tokens
    rate_in: float = 0.0
    rate_out: float = 0.0

    def run(self, seed: int) -> DataFrame:
        """(task_id, seed, response, score, n_turns, n_errors, input_tokens, output_tokens, cost_usd), a row a task.

        Turns after a task's first failed one do not count: they are neither paid nor answered, and such a task scores 0,
        as does one that cannot be judged. The response is that of the last turn.
        """
        turns = self.adapter(seed)
        answered = self.baseline(turns.select("task_id", "turn_index", "prompt")).select("task_id", "turn_index", "response")
        rows = turns.join(answered, ["task_id", "turn_index"], "left")
        failed = rows.filter("response is null").groupBy("task_id").agg(F.min("turn_index").alias("failed_at"))
        counted = rows.join(failed, "task_id", "left").filter("failed_at is null or turn_index <= failed_at")
        tokens = lambda c: F.coalesce(F.sum(self.counter(F.coalesce(c, F.lit("")))), F.lit(0))
        tasks = counted.groupBy("task_id").agg(
            F.max_by("response", "turn_index").alias("response"), F.max_by("expected", "turn_index").alias("expected"), F.count(F.lit(1)).alias("n_turns"),
            F.count_if(F.col("response").isNull()).alias("n_errors"), tokens(F.col("prompt")).alias("input_tokens"), tokens(F.col("response")).alias("output_tokens"),
        )
        score = F.when(F.col("n_errors") == 0, F.coalesce(self.grader(F.col("response"), F.col("expected")), F.lit(0.0))).otherwise(0.0)
        cost = (F.col("input_tokens") * self.rate_in + F.col("output_tokens") * self.rate_out) / 1e6
        return tasks.select("task_id", F.lit(seed).alias("seed"), "response", score.alias("score"), "n_turns", "n_errors", "input_tokens", "output_tokens", cost.alias("cost_usd"))
