"""The driver loop that iterative plans share.

A step maps a state to the next one with a boolean column ``changed``.  Every iteration is one
job: the reliable checkpoint that cuts the lineage also counts the changes, by an observation.
Only that count reaches the driver.  Hitting the cap is an error, never a silent wrong answer.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from knotwork.plans import scratch


class NotConverged(RuntimeError):
    """The state still changed after the last permitted iteration."""


@dataclass
class Result:
    """labels(id, component) and the number of iterations, the last, unchanged one included; ``seconds``
    says for solvers with several phases how long each took."""

    labels: DataFrame
    iterations: int
    seconds: dict[str, float] = field(default_factory=dict)

    def component_count(self) -> int:
        return self.labels.agg(F.count_distinct("component")).first()[0]


def settle(step: Callable[[DataFrame], DataFrame], state: DataFrame, cap: int = 10_000, keep: bool = False) -> tuple[DataFrame, int]:
    """Apply step until nothing changes.  ``keep`` leaves the column ``changed`` in the state, for
    steps that send only what changed."""
    before = None
    for n in range(1, cap + 1):
        seen = Observation()
        now = scratch.checkpoint(step(state).observe(seen, F.sum(F.col("changed").cast("long")).alias("changes")))
        if before is not None:
            scratch.drop(before)
        before, state = now, now if keep else now.drop("changed")
        if not seen.get["changes"]:
            return state, n
    raise NotConverged(f"labels still changed after {cap} iterations")
