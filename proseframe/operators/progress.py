"""Progress of a chain of steps: how many rows passed each, without a job of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class ProgressLog:
    """Watches steps of a plan; when an action has run over them, lines() tells the rows that passed each."""

    def __init__(self) -> None:
        self.steps: list[tuple[str, Observation]] = []

    def watch(self, df: DataFrame, name: str) -> DataFrame:
        seen = Observation(f"{len(self.steps)}-{name}")
        self.steps.append((name, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"))

    def lines(self) -> list[tuple[str, int]]:
        """(step, rows), in the order of watching. Waits for an action over the last step."""
        return [(name, seen.get["rows"]) for name, seen in self.steps]
