"""A chain of named stages, each written as Parquet, so that a run can start at any stage or do one alone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Stage = Callable[[SparkSession, DataFrame | None], DataFrame]


@dataclass
class Chain:
    """``stages`` are (name, function of the predecessor's table); ``folder`` holds a table for each."""

    stages: list[tuple[str, Stage]]
    folder: str

    def path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}"

    def run(self, spark: SparkSession, start: str | None = None, only: str | None = None) -> DataFrame:
        """Runs all stages, those from ``start`` on, or ``only`` one; earlier results are read from the folder."""
        names = [n for n, _ in self.stages]
        for asked in (start, only):
            if asked is not None and asked not in names:
                raise ValueError(f"no stage {asked!r}; there are {', '.join(names)}")
        first = names.index(only or start or names[0])
        last = names.index(only) if only else len(names) - 1
        before = spark.read.parquet(self.path(names[first - 1])) if first else None
        for name, fn in self.stages[first : last + 1]:
            fn(spark, before).write.mode("overwrite").parquet(self.path(name))
            before = spark.read.parquet(self.path(name))
        return before
