"""Running state of a stream as levelled runs: small ones are merged into larger ones, so that few are ever read.

A batch adds one run.  When a level holds ``fan`` runs they are merged into one of the next level,
so after n batches there are at most ``fan - 1`` runs on each of log n levels.  Which runs are
current is one small list per batch, written last as a single file: a reader sees the list before
or the list after, and a batch that is run again starts from the list before it.  Lists and runs
that neither the last nor the list before it names are deleted.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.session import delete_path, list_path

FAN = 8
LIST = "run string, level int, number long"


def sums(*by: str) -> Callable[[DataFrame], DataFrame]:
    """A merge that adds up all other columns."""
    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in by])

    return merge


def latest(*by: str, order: str = "batch") -> Callable[[DataFrame], DataFrame]:
    """A merge that keeps, of the rows with one key, those of the last batch."""
    def merge(rows: DataFrame) -> DataFrame:
        last = F.max(order).over(Window.partitionBy(*by))
        return rows.withColumn("_last", last).filter(F.col(order) == F.col("_last")).drop("_last")

    return merge


@dataclass(frozen=True)
class Levels:
    spark: SparkSession
    path: str
    merge: Callable[[DataFrame], DataFrame]
    fan: int = FAN

    def _lists(self) -> list:
        """The entries of the last two lists: a few runs each, all there is."""
        try:
            return self.spark.read.schema(LIST).parquet(f"{self.path}/lists").collect()
        except AnalysisException:
            return []

    def runs(self, before: int | None = None) -> list[str]:
        """Runs of the last list, of those before a batch if one is given."""
        return [r.run for r in _last(self._lists(), before)]

    def _union(self, runs: list[str]) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/runs/{r}") for r in runs])

    def read(self, before: int | None = None) -> DataFrame | None:
        """The merged state, as it was before a batch if one is given; None if there is none."""
        runs = self.runs(before)
        return self.merge(self._union(runs)) if runs else None

    def _write(self, rows: DataFrame, level: int, number: int) -> tuple[str, int]:
        run = f"{number}-{level}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/runs/{run}")
        return run, level

    def add(self, rows: DataFrame, number: int) -> None:
        """Put the rows of batch ``number`` beside what the batches before it left."""
        lists = self._lists()
        known = _last(lists, number)
        runs = [(r.run, r.level) for r in known] + [self._write(rows, 0, number)]
        level = 0
        while len(full := [r for r, at in runs if at == level]) >= self.fan:
            merged = self._write(self.merge(self._union(full)), level + 1, number)
            runs = [(r, at) for r, at in runs if at != level] + [merged]
            level += 1
        listed = self.spark.createDataFrame([(r, at, number) for r, at in runs], LIST).coalesce(1)
        listed.write.mode("overwrite").parquet(f"{self.path}/lists/at={number}")
        used = {number, *(r.number for r in known)}
        for old in {r.number for r in lists} - used:
            delete_path(self.spark, f"{self.path}/lists/at={old}")
        kept = {r for r, _ in runs} | {r.run for r in known}
        for name in set(list_path(self.spark, f"{self.path}/runs")) - kept:
            delete_path(self.spark, f"{self.path}/runs/{name}")


def _last(lists: list, before: int | None) -> list:
    found = [r for r in lists if before is None or r.number < before]
    number = max((r.number for r in found), default=None)
    return [r for r in found if r.number == number]
