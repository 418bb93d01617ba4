"""What a fit leaves behind: parameters and moments by version, and a log with one entry per finished epoch.

An epoch's parameters go to a folder of their own; the log entry that names the folder is
written after them as a single file, and it is the commit: what no entry names was never there.  So
a fit that is ended at any point goes on after its last logged epoch.  One fit at a
time writes to a store.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = pa.schema([("col", pa.int32()), ("name", pa.string()), ("data", pa.list_(pa.float64()))])
# The parts of a column's state: its parameters and both moments of the optimizer.
PARTS = ("flat", "first", "second")
# Files of a version; its size is that of the parameters, not of the data.
WRITERS = 4


@dataclass(frozen=True)
class FitStore:
    spark: SparkSession
    path: str
    columns: tuple

    @property
    def log_ddl(self) -> str:
        losses = ", ".join(f"loss_{c} double" for c in self.columns)
        return f"epoch int, seconds double, steps int, optimizer_step long, version string, {losses}"

    def log(self) -> DataFrame:
        """``epoch, seconds, steps, optimizer_step, version`` and the mean loss of every column over the epoch's steps."""
        try:
            return self.spark.read.schema(self.log_ddl).parquet(f"{self.path}/log")
        except AnalysisException:
            return self.spark.createDataFrame([], self.log_ddl)

    def last_epoch(self) -> int | None:
        return self.log().agg(F.max("epoch")).first()[0]

    def commit(self, epoch: int, seconds: float, steps: int, optimizer_step: int, losses: dict, state: dict) -> None:
        """``state``: column -> its three arrays; written first, then the entry that names them."""
        version = uuid.uuid4().hex
        rows = [{"col": col, "name": name, "data": part} for col, parts in state.items() for name, part in zip(PARTS, parts)]
        self.spark.createDataFrame(pa.Table.from_pylist(rows, schema=STATE)).coalesce(WRITERS).write.parquet(f"{self.path}/parameters/version={version}")
        entry = (epoch, float(seconds), steps, optimizer_step, version, *[float(losses[c]) for c in self.columns])
        self.spark.createDataFrame([entry], self.log_ddl).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def load(self, epoch: int) -> tuple[int, dict]:
        """The optimizer's step and the state of every column as committed for an epoch."""
        entry = self.log().filter(F.col("epoch") == epoch).select("optimizer_step", "version").first()
        if entry is None:
            raise KeyError(f"epoch {epoch} was not committed")
        rows = self.spark.read.parquet(f"{self.path}/parameters/version={entry['version']}").toArrow().to_pylist()
        parts = {(r["col"], r["name"]): np.array(r["data"]) for r in rows}
        return entry["optimizer_step"], {col: tuple(parts[col, name] for name in PARTS) for col, _ in parts}


def losses_by_column(log: DataFrame) -> DataFrame:
    """The log as rows ``epoch, col, loss, steps``."""
    cols = [c for c in log.columns if c.startswith("loss_")]
    stack = ", ".join(f"{c.removeprefix('loss_')}, {c}" for c in cols)
    return log.selectExpr("epoch", f"stack({len(cols)}, {stack}) AS (col, loss)", "steps").select("epoch", "col", "loss", "steps")
