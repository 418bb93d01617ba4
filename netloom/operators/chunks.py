"""Time-ordered windows per key that stay parallel when one key holds most rows.

A key with more rows than the target is cut along time into chunks of about that size.
Each chunk also receives a copy of the last rows before it (its halo), so plain window
functions over key and chunk see exactly the rows they would see in one long partition;
the copies are dropped at the end.  Keys below the target form a single chunk each, and
when there is no heavy key nothing is copied.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from netloom.functions.columns import micros
from netloom.session import broadcast_if_small, materialize

# Rows one window task is meant to sort; spilled sorts beyond it still finish.
TARGET_ROWS = 2_000_000
# Time cells a target-sized piece of a heavy key is measured in before it is cut.
CELLS_PER_CHUNK = 16


@dataclass(frozen=True)
class Chunked:
    """Flows with a ``chunk`` number per key, in time order, and a mark ``halo`` on copied rows."""

    df: DataFrame
    keys: tuple
    split: bool
    id_col: str = "flow_id"

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, "chunk").orderBy("te", self.id_col)

    def having(self, df: DataFrame) -> "Chunked":
        return Chunked(df, self.keys, self.split, self.id_col)

    def result(self) -> DataFrame:
        """The rows themselves, without the copies."""
        return self.df.filter(~F.col("halo")).drop("chunk", "halo")


def _with_halo(df: DataFrame, keys: tuple, id_col: str, n: int) -> DataFrame:
    """Add to every chunk a copy of the ``n`` rows of its key before it.

    The plain row_number() <= n is a group limit, applied before the shuffle too, so at most
    n rows per chunk and task move.  Every chunk holds a row, so n chunks back there are n rows.
    """
    marked = df.withColumn("halo", F.lit(False))
    if not n:
        return marked
    names = [c for c in df.columns if c != "chunk"]
    latest = Window.partitionBy(*keys, "chunk").orderBy(F.desc("te"), F.desc(id_col))
    earlier = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(-n, -1)
    tails = (
        df.filter(F.col("chunk") >= 0)
        .withColumn("_nth", F.row_number().over(latest)).filter(F.col("_nth") <= n)
        .withColumn("_back", -F.col("_nth")).drop("_nth")
        .groupBy(*keys, "chunk")
        .agg(F.array_sort(F.collect_list(F.struct("_back", F.struct(*names).alias("row")))).alias("_tail"))
    )
    copies = tails.select("chunk", F.flatten(F.collect_list("_tail").over(earlier)).alias("_rows")).select(
        "chunk", F.explode(F.slice("_rows", F.greatest(F.size("_rows") - n + 1, F.lit(1)), F.lit(n))).alias("_r")
    )
    return marked.unionByName(copies.select("_r.row.*", "chunk", F.lit(True).alias("halo")))


def chunked(
    df: DataFrame, *keys: str, halo: int, id_col: str = "flow_id", target_rows: int = TARGET_ROWS
) -> Chunked:
    """Number the chunks of each key and copy ``halo`` earlier rows into each.

    Keys that need no cutting get chunk -1.

    One narrow aggregate sizes the keys; those above ``target_rows`` are heavy.  Their
    flows are counted in equal time cells.  A cell that still exceeds the target (a burst,
    or everything next to one stray time) is divided again over its own range, by number
    once all its flows carry the same time.  Cells in order, summed up, give the chunks.
    """
    place = {"at": micros(F.col("te")), "id": F.col(id_col).cast("long")}

    def sizes(rows: DataFrame, group: list) -> DataFrame:
        ends = [f(c).alias(f"_{n}_{f.__name__}") for n, c in place.items() for f in (F.min, F.max)]
        return materialize(rows.groupBy(*group).agg(F.count("*").alias("_n"), *ends))

    groups, path, placed = sizes(df, list(keys)), [], df
    while True:
        by_id = F.col("_at_min") == F.col("_at_max")
        lo, hi = (F.when(by_id, F.col(f"_id_{e}")).otherwise(F.col(f"_at_{e}")) for e in ("min", "max"))
        cells = F.ceil(F.col("_n") / target_rows) * CELLS_PER_CHUNK
        full = groups.filter((F.col("_n") > target_rows) & (hi > lo)).select(
            *keys, *path, by_id.alias("_by_id"), lo.alias("_lo"), F.ceil((hi - lo + 1) / cells).alias("_width")
        )
        if full.isEmpty():
            break
        name = f"_cell{len(path)}"
        value = F.when(F.col("_by_id"), place["id"]).otherwise(place["at"])
        cell = F.floor((value - F.col("_lo")) / F.col("_width")).cast("long")
        placed = (
            placed.join(broadcast_if_small(full), [*keys, *path], "left")
            .withColumn(name, F.coalesce(cell, F.lit(-1).cast("long")))
            .drop("_by_id", "_lo", "_width")
        )
        path = [*path, name]
        groups = sizes(placed.filter(F.col(name) >= 0), [*keys, *path])
    if not path:
        whole = df.withColumns({"chunk": F.lit(-1).cast("long"), "halo": F.lit(False)})
        return Chunked(whole, keys, False, id_col)
    if len(path) > 1:
        groups = sizes(placed.filter(F.col(path[0]) >= 0), [*keys, *path])
    before = Window.partitionBy(*keys).orderBy(*path).rowsBetween(Window.unboundedPreceding, -1)
    number = F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / target_rows).cast("long")
    chunks = materialize(groups.select(*keys, *path, number.alias("chunk")))
    out = placed.join(broadcast_if_small(chunks), [*keys, *path], "left").drop(*path)
    out = out.withColumn("chunk", F.coalesce("chunk", F.lit(-1).cast("long")))
    return Chunked(_with_halo(out, keys, id_col, halo), keys, True, id_col)


def lags(part: Chunked, value: Column, n: int) -> list[Column]:
    """``value`` of the 1st .. nth row before a row; null where the key has no such row."""
    return [F.lag(value, i).over(part.window()) for i in range(1, n + 1)]


def with_running_sum(part: Chunked, name: str, value: Column) -> Chunked:
    """Add ``name``: the sum of ``value`` over the key's flows before this one, 0 on the first."""
    valued = part.df.withColumn("_value", F.when(~F.col("halo"), value))
    before = part.window().rowsBetween(Window.unboundedPreceding, -1)
    inside = valued.withColumn(name, F.coalesce(F.sum("_value").over(before), F.lit(0)))
    if not part.split:
        return part.having(inside.drop("_value"))
    group = [*part.keys, "chunk"]
    earlier = Window.partitionBy(*part.keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        valued.groupBy(*group).agg(F.sum("_value").alias("_sum"))
        .select(*group, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carried"))
    )
    joined = inside.join(carried, group).withColumn(name, F.col(name) + F.col("_carried"))
    return part.having(joined.drop("_value", "_carried"))
