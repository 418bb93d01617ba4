"""Global ranks without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.session import broadcast_if_small, materialize

# monotonically_increasing_id: partition number above, row number below this bit.
_ROW_BITS = 33


def rank_rows(df: DataFrame, *order: Column, name: str = "rank", within: str | None = None) -> DataFrame:
    """Add ``name`` = 1, 2, ... in the given total order, anew for each value of ``within``.

    Rows are range-partitioned and sorted in parallel; the sorted copy is kept in the
    checkpoint folder so that row positions cannot change on a retry.  A partition's
    first rank is the number of rows in the partitions before it, one row per partition.
    """
    if within:
        ranked = rank_rows(df, F.asc(within), *order, name=name)
        starts = ranked.groupBy(F.col(within).alias("_group")).agg(F.min(name).alias("_start"))
        joined = ranked.join(broadcast_if_small(starts), F.col(within).eqNullSafe(F.col("_group")))
        return joined.withColumn(name, F.col(name) - F.col("_start") + 1).drop("_group", "_start")
    placed = materialize(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    placed = placed.withColumn("_part", F.shiftright("_at", _ROW_BITS))
    row = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        placed.groupBy("_part").agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    )
    return (
        placed.join(F.broadcast(first), "_part")
        .withColumn(name, F.col("_first") + row + 1)
        .drop("_at", "_part", "_first")
    )


def rank_curve(values: DataFrame, value: str = "value", key: str = "ip", within: str | None = None) -> DataFrame:
    """Rank by value descending, ties by key, with the natural logarithm of the value."""
    ranked = rank_rows(values, F.desc(value), F.asc(key), within=within)
    return ranked.withColumn("ln_value", F.log(F.col(value).cast("double")))
