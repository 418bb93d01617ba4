"""Equal-width bin numbers.

A quotient gives the bin up to rounding; comparing the value with the two neighbouring
edges ``i * step + low`` settles values that sit on an edge.  The quotient is a column of
its own, so that the generated code evaluates it once and stays short enough to compile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom import config as cfg


def with_right_closed_bin(df: DataFrame, name: str, x: Column, lo: Column, hi: Column, bins: int) -> DataFrame:
    """Add bin 1..bins of (edge, edge] bins over [lo, hi]; the minimum belongs to bin 1.

    A constant column is stretched around its value: everything is in the middle bin.
    """
    step = (hi - lo) / float(bins)
    quotient = F.when(hi > lo, F.ceil((x - lo) / step))
    at, x0 = F.col("_at"), F.col("_lo")
    moved = at + (x > at * F.col("_step") + x0).cast("int") - (x <= (at - 1) * F.col("_step") + x0).cast("int")
    inside = F.greatest(F.lit(1), F.least(F.lit(bins), moved)).cast("int")
    middle = F.when(x.isNotNull(), F.lit((bins + 1) // 2))
    return (
        df.withColumns({"_at": quotient, "_step": step, "_lo": lo})
        .withColumn(name, F.when(at.isNull(), middle).otherwise(inside))
        .drop("_at", "_step", "_lo")
    )


def with_left_closed_bin(df: DataFrame, name: str, x: Column, lo: Column, hi: Column, bins: int) -> DataFrame:
    """Add bin 0..bins-1 of [edge, edge) bins over [lo, hi]; the last bin holds the maximum.

    Null outside [lo, hi].  A constant column spans half a unit on either side.
    """
    half = F.when(hi > lo, 0.0).otherwise(0.5)
    low, high = F.col("_low"), F.col("_high")
    at, step = F.col("_at"), F.col("_step")
    moved = at - (x < at * step + low).cast("int") + (x >= (at + 1) * step + low).cast("int")
    inside = F.greatest(F.lit(0), F.least(F.lit(bins - 1), moved)).cast("int")
    return (
        df.withColumns({"_low": lo - half, "_high": hi + half})
        .withColumn("_step", (high - low) / float(bins))
        .withColumn("_at", F.floor((x - low) / step))
        .withColumn(name, F.when((x >= low) & (x <= high), inside))
        .drop("_low", "_high", "_step", "_at")
    )


def with_ln_byte_bucket(df: DataFrame, name: str, byt: Column) -> DataFrame:
    """Add bucket 0..303 of ln(byt) by the configured edges, left closed, last closed; null outside."""
    count = cfg.LN_BYT_EDGE_COUNT - 2
    first, last = F.lit(cfg.LN_BYT_EDGE_FIRST), F.lit(cfg.LN_BYT_EDGE_LAST)
    x = F.col("_x")
    binned = with_left_closed_bin(df.withColumn("_x", F.log(byt.cast("double"))), name, x, first, last, count)
    return binned.withColumn(name, F.when((x >= 0) & (x < first), 0).otherwise(F.col(name) + 1)).drop("_x")
