"""Scalers and encoders fitted on a table, applied as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.ranking import rank_rows
from netloom.session import broadcast_if_small


def fit_minmax(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Minimum and maximum of each column: one aggregate, one row back."""
    aggs = [F.struct(F.min(n).cast("double"), F.max(n).cast("double")).alias(n) for n in columns]
    return {n: tuple(v) for n, v in df.agg(*aggs).first().asDict().items()}


def minmax(name: str, span: tuple[float, float]) -> Column:
    """Column scaled to [0, 1] by a fitted range; a constant column becomes 0."""
    lo, hi = span
    return (F.col(name) - lo) / (hi - lo if hi > lo else 1.0)


def minmax_scale(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({f"{n}_normed": minmax(n, span) for n, span in fitted.items()})


def ordinal_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Codes 0, 1, ... in sorted category order; a null stays null.

    Categories are numbered by a parallel sort of the distinct values, however many.
    """
    for name in columns:
        categories = df.select(name).filter(F.col(name).isNotNull()).distinct()
        codes = rank_rows(categories, F.asc(name), name="_code")
        coded = codes.select(name, (F.col("_code") - 1).cast("double").alias(f"{name}_normed"))
        df = df.join(broadcast_if_small(coded), name, "left")
    return df
