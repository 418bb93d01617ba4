"""Histograms, smoothed distributions and divergences between datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom import config as cfg
from netloom.functions.binning import with_left_closed_bin, with_right_closed_bin
from netloom.operators.filters import drop_invalid, metric_columns
from netloom.session import materialize


def histograms(
    df: DataFrame, columns: list[str], bins: int = cfg.DIVERGENCE_BINS, binning: str = "own", closed: str = "right"
) -> DataFrame:
    """Equal-width counts of every column of every dataset: (dataset, column, bin, n), zeros kept.

    ``binning`` "own" spans each dataset's own range, "shared" the range over all of
    them.  Right-closed bins count from 1, left-closed ones from 0.  One aggregate finds
    the ranges, one row per dataset, which is kept and broadcast to the binning pass: two scans
    in all.  Binning sums up per task before the shuffle, so at most ``bins`` rows per column
    leave a task.
    """
    base = df.select("dataset", *[F.col(n).cast("double").alias(n) for n in columns])
    spans = base.groupBy("dataset").agg(
        *[agg for n in columns for agg in (F.min(n).alias(f"{n}_lo"), F.max(n).alias(f"{n}_hi"))]
    )
    if binning == "shared":
        everywhere = Window.partitionBy()
        spans = spans.select(
            "dataset",
            *[F.min(f"{n}_lo").over(everywhere).alias(f"{n}_lo") for n in columns],
            *[F.max(f"{n}_hi").over(everywhere).alias(f"{n}_hi") for n in columns],
        )
    elif binning != "own":
        raise ValueError(f"unknown binning {binning!r}")
    spans = materialize(spans)
    to_bin = with_right_closed_bin if closed == "right" else with_left_closed_bin
    first = 1 if closed == "right" else 0
    # Datasets are named by the caller, a handful: their ranges may be broadcast.
    stack = ", ".join(f"'{n}', {n}, {n}_lo, {n}_hi" for n in columns)
    long = base.join(F.broadcast(spans), "dataset").selectExpr(
        "dataset", f"stack({len(columns)}, {stack}) AS (column, x, lo, hi)"
    )
    counts = (
        to_bin(long, "bin", F.col("x"), F.col("lo"), F.col("hi"), bins)
        .filter(F.col("bin").isNotNull())
        .groupBy("dataset", "column", "bin").agg(F.count("*").alias("n"))
    )
    entries = F.array(*[
        F.struct(F.lit(n).alias("column"), F.col(f"{n}_lo").alias("lo"), F.col(f"{n}_hi").alias("hi"))
        for n in columns
    ])
    frame = (
        spans.select("dataset", F.explode(entries).alias("e"))
        .select("dataset", "e.*", F.explode(F.sequence(F.lit(first), F.lit(first + bins - 1))).alias("bin"))
    )
    return (
        frame.join(counts, ["dataset", "column", "bin"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
    )


def density(hist: DataFrame, bins: int = cfg.DIVERGENCE_BINS) -> DataFrame:
    """Counts to a density: over total and bin width (one unit in all for a constant column)."""
    total = F.sum("n").over(Window.partitionBy("dataset", "column"))
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    return hist.withColumn("density", F.col("n") / (total * (span / float(bins))))


def hist2d(df: DataFrame, x: str, y: str, bins: int = 50, lo: float = -1.0, hi: float = 1.0) -> DataFrame:
    """Non-empty cells of a square histogram; points outside are left out, the top edge is in."""
    cells = df
    for name in (x, y):
        cells = with_left_closed_bin(cells, f"{name}_bin", F.col(name).cast("double"), F.lit(lo), F.lit(hi), bins)
    return (
        cells.select("dataset", F.col(f"{x}_bin").alias("x_bin"), F.col(f"{y}_bin").alias("y_bin")).dropna()
        .groupBy("dataset", "x_bin", "y_bin").agg(F.count("*").alias("n"))
    )


def laplace_smooth(hist: DataFrame, k: float = 1.0) -> DataFrame:
    """``p`` = (n + k) / (total + k * bins) within each dataset and column."""
    group = Window.partitionBy("dataset", "column")
    return hist.withColumn("p", (F.col("n") + k) / (F.sum("n").over(group) + k * F.count("*").over(group)))


def plain_distribution(hist: DataFrame) -> DataFrame:
    """``p`` = n / total within each dataset and column."""
    return hist.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("dataset", "column")))


def align(dist: DataFrame, real: str) -> DataFrame:
    """Each other dataset's distribution ``q`` beside the real one ``p``, bin by bin.

    The real value of a bin is carried to its other rows by a window over the distributions, a row
    per dataset, column and bin, so the distributions are worked out once.
    """
    of_real = F.max(F.when(F.col("dataset") == real, F.col("p"))).over(Window.partitionBy("column", "bin"))
    both = dist.select("dataset", "column", "bin", F.col("p").alias("q"), of_real.alias("p"))
    return both.filter((F.col("dataset") != real) & F.col("p").isNotNull()).select("column", "bin", "dataset", "q", "p")


def _relative_entropy(p: Column, q: Column) -> Column:
    """Sum of p ln(p/q); a bin only p has makes it infinite."""
    return F.sum(F.when(p == 0, 0.0).when(q == 0, float("inf")).otherwise(p * F.log(p / q)))


def divergences(aligned: DataFrame) -> DataFrame:
    """Jensen-Shannon and both Kullback-Leibler divergences (natural logarithm) per column."""
    p, q = F.col("p"), F.col("q")
    mid = (p + q) / 2
    return aligned.groupBy("dataset", "column").agg(
        ((_relative_entropy(p, mid) + _relative_entropy(q, mid)) / 2).alias("js"),
        _relative_entropy(p, q).alias("kl_forward"),
        _relative_entropy(q, p).alias("kl_reverse"),
    )


def js_scorecard(flows: DataFrame, real: str, binning: str = "own") -> DataFrame:
    """Divergence of the six scored columns of every generated dataset from the real one."""
    scored = drop_invalid(metric_columns(flows, ("dataset",)))
    hist = histograms(scored, cfg.METRIC_COLUMNS, binning=binning)
    return divergences(align(laplace_smooth(hist), real))
