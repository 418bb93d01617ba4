"""Marginal distributions of protocol, ports, addresses and sizes, per dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom import config as cfg
from netloom.functions import columns as c
from netloom.operators.divergence import histograms
from netloom.operators.filters import by_port_class, endpoints, external
from netloom.operators.ranking import rank_curve


def protocol_share(flows: DataFrame) -> DataFrame:
    """Share of TCP, UDP and everything else per dataset."""
    code = c.protocol_code(F.col("pr"))
    return flows.groupBy("dataset").agg(
        *[F.avg((code == i).cast("double")).alias(name) for i, name in enumerate(("tcp", "udp", "other"))]
    )


def protocol_value_counts(flows: DataFrame) -> DataFrame:
    code = c.protocol_code(F.col("pr")).alias("code")
    return flows.groupBy("dataset", code).agg(F.count("*").alias("flows"))


def system_port_top(flows: DataFrame, n: int = 10, by: tuple = ("dataset", "pr")) -> DataFrame:
    """The ``n`` commonest system destination ports per dataset and protocol (or other ``by``), with their share.

    The windows run over counts, at most 1,024 per group.
    """
    counts = by_port_class(flows, "system").groupBy(*by, "dp").agg(F.count("*").alias("flows"))
    group = Window.partitionBy(*by)
    return (
        counts.withColumn("share", F.col("flows") / F.sum("flows").over(group))
        .withColumn("rank", F.row_number().over(group.orderBy(F.desc("flows"), F.asc("dp"))))
        .filter(F.col("rank") <= n)
    )


def system_port_hist(flows: DataFrame, bins: int = 1024, by: tuple = ("dataset",)) -> DataFrame:
    """Equal-width histogram of system destination ports, every group of ``by`` over its own range."""
    ports = by_port_class(flows, "system").select(F.struct(*by).alias("dataset"), F.col("dp").cast("double").alias("dp"))
    hist = histograms(ports, ["dp"], bins, closed="left")
    return hist.withColumnRenamed("dataset", "_group").select("_group.*", "column", "lo", "hi", "bin", "n")


def user_port_hist(flows: DataFrame, by: tuple = ("dataset", "pr")) -> DataFrame:
    """Share of user destination ports in bars of 6000 ports from 1024 on, zeros kept.

    The bars are fixed, so they are counted side by side in one scan and turned to rows.
    """
    starts = range(cfg.FIRST_USER_PORT, cfg.PORT_MAX + 1, cfg.USER_PORT_BAR)
    port = F.col("dp")
    wide = by_port_class(flows, "user").groupBy(*by).agg(
        F.count("*").alias("total"),
        *[F.count_if((port >= s) & (port < s + cfg.USER_PORT_BAR)).alias(f"n{s}") for s in starts],
    )
    stack = ", ".join(f"{s}, n{s} / total" for s in starts)
    return wide.selectExpr(*by, f"stack({len(starts)}, {stack}) AS (port, share)")


def side_by_side(
    table: DataFrame, index: str, values: list[str], columns: list[tuple], by: tuple = ("dataset", "pr")
) -> DataFrame:
    """Port tables of all datasets next to each other: one row per ``index``.

    ``columns`` lists the groups of ``by`` that are shown, which bounds the width.
    """
    chosen = []
    for group in columns:
        here = F.lit(True)
        for name, value in zip(by, group, strict=True):
            here = here & (F.col(name) == value)
        chosen += [F.max(F.when(here, F.col(v))).alias("_".join([*group, v])) for v in values]
    return table.groupBy(index).agg(*chosen)


def ip_occurrence_curve(flows: DataFrame, by: str | None = None) -> DataFrame:
    """External addresses by the number of flow ends they are, one curve per value of ``by``."""
    group = [by] if by else []
    counts = external(endpoints(flows, *group)).groupBy(*group, "ip").agg(F.count("*").alias("value"))
    return rank_curve(counts, within=by)


def ip_volume_curve(flows: DataFrame, by: str | None = None) -> DataFrame:
    """External addresses by the bytes of the flows they are an end of, one curve per value of ``by``."""
    group = [by] if by else []
    sums = external(endpoints(flows, "byt", *group)).groupBy(*group, "ip").agg(F.sum("byt").alias("value"))
    return rank_curve(sums, within=by)


def scale_check(flows: DataFrame) -> DataFrame:
    """Minimum and logarithm of the maximum of bytes and packets per dataset."""
    aggs = [
        agg
        for name in ("byt", "pkt")
        for agg in (
            F.min(name).cast("double").alias(f"{name}_min"),
            F.log(F.max(name).cast("double")).alias(f"{name}_ln_max"),
        )
    ]
    return flows.groupBy("dataset").agg(*aggs)


def max_over_sets(flows: DataFrame, column: str = "td") -> DataFrame:
    """Largest value of a column over all datasets."""
    return flows.agg(F.max(column).alias(f"max_{column}"))
