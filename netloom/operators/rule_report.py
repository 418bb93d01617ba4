"""Pass rates of the protocol rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions.rules import RULES


def rule_verdicts(flows: DataFrame, *keep: str, rules=None) -> DataFrame:
    """One boolean column per rule; null where it does not apply."""
    chosen = rules or list(RULES)
    return flows.select(*keep, *[RULES[r]().alias(r) for r in chosen])


def rule_summary(flows: DataFrame, *by: str, rules=None) -> DataFrame:
    """Per rule: flows that pass, flows it applies to, and the share (null if to none).

    All rules are counted in one scan into one row per group, then turned to rows.
    """
    chosen = rules or list(RULES)
    verdicts = rule_verdicts(flows, *by, rules=chosen)
    counts = [
        agg
        for r in chosen
        for agg in (F.count_if(F.col(r)).alias(f"{r}_true"), F.count(r).alias(f"{r}_total"))
    ]
    wide = verdicts.groupBy(*by).agg(*counts)
    stack = ", ".join(f"'{r}', {r}_true, {r}_total" for r in chosen)
    rows = wide.selectExpr(*by, f"stack({len(chosen)}, {stack}) AS (rule, true_count, total)")
    return rows.withColumn("share", F.when(F.col("total") > 0, F.col("true_count") / F.col("total")))
