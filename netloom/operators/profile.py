"""Host profiles: how often each internal address occurs, and in which direction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom import config as cfg
from netloom.functions import columns as c
from netloom.operators.ranking import rank_rows


def endpoint_roles(flows: DataFrame, prefix: str = cfg.INTERNAL_PREFIX, *carry: str) -> DataFrame:
    """One row per internal end of a flow: ``ip``, ``sent``, whether the peer is outside, and the ``carry`` columns."""
    ends = F.array(
        F.struct(F.col("sa").alias("ip"), F.col("da").alias("peer"), F.lit(True).alias("sent")),
        F.struct(F.col("da").alias("ip"), F.col("sa").alias("peer"), F.lit(False).alias("sent")),
    )
    roles = flows.select(*carry, F.explode(ends).alias("end")).select(*carry, "end.ip", "end.peer", "end.sent")
    return roles.filter(c.internal(F.col("ip"), prefix)).select(
        *carry, "ip", "sent", (~c.internal(F.col("peer"), prefix)).alias("peer_outside")
    )


def user_type(incoming, outgoing):
    """0 sends and receives, 1 only sends, 2 only receives, 3 internal traffic only."""
    return (
        F.when((incoming > 0) & (outgoing > 0), 0)
        .when(outgoing > 0, 1)
        .when(incoming > 0, 2)
        .otherwise(3)
    )


def count_roles(roles: DataFrame, *by: str) -> DataFrame:
    """Occurrences, incoming and outgoing flows per address (and ``by``), in one hash aggregate.

    Partial sums per task leave one row per address and task for the shuffle, so an
    address that holds a third of the flows costs no more than any other.
    """
    return roles.groupBy(*by, "ip").agg(
        F.count("*").alias("number_of_rows"),
        F.count_if(~F.col("sent") & F.col("peer_outside")).alias("incoming_num"),
        F.count_if(F.col("sent") & F.col("peer_outside")).alias("outgoing_num"),
    )


def user_stats(flows: DataFrame, prefix: str = cfg.INTERNAL_PREFIX, by: str | None = None) -> DataFrame:
    """Occurrences, incoming, outgoing and type of each internal address (unordered), per value of ``by``.

    Flows between outside addresses need no filter of their own: neither end is counted.
    """
    group = [by] if by else []
    counts = count_roles(endpoint_roles(flows, prefix, *group), *group)
    kind = user_type(F.col("incoming_num"), F.col("outgoing_num"))
    return counts.withColumn("user_type", kind).select(
        *group, "number_of_rows", "ip", "incoming_num", "outgoing_num", "user_type"
    )


def ordered_stats(stats: DataFrame) -> DataFrame:
    """Busiest address first, ties by address text, both descending."""
    return stats.orderBy(F.desc("number_of_rows"), F.desc("ip"))


def top_users(stats: DataFrame, n: int = 20) -> DataFrame:
    return ordered_stats(stats).select("number_of_rows", "ip").limit(n)


def user_type_counts(stats: DataFrame) -> DataFrame:
    """Addresses per type, zeros kept: one aggregate row, then four rows."""
    totals = stats.agg(*[F.count_if(F.col("user_type") == t).alias(f"t{t}") for t in range(4)])
    return totals.selectExpr("stack(4, 0, t0, 1, t1, 2, t2, 3, t3) AS (user_type, users)")


def still_present(previous: DataFrame, stats: DataFrame) -> DataFrame:
    """Addresses of an earlier list that are type 0 now."""
    current = stats.filter(F.col("user_type") == 0).select("ip")
    return previous.join(current, "ip", "left_semi")


def middle_half(stats: DataFrame) -> DataFrame:
    """Type-0 addresses at positions [n/4, 3n/4) of the busiest-first order."""
    placed = rank_rows(stats.filter(F.col("user_type") == 0), F.desc("number_of_rows"), F.desc("ip"), name="position")
    # one row, so the join is a broadcast of it
    total = placed.agg(F.count("*").alias("n"))
    ranked = placed.withColumn("position", F.col("position") - 1).crossJoin(F.broadcast(total))
    lower, upper = F.floor(F.col("n") / 4), F.floor(F.col("n") * 3 / 4)
    return ranked.filter((F.col("position") >= lower) & (F.col("position") < upper)).drop("n")
