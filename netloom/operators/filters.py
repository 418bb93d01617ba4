"""Filters and projections over flows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom import config as cfg
from netloom.functions import columns as c
from netloom.session import broadcast_if_small, materialize


def on_day(flows: DataFrame, day: str) -> DataFrame:
    """Flows whose time lies on ``day``: a range on the bare column, so it reaches the scan."""
    start = dt.datetime.fromisoformat(day)
    stop = start + dt.timedelta(days=1)
    lower, upper = (F.lit(x.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz") for x in (start, stop))
    return flows.filter((F.col("te") >= lower) & (F.col("te") < upper))


def touches_internal(flows: DataFrame, prefix: str = cfg.INTERNAL_PREFIX) -> DataFrame:
    return flows.filter(c.internal(F.col("sa"), prefix) | c.internal(F.col("da"), prefix))


def by_endpoint(flows: DataFrame) -> DataFrame:
    """One row per flow and distinct endpoint, named ``user``."""
    return flows.withColumn("user", F.explode(F.array_distinct(F.array("sa", "da"))))


def extract_users(flows: DataFrame, users: DataFrame) -> DataFrame:
    """Each flow once for each listed endpoint; ``users`` has one column ``user``.

    An equi-join on the exploded endpoint, not an OR condition.  The list is worked out once,
    counted and joined as a copy.  A user list too long to
    broadcast is joined by shuffle, where adaptive execution splits a heavy user.
    """
    listed = broadcast_if_small(materialize(users.select("user").distinct()))
    return by_endpoint(flows).join(listed, "user", "left_semi")


def extract_user(flows: DataFrame, ip: str) -> DataFrame:
    """Flows one address sent."""
    return flows.filter(F.col("sa") == ip)


def drop_nulls(df: DataFrame) -> DataFrame:
    """Rows without a null.

    The null test covers a generated column, which keeps Spark from moving it below the
    projection that computes the other columns and evaluating all of them a second time
    inside one oversized filter.
    """
    return df.withColumn("_row", F.explode(F.array(F.lit(True)))).dropna().drop("_row")


def by_direction(flows: DataFrame, direction: str) -> DataFrame:
    if direction == "outgoing":
        return flows.filter(c.internal(F.col("sa"), cfg.INTERNAL_NET))
    if direction == "incoming":
        return flows.filter(c.internal(F.col("da"), cfg.INTERNAL_NET))
    if direction == "all":
        return drop_nulls(flows)
    raise ValueError(f"unknown direction {direction!r}")


def with_directions(flows: DataFrame) -> DataFrame:
    """Each flow once for every direction it belongs to, in one scan: ``direction`` outgoing, incoming, all."""
    whole = F.lit(True)
    for name in flows.columns:
        whole = whole & F.col(f"`{name}`").isNotNull()
    marks = F.array(
        F.when(c.internal(F.col("sa"), cfg.INTERNAL_NET), "outgoing"), F.when(c.internal(F.col("da"), cfg.INTERNAL_NET), "incoming"),
        F.when(whole, "all"))
    return flows.withColumn("direction", F.explode(F.filter(marks, lambda m: m.isNotNull())))


def by_piece(flows: DataFrame, real: str) -> DataFrame:
    """Every piece of a generated dataset as a dataset of its own, named ``dataset|piece``; the real one stays whole.

    Scores, rule lines and marginals of the result are those of each piece.
    """
    piece = F.concat_ws("|", "dataset", F.col("piece").cast("string"))
    return flows.withColumn("dataset", F.when(F.col("dataset") == real, F.col("dataset")).otherwise(piece)).drop("piece")


def by_protocol(flows: DataFrame, pr: str) -> DataFrame:
    return flows.filter(F.col("pr") == pr)


def by_port_class(flows: DataFrame, kind: str) -> DataFrame:
    """``system`` destination ports are below 1024, ``user`` ports the rest."""
    if kind not in ("system", "user"):
        raise ValueError(f"unknown port class {kind!r}")
    system = F.col("dp") < cfg.FIRST_USER_PORT
    return flows.filter(system if kind == "system" else ~system)


def endpoints(flows: DataFrame, *carry: str) -> DataFrame:
    """``sa`` UNION ALL ``da`` as column ``ip`` with the ``carry`` columns, in one scan."""
    return flows.select(F.explode(F.array("sa", "da")).alias("ip"), *carry)


def external(ips: DataFrame) -> DataFrame:
    return ips.filter(~c.internal(F.col("ip"), cfg.INTERNAL_NET))


def drop_invalid(df: DataFrame) -> DataFrame:
    """Infinite and not-a-number values become null, rows with nulls are dropped."""
    floats = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    finite = {
        name: F.when(~F.isnan(name) & (F.abs(F.col(name)) != float("inf")), F.col(name)) for name in floats
    }
    return drop_nulls(df.withColumns(finite))


def metric_columns(flows: DataFrame, keep: tuple = ()) -> DataFrame:
    """The scored columns: ln(byt+1), ln(pkt+1), td, both ports and the protocol code."""
    return flows.select(
        *keep,
        c.ln1p(F.col("byt")).alias("byt"),
        c.ln1p(F.col("pkt")).alias("pkt"),
        F.col("td").cast("double").alias("td"),
        F.col("sp").cast("double").alias("sp"),
        F.col("dp").cast("double").alias("dp"),
        c.protocol_code(F.col("pr")).cast("double").alias("pr"),
    )


def swap_local(flows: DataFrame) -> DataFrame:
    """Local and outside ports and address octets: ends are swapped when the source is outside."""
    local = c.internal(F.col("sa"), cfg.INTERNAL_NET + ".")
    local_ip = F.when(local, F.col("sa")).otherwise(F.col("da"))
    out_ip = F.when(local, F.col("da")).otherwise(F.col("sa"))
    return flows.select(
        *[name for name in ("flow_id",) if name in flows.columns],
        "td",
        F.when(local, F.col("sp")).otherwise(F.col("dp")).alias("localPort"),
        F.when(local, F.col("dp")).otherwise(F.col("sp")).alias("outPort"),
        "pr", "pkt", "byt",
        *[o.cast("int").alias(f"localIP_{i}") for i, o in enumerate(c.octets(local_ip))],
        *[o.cast("int").alias(f"outIP_{i}") for i, o in enumerate(c.octets(out_ip))],
    )
