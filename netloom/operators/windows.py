"""Encoding of flows into scaled columns, and context windows with their label rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom import config as cfg
from netloom.functions import columns as c
from netloom.operators.chunks import TARGET_ROWS, Chunked, chunked, lags
from netloom.operators.filters import drop_nulls


def encoded(hour_max: float = cfg.HOUR_MAX) -> list[Column]:
    """The 16 encoded columns of a flow that carries ``delta`` and ``this_ip``.

    ``hour_max`` 23 is the published scale; fitting and generating use 24, the scale
    the generation clock writes.
    """
    out = c.is_outgoing(F.col("sa"), F.col("this_ip"))
    ends = c.local_remote(out, *(F.col(n) for n in ("sa", "da", "sp", "dp")))
    values = [
        F.hour("te") / float(hour_max),
        F.col("delta") / float(cfg.DELTA_MAX),
        c.ln(F.col("byt")) / cfg.LN_BYT_MAX,
        c.ln(F.col("pkt")) / cfg.LN_PKT_MAX,
        F.col("td") / float(cfg.TD_MAX),
        c.port_scaled(ends["local_port"]),
        c.port_scaled(ends["remote_port"]),
        *c.octets_scaled(ends["remote_ip"]),
        out.cast("double"),
        (~out).cast("double"),
        *c.protocol_one_hot(F.col("pr")),
    ]
    return [v.alias(name) for v, name in zip(values, cfg.ENCODED_COLUMNS)]


def encode_flows(flows: DataFrame, *keep: str, hour_max: float = cfg.HOUR_MAX) -> DataFrame:
    """Flows with ``delta`` and ``this_ip`` to 16 encoded columns: one projection."""
    return flows.select(*keep, *encoded(hour_max))


def with_inter_arrival(part: Chunked) -> Chunked:
    """Add ``delta``: seconds since the key's previous flow, 0 on its first."""
    at = c.micros(F.col("te"))
    (before,) = lags(part, F.col("_at"), 1)
    timed = part.df.withColumn("_at", at)
    return part.having(
        timed.withColumn("delta", F.coalesce((F.col("_at") - before) / 1e6, F.lit(0.0))).drop("_at")
    )


def inter_arrival(flows: DataFrame, key: str = "this_ip", target_rows: int = TARGET_ROWS) -> DataFrame:
    return with_inter_arrival(chunked(flows, key, halo=1, target_rows=target_rows)).result()


def with_context(part: Chunked, row: list[str], agg: int) -> Chunked:
    """Add ``ctx``: the ``agg`` rows before and the row itself, oldest first, flattened.

    Rows before the key's first flow are zeros.
    """
    rows = part.df.withColumn("_row", F.array(*row))
    zeros = F.array(*[F.lit(0.0)] * len(row))
    past = {f"_row{i}": lag for i, lag in enumerate(lags(part, F.col("_row"), agg), 1)}
    seen = [F.coalesce(F.col(f"_row{i}"), zeros) for i in range(agg, 0, -1)]
    ctx = F.concat(*seen, F.col("_row"))
    return part.having(rows.withColumns(past).withColumn("ctx", ctx).drop("_row", *past))


def context_window(
    rows: DataFrame, row: list[str], agg: int, key: str = "this_ip", target_rows: int = TARGET_ROWS
) -> DataFrame:
    return with_context(chunked(rows, key, halo=agg, target_rows=target_rows), row, agg).result()


def flow_label() -> list[Column]:
    """The label row of an encoded flow: port classes and integer octets, the rest unchanged."""
    out = []
    for i, name in enumerate(cfg.ENCODED_COLUMNS):
        x = F.col(name)
        if i in (5, 6):
            x = c.label_port(x)
        elif 7 <= i <= 10:
            x = c.label_octet(x)
        out.append(x.cast("double").alias(name))
    return out


def label_row() -> Column:
    return F.array(*flow_label())


def windows_of(
    part: Chunked, agg: int, *keep: str, hour_max: float = cfg.HOUR_MAX, clip: bool = False, transfer=None,
    label: Column | None = None,
) -> DataFrame:
    """Chunked flows with ``delta`` to (user, flow_id, te, ctx, label) and the ``keep`` columns."""
    key = part.keys[0]
    if transfer is None:
        rows = encode_flows(part.df, key, "te", "flow_id", "chunk", "halo", *keep, hour_max=hour_max)
    else:
        rows = part.df.transform(transfer)
    if clip:
        rows = rows.withColumn("delta_x", F.least("delta_x", F.lit(1.0)))
    windows = with_context(part.having(rows), cfg.ENCODED_COLUMNS, agg).result()
    label = label_row() if label is None else label
    return windows.select(F.col(key).alias("user"), "flow_id", "te", *keep, "ctx", label.alias("label"))


def complete(flows: DataFrame) -> DataFrame:
    """Flows that can be encoded: no nulls, and sizes that have a logarithm."""
    return drop_nulls(flows.filter((F.col("byt") > 0) & (F.col("pkt") > 0)))


def prepare_windows(
    flows: DataFrame, agg: int = cfg.FLOW_WINDOW, key: str = "this_ip", target_rows: int = TARGET_ROWS, **encoding
) -> DataFrame:
    """Every user's flows to (user, flow_id, te, ctx, label) in one job.

    Inter-arrival times and windows share one shuffle by user and one sort.  ``encoding``:
    ``transfer`` replaces the encoder by any DataFrame transform that keeps every row with
    its key, ``te``, ``flow_id``, ``chunk`` and ``halo`` and yields the encoded columns;
    ``label`` replaces the label row; ``clip`` limits the encoded delta to 1, the range the
    models are fitted on; ``hour_max`` sets the scale of the hour.
    """
    # One more row than the context, for the delta of its oldest row.
    part = chunked(complete(flows), key, halo=agg + 1, target_rows=target_rows)
    return windows_of(with_inter_arrival(part), agg, **encoding)


def masked_features(windows: DataFrame, plan: cfg.ColumnPlan, col: int) -> DataFrame:
    """``features``: the inputs head ``col`` may look at, zeros elsewhere."""
    mask = plan.feature_mask(col)
    positions = [F.col("ctx")[i] if seen else F.lit(0.0) for i, seen in enumerate(mask)]
    return windows.withColumn("features", F.array(*positions))
