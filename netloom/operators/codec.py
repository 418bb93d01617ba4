"""Generated rows back to flow records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom import config as cfg
from netloom.functions import columns as c


def default_local_ip(seq: Column, addresses=None, seed: int = 0) -> Column:
    """One address per sequence out of a fixed list, chosen by a hash of the sequence."""
    pool = F.array(*[F.lit(a) for a in addresses or cfg.DEFAULT_LOCAL_ADDRESSES])
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(seq.cast("string"), F.lit(""))).cast("binary"))
    return F.get(pool, (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.size(pool)).cast("int"))


def _address(octets: list[Column]) -> Column:
    return F.concat_ws(".", *[o.cast("int").cast("string") for o in octets])


def _protocol() -> Column:
    return F.when(F.col("tcp_x") == 1, "TCP").when(F.col("udp_x") == 1, "UDP").otherwise("Other")


def _records(rows, keep, hour, byt, pkt, lport, rport, remote_ip, this_ip) -> DataFrame:
    out = F.col("out_x") == 1
    return rows.select(
        *keep,
        hour.cast("int").alias("hour"),
        (F.col("delta_x") * float(cfg.DELTA_MAX)).alias("time_delta"),
        byt.cast("long").alias("byt"),
        pkt.cast("long").alias("pkt"),
        (F.col("td_x") * float(cfg.TD_MAX)).alias("time_duration"),
        F.when(out, lport).otherwise(rport).alias("sp"),
        F.when(out, rport).otherwise(lport).alias("dp"),
        F.when(out, this_ip).otherwise(remote_ip).alias("sa"),
        F.when(out, remote_ip).otherwise(this_ip).alias("da"),
        _protocol().alias("pr"),
    )


def decode_flows(
    rows: DataFrame, this_ip: Column, *keep: str, draw: tuple[Column, Column] | None = None,
    hour_scale: float = 24.0,
) -> DataFrame:
    """Encoded rows with integer ``lport_class`` and ``rport_class`` to the ten flow columns.

    Values are rounded, octets come back in address order and the hour stays below 24.
    ``draw`` fixes the two draws inside a 100-port class; by default they hash the row.
    """
    if draw is None:
        row = [F.col(n) for n in (keep or cfg.ENCODED_COLUMNS)]
        draw = (c.uniform(F.lit("local"), *row), c.uniform(F.lit("remote"), *row))
    octets = [c.label_octet(F.col(n)) for n in ("ip1_x", "ip2_x", "ip3_x", "ip4_x")]
    return _records(
        rows, keep,
        hour=F.least(F.floor(F.col("hour_x") * float(hour_scale) + 1e-9), F.lit(23)),
        byt=F.rint(F.exp(F.col("byt_x") * cfg.LN_BYT_MAX)),
        pkt=F.rint(F.exp(F.col("pkt_x") * cfg.LN_PKT_MAX)),
        lport=c.decode_port(F.col("lport_class"), draw[0]),
        rport=c.decode_port(F.col("rport_class"), draw[1]),
        remote_ip=_address(octets),
        this_ip=this_ip,
    )


def decode_flows_compat(rows: DataFrame, this_ip: Column, *keep: str, draw=None) -> DataFrame:
    """The published decoding of rows with ports as class/1670 and octets as octet/256.

    Every value is truncated, octets stay in stored (reversed) order, hour 23/23 gives 24.
    """
    if draw is None:
        row = [F.col(n) for n in (keep or cfg.ENCODED_COLUMNS)]
        draw = (c.uniform(F.lit("local"), *row), c.uniform(F.lit("remote"), *row))
    lclass, rclass = (F.floor(F.col(n) * float(cfg.PORT_CLASSES)) for n in ("lport_x", "rport_x"))
    octets = [F.floor(F.col(n) * 256.0) for n in ("ip4_x", "ip3_x", "ip2_x", "ip1_x")]
    return _records(
        rows, keep,
        hour=F.floor(F.col("hour_x") * 24.0),
        byt=F.floor(F.exp(F.col("byt_x") * cfg.LN_BYT_MAX)),
        pkt=F.floor(F.exp(F.col("pkt_x") * cfg.LN_PKT_MAX)),
        lport=c.decode_port(lclass, draw[0]),
        rport=c.decode_port(rclass, draw[1]),
        remote_ip=_address(octets),
        this_ip=this_ip,
    )
