"""Protocol rules: each is a boolean column, null where the rule does not apply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netloom import config as cfg


def _octet(ip: Column, i: int) -> Column:
    """Null where the address has no such number."""
    return F.get(F.split(ip, "[.]"), F.lit(i)).try_cast("int")


def _only_if(applies: Column, holds: Column) -> Column:
    return F.when(applies, holds)


def one_end_internal() -> Column:
    sa, da = F.col("sa"), F.col("da")
    return (
        F.startswith(sa, F.lit(cfg.INTERNAL_NET))
        | F.startswith(da, F.lit(cfg.INTERNAL_NET))
        | (sa == "0.0.0.0")
        | (da == "255.255.255.255")
    )


def _any_port(*ports: int) -> Column:
    return F.col("sp").isin(*ports) | F.col("dp").isin(*ports)


def web_is_tcp() -> Column:
    return _only_if(_any_port(80, 443), F.col("pr") == "TCP")


def dns_is_udp() -> Column:
    return _only_if(_any_port(52, 53), F.col("pr") == "UDP")


def multicast_only_destination(strict: bool = False) -> Column:
    """Multicast or broadcast addresses may be destinations only.

    ``strict`` also treats 192.x.x.255 as a source as a violation; the published check
    compares one octet with two values there, so by default that part never holds.
    """
    sa1, sa4 = _octet(F.col("sa"), 0), _octet(F.col("sa"), 3)
    da1, da4 = _octet(F.col("da"), 0), _octet(F.col("da"), 3)
    to_group = (da1 > 223) | ((da1 == 192) & (da4 == 255))
    from_group = sa1 > 223
    if strict:
        from_group = from_group | ((sa1 == 192) & (sa4 == 255))
    return F.when(to_group & ~from_group, True).when(from_group, False)


def netbios_stays_inside() -> Column:
    sa, da = F.col("sa"), F.col("da")
    holds = (
        (_octet(sa, 0) == 42)
        & (_octet(sa, 1) == 219)
        & (F.col("pr") == "UDP")
        & (_octet(da, 0) == 42)
        & (_octet(da, 3) == 255)
    )
    return _only_if(F.col("dp").isin(137, 138), holds)


def no_reserved_address() -> Column:
    return ~(F.col("sa").isin(cfg.RESERVED_ADDRESSES) | F.col("da").isin(cfg.RESERVED_ADDRESSES))


def bytes_fit_packets() -> Column:
    pkt = F.col("pkt")
    return F.col("byt").between(pkt * cfg.MIN_BYTES_PER_PACKET, pkt * cfg.MAX_BYTES_PER_PACKET)


def one_packet_is_short() -> Column:
    return _only_if(F.col("pkt") <= 1, F.col("td") < 1)


RULES = {
    "one_end_internal": one_end_internal,
    "web_is_tcp": web_is_tcp,
    "dns_is_udp": dns_is_udp,
    "multicast_only_destination": multicast_only_destination,
    "netbios_stays_inside": netbios_stays_inside,
    "no_reserved_address": no_reserved_address,
    "bytes_fit_packets": bytes_fit_packets,
    "one_packet_is_short": one_packet_is_short,
}
