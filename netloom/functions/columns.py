"""Scalar column functions of the flow codec and of the evaluation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netloom import config as cfg


def micros(te: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session time zone."""
    day = F.unix_date(te.cast("date")).cast("long") * 86400
    clock = F.hour(te) * 3600 + F.minute(te) * 60
    second = F.date_part(F.lit("SECOND"), te)
    return (day + clock) * 1_000_000 + (second * 1_000_000).cast("long")


def internal(ip: Column, prefix: str = cfg.INTERNAL_PREFIX) -> Column:
    return F.startswith(ip, F.lit(prefix))


def ln(x: Column) -> Column:
    """Natural logarithm; null at 0."""
    return F.log(x.cast("double"))


def ln1p(x: Column) -> Column:
    """ln(x + 1)."""
    return F.log(x.cast("double") + 1.0)


def protocol_code(pr: Column) -> Column:
    """TCP 0, UDP 1, anything else 2."""
    return F.when(pr == "TCP", 0).when(pr == "UDP", 1).otherwise(2)


def protocol_one_hot(pr: Column) -> list[Column]:
    code = protocol_code(pr)
    return [(code == i).cast("double") for i in range(3)]


def octets(ip: Column) -> list[Column]:
    """The four octets as text, first octet first."""
    parts = F.split(ip, "[.]")
    return [F.get(parts, F.lit(i)) for i in range(4)]


def octets_scaled(ip: Column) -> list[Column]:
    """The four octets over 255, last octet first."""
    return [o.try_cast("int") / float(cfg.OCTET_MAX) for o in reversed(octets(ip))]


def split_address(df, name: str, normalize: bool = False):
    """Replace address column ``name`` by ``name_0`` .. ``name_3``; text, or over 255."""
    parts = octets(F.col(name))
    if normalize:
        parts = [p.try_cast("int") / float(cfg.OCTET_MAX) for p in parts]
    return df.withColumns({f"{name}_{i}": p for i, p in enumerate(parts)}).drop(name)


def port_scaled(port: Column) -> Column:
    return port / float(cfg.PORT_MAX)


def port_class(port: Column) -> Column:
    """The port itself below 1024, then one class per 100 ports."""
    user = F.floor((port - cfg.FIRST_USER_PORT) / cfg.PORT_CLASS_WIDTH) + cfg.FIRST_USER_PORT
    return F.when(port < cfg.FIRST_USER_PORT, port.cast("long")).otherwise(user).cast("int")


def label_port(scaled: Column) -> Column:
    """Class of a scaled port as label rows carry it: scaled back by 65536, rounded half to even."""
    return port_class(F.rint(scaled * 65536.0))


def label_octet(scaled: Column) -> Column:
    return F.least(F.rint(scaled * 255.0), F.lit(255.0)).cast("int")


def is_outgoing(sa: Column, this_ip: Column) -> Column:
    return sa == this_ip


def local_remote(out: Column, sa: Column, da: Column, sp: Column, dp: Column) -> dict[str, Column]:
    """Ports and remote address ordered from the user's point of view."""
    return {
        "local_port": F.when(out, sp).otherwise(dp),
        "remote_port": F.when(out, dp).otherwise(sp),
        "remote_ip": F.when(out, da).otherwise(sa),
    }


def day_fraction(value: Column, kind: str = "time") -> Column:
    """Share of the day: of ``HH:MM:SS`` or full timestamp text, a timestamp, or an integer hour."""
    if kind == "hour":
        return value * 3600 / 86400.0
    if kind == "time":
        clock = F.split(F.substring_index(value, " ", -1), ":")
        hour, minute, second = (clock.getItem(i).cast("int") for i in range(3))
    else:
        hour, minute, second = F.hour(value), F.minute(value), F.second(value)
    return (hour * 3600.0 + minute * 60.0 + second) / 86400.0


def uniform(*key: Column) -> Column:
    """A draw in [0, 1) that depends on ``key`` only, never on partitioning."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11) / float(2**53)


def decode_port(cls: Column, draw: Column) -> Column:
    """A port of class ``cls``: itself below 1024, else ``draw`` picks one of the class's 100."""
    base = (cls - cfg.FIRST_USER_PORT) * cfg.PORT_CLASS_WIDTH + cfg.FIRST_USER_PORT
    port = F.when(cls < cfg.FIRST_USER_PORT, cls).otherwise(base + F.floor(draw * cfg.PORT_CLASS_WIDTH))
    return F.least(port, F.lit(cfg.PORT_MAX)).cast("int")
