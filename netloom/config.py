"""Fixed values of the flow data model, and the column plan of the synthesizer."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# They must equal the published data model for right results.
# ---------------------------------------------------------------------------

# Column names of the raw flow table, in file order ("lable" is its spelling).
FLOW_COLUMNS = ["te", "td", "sa", "da", "sp", "dp", "pr", "flg", "fwd", "stos", "pkt", "byt", "lable"]

# Prefix of an internal address, as the profiling and as the evaluation tests it.
INTERNAL_PREFIX = "42.219."
INTERNAL_NET = "42.219"

# Scale maxima of the encoder: hour, seconds between flows, ln bytes, ln packets,
# duration in seconds, port, address octet.
HOUR_MAX = 23
DELTA_MAX = 1430
LN_BYT_MAX = 20.12915933105231
LN_PKT_MAX = 12.83
TD_MAX = 363
PORT_MAX = 65535
OCTET_MAX = 255

# Port classes: one per system port, then one per 100 user ports.
FIRST_USER_PORT = 1024
PORT_CLASS_WIDTH = 100
PORT_CLASSES = 1670

# User port histogram: bar width.
USER_PORT_BAR = 6000

# Histogram bins of the divergence scores, and columns they cover.
DIVERGENCE_BINS = 304
METRIC_COLUMNS = ["byt", "pkt", "td", "sp", "dp", "pr"]

# ln(byte) bucket edges: 0, then evenly spaced edges from the first to the last.
LN_BYT_EDGE_COUNT = 305
LN_BYT_EDGE_FIRST = 3.3322045101752034
LN_BYT_EDGE_LAST = 20.153654225990877

# Bytes per packet allowed by the size rule.
MIN_BYTES_PER_PACKET = 41
MAX_BYTES_PER_PACKET = 65536

# Addresses no flow may use.
RESERVED_ADDRESSES = [
    "0.0.0.0", "10.0.0.0", "100.64.0.0", "127.0.0.0", "169.254.0.0", "172.16.0.0",
    "192.0.0.0", "192.0.2.0", "192.88.99.0", "192.168.0.0", "198.18.0.0", "198.51.100.0",
    "203.0.113.0", "224.0.0.0", "240.0.0.0", "255.255.255.255",
]

# Local addresses a decoded sequence gets when the caller names none.
DEFAULT_LOCAL_ADDRESSES = [
    "42.219.153.159", "42.219.153.16", "42.219.153.165", "42.219.153.170", "42.219.153.174",
    "42.219.153.179", "42.219.153.187", "42.219.153.190", "42.219.153.193", "42.219.153.198",
    "42.219.153.210", "42.219.153.214", "42.219.153.216", "42.219.153.220", "42.219.153.221",
    "42.219.153.23", "42.219.153.238", "42.219.153.241", "42.219.153.246", "42.219.153.250",
    "42.219.153.35", "42.219.153.36", "42.219.153.45", "42.219.153.47", "42.219.153.5",
    "42.219.153.53", "42.219.153.59", "42.219.153.60", "42.219.153.71", "42.219.153.75",
    "42.219.153.80", "42.219.153.81", "42.219.153.82", "42.219.153.83", "42.219.153.9",
    "42.219.154.124", "42.219.154.134", "42.219.154.145", "42.219.154.152", "42.219.154.155",
    "42.219.154.18", "42.219.154.181", "42.219.154.184", "42.219.154.185", "42.219.154.189",
    "42.219.154.191", "42.219.155.115", "42.219.155.123", "42.219.155.128", "42.219.155.132",
    "42.219.155.19", "42.219.155.25", "42.219.155.27", "42.219.155.30", "42.219.155.68",
    "42.219.155.69", "42.219.155.72", "42.219.155.86", "42.219.155.87", "42.219.155.89",
    "42.219.155.91", "42.219.156.188", "42.219.156.190", "42.219.156.194", "42.219.156.227",
    "42.219.156.237", "42.219.156.240", "42.219.157.13", "42.219.157.220", "42.219.157.246",
    "42.219.157.28", "42.219.158.162", "42.219.158.163", "42.219.158.169", "42.219.158.205",
    "42.219.158.209", "42.219.158.211", "42.219.158.217", "42.219.158.223", "42.219.158.224",
]

# Columns of an encoded row, by position.
ENCODED_COLUMNS = [
    "hour_x", "delta_x", "byt_x", "pkt_x", "td_x", "lport_x", "rport_x",
    "ip4_x", "ip3_x", "ip2_x", "ip1_x", "out_x", "in_x", "tcp_x", "udp_x", "other_x",
]

# Netflow layout: one-hot groups, classes of the categorical columns, generation order.
FLOW_ONE_HOT = ((11, 12), (13, 14, 15))
FLOW_CLASSES = {5: PORT_CLASSES, 6: PORT_CLASSES, 7: 256, 8: 256, 9: 256, 10: 256}
FLOW_PORTS = (5, 6)
FLOW_ORDER = (0, 1, 13, 11, 5, 6, 7, 8, 9, 10, 3, 2, 4)
FLOW_WINDOW = 5

# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class ColumnPlan:
    """Which columns are continuous, which discrete, and in what order they are generated.

    ``one_hot`` lists groups of adjacent indicator columns (one head per group, named by
    its first column); ``classes`` gives the class count of integer-coded columns, ``ports``
    those of them whose classes are port classes.
    ``mode`` "B" lets a head see the context rows and the current-row columns generated
    before it, "A" the context rows only.  ``arch`` sets mixture size and learning rate.
    """

    dim: int
    window: int
    one_hot: tuple = ()
    classes: dict = field(default_factory=dict)
    order: tuple = ()
    mode: str = "B"
    arch: str = "A"
    ports: tuple = ()

    def __post_init__(self):
        if self.mode not in ("A", "B"):
            raise ValueError(f"unknown mode {self.mode!r}")
        object.__setattr__(self, "classes", dict(self.classes))
        object.__setattr__(self, "order", tuple(self.order) or self.continuous + self.discrete)
        if set(self.order) != set(self.continuous + self.discrete):
            raise ValueError("order must name every head once")

    @property
    def group_of(self) -> dict:
        return {group[0]: group for group in self.one_hot}

    @property
    def discrete(self) -> tuple:
        return tuple(sorted(set(self.group_of) | set(self.classes)))

    @property
    def continuous(self) -> tuple:
        grouped = {c for group in self.one_hot for c in group}
        return tuple(c for c in range(self.dim) if c not in grouped and c not in self.classes)

    @property
    def components(self) -> int:
        return 2 if self.arch == "A" else 10

    @property
    def learning_rate(self) -> float:
        return 0.02 if self.arch == "A" else 0.001

    @property
    def input_dim(self) -> int:
        return self.dim * (self.window + (self.mode == "B"))

    def class_count(self, col: int) -> int:
        return len(self.group_of[col]) if col in self.group_of else self.classes[col]

    def visible(self, col: int) -> list:
        """Current-row columns that head ``col`` may look at."""
        if self.mode == "A":
            return []
        before = self.order[: self.order.index(col)]
        return sorted(c for head in before for c in self.group_of.get(head, (head,)))

    def feature_mask(self, col: int) -> list:
        """1 for each input position head ``col`` may look at, 0 for the rest."""
        seen = set(self.visible(col))
        current = [float(c in seen) for c in range(self.dim)] if self.mode == "B" else []
        return [1.0] * (self.dim * self.window) + current


def flow_plan(mode: str = "B", arch: str = "B") -> ColumnPlan:
    """The plan of the 16 encoded flow columns."""
    return ColumnPlan(len(ENCODED_COLUMNS), FLOW_WINDOW, FLOW_ONE_HOT, FLOW_CLASSES, FLOW_ORDER, mode, arch, FLOW_PORTS)
