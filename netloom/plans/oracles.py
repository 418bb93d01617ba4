"""The registered queries once more, as SQL over the same tables."""

from __future__ import annotations

from netloom import config as cfg
from netloom.sources.flows import FLOWS_FROM_EVENTS

FLOWS = FLOWS_FROM_EVENTS.replace("{events}", "events")
FIELDS = "flow_id, td, sa, da, sp, dp, pr, pkt, byt, lable"
DAY = "te >= TIMESTAMP '2024-01-05' AND te < TIMESTAMP '2024-01-06'"
ORDER = "ORDER BY te, flow_id"
W = f"PARTITION BY this_ip {ORDER}"


def _with(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([f"flows AS ({FLOWS})", *ctes]) + "\n" + body


DATASETS = "d AS (SELECT *, CASE WHEN flow_id % 2 = 0 THEN 'real' ELSE 'generated' END AS dataset FROM flows)"


def _datasets(body: str, *ctes: str) -> str:
    return _with(body, DATASETS, *ctes)


# --- host profiles ----------------------------------------------------------

def _stats(name: str = "stats", where: str = "TRUE") -> str:
    return f"""{name}_ends AS (
  SELECT sa AS ip, da AS peer, 1 AS sent FROM flows WHERE {where}
  UNION ALL SELECT da, sa, 0 FROM flows WHERE {where}),
{name}_counts AS (
  SELECT ip, count(*) AS number_of_rows,
         count(*) FILTER (WHERE sent = 0 AND peer NOT LIKE '42.219.%') AS incoming_num,
         count(*) FILTER (WHERE sent = 1 AND peer NOT LIKE '42.219.%') AS outgoing_num
  FROM {name}_ends WHERE ip LIKE '42.219.%' GROUP BY ip),
{name} AS (
  SELECT *, CASE WHEN incoming_num > 0 AND outgoing_num > 0 THEN 0 WHEN outgoing_num > 0 THEN 1
                 WHEN incoming_num > 0 THEN 2 ELSE 3 END AS user_type
  FROM {name}_counts)"""


EXTRACTED = f"""extracted AS (
  SELECT ip AS "user", {FIELDS} FROM stats JOIN flows ON sa = ip OR da = ip WHERE user_type = 0)"""

MIDDLE = """ranked AS (
  SELECT ip, number_of_rows, row_number() OVER (ORDER BY number_of_rows DESC, ip DESC) - 1 AS position,
         count(*) OVER () AS n
  FROM stats WHERE user_type = 0),
middle AS (
  SELECT position, ip, number_of_rows FROM ranked
  WHERE position >= floor(n / 4) AND position < floor(n * 3 / 4))"""

# --- encoding ---------------------------------------------------------------

DELTAS = f"""deltas AS (
  SELECT *, coalesce((epoch_us(te) - lag(epoch_us(te)) OVER ({W})) / 1e6, 0.0) AS delta,
         sa = this_ip AS outgoing,
         CASE WHEN sa = this_ip THEN sp ELSE dp END AS local_port,
         CASE WHEN sa = this_ip THEN dp ELSE sp END AS remote_port,
         CASE WHEN sa = this_ip THEN da ELSE sa END AS remote_ip
  FROM flows)"""


def _octet(ip: str, i: int) -> str:
    return f"CAST(split_part({ip}, '.', {i}) AS INTEGER)"


def _port_class(port: str) -> str:
    return f"CAST(CASE WHEN {port} < 1024 THEN {port} ELSE floor(({port} - 1024) / 100) + 1024 END AS INTEGER)"


ENCODED_SQL = [
    "hour(te) / 23.0::DOUBLE",
    "delta / 1430.0::DOUBLE",
    "ln(byt) / 20.12915933105231::DOUBLE",
    "ln(pkt) / 12.83::DOUBLE",
    "td / 363.0::DOUBLE",
    "local_port / 65535.0::DOUBLE",
    "remote_port / 65535.0::DOUBLE",
    *[f"{_octet('remote_ip', i)} / 255.0::DOUBLE" for i in (4, 3, 2, 1)],
    "CAST(outgoing AS INTEGER)::DOUBLE",
    "CAST(NOT outgoing AS INTEGER)::DOUBLE",
    "CAST(pr = 'TCP' AS INTEGER)::DOUBLE",
    "CAST(pr = 'UDP' AS INTEGER)::DOUBLE",
    "CAST(pr NOT IN ('TCP', 'UDP') AS INTEGER)::DOUBLE",
]
ENCODED = (
    "encoded AS (SELECT flow_id, te, this_ip, pr, sa, da, sp, dp, remote_ip, outgoing, local_port, remote_port, delta, "
    + ", ".join(f"{x} AS {n}" for x, n in zip(ENCODED_SQL, cfg.ENCODED_COLUMNS))
    + " FROM deltas)"
)


def _label(i: int) -> str:
    name = cfg.ENCODED_COLUMNS[i]
    if i in (5, 6):
        return _port_class(f"round_even({name} * 65536.0, 0)") + "::DOUBLE"
    if 7 <= i <= 10:
        return f"least(round_even({name} * 255.0, 0), 255)::DOUBLE"
    return name


LABELS = (
    "labels_of AS (SELECT flow_id, te, this_ip, "
    + ", ".join(f"{_label(i)} AS {n}" for i, n in enumerate(cfg.ENCODED_COLUMNS))
    + " FROM encoded)"
)

CONTEXT = "context AS (SELECT flow_id, te, this_ip, " + ", ".join(
    (f"coalesce(lag({n}, {back}) OVER w, 0.0)" if back else n) + f" AS c{(cfg.FLOW_WINDOW - back) * 16 + i}"
    for back in range(cfg.FLOW_WINDOW, -1, -1)
    for i, n in enumerate(cfg.ENCODED_COLUMNS)
) + f" FROM encoded WINDOW w AS ({W}))"

POSITION_SUMS = _with(
    "SELECT position, count(*) AS rows, round(sum(x), 4) AS total FROM ("
    + " UNION ALL ".join(f"SELECT {i} AS position, c{i} AS x FROM context" for i in range(96))
    + " UNION ALL "
    + " UNION ALL ".join(f"SELECT {96 + i}, {n} FROM labels_of" for i, n in enumerate(cfg.ENCODED_COLUMNS))
    + ") GROUP BY position",
    DELTAS, ENCODED, LABELS, CONTEXT,
)


def _encoded(columns: list[str]) -> str:
    return _with(f"SELECT flow_id, {', '.join(columns)} FROM encoded", DELTAS, ENCODED)


# --- histograms -------------------------------------------------------------

SCORED = """scored AS (
  SELECT dataset, ln(byt + 1.0::DOUBLE) AS byt, ln(pkt + 1.0::DOUBLE) AS pkt, td, sp::DOUBLE AS sp, dp::DOUBLE AS dp,
         CASE pr WHEN 'TCP' THEN 0.0::DOUBLE WHEN 'UDP' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS pr
  FROM d)"""


def _long(columns, source="scored") -> str:
    rows = " UNION ALL ".join(f"SELECT dataset, '{n}' AS col, {n} AS x FROM {source}" for n in columns)
    return f"long AS ({rows})"


def _right_closed(bins: int, shared: bool = False) -> str:
    over = "() " if shared else "(PARTITION BY dataset, col)"
    per = "PARTITION BY col" if shared else "PARTITION BY dataset, col"
    return f"""spans AS (
  SELECT dataset, col, min(min(x)) OVER ({per}) AS lo, max(max(x)) OVER ({per}) AS hi
  FROM long GROUP BY dataset, col),
guessed AS (
  SELECT l.dataset, l.col, x, lo, hi, (hi - lo) / {bins}.0::DOUBLE AS step,
         CASE WHEN hi > lo THEN greatest(1, least({bins}, ceil((x - lo) / ((hi - lo) / {bins}.0::DOUBLE)))) END AS g
  FROM long l JOIN spans USING (dataset, col)),
binned AS (
  SELECT dataset, col, CAST(CASE WHEN hi = lo THEN {(bins + 1) // 2}
      WHEN g < {bins} AND x > g * step + lo THEN g + 1
      WHEN g > 1 AND x <= (g - 1) * step + lo THEN g - 1 ELSE g END AS INTEGER) AS bin
  FROM guessed),
hist AS (
  SELECT s.dataset, s.col, r.bin, coalesce(c.n, 0) AS n
  FROM spans s CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(1, {bins + 1})) r
  LEFT JOIN (SELECT dataset, col, bin, count(*) AS n FROM binned GROUP BY ALL) c
    ON c.dataset = s.dataset AND c.col = s.col AND c.bin = r.bin)"""


def _left_closed(bins: int) -> str:
    return f"""spans AS (SELECT dataset, col, min(x) AS lo, max(x) AS hi FROM long GROUP BY dataset, col),
guessed AS (
  SELECT dataset, col, x, lo, hi, (hi - lo) / {bins}.0::DOUBLE AS step,
         greatest(0, least({bins - 1}, floor((x - lo) / ((hi - lo) / {bins}.0::DOUBLE)))) AS g
  FROM long JOIN spans USING (dataset, col)),
binned AS (
  SELECT dataset, col, CAST(CASE WHEN g > 0 AND x < g * step + lo THEN g - 1
      WHEN g < {bins - 1} AND x >= (g + 1) * step + lo THEN g + 1 ELSE g END AS INTEGER) AS bin
  FROM guessed),
hist AS (
  SELECT s.dataset, s.col, r.bin, s.lo, s.hi, coalesce(c.n, 0) AS n
  FROM spans s CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(0, {bins})) r
  LEFT JOIN (SELECT dataset, col, bin, count(*) AS n FROM binned GROUP BY ALL) c
    ON c.dataset = s.dataset AND c.col = s.col AND c.bin = r.bin)"""


HIST = [SCORED, _long(cfg.METRIC_COLUMNS), _right_closed(304)]
SMOOTH = """smooth AS (
  SELECT dataset, col, bin, (n + 1.0::DOUBLE) / (sum(n) OVER (PARTITION BY dataset, col) + 304.0::DOUBLE) AS p FROM hist)"""
ALIGNED = """aligned AS (
  SELECT g.dataset, g.col, g.bin, r.p, g.p AS q FROM smooth g JOIN smooth r ON g.col = r.col AND g.bin = r.bin
  WHERE g.dataset <> 'real' AND r.dataset = 'real')"""


def _score(*names: str, hist=HIST) -> str:
    exprs = {
        "js": "round((sum(p * ln(p / ((p + q) / 2))) + sum(q * ln(q / ((p + q) / 2)))) / 2, 9) AS js",
        "kl_forward": "round(sum(p * ln(p / q)), 9) AS kl_forward",
        "kl_reverse": "round(sum(q * ln(q / p)), 9) AS kl_reverse",
    }
    chosen = ", ".join(exprs[n] for n in names)
    return _datasets(f'SELECT dataset, col AS "column", {chosen} FROM aligned GROUP BY dataset, col', *hist, SMOOTH, ALIGNED)


# --- ports ------------------------------------------------------------------

TOP_PORTS = """top AS (
  SELECT dataset, pr, dp, flows, round(share, 9) AS share, rank FROM (
    SELECT dataset, pr, dp, count(*) AS flows, count(*) / sum(count(*)) OVER (PARTITION BY dataset, pr) AS share,
           row_number() OVER (PARTITION BY dataset, pr ORDER BY count(*) DESC, dp) AS rank
    FROM d WHERE dp < 1024 GROUP BY dataset, pr, dp) WHERE rank <= 10)"""
BARS = """bars AS (
  SELECT g.dataset, g.pr, r.bar * 6000 + 1024 AS port, round(coalesce(c.n, 0) / g.total, 9) AS share
  FROM (SELECT dataset, pr, count(*) AS total FROM d WHERE dp >= 1024 GROUP BY dataset, pr) g
  CROSS JOIN (SELECT CAST(range AS INTEGER) AS bar FROM range(0, 11)) r
  LEFT JOIN (SELECT dataset, pr, (dp - 1024) // 6000 AS bar, count(*) AS n FROM d WHERE dp >= 1024 GROUP BY ALL) c
    ON c.dataset = g.dataset AND c.pr = g.pr AND c.bar = r.bar)"""
PORT_TABLES = [(d, p) for d in ("real", "generated") for p in ("TCP", "UDP")]


def _side_by_side(table: str, index: str, values: dict[str, str]) -> str:
    chosen = ", ".join(
        f'max({v}) FILTER (WHERE dataset = \'{d}\' AND pr = \'{p}\') AS "{d}_{p}_{name}"'
        for d, p in PORT_TABLES
        for name, v in values.items()
    )
    return f"SELECT {index}, {chosen} FROM {table} GROUP BY {index}"


ENDS = "ends AS (SELECT sa AS ip, byt, flow_id FROM flows UNION ALL SELECT da, byt, flow_id FROM flows)"


def _curve(value: str, where: str = "ip NOT LIKE '42.219%'") -> str:
    return _with(
        "SELECT ip, value, row_number() OVER (ORDER BY value DESC, ip) AS rank, round(ln(value), 9) AS ln_value "
        f"FROM (SELECT ip, CAST({value} AS BIGINT) AS value FROM ends WHERE {where} GROUP BY ip)", ENDS,
    )


SETS = ("sets AS (SELECT dataset, sa AS ip, da AS peer, byt, 1 AS sent FROM d "
        "UNION ALL SELECT dataset, da, sa, byt, 0 FROM d)")


def _set_curve(value: str) -> str:
    return _datasets(
        "SELECT dataset, ip, value, row_number() OVER (PARTITION BY dataset ORDER BY value DESC, ip) AS rank, "
        f"round(ln(value), 9) AS ln_value FROM (SELECT dataset, ip, CAST({value} AS BIGINT) AS value FROM sets "
        "WHERE ip NOT LIKE '42.219%' GROUP BY dataset, ip)", SETS,
    )


# --- rules ------------------------------------------------------------------

def _listed(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


RULES = {
    "one_end_internal":
        "sa LIKE '42.219%' OR da LIKE '42.219%' OR sa = '0.0.0.0' OR da = '255.255.255.255'",
    "web_is_tcp": "CASE WHEN sp IN (80, 443) OR dp IN (80, 443) THEN pr = 'TCP' END",
    "dns_is_udp": "CASE WHEN sp IN (52, 53) OR dp IN (52, 53) THEN pr = 'UDP' END",
    "multicast_only_destination": (
        f"CASE WHEN ({_octet('da', 1)} > 223 OR ({_octet('da', 1)} = 192 AND {_octet('da', 4)} = 255)) "
        f"AND {_octet('sa', 1)} < 224 THEN TRUE WHEN {_octet('sa', 1)} > 223 THEN FALSE END"
    ),
    "netbios_stays_inside": (
        "CASE WHEN dp IN (137, 138) THEN sa LIKE '42.219.%' AND pr = 'UDP' "
        f"AND {_octet('da', 1)} = 42 AND {_octet('da', 4)} = 255 END"
    ),
    "no_reserved_address":
        f"sa NOT IN {_listed(cfg.RESERVED_ADDRESSES)} AND da NOT IN {_listed(cfg.RESERVED_ADDRESSES)}",
    "bytes_fit_packets": "byt >= 41 * pkt AND byt <= 65536 * pkt",
    "one_packet_is_short": "CASE WHEN pkt <= 1 THEN td < 1 END",
}

RULE_ROWS = "verdicts AS (" + " UNION ALL ".join(
    f"SELECT dataset, '{name}' AS rule, CAST(({sql}) AS INTEGER) AS verdict FROM d" for name, sql in RULES.items()
) + ")"



def _reports() -> str:
    """Every value of every report, one row each."""
    sizes = {f"{n}_{kind}": f"{value.format(n)}" for n in ("byt", "pkt") for kind, value in (("min", "min({})::DOUBLE"), ("ln_max", "ln(max({}))"))}
    shares = {"tcp": "pr = 'TCP'", "udp": "pr = 'UDP'", "other": "pr NOT IN ('TCP', 'UDP')"}
    curve = ("SELECT dataset, ip, value, row_number() OVER (PARTITION BY dataset ORDER BY value DESC, ip) AS rank FROM ("
             "SELECT dataset, ip, {} AS value FROM sets WHERE ip NOT LIKE '42.219%' GROUP BY dataset, ip)")
    kinds = ("CASE WHEN incoming_num > 0 AND outgoing_num > 0 THEN 0 WHEN outgoing_num > 0 THEN 1 WHEN incoming_num > 0 THEN 2 ELSE 3 END")
    tables = {
        "scale": ("", {n: n for n in sizes}, "SELECT dataset, " + ", ".join(f"{v} AS {n}" for n, v in sizes.items()) + " FROM d GROUP BY dataset"),
        "protocol": ("", {n: n for n in shares}, "SELECT dataset, " + ", ".join(f"avg(CAST({v} AS INTEGER)) AS {n}" for n, v in shares.items()) + " FROM d GROUP BY dataset"),
        "system_ports": ("pr || '|' || rank", {n: n for n in ("dp", "flows", "share")}, TOP_PORTS.split("AS (", 1)[1].rsplit(")", 1)[0].replace("round(share, 9)", "share")),
        "user_ports": ("pr || '|' || port", {"share": "share"}, "SELECT * FROM bars"),
        "rules": ("rule", {n: n for n in ("true_count", "total")},
                  "SELECT dataset, rule, coalesce(sum(verdict), 0) AS true_count, count(verdict) AS total FROM verdicts GROUP BY dataset, rule"),
        "divergence": ("col", {n: n for n in ("js", "kl_forward", "kl_reverse")}, _score_select()),
        "user_stats": ("ip", {n: n for n in ("number_of_rows", "incoming_num", "outgoing_num", "user_type")},
                       f"SELECT *, {kinds} AS user_type FROM (SELECT dataset, ip, count(*) AS number_of_rows, "
                       "count(*) FILTER (WHERE sent = 0 AND peer NOT LIKE '42.219.%') AS incoming_num, "
                       "count(*) FILTER (WHERE sent = 1 AND peer NOT LIKE '42.219.%') AS outgoing_num "
                       "FROM sets WHERE ip LIKE '42.219.%' GROUP BY dataset, ip)"),
        "ip_occurrence": ("ip", {n: n for n in ("value", "rank")}, curve.format("count(*)")),
        "ip_volume": ("ip", {n: n for n in ("value", "rank")}, curve.format("sum(byt)")),
    }
    rows = [
        f"SELECT '{report}' AS report, 'run' AS run, dataset, {item or repr('')} AS item, '{name}' AS name, "
        f"round(CAST({value} AS DOUBLE), 6) AS value FROM ({table})"
        for report, (item, values, table) in tables.items() for name, value in values.items()
    ]
    return _datasets(" UNION ALL ".join(rows), *HIST, SMOOTH, ALIGNED, BARS, RULE_ROWS, SETS)


def _score_select() -> str:
    return ("SELECT dataset, col, (sum(p * ln(p / ((p + q) / 2))) + sum(q * ln(q / ((p + q) / 2)))) / 2 AS js, "
            "sum(p * ln(p / q)) AS kl_forward, sum(q * ln(q / p)) AS kl_reverse FROM aligned GROUP BY dataset, col")


# --- series -----------------------------------------------------------------

DW = f"PARTITION BY dataset {ORDER}"
SIZES = "sizes AS (SELECT dataset, te, flow_id, ln(byt) AS x, ln(pkt) AS y FROM d)"
LAGS = (
    "lags AS (SELECT dataset, byt::DOUBLE AS x, "
    + ", ".join(f"lead(byt::DOUBLE, {i}) OVER w AS x{i}" for i in range(1, 10))
    + f" FROM d WINDOW w AS ({DW}))"
)

TWO_FIELDS = "SELECT flow_id, {} FROM flows"
CLASS_OF = {n: _port_class(n) for n in ("sp", "dp", "local_port", "remote_port")}


def _decoded_port(port: str) -> str:
    cls = _port_class(port)
    return f"CAST(least(CASE WHEN {cls} < 1024 THEN {cls} ELSE ({cls} - 1024) * 100 + 1024 END, 65535) AS INTEGER)"


def _pair(out: str, other: str, name: str) -> str:
    return f"CASE WHEN outgoing THEN {out} ELSE {other} END AS {name}"


REVERSED_IP = "concat_ws('.', " + ", ".join(f"split_part(remote_ip, '.', {i})" for i in (4, 3, 2, 1)) + ")"
# The published port decoding: the class, stored as class/1670, read back by truncation.
COMPAT_CLASS = {
    n: f"CAST(floor({CLASS_OF[n]} / 1670.0::DOUBLE * 1670.0::DOUBLE) AS INTEGER)" for n in ("local_port", "remote_port")
}
COMPAT_PORT = {
    n: f"least(CASE WHEN {c} < 1024 THEN {c} ELSE ({c} - 1024) * 100 + 1024 END, 65535)"
    for n, c in COMPAT_CLASS.items()
}
OTHER_PR = "CASE WHEN pr IN ('TCP', 'UDP') THEN pr ELSE 'Other' END AS pr"

EDGE_STEP = f"(({cfg.LN_BYT_EDGE_LAST}::DOUBLE - {cfg.LN_BYT_EDGE_FIRST}::DOUBLE) / 303.0::DOUBLE)"
EDGES = (
    "edges AS (SELECT 0 AS bucket, 0.0::DOUBLE AS lo, "
    f"{cfg.LN_BYT_EDGE_FIRST}::DOUBLE AS hi UNION ALL SELECT CAST(range AS INTEGER) + 1, "
    f"range * {EDGE_STEP} + {cfg.LN_BYT_EDGE_FIRST}::DOUBLE, (range + 1) * {EDGE_STEP} + {cfg.LN_BYT_EDGE_FIRST}::DOUBLE "
    "FROM range(0, 303))"
)

NORMED = "(({0} - min({0}) OVER ()) / (max({0}) OVER () - min({0}) OVER ())::DOUBLE)"

ORACLES = {
    # sources and sinks
    "read_raw_flows": _with(
        "SELECT pr, lable, count(*) AS flows, CAST(sum(pkt) AS BIGINT) AS pkt, CAST(sum(byt) AS BIGINT) AS byt, "
        "sum(td) AS td, count(DISTINCT te) AS times, CAST(sum(sp) AS BIGINT) AS sp, CAST(sum(dp) AS BIGINT) AS dp "
        "FROM flows GROUP BY pr, lable"
    ),
    "read_flow_pieces": _with(
        "SELECT dataset, piece, pr, count(*) AS flows, CAST(sum(byt) AS BIGINT) AS byt, CAST(sum(pkt) AS BIGINT) AS pkt "
        "FROM (SELECT 'baseline' AS dataset, CAST((sp + dp) % 5 AS INTEGER) AS piece, * FROM flows "
        "UNION ALL SELECT 'real', 0, * FROM flows) GROUP BY dataset, piece, pr"
    ),
    "read_windows": POSITION_SUMS,
    "write_user_flows": _with(
        'SELECT "user", count(*) AS flows, CAST(sum(byt) AS BIGINT) AS byt, min(flow_id) AS first_flow '
        'FROM extracted GROUP BY "user"', _stats(), EXTRACTED,
    ),
    "read_one_user": _with(
        'SELECT "user", count(*) AS flows, CAST(sum(byt) AS BIGINT) AS byt, TRUE AS in_range FROM extracted '
        'WHERE "user" IN (SELECT "user" FROM extracted GROUP BY "user" ORDER BY count(*) DESC, "user" LIMIT 5) GROUP BY "user"',
        _stats(), EXTRACTED,
    ),
    "write_windows": _with(
        'SELECT this_ip AS "user", count(*) AS windows, count(*) * 112 AS fields FROM flows GROUP BY this_ip'
    ),
    "write_reports": _reports(),
    "recover_user_list": _with(
        'SELECT "user", count(*) AS rows FROM extracted GROUP BY "user"', _stats(), EXTRACTED
    ),
    "folder_totals": _with("SELECT count(*) AS total_rows FROM extracted", _stats(), EXTRACTED),
    "prepare_windows": POSITION_SUMS,
    # filters
    "on_day": _with(f"SELECT {FIELDS} FROM flows WHERE {DAY}"),
    "touches_internal": _with(f"SELECT {FIELDS} FROM flows WHERE sa LIKE '42.219.%' OR da LIKE '42.219.%'"),
    "extract_users": _with("SELECT * FROM extracted", _stats(), EXTRACTED),
    "extract_user": _with(f"SELECT {FIELDS} FROM flows WHERE sa = '42.219.152.150'"),
    "by_direction": _with(
        "SELECT 'outgoing' AS direction, flow_id, sa, da FROM flows WHERE sa LIKE '42.219%' "
        "UNION ALL SELECT 'incoming', flow_id, sa, da FROM flows WHERE da LIKE '42.219%' "
        "UNION ALL SELECT 'all', flow_id, sa, da FROM flows"
    ),
    "by_protocol": _with(f"SELECT pr AS chosen, {FIELDS} FROM flows WHERE pr IN ('TCP', 'UDP')"),
    "by_port_class": _with(
        "SELECT CASE WHEN dp < 1024 THEN 'system' ELSE 'user' END AS port_class, flow_id, dp FROM flows"
    ),
    "external_endpoints": _with("SELECT ip, flow_id FROM ends WHERE ip NOT LIKE '42.219%'", ENDS),
    "drop_invalid": _with(
        "SELECT flow_id, pr, round(byt / td, 6) AS byte_rate, round(td / (pkt - 1), 6) AS gap "
        "FROM flows WHERE td > 0 AND pkt > 1"
    ),
    "metric_columns": _with(
        "SELECT flow_id, round(ln(byt + 1.0::DOUBLE), 9) AS byt, round(ln(pkt + 1.0::DOUBLE), 9) AS pkt, td, "
        "sp::DOUBLE AS sp, dp::DOUBLE AS dp, CASE pr WHEN 'TCP' THEN 0 WHEN 'UDP' THEN 1 ELSE 2 END::DOUBLE AS pr "
        "FROM flows"
    ),
    # joins
    "flows_of_listed_users": _with(
        'SELECT "user", count(*) AS flows, count(*) FILTER (WHERE sa = "user") AS sent, '
        'CAST(sum(byt) AS BIGINT) AS byt FROM extracted GROUP BY "user"', _stats(), EXTRACTED,
    ),
    "still_present": _with(
        "SELECT e.ip FROM early e JOIN stats s ON e.ip = s.ip WHERE s.user_type = 0",
        _stats(), _stats("early", DAY),
    ),
    "aligned_histograms": _datasets(
        'SELECT dataset, col AS "column", bin, round(p, 12) AS p, round(q, 12) AS q FROM aligned',
        *HIST, SMOOTH, ALIGNED,
    ),
    "system_ports_side_by_side": _datasets(_side_by_side("top", "rank", {"port": "dp::DOUBLE", "share": "share"}), TOP_PORTS),
    "user_ports_side_by_side": _datasets(_side_by_side("bars", "port", {"share": "share"}), BARS),
    # aggregations
    "endpoint_occurrences": _with("SELECT ip, number_of_rows FROM stats", _stats()),
    "outgoing_num": _with("SELECT ip, outgoing_num FROM stats", _stats()),
    "incoming_num": _with("SELECT ip, incoming_num FROM stats", _stats()),
    "user_type": _with("SELECT ip, user_type FROM stats", _stats()),
    "user_type_counts": _with(
        "SELECT CAST(t.range AS INTEGER) AS user_type, count(ip) AS users "
        "FROM range(0, 4) t LEFT JOIN stats ON stats.user_type = t.range GROUP BY t.range", _stats(),
    ),
    "user_stats": _with(
        "SELECT number_of_rows, ip, incoming_num, outgoing_num, user_type FROM stats "
        "ORDER BY number_of_rows DESC, ip DESC", _stats(),
    ),
    "user_stats_of_day": _with(
        "SELECT number_of_rows, ip, incoming_num, outgoing_num, user_type FROM stats "
        "ORDER BY number_of_rows DESC, ip DESC", _stats(where=DAY),
    ),
    "protocol_share": _datasets(
        "SELECT dataset, round(avg(CAST(pr = 'TCP' AS INTEGER)), 9) AS tcp, "
        "round(avg(CAST(pr = 'UDP' AS INTEGER)), 9) AS udp, "
        "round(avg(CAST(pr NOT IN ('TCP', 'UDP') AS INTEGER)), 9) AS other FROM d GROUP BY dataset"
    ),
    "protocol_value_counts": _datasets(
        "SELECT dataset, CASE pr WHEN 'TCP' THEN 0 WHEN 'UDP' THEN 1 ELSE 2 END AS code, count(*) AS flows "
        "FROM d GROUP BY ALL"
    ),
    "system_port_top": _datasets("SELECT * FROM top", TOP_PORTS),
    "system_port_hist": _datasets(
        "SELECT dataset, bin, n FROM hist",
        "system AS (SELECT dataset, dp::DOUBLE AS dp FROM d WHERE dp < 1024)", _long(["dp"], "system"),
        _left_closed(1024),
    ),
    "user_port_hist": _datasets("SELECT * FROM bars", BARS),
    "ip_occurrence_curve": _curve("count(*)"),
    "ip_volume_curve": _curve("sum(byt)"),
    "ip_occurrence_by_dataset": _set_curve("count(*)"),
    "ip_volume_by_dataset": _set_curve("sum(byt)"),
    "user_stats_by_dataset": _datasets(
        "SELECT *, CASE WHEN incoming_num > 0 AND outgoing_num > 0 THEN 0 WHEN outgoing_num > 0 THEN 1 "
        "WHEN incoming_num > 0 THEN 2 ELSE 3 END AS user_type FROM (SELECT dataset, ip, count(*) AS number_of_rows, "
        "count(*) FILTER (WHERE sent = 0 AND peer NOT LIKE '42.219.%') AS incoming_num, "
        "count(*) FILTER (WHERE sent = 1 AND peer NOT LIKE '42.219.%') AS outgoing_num "
        "FROM sets WHERE ip LIKE '42.219.%' GROUP BY dataset, ip)", SETS,
    ),
    "scale_check": _datasets(
        "SELECT dataset, min(byt)::DOUBLE AS byt_min, min(pkt)::DOUBLE AS pkt_min, "
        "round(ln(max(byt)), 9) AS byt_ln_max, round(ln(max(pkt)), 9) AS pkt_ln_max FROM d GROUP BY dataset"
    ),
    "histogram_cut": _datasets('SELECT dataset, col AS "column", bin, n FROM hist', *HIST),
    "histogram_cut_shared": _datasets(
        'SELECT dataset, col AS "column", bin, n FROM hist', *HIST[:2], _right_closed(304, shared=True)
    ),
    "density_hist": _datasets(
        "SELECT dataset, bin, n, round(n / (sum(n) OVER (PARTITION BY dataset) * ((hi - lo) / 304.0::DOUBLE)), 9) "
        "AS density FROM hist", SCORED, _long(["byt"]), _left_closed(304),
    ),
    "hist2d": _datasets(
        "SELECT dataset, x_bin, y_bin, count(*) AS n FROM (SELECT dataset, "
        + ", ".join(
            f"CAST(CASE WHEN g{v} > 0 AND {v} < g{v} * 0.04::DOUBLE + -1.0 THEN g{v} - 1 "
            f"WHEN g{v} < 49 AND {v} >= (g{v} + 1) * 0.04::DOUBLE + -1.0 THEN g{v} + 1 ELSE g{v} END AS INTEGER) AS {v}_bin"
            for v in "xy"
        )
        + " FROM (SELECT *, least(49, floor((x + 1.0) / 0.04::DOUBLE)) AS gx, "
        "least(49, floor((y + 1.0) / 0.04::DOUBLE)) AS gy FROM "
        "(SELECT dataset, td / 40 - 1 AS x, pkt / 16 - 1 AS y FROM d) "
        "WHERE x BETWEEN -1 AND 1 AND y BETWEEN -1 AND 1)) GROUP BY ALL"
    ),
    "max_over_sets": _with("SELECT max(td) AS max_td FROM flows"),
    "laplace_smooth": _datasets('SELECT dataset, col AS "column", bin, round(p, 12) AS p FROM smooth', *HIST, SMOOTH),
    "plain_distribution": _datasets(
        'SELECT dataset, col AS "column", bin, round(n / sum(n) OVER (PARTITION BY dataset, col), 12) AS p FROM hist',
        *HIST,
    ),
    "js_divergence": _score("js", hist=[SCORED, _long(["byt"]), _right_closed(304)]),
    "kl_divergence": _score("kl_forward", "kl_reverse"),
    "js_scorecard": _score("js"),
    "js_scorecard_shared": _score("js", hist=[*HIST[:2], _right_closed(304, shared=True)]),
    "rule_report": _datasets(
        "SELECT dataset, rule, CAST(coalesce(sum(verdict), 0) AS BIGINT) AS true_count, count(verdict) AS total, "
        "round(avg(verdict), 9) AS share FROM verdicts GROUP BY dataset, rule", RULE_ROWS,
    ),
    **{
        f"rule_{name}": _with(
            f"SELECT flow_id, CASE WHEN v THEN 'pass' WHEN NOT v THEN 'fail' ELSE 'not applicable' END AS verdict "
            f"FROM (SELECT flow_id, ({sql}) AS v FROM flows)"
        )
        for name, sql in RULES.items()
    },
    # window and time-series functions
    "lag1": _datasets(
        f"SELECT * FROM (SELECT dataset, flow_id, byt, lag(byt) OVER ({DW}) AS byt_prev FROM d) WHERE byt_prev IS NOT NULL"
    ),
    "lead1": _datasets(
        f"SELECT * FROM (SELECT dataset, flow_id, byt, lead(byt) OVER ({DW}) AS byt_next FROM d) WHERE byt_next IS NOT NULL"
    ),
    "acf": _datasets(
        "SELECT dataset, 0 AS lag, 1.0::DOUBLE AS acf FROM (SELECT DISTINCT dataset FROM d) "
        + " ".join(
            f"UNION ALL SELECT dataset, {i}, round(corr(x, x{i}), 9) FROM lags WHERE x{i} IS NOT NULL GROUP BY dataset"
            for i in range(1, 10)
        ), LAGS,
    ),
    "autocorrelation": _datasets(
        " UNION ALL ".join(
            f"SELECT l.dataset, {i} AS lag, round(sum((x - m) * ({'x' if i == 0 else f'x{i}'} - m)) / (any_value(v) * (any_value(n) - {i})), 9) "
            "AS autocorrelation FROM lags l JOIN moments USING (dataset) GROUP BY l.dataset"
            for i in range(5)
        ), LAGS,
        "moments AS (SELECT dataset, avg(byt::DOUBLE) AS m, var_pop(byt::DOUBLE) AS v, count(*) AS n FROM d GROUP BY dataset)",
    ),
    "context_window": _with(
        "SELECT flow_id, " + ", ".join(f"round(c{i}, 9) AS c{i}" for i in range(96)) + " FROM context",
        DELTAS, ENCODED, CONTEXT,
    ),
    "label_row": _with(
        "SELECT flow_id, " + ", ".join(f"round({n}, 9) AS {n}" for n in cfg.ENCODED_COLUMNS) + " FROM labels_of",
        DELTAS, ENCODED, LABELS,
    ),
    "inter_arrival": _with("SELECT flow_id, this_ip, round(delta, 6) AS delta FROM deltas", DELTAS),
    "middle_half": _with("SELECT * FROM middle", _stats(), MIDDLE),
    "cumulative_clock": _with(
        "SELECT flow_id, clock, round(floor(clock / 3600) / 24.0::DOUBLE, 9) AS clock_hour FROM ("
        "SELECT flow_id, CAST(coalesce(sum(floor(delta)) OVER "
        f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS clock FROM deltas)", DELTAS,
    ),
    # sort, limit, sampling
    "top20_users": _with(
        "SELECT number_of_rows, ip FROM stats ORDER BY number_of_rows DESC, ip DESC LIMIT 20", _stats()
    ),
    "ranked_destinations": _with(
        "SELECT da, packets, row_number() OVER (ORDER BY packets DESC, da) AS rank, round(ln(packets), 9) AS ln_value "
        "FROM (SELECT da, CAST(sum(pkt) AS BIGINT) AS packets FROM flows GROUP BY da)"
    ),
    "head_flows": _with(f"SELECT {FIELDS} FROM flows ORDER BY te, flow_id LIMIT 100"),
    # set operations
    "endpoints_union": _with(
        "SELECT ip, count(*) AS ends, CAST(sum(byt) AS BIGINT) AS byt FROM ends GROUP BY ip", ENDS
    ),
    "pieces_union": _datasets(f"SELECT dataset, {FIELDS} FROM d"),
    "train_test_union": _datasets(
        "SELECT dataset, " + ", ".join(f"round(avg({n}_x), 9) AS {n}_mean" for n in ("byt", "pkt", "td", "sp", "dp"))
        + " FROM (SELECT dataset, " + ", ".join(f"{NORMED.format(n)} AS {n}_x" for n in ("byt", "pkt", "td", "sp", "dp"))
        + " FROM d) GROUP BY dataset"
    ),
    "swap_local": _with(
        'SELECT flow_id, td, CASE WHEN loc THEN sp ELSE dp END AS "localPort", '
        'CASE WHEN loc THEN dp ELSE sp END AS "outPort", pr, pkt, byt, '
        + ", ".join(f'{_octet("CASE WHEN loc THEN sa ELSE da END", i + 1)} AS "localIP_{i}"' for i in range(4)) + ", "
        + ", ".join(f'{_octet("CASE WHEN loc THEN da ELSE sa END", i + 1)} AS "outIP_{i}"' for i in range(4))
        + " FROM (SELECT *, sa LIKE '42.219.%' AS loc FROM flows)"
    ),
    # column functions
    "ln_sizes": _with(TWO_FIELDS.format("round(ln(byt), 9) AS ln_byt, round(ln(pkt), 9) AS ln_pkt")),
    "ln1p_sizes": _with(
        TWO_FIELDS.format("round(ln(byt + 1.0::DOUBLE), 9) AS byt, round(ln(pkt + 1.0::DOUBLE), 9) AS pkt")
    ),
    "protocol_code": _with(TWO_FIELDS.format("CASE pr WHEN 'TCP' THEN 0 WHEN 'UDP' THEN 1 ELSE 2 END AS code")),
    "protocol_one_hot": _with(TWO_FIELDS.format(
        "CAST(pr = 'TCP' AS INTEGER)::DOUBLE AS tcp, CAST(pr = 'UDP' AS INTEGER)::DOUBLE AS udp, "
        "CAST(pr NOT IN ('TCP', 'UDP') AS INTEGER)::DOUBLE AS other"
    )),
    "split_address": _with(TWO_FIELDS.format(
        ", ".join(f"split_part(sa, '.', {i + 1}) AS sa_{i}" for i in range(4)) + ", "
        + ", ".join(f"round({_octet('da', i + 1)} / 255.0::DOUBLE, 9) AS da_{i}" for i in range(4))
    )),
    "octets_scaled": _with(TWO_FIELDS.format(
        ", ".join(f"round({_octet('sa', 4 - i)} / 255.0::DOUBLE, 9) AS x{i}" for i in range(4))
    )),
    "port_scaled": _with(TWO_FIELDS.format(
        "round(sp / 65535.0::DOUBLE, 12) AS sp_x, round(dp / 65535.0::DOUBLE, 12) AS dp_x"
    )),
    "port_class": _with(TWO_FIELDS.format(f"{CLASS_OF['sp']} AS sp_class, {CLASS_OF['dp']} AS dp_class")),
    "label_port": _with(TWO_FIELDS.format(
        f"{_port_class('round_even(sp / 65535.0::DOUBLE * 65536.0, 0)')} AS sp_label, "
        f"{_port_class('round_even(dp / 65535.0::DOUBLE * 65536.0, 0)')} AS dp_label"
    )),
    "direction_one_hot": _with(TWO_FIELDS.format(
        "CAST(sa = this_ip AS INTEGER)::DOUBLE AS out_x, CAST(sa <> this_ip AS INTEGER)::DOUBLE AS in_x"
    )),
    "local_remote": _with("SELECT flow_id, local_port, remote_port, remote_ip FROM deltas", DELTAS),
    "encode_flows": _encoded([f"round({n}, 9) AS {n}" for n in cfg.ENCODED_COLUMNS]),
    "decode_port": _with(TWO_FIELDS.format(f"{_decoded_port('sp')} AS port")),
    "decode_flows": _with(
        "SELECT flow_id, CAST(hour(te) AS INTEGER) AS hour, round(delta, 6) AS time_delta, byt, pkt, "
        "round(td, 6) AS time_duration, "
        + ", ".join([
            _pair(_decoded_port("local_port"), _decoded_port("remote_port"), "sp"),
            _pair(_decoded_port("remote_port"), _decoded_port("local_port"), "dp"),
            _pair("this_ip", "remote_ip", "sa"), _pair("remote_ip", "this_ip", "da"), OTHER_PR,
        ])
        + " FROM (SELECT deltas.*, byt AS byt_, pkt AS pkt_ FROM deltas)", DELTAS,
    ),
    "decode_flows_compat": _with(
        "SELECT flow_id, CAST(floor(hour(te) / 23.0::DOUBLE * 24.0) AS INTEGER) AS hour, "
        + ", ".join([
            _pair(COMPAT_PORT["local_port"], COMPAT_PORT["remote_port"], "sp"),
            _pair(COMPAT_PORT["remote_port"], COMPAT_PORT["local_port"], "dp"),
            _pair("this_ip", REVERSED_IP, "sa"), _pair(REVERSED_IP, "this_ip", "da"), OTHER_PR,
        ])
        + " FROM deltas", DELTAS,
    ),
    "day_fraction": _with(TWO_FIELDS.format(
        ", ".join(
            f"round((hour(te) * 3600 + minute(te) * 60 + second(te)) / 86400.0::DOUBLE, 9) AS {n}"
            for n in ("of_text", "of_clock", "of_timestamp")
        ) + ", round(hour(te) * 3600 / 86400.0::DOUBLE, 9) AS of_hour"
    )),
    "scaled_maxima": _encoded([f"round({n}, 9) AS {n}" for n in cfg.ENCODED_COLUMNS[:5]]),
    "label_octet": _with(TWO_FIELDS.format(", ".join(f"{_octet('da', 4 - i)} AS o{i}" for i in range(4)))),
    "minmax_scale": _with(TWO_FIELDS.format(
        ", ".join(f"round({NORMED.format(n)}, 9) AS {n}_normed" for n in ("byt", "pkt", "td"))
    )),
    "ordinal_encode": _with(TWO_FIELDS.format(
        "(dense_rank() OVER (ORDER BY pr) - 1)::DOUBLE AS pr_normed, "
        "(dense_rank() OVER (ORDER BY sa) - 1)::DOUBLE AS sa_normed"
    )),
    "ln_byte_buckets": _with(
        "SELECT bucket, count(*) AS flows FROM flows JOIN edges ON ln(byt) >= lo AND ln(byt) < hi GROUP BY bucket", EDGES
    ),
    "pearson": _datasets(
        "SELECT dataset, round(corr(x, y), 9) AS corr_xy, round(corr(x, p), 9) AS corr_xx1 "
        f"FROM (SELECT *, lag(x) OVER ({DW}) AS p FROM sizes) WHERE p IS NOT NULL GROUP BY dataset", SIZES,
    ),
    "mse_same_row": _datasets(
        "SELECT l.dataset, round(any_value(b), 6) AS slope, round(any_value(a), 6) AS intercept, "
        "round(avg((r.y - a - b * r.x) * (r.y - a - b * r.x)), 6) AS mse "
        "FROM lines l CROSS JOIN (SELECT * FROM sizes WHERE dataset = 'real') r GROUP BY l.dataset",
        SIZES, "lines AS (SELECT dataset, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM sizes GROUP BY dataset)",
    ),
    "mse_temporal": _datasets(
        "SELECT f.dataset, round(any_value(bx), 6) AS bx, round(any_value(by_), 6) AS \"by\", "
        "round(any_value(a), 6) AS intercept, "
        "round(avg((r.z - a - bx * r.x - by_ * r.y) * (r.z - a - bx * r.x - by_ * r.y)), 6) AS mse "
        "FROM (SELECT *, mz - bx * mx - by_ * my AS a FROM ("
        "SELECT *, (cxz * vy - cyz * cxy) / (vx * vy - cxy * cxy) AS bx, "
        "(cyz * vx - cxz * cxy) / (vx * vy - cxy * cxy) AS by_ FROM moments)) f "
        "CROSS JOIN (SELECT * FROM nexts WHERE dataset = 'real') r GROUP BY f.dataset",
        SIZES,
        f"nexts AS (SELECT * FROM (SELECT *, lead(x) OVER ({DW}) AS z FROM sizes) WHERE z IS NOT NULL)",
        "moments AS (SELECT dataset, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_pop(x) AS vx, var_pop(y) AS vy, "
        "covar_pop(x, y) AS cxy, covar_pop(x, z) AS cxz, covar_pop(y, z) AS cyz FROM nexts GROUP BY dataset)",
    ),
    "masked_features": _with(
        "SELECT flow_id, round(" + " + ".join(f"c{i}" for i in range(80)) + ", 6) AS past, "
        + ", ".join(
            f"round(c{80 + i}, 9) AS {n}" if i not in (2, 3, 4) else f"0.0::DOUBLE AS {n}"
            for i, n in enumerate(cfg.ENCODED_COLUMNS)
        ) + " FROM context", DELTAS, ENCODED, CONTEXT,
    ),
    "custom_encoder": _with(
        'SELECT flow_id, this_ip AS "user", round(coalesce(lag(sqrt(td_x)) OVER '
        f"({W}), 0.0), 9) AS td_before, round(sqrt(td_x), 9) AS td_now, round(sqrt(td_x), 9) AS td_label FROM encoded",
        DELTAS, ENCODED,
    ),
}


def _hash(seed: int, *key: str) -> str:
    """The hash that samples are decided by; fixed-width hex digits order like the numbers."""
    return "substr(md5('" + str(seed) + "' || " + " || ".join(f"':' || {k}" for k in key) + "), 1, 15)"


# each piece of the generated set as a dataset
PIECES = "d AS (SELECT *, CASE WHEN flow_id % 2 = 0 THEN 'real' ELSE 'generated|' || (flow_id // 2 % 5) END AS dataset FROM flows)"
ORACLES |= {
    "js_scorecard_by_piece": ORACLES["js_scorecard"].replace(DATASETS, PIECES),
    "rule_report_by_piece": ORACLES["rule_report"].replace(DATASETS, PIECES),
}

ADDRESSES = ", ".join(f"'{a}'" for a in cfg.DEFAULT_LOCAL_ADDRESSES)
DIRECTIONS = {"outgoing": "sa LIKE '42.219%'", "incoming": "da LIKE '42.219%'", "all": "TRUE"}
# each dataset and direction as a dataset of its own
DIRECTED = ("flows_of AS (" + " UNION ALL ".join(f"SELECT *, '{w}' AS direction FROM d WHERE {cond}" for w, cond in DIRECTIONS.items()) + "), "
            "directed AS (SELECT * REPLACE (dataset || '|' || direction AS dataset) FROM flows_of)")
PARTED = "split_part(dataset, '|', 1) AS dataset, split_part(dataset, '|', 2) AS direction"


def _directed_table(index: str, table: str, values: dict[str, str]) -> str:
    chosen = ", ".join(
        f'max({v}) FILTER (WHERE dataset = \'{d}|{w}\' AND pr = \'{p}\') AS "{d}_{p}_{w}_{name}"'
        for d in ("real", "generated") for p in ("TCP", "UDP") for w in DIRECTIONS for name, v in values.items())
    return f"SELECT {index}, {chosen} FROM {table} GROUP BY {index}"


_TOP, _BARS = (t.replace("FROM d ", "FROM directed ") for t in (TOP_PORTS, BARS))
ORACLES |= {
    "system_ports_by_direction": _datasets(_directed_table("rank", "top", {"port": "dp::DOUBLE", "share": "share"}), DIRECTED, _TOP),
    "user_ports_by_direction": _datasets(_directed_table("port", "bars", {"share": "share"}), DIRECTED, _BARS),
    "directed_system_port_top": _datasets(f"SELECT * EXCLUDE (dataset), {PARTED} FROM top", DIRECTED, _TOP),
    "directed_user_port_hist": _datasets(f"SELECT * EXCLUDE (dataset), {PARTED} FROM bars", DIRECTED, _BARS),
    "directed_system_port_hist": _datasets(
        f"SELECT {PARTED}, split_part(dataset, '|', 3) AS pr, bin, n FROM hist", DIRECTED,
        "system AS (SELECT dataset || '|' || pr AS dataset, dp::DOUBLE AS dp FROM directed WHERE dp < 1024)", _long(["dp"], "system"),
        _left_closed(1024)),
    "sample_flows": _with(f"SELECT {FIELDS} FROM flows ORDER BY {_hash(131, 'flow_id')}, flow_id LIMIT 5000"),
    "pick_users": _with(
        f"SELECT ip, number_of_rows, position FROM middle ORDER BY {_hash(131, 'ip')}, ip LIMIT 100", _stats(), MIDDLE),
    "sampled_ip_curve": ORACLES["ip_occurrence_curve"],
    "shuffled_batches": _with(
        "SELECT epoch, batch, least(512, n - batch * 512) AS flows, least(512, n - batch * 512) AS distinct_flows, TRUE AS remixed "
        "FROM (SELECT count(*) AS n, unnest(range(CAST(ceil(count(*) / 512) AS BIGINT))) AS batch FROM flows), (SELECT unnest(range(2)) AS epoch)"),
    "default_local_ip": _with(
        f"SELECT flow_id, ([{ADDRESSES}])[CAST('0x' || substr(md5('0:' || flow_id), 1, 15) AS BIGINT) % {len(cfg.DEFAULT_LOCAL_ADDRESSES)} + 1] AS ip "
        "FROM flows"),
}

# --- learned operators: counts and properties that must hold -----------------

MODEL_CONTINUOUS = [c for c in cfg.flow_plan().continuous]
_MODEL_VALUE = {0: "hour(te) / 24.0::DOUBLE", 1: "least(delta_x, 1.0)"}
_MODEL_CLASS = {
    11: "CASE WHEN out_x = 1 THEN 0 ELSE 1 END",
    13: "CASE WHEN tcp_x = 1 THEN 0 WHEN udp_x = 1 THEN 1 ELSE 2 END",
}

ORACLES |= {
    # equal standard normal components: density of the value itself
    "mixture_nll": _with(
        " UNION ALL ".join(
            f"SELECT {i} AS col, round(avg(-ln(exp(-0.5 * x * x) / sqrt(2 * pi()) + 1e-10)), 6) AS loss, count(*) AS n "
            f"FROM (SELECT {_MODEL_VALUE.get(i, cfg.ENCODED_COLUMNS[i])} AS x FROM encoded)"
            for i in MODEL_CONTINUOUS
        ), DELTAS, ENCODED,
    ),
    "fit_continuous": _with(" UNION ALL ".join(
        f"SELECT {i} AS col, count(*) AS n, TRUE AS improved FROM flows" for i in MODEL_CONTINUOUS
    )),
    "fit_discrete": _with(
        " UNION ALL ".join(
            f"SELECT {i} AS col, count(DISTINCT {_MODEL_CLASS.get(i, cfg.ENCODED_COLUMNS[i])}) AS classes, "
            f"count(*) AS n, TRUE AS improved FROM "
            + ("encoded" if i in _MODEL_CLASS else "labels_of")
            for i in cfg.flow_plan().discrete
        ), DELTAS, ENCODED, LABELS,
    ),
    "sample_rows": _with(
        "SELECT this_ip AS seq_id, count(*) AS rows, count(*) AS one_hot, count(*) - 1 AS last_step "
        "FROM flows GROUP BY this_ip"
    ),
    "sample_time_span": _with(
        "SELECT this_ip AS seq_id, TRUE AS reached, TRUE AS needed, TRUE AS scaled FROM flows GROUP BY this_ip"
    ),
    "artificial_series": _with(
        "SELECT this_ip AS seq_id, count(*) AS rows, CAST(count(*) - 1 AS INTEGER) AS last_step FROM flows GROUP BY this_ip"
    ),
    "flow_classifier": _datasets(
        "SELECT CASE pr WHEN 'TCP' THEN 0 WHEN 'UDP' THEN 1 ELSE 2 END AS actual, count(*) AS rows, TRUE AS near_majority "
        "FROM d WHERE dataset = 'real' GROUP BY 1"
    ),
    # a bin of 0.005 holds its width times the density, to the digits compared
    "binned_nll": _with(
        " UNION ALL ".join(
            f"SELECT {i} AS col, 'binned_nll' AS kind, round(avg(-ln(0.005 * exp(-0.5 * x * x) / sqrt(2 * pi()) + 1e-10)), 3) AS loss, count(*) AS n "
            f"FROM (SELECT {_MODEL_VALUE.get(i, cfg.ENCODED_COLUMNS[i])} AS x FROM encoded)"
            for i in MODEL_CONTINUOUS
        ), DELTAS, ENCODED,
    ),
    "cross_entropy": _with(" UNION ALL ".join(
        f"SELECT {i} AS col, 'cross_entropy' AS kind, round(ln({cfg.flow_plan().class_count(i)}), 6) AS loss, count(*) AS n, TRUE AS improved FROM flows"
        for i in cfg.flow_plan().discrete)),
    "validate_loss": _with("SELECT 1 AS epoch, 13 AS columns, TRUE AS timed, TRUE AS same"),
    "fit_batches": _with(
        "SELECT epoch, CAST(ceil(count(*) / 2048) AS INTEGER) AS steps, 13 AS columns, TRUE AS timed, TRUE AS lower "
        "FROM flows, (SELECT unnest(range(2)) AS epoch) GROUP BY epoch"),
    "fit_resumed": _with(" UNION ALL ".join(f"SELECT {i} AS col, 2 AS epochs, TRUE AS same" for i in sorted(cfg.FLOW_ORDER))),
    "epoch_batches": _with(
        "SELECT epoch, batch, least(2048, n - batch * 2048) AS flows, least(2048, n - batch * 2048) AS distinct_flows, "
        "least(2048, n - batch * 2048) AS as_dealt "
        "FROM (SELECT count(*) AS n, unnest(range(CAST(ceil(count(*) / 2048) AS BIGINT))) AS batch FROM flows), (SELECT unnest(range(2)) AS epoch)"),
    "fit_whole_table": "SELECT epoch, 1 AS steps, 5 AS columns, TRUE AS timed, TRUE AS lower FROM (SELECT unnest(range(2)) AS epoch)",
    "save_and_load_models": _with(" UNION ALL ".join(
        f"SELECT {i} AS col, '{'binned_nll' if i in MODEL_CONTINUOUS else 'cross_entropy'}' AS kind, count(*) AS n, TRUE AS same FROM flows"
        for i in sorted(cfg.FLOW_ORDER))),
    "generate_flows": _with(
        "SELECT DISTINCT this_ip AS seq_id, TRUE AS reached, 3 AS legs, TRUE AS in_bounds, TRUE AS local FROM flows"),
    "generate_many_users": _with(
        'SELECT DISTINCT this_ip AS "user", day, 3 AS legs, TRUE AS clock, TRUE AS in_bounds FROM flows, (SELECT unnest(range(2)) AS day)'),
    "generate_long_request": _with(
        "SELECT '42.219.1.1' AS seq_id, count(*) AS rows, count(*) AS steps, count(*) - 1 AS last_step, "
        "CAST(ceil(count(*) / 500) AS BIGINT) AS legs FROM flows"),
    "flow_regressor": _with("SELECT count(*) AS rows, TRUE AS near_mean FROM flows WHERE flow_id % 2 = 0"),
    "flow_confusion": _datasets(
        "SELECT CASE pr WHEN 'TCP' THEN 0 WHEN 'UDP' THEN 1 ELSE 2 END AS actual, count(*) AS rows, TRUE AS known, TRUE AS distinct_cells "
        "FROM d WHERE dataset = 'real' GROUP BY 1"),
    # streaming
    "streaming_user_stats": _with(
        "SELECT ip, number_of_rows, incoming_num, outgoing_num, user_type FROM stats", _stats()
    ),
    "streaming_rule_rates": _with(
        "SELECT CAST(epoch(day) AS BIGINT) AS window_start, rule, CAST(coalesce(sum(verdict), 0) AS BIGINT) AS true_count, "
        "count(verdict) AS total FROM verdicts GROUP BY day, rule",
        RULE_ROWS.replace("dataset", "date_trunc('day', te) AS day").replace("FROM d", "FROM flows"),
    ),
    # the watermark of a step is the latest time of the steps before it, less ten minutes
    "streaming_late_flows": _with(
        "SELECT CAST(epoch(day) AS BIGINT) AS window_start, count(*) FILTER (NOT late) AS reported, count(*) FILTER (late) AS late FROM ("
        "SELECT date_trunc('day', te) AS day, coalesce(date_trunc('day', te) + INTERVAL 1 DAY <= mark - INTERVAL 10 MINUTE, FALSE) AS late "
        "FROM flows JOIN (SELECT step, max(newest) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark "
        "FROM (SELECT flow_id % 4 AS step, max(te) AS newest FROM flows GROUP BY step)) ON flow_id % 4 = step) GROUP BY day"
    ),
    "streaming_late_windows": POSITION_SUMS,
    "streaming_windows": POSITION_SUMS,
    "streaming_user_sink": _with(
        'SELECT ip AS "user", count(*) AS flows, CAST(sum(byt) AS BIGINT) AS byt '
        "FROM (SELECT DISTINCT flow_id, ip, byt FROM ends) WHERE ip LIKE '42.219.%' GROUP BY ip", ENDS,
    ),
}
