"""The registered queries: every operator over the whole supplied tables.

Flows are derived from ``events``.  Where two datasets are compared, flows with an even
number are the real set and the others the generated set, so both together are the table.
"""

from __future__ import annotations

import functools
import hashlib
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom import config as cfg
from netloom.functions import columns as c
from netloom.functions.binning import with_ln_byte_bucket
from netloom.functions.rules import RULES
from netloom.models import fitting, generating, tasks
from netloom.models.store import FitStore
from netloom.models.training import open_training, training_table
from netloom.operators import codec, divergence, filters, marginals, profile, sampling, scaling, series, windows
from netloom.operators.ranking import rank_curve
from netloom.operators.rule_report import rule_summary, rule_verdicts
from netloom.plans import workflows
from netloom.session import materialize, shared_path, shared_root
from netloom.streaming import jobs
from netloom.sources import flows as src
from netloom.sources import sinks

DAY = "2024-01-05"
REAL, GENERATED = "real", "generated"
FLOW_FIELDS = ["flow_id", "td", "sa", "da", "sp", "dp", "pr", "pkt", "byt", "lable"]


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.load_flows(spark, sf_dir)


def _datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    dataset = F.when(F.col("flow_id") % 2 == 0, REAL).otherwise(GENERATED)
    return _flows(spark, sf_dir).withColumn("dataset", dataset)


def _bidirectional_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = profile.user_stats(_flows(spark, sf_dir))
    return stats.filter(F.col("user_type") == 0).select(F.col("ip").alias("user"))


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


# --- sources and sinks ------------------------------------------------------

def read_raw_flows(spark, sf_dir):
    path = shared_path(spark, "raw")
    sinks.write_raw_flows(src.raw_columns(_flows(spark, sf_dir)), path)
    raw = src.read_raw_flows(spark, path)
    return raw.groupBy("pr", "lable").agg(
        F.count("*").alias("flows"), F.sum("pkt").alias("pkt"), F.sum("byt").alias("byt"),
        F.sum("td").alias("td"), F.count_distinct("te").alias("times"),
        F.sum(F.col("sp").cast("long")).alias("sp"), F.sum(F.col("dp").cast("long")).alias("dp"),
    )


def read_flow_pieces(spark, sf_dir):
    flows = src.raw_columns(_flows(spark, sf_dir))
    path = shared_path(spark, "pieces")
    pieces = [f"{path}/piece{i}" for i in range(5)]
    part = F.pmod(F.col("sp") + F.col("dp"), F.lit(len(pieces)))
    for i, piece in enumerate(pieces):
        turned = flows.columns[i:] + flows.columns[:i]
        sinks.write_raw_flows(flows.filter(part == i).select(*turned), piece, header=True)
    whole = f"{path}/whole"
    sinks.write_raw_flows(flows, whole, header=True)
    read = src.read_flow_pieces(spark, {"baseline": pieces, "real": [whole]}, src.FLOW_SCHEMA)
    return read.groupBy("dataset", "piece", "pr").agg(
        F.count("*").alias("flows"), F.sum("byt").alias("byt"), F.sum("pkt").alias("pkt")
    )


def _windows(spark, sf_dir):
    return windows.prepare_windows(_flows(spark, sf_dir))


def _position_sums(rows: DataFrame) -> DataFrame:
    both = F.concat("ctx", "label")
    at = rows.select(F.posexplode(both).alias("position", "x"))
    return at.groupBy("position").agg(F.count("*").alias("rows"), F.round(F.sum("x"), 4).alias("total"))


def read_windows(spark, sf_dir):
    path = shared_path(spark, "windows")
    sinks.write_windows(_windows(spark, sf_dir), path)
    sinks.export_windows(spark, path, f"{path}/text")
    width = len(cfg.ENCODED_COLUMNS)
    return _position_sums(src.read_windows(spark, f"{path}/text", cfg.FLOW_WINDOW + 1, width))


def _written_users(spark, sf_dir) -> str:
    path = shared_path(spark, "users")
    users = _bidirectional_users(spark, sf_dir)
    extracted = filters.extract_users(_flows(spark, sf_dir), users)
    sinks.write_user_flows(extracted.select("user", *FLOW_FIELDS), path)
    return path


def write_user_flows(spark, sf_dir):
    written = sinks.read_user_flows(spark, _written_users(spark, sf_dir))
    return written.groupBy("user").agg(
        F.count("*").alias("flows"), F.sum("byt").alias("byt"), F.min("flow_id").alias("first_flow")
    )


def read_one_user(spark, sf_dir):
    """Flows of five users out of the clustered storage of all, and that no file without them is read."""
    path = _written_users(spark, sf_dir)
    users = [r.user for r in sinks.recover_user_list(spark, path).orderBy(F.desc("rows"), "user").limit(5).collect()]
    read = sinks.read_user_flows(spark, path, *users).select("user", "flow_id", "byt", F.col("_metadata.file_path").alias("file"))
    held = sinks.stored_files(spark, path).select("file", "first", "last")
    return read.join(F.broadcast(held), "file").groupBy("user").agg(
        F.count("*").alias("flows"), F.sum("byt").alias("byt"), F.every(F.col("user").between(F.col("first"), F.col("last"))).alias("in_range"))


def write_windows(spark, sf_dir):
    path = shared_path(spark, "windows")
    sinks.write_windows(_windows(spark, sf_dir), path)
    fields = F.size(F.split("line", ","))
    return sinks.read_user_flows(spark, path).groupBy("user").agg(
        F.count("*").alias("windows"), F.sum(fields.cast("long")).alias("fields")
    )


#: Of each stored report, what names a row and the values in it that are compared.
REPORT_VALUES = {
    "scale": ([], ["byt_min", "pkt_min", "byt_ln_max", "pkt_ln_max"]),
    "protocol": ([], ["tcp", "udp", "other"]),
    "system_ports": (["pr", "rank"], ["dp", "flows", "share"]),
    "user_ports": (["pr", "port"], ["share"]),
    "rules": (["rule"], ["true_count", "total"]),
    "divergence": (["column"], ["js", "kl_forward", "kl_reverse"]),
    "user_stats": (["ip"], ["number_of_rows", "incoming_num", "outgoing_num", "user_type"]),
    "ip_occurrence": (["ip"], ["value", "rank"]),
    "ip_volume": (["ip"], ["value", "rank"]),
}


def write_reports(spark, sf_dir):
    """The values of all stored reports, read back: one row per report, dataset, row and value."""
    stored = sinks.read_reports(spark, workflows.evaluate(_datasets(spark, sf_dir), REAL))

    def of(name):
        return F.get_json_object("row", f"$.{name}")

    parts = []
    for report, (names, values) in REPORT_VALUES.items():
        pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("name"), of(v).cast("double").alias("value")) for v in values]))
        parts.append(stored.filter(F.col("report") == report).select(
            "report", "run", of("dataset").alias("dataset"), F.concat_ws("|", *[of(n) for n in names]).alias("item"), pairs.alias("v")))
    every = functools.reduce(DataFrame.unionByName, parts)
    return every.select("report", "run", "dataset", "item", "v.name", F.round("v.value", 6).alias("value"))


def recover_user_list(spark, sf_dir):
    return sinks.recover_user_list(spark, _written_users(spark, sf_dir))


def folder_totals(spark, sf_dir):
    return sinks.folder_total(sinks.recover_user_list(spark, _written_users(spark, sf_dir)))


def prepare_windows(spark, sf_dir):
    return _position_sums(_windows(spark, sf_dir))


# --- filters ----------------------------------------------------------------

def on_day(spark, sf_dir):
    return filters.on_day(_flows(spark, sf_dir), DAY).select(*FLOW_FIELDS)


def touches_internal(spark, sf_dir):
    return filters.touches_internal(_flows(spark, sf_dir)).select(*FLOW_FIELDS)


def extract_users(spark, sf_dir):
    users = _bidirectional_users(spark, sf_dir)
    return filters.extract_users(_flows(spark, sf_dir), users).select("user", *FLOW_FIELDS)


def extract_user(spark, sf_dir):
    return filters.extract_user(_flows(spark, sf_dir), "42.219.152.150").select(*FLOW_FIELDS)


def by_direction(spark, sf_dir):
    flows = _flows(spark, sf_dir)
    cut = src.union_datasets({d: filters.by_direction(flows, d) for d in ("outgoing", "incoming", "all")})
    return cut.select(F.col("dataset").alias("direction"), "flow_id", "sa", "da")


def by_protocol(spark, sf_dir):
    flows = _flows(spark, sf_dir)
    return src.union_datasets({p: filters.by_protocol(flows, p) for p in ("TCP", "UDP")}).select(
        F.col("dataset").alias("chosen"), *FLOW_FIELDS
    )


def by_port_class(spark, sf_dir):
    flows = _flows(spark, sf_dir)
    return src.union_datasets({k: filters.by_port_class(flows, k) for k in ("system", "user")}).select(
        F.col("dataset").alias("port_class"), "flow_id", "dp"
    )


def external_endpoints(spark, sf_dir):
    return filters.external(filters.endpoints(_flows(spark, sf_dir), "flow_id"))


def drop_invalid(spark, sf_dir):
    flows = _flows(spark, sf_dir).select(
        "flow_id", "pr", (F.col("byt") / F.nullif(F.col("td"), F.lit(0.0))).alias("byte_rate"),
        F.when(F.col("pkt") > 1, F.col("td") / (F.col("pkt") - 1)).otherwise(float("inf")).alias("gap"),
    )
    return filters.drop_invalid(flows).select("flow_id", "pr", _r("byte_rate"), _r("gap"))


def metric_columns(spark, sf_dir):
    scored = filters.metric_columns(_flows(spark, sf_dir), ("flow_id",))
    return scored.select("flow_id", _r("byt", 9), _r("pkt", 9), "td", "sp", "dp", "pr")


# --- joins ------------------------------------------------------------------

def flows_of_listed_users(spark, sf_dir):
    users = _bidirectional_users(spark, sf_dir)
    joined = filters.extract_users(_flows(spark, sf_dir), users)
    return joined.groupBy("user").agg(
        F.count("*").alias("flows"), F.count_if(F.col("sa") == F.col("user")).alias("sent"),
        F.sum("byt").alias("byt"),
    )


def still_present(spark, sf_dir):
    flows = _flows(spark, sf_dir)
    earlier = profile.user_stats(filters.on_day(flows, DAY)).select("ip")
    return profile.still_present(earlier, profile.user_stats(flows))


def _histograms(spark, sf_dir, binning="own"):
    scored = filters.drop_invalid(filters.metric_columns(_datasets(spark, sf_dir), ("dataset",)))
    return divergence.histograms(scored, cfg.METRIC_COLUMNS, binning=binning)


def aligned_histograms(spark, sf_dir):
    aligned = divergence.align(divergence.laplace_smooth(_histograms(spark, sf_dir)), REAL)
    return aligned.select("dataset", "column", "bin", _r("p", 12), _r("q", 12))


PORT_TABLES = [(d, p) for d in (REAL, GENERATED) for p in ("TCP", "UDP")]


def system_ports_side_by_side(spark, sf_dir):
    top = marginals.system_port_top(_datasets(spark, sf_dir)).withColumn("share", F.round("share", 9))
    return marginals.side_by_side(
        top.withColumn("port", F.col("dp").cast("double")), "rank", ["port", "share"], PORT_TABLES
    )


def user_ports_side_by_side(spark, sf_dir):
    bars = marginals.user_port_hist(_datasets(spark, sf_dir)).withColumn("share", F.round("share", 9))
    return marginals.side_by_side(bars, "port", ["share"], PORT_TABLES)


DIRECTIONS = ("outgoing", "incoming", "all")
DIRECTED_TABLES = [(d, p, w) for d in (REAL, GENERATED) for p in ("TCP", "UDP") for w in DIRECTIONS]
DIRECTED = ("dataset", "pr", "direction")


def _directed(spark, sf_dir):
    return filters.with_directions(_datasets(spark, sf_dir))


def system_ports_by_direction(spark, sf_dir):
    top = marginals.system_port_top(_directed(spark, sf_dir), by=DIRECTED).withColumn("share", F.round("share", 9))
    return marginals.side_by_side(
        top.withColumn("port", F.col("dp").cast("double")), "rank", ["port", "share"], DIRECTED_TABLES, DIRECTED)


def user_ports_by_direction(spark, sf_dir):
    bars = marginals.user_port_hist(_directed(spark, sf_dir), by=DIRECTED).withColumn("share", F.round("share", 9))
    return marginals.side_by_side(bars, "port", ["share"], DIRECTED_TABLES, DIRECTED)


# --- aggregations -----------------------------------------------------------

def endpoint_occurrences(spark, sf_dir):
    return profile.user_stats(_flows(spark, sf_dir)).select("ip", "number_of_rows")


def outgoing_num(spark, sf_dir):
    return profile.user_stats(_flows(spark, sf_dir)).select("ip", "outgoing_num")


def incoming_num(spark, sf_dir):
    return profile.user_stats(_flows(spark, sf_dir)).select("ip", "incoming_num")


def user_type(spark, sf_dir):
    return profile.user_stats(_flows(spark, sf_dir)).select("ip", "user_type")


def user_type_counts(spark, sf_dir):
    return profile.user_type_counts(profile.user_stats(_flows(spark, sf_dir)))


def user_stats(spark, sf_dir):
    return profile.ordered_stats(profile.user_stats(_flows(spark, sf_dir)))


def user_stats_of_day(spark, sf_dir):
    return profile.ordered_stats(profile.user_stats(filters.on_day(_flows(spark, sf_dir), DAY)))


def protocol_share(spark, sf_dir):
    return marginals.protocol_share(_datasets(spark, sf_dir)).select(
        "dataset", _r("tcp", 9), _r("udp", 9), _r("other", 9)
    )


def protocol_value_counts(spark, sf_dir):
    return marginals.protocol_value_counts(_datasets(spark, sf_dir))


def system_port_top(spark, sf_dir):
    return marginals.system_port_top(_datasets(spark, sf_dir)).withColumn("share", F.round("share", 9))


def system_port_hist(spark, sf_dir):
    return marginals.system_port_hist(_datasets(spark, sf_dir)).select("dataset", "bin", "n")


def directed_system_port_top(spark, sf_dir):
    return marginals.system_port_top(_directed(spark, sf_dir), by=DIRECTED).withColumn("share", F.round("share", 9))


def directed_system_port_hist(spark, sf_dir):
    hist = marginals.system_port_hist(_directed(spark, sf_dir), by=DIRECTED)
    return hist.select(*DIRECTED, "bin", "n")


def directed_user_port_hist(spark, sf_dir):
    return marginals.user_port_hist(_directed(spark, sf_dir), by=DIRECTED).withColumn("share", F.round("share", 9))


def user_port_hist(spark, sf_dir):
    return marginals.user_port_hist(_datasets(spark, sf_dir)).withColumn("share", F.round("share", 9))


def ip_occurrence_curve(spark, sf_dir):
    return marginals.ip_occurrence_curve(_flows(spark, sf_dir)).withColumn("ln_value", F.round("ln_value", 9))


def ip_volume_curve(spark, sf_dir):
    return marginals.ip_volume_curve(_flows(spark, sf_dir)).withColumn("ln_value", F.round("ln_value", 9))


def ip_occurrence_by_dataset(spark, sf_dir):
    curve = marginals.ip_occurrence_curve(_datasets(spark, sf_dir), "dataset")
    return curve.withColumn("ln_value", F.round("ln_value", 9))


def ip_volume_by_dataset(spark, sf_dir):
    curve = marginals.ip_volume_curve(_datasets(spark, sf_dir), "dataset")
    return curve.withColumn("ln_value", F.round("ln_value", 9))


def user_stats_by_dataset(spark, sf_dir):
    return profile.user_stats(_datasets(spark, sf_dir), by="dataset")


def scale_check(spark, sf_dir):
    checked = marginals.scale_check(_datasets(spark, sf_dir))
    return checked.select("dataset", "byt_min", "pkt_min", _r("byt_ln_max", 9), _r("pkt_ln_max", 9))


def histogram_cut(spark, sf_dir):
    return _histograms(spark, sf_dir).select("dataset", "column", "bin", "n")


def histogram_cut_shared(spark, sf_dir):
    return _histograms(spark, sf_dir, "shared").select("dataset", "column", "bin", "n")


def density_hist(spark, sf_dir):
    scored = filters.metric_columns(_datasets(spark, sf_dir), ("dataset",)).select("dataset", "byt")
    hist = divergence.histograms(scored, ["byt"], closed="left")
    return divergence.density(hist).select("dataset", "bin", "n", _r("density", 9))


def hist2d(spark, sf_dir):
    flows = _datasets(spark, sf_dir).select(
        "dataset", (F.col("td") / 40 - 1).alias("x"), (F.col("pkt") / 16 - 1).alias("y")
    )
    return divergence.hist2d(flows, "x", "y")


def max_over_sets(spark, sf_dir):
    return marginals.max_over_sets(_datasets(spark, sf_dir))


def laplace_smooth(spark, sf_dir):
    smoothed = divergence.laplace_smooth(_histograms(spark, sf_dir))
    return smoothed.select("dataset", "column", "bin", _r("p", 12))


def plain_distribution(spark, sf_dir):
    plain = divergence.plain_distribution(_histograms(spark, sf_dir))
    return plain.select("dataset", "column", "bin", _r("p", 12))


def _score(spark, sf_dir, *names, binning="own"):
    scores = divergence.js_scorecard(_datasets(spark, sf_dir), REAL, binning)
    return scores.select("dataset", "column", *[_r(n, 9) for n in names])


def js_divergence(spark, sf_dir):
    byt = filters.metric_columns(_datasets(spark, sf_dir), ("dataset",)).select("dataset", "byt")
    hist = divergence.laplace_smooth(divergence.histograms(byt, ["byt"]))
    return divergence.divergences(divergence.align(hist, REAL)).select("dataset", "column", _r("js", 9))


def kl_divergence(spark, sf_dir):
    return _score(spark, sf_dir, "kl_forward", "kl_reverse")


def js_scorecard(spark, sf_dir):
    return _score(spark, sf_dir, "js")


def js_scorecard_shared(spark, sf_dir):
    return _score(spark, sf_dir, "js", binning="shared")


def rule_report(spark, sf_dir):
    return rule_summary(_datasets(spark, sf_dir), "dataset").withColumn("share", F.round("share", 9))


def _pieces(spark, sf_dir):
    piece = F.pmod(F.floor(F.col("flow_id") / 2), F.lit(5))
    return filters.by_piece(_datasets(spark, sf_dir).withColumn("piece", piece), REAL)


def js_scorecard_by_piece(spark, sf_dir):
    return divergence.js_scorecard(_pieces(spark, sf_dir), REAL).select("dataset", "column", _r("js", 9))


def rule_report_by_piece(spark, sf_dir):
    return rule_summary(_pieces(spark, sf_dir), "dataset").withColumn("share", F.round("share", 9))


def _rule(rule: str):
    def verdicts(spark, sf_dir):
        flows = rule_verdicts(_flows(spark, sf_dir), "flow_id", rules=[rule])
        verdict = F.when(F.col(rule), "pass").when(~F.col(rule), "fail").otherwise("not applicable")
        return flows.select("flow_id", verdict.alias("verdict"))

    return verdicts


# --- window and time-series functions ---------------------------------------

def lag1(spark, sf_dir):
    flows = _datasets(spark, sf_dir).select("dataset", "te", "flow_id", "byt")
    return series.lag1(flows, "byt").select("dataset", "flow_id", "byt", "byt_prev")


def lead1(spark, sf_dir):
    flows = _datasets(spark, sf_dir).select("dataset", "te", "flow_id", "byt")
    return series.lead1(flows, "byt").select("dataset", "flow_id", "byt", "byt_next")


def acf(spark, sf_dir):
    return series.acf(_datasets(spark, sf_dir), "byt").withColumn("acf", F.round("acf", 9))


def autocorrelation(spark, sf_dir):
    rows = series.autocorrelation(_datasets(spark, sf_dir), "byt")
    return rows.withColumn("autocorrelation", F.round("autocorrelation", 9))


def _encoded_input(spark, sf_dir) -> DataFrame:
    return windows.inter_arrival(_flows(spark, sf_dir))


def _encoded(spark, sf_dir) -> DataFrame:
    return windows.encode_flows(_encoded_input(spark, sf_dir), "flow_id", "this_ip", "te")


def context_window(spark, sf_dir):
    rows = _encoded(spark, sf_dir)
    ctx = windows.context_window(rows, cfg.ENCODED_COLUMNS, cfg.FLOW_WINDOW)
    width = len(cfg.ENCODED_COLUMNS) * (cfg.FLOW_WINDOW + 1)
    return ctx.select("flow_id", *[F.round(F.col("ctx")[i], 9).alias(f"c{i}") for i in range(width)])


def label_row(spark, sf_dir):
    labels = _encoded(spark, sf_dir).select("flow_id", *windows.flow_label())
    return labels.select("flow_id", *[_r(n, 9) for n in cfg.ENCODED_COLUMNS])


def inter_arrival(spark, sf_dir):
    return _encoded_input(spark, sf_dir).select("flow_id", "this_ip", _r("delta"))


def middle_half(spark, sf_dir):
    middle = profile.middle_half(profile.user_stats(_flows(spark, sf_dir)))
    return middle.select("position", "ip", "number_of_rows")


def cumulative_clock(spark, sf_dir):
    clock = series.cumulative_clock(_flows(spark, sf_dir))
    return clock.select("flow_id", "clock", _r("clock_hour", 9))


# --- sort, limit, sampling --------------------------------------------------

def top20_users(spark, sf_dir):
    return profile.top_users(profile.user_stats(_flows(spark, sf_dir)))


def ranked_destinations(spark, sf_dir):
    sums = _flows(spark, sf_dir).groupBy("da").agg(F.sum("pkt").alias("packets"))
    return rank_curve(sums, "packets", "da").withColumn("ln_value", F.round("ln_value", 9))


def sample_flows(spark, sf_dir):
    return sampling.sample_n(_flows(spark, sf_dir), 5_000, "flow_id").select(*FLOW_FIELDS)


def sampled_ip_curve(spark, sf_dir):
    """The curve of a sample that is as large as the table: all external endpoints."""
    ends = filters.external(filters.endpoints(_flows(spark, sf_dir), "flow_id"))
    sampled = sampling.sample_n(ends, ends.count(), "flow_id", "ip")
    return rank_curve(sampled.groupBy("ip").agg(F.count("*").alias("value"))).withColumn(
        "ln_value", F.round("ln_value", 9)
    )


def pick_users(spark, sf_dir):
    middle = profile.middle_half(profile.user_stats(_flows(spark, sf_dir)))
    return sampling.sample_n(middle, 100, "ip").select("ip", "number_of_rows", "position")


def head_flows(spark, sf_dir):
    return sampling.head(_flows(spark, sf_dir), 100, "te", "flow_id").select(*FLOW_FIELDS)


def shuffled_batches(spark, sf_dir):
    """Batches of two epochs, and the flows of the first that stay in the batch of that number in the second."""
    flows = _flows(spark, sf_dir).select("flow_id")
    mixes = [sampling.shuffled_batches(flows, 512, "flow_id", epoch=e) for e in (0, 1)]
    stay = mixes[0].join(mixes[1].withColumnRenamed("flow_id", "f"), (F.col("flow_id") == F.col("f")) & mixes[0]["batch"].eqNullSafe(mixes[1]["batch"]))
    moved = (F.lit(stay.count()) < F.lit(flows.count())).alias("remixed")
    rows = [m.select(F.lit(e).alias("epoch"), "batch", "flow_id") for e, m in enumerate(mixes)]
    return rows[0].unionByName(rows[1]).groupBy("epoch", "batch").agg(
        F.count("*").alias("flows"), F.count_distinct("flow_id").alias("distinct_flows")).select("*", moved)


# --- set operations ---------------------------------------------------------

def endpoints_union(spark, sf_dir):
    ends = filters.endpoints(_flows(spark, sf_dir), "byt")
    return ends.groupBy("ip").agg(F.count("*").alias("ends"), F.sum("byt").alias("byt"))


def pieces_union(spark, sf_dir):
    flows = _datasets(spark, sf_dir)
    pieces = {d: flows.filter(F.col("dataset") == d).drop("dataset") for d in (REAL, GENERATED)}
    return src.union_datasets(pieces).select("dataset", *FLOW_FIELDS)


def train_test_union(spark, sf_dir):
    flows = _datasets(spark, sf_dir)
    both = flows.filter(F.col("dataset") == REAL).unionByName(flows.filter(F.col("dataset") == GENERATED))
    spans = scaling.fit_minmax(both, ["byt", "pkt", "td", "sp", "dp"])
    return both.groupBy("dataset").agg(
        *[F.round(F.avg(scaling.minmax(n, s)), 9).alias(f"{n}_mean") for n, s in spans.items()]
    )


def swap_local(spark, sf_dir):
    return filters.swap_local(_flows(spark, sf_dir))


# --- column functions -------------------------------------------------------

def ln_sizes(spark, sf_dir):
    return _flows(spark, sf_dir).select(
        "flow_id", F.round(c.ln(F.col("byt")), 9).alias("ln_byt"), F.round(c.ln(F.col("pkt")), 9).alias("ln_pkt")
    )


def ln1p_sizes(spark, sf_dir):
    return _flows(spark, sf_dir).select(
        "flow_id", F.round(c.ln1p(F.col("byt")), 9).alias("byt"), F.round(c.ln1p(F.col("pkt")), 9).alias("pkt")
    )


def protocol_code(spark, sf_dir):
    return _flows(spark, sf_dir).select("flow_id", c.protocol_code(F.col("pr")).alias("code"))


def protocol_one_hot(spark, sf_dir):
    hot = c.protocol_one_hot(F.col("pr"))
    return _flows(spark, sf_dir).select("flow_id", *[h.alias(n) for h, n in zip(hot, ("tcp", "udp", "other"))])


def split_address(spark, sf_dir):
    flows = _flows(spark, sf_dir).select("flow_id", "sa", "da")
    split = c.split_address(c.split_address(flows, "sa"), "da", normalize=True)
    return split.select("flow_id", *[f"sa_{i}" for i in range(4)], *[_r(f"da_{i}", 9) for i in range(4)])


def octets_scaled(spark, sf_dir):
    parts = c.octets_scaled(F.col("sa"))
    return _flows(spark, sf_dir).select("flow_id", *[F.round(p, 9).alias(f"x{i}") for i, p in enumerate(parts)])


def port_scaled(spark, sf_dir):
    return _flows(spark, sf_dir).select(
        "flow_id", F.round(c.port_scaled(F.col("sp")), 12).alias("sp_x"),
        F.round(c.port_scaled(F.col("dp")), 12).alias("dp_x"),
    )


def port_class(spark, sf_dir):
    return _flows(spark, sf_dir).select(
        "flow_id", c.port_class(F.col("sp")).alias("sp_class"), c.port_class(F.col("dp")).alias("dp_class")
    )


def label_port(spark, sf_dir):
    return _flows(spark, sf_dir).select(
        "flow_id", c.label_port(c.port_scaled(F.col("sp"))).alias("sp_label"),
        c.label_port(c.port_scaled(F.col("dp"))).alias("dp_label"),
    )


def direction_one_hot(spark, sf_dir):
    out = c.is_outgoing(F.col("sa"), F.col("this_ip"))
    return _flows(spark, sf_dir).select(
        "flow_id", out.cast("double").alias("out_x"), (~out).cast("double").alias("in_x")
    )


def local_remote(spark, sf_dir):
    out = c.is_outgoing(F.col("sa"), F.col("this_ip"))
    ends = c.local_remote(out, *(F.col(n) for n in ("sa", "da", "sp", "dp")))
    return _flows(spark, sf_dir).select("flow_id", *[e.alias(n) for n, e in ends.items()])


def encode_flows(spark, sf_dir):
    return _encoded(spark, sf_dir).select("flow_id", *[_r(n, 9) for n in cfg.ENCODED_COLUMNS])


def decode_port(spark, sf_dir):
    cls, zero = c.port_class(F.col("sp")), F.lit(0.0)
    return _flows(spark, sf_dir).select("flow_id", c.decode_port(cls, zero).alias("port"))


def decode_flows(spark, sf_dir):
    rows = windows.encode_flows(_encoded_input(spark, sf_dir), "flow_id", "this_ip", hour_max=24)
    classes = {
        "lport_class": c.port_class(F.rint(F.col("lport_x") * cfg.PORT_MAX)),
        "rport_class": c.port_class(F.rint(F.col("rport_x") * cfg.PORT_MAX)),
    }
    draw = (F.lit(0.0), F.lit(0.0))
    out = codec.decode_flows(rows.withColumns(classes), F.col("this_ip"), "flow_id", draw=draw)
    return out.withColumns({n: F.round(n, 6) for n in ("time_delta", "time_duration")})


def decode_flows_compat(spark, sf_dir):
    rows = windows.encode_flows(_encoded_input(spark, sf_dir), "flow_id", "this_ip")
    published = {n: c.port_class(F.rint(F.col(n) * cfg.PORT_MAX)) / float(cfg.PORT_CLASSES)
                 for n in ("lport_x", "rport_x")}
    published |= {f"ip{i}_x": F.rint(F.col(f"ip{i}_x") * 255) / 256 for i in range(1, 5)}
    draw = (F.lit(0.0), F.lit(0.0))
    out = codec.decode_flows_compat(rows.withColumns(published), F.col("this_ip"), "flow_id", draw=draw)
    return out.select("flow_id", "hour", "sp", "dp", "sa", "da", "pr")


def day_fraction(spark, sf_dir):
    text = F.date_format("te", "yyyy-MM-dd HH:mm:ss")
    return _flows(spark, sf_dir).select(
        "flow_id",
        F.round(c.day_fraction(text), 9).alias("of_text"),
        F.round(c.day_fraction(F.substring_index(text, " ", -1)), 9).alias("of_clock"),
        F.round(c.day_fraction(F.col("te"), "timestamp"), 9).alias("of_timestamp"),
        F.round(c.day_fraction(F.hour("te"), "hour"), 9).alias("of_hour"),
    )


def scaled_maxima(spark, sf_dir):
    return _encoded(spark, sf_dir).select(
        "flow_id", *[_r(n, 9) for n in ("hour_x", "delta_x", "byt_x", "pkt_x", "td_x")]
    )


def label_octet(spark, sf_dir):
    parts = c.octets_scaled(F.col("da"))
    return _flows(spark, sf_dir).select("flow_id", *[c.label_octet(p).alias(f"o{i}") for i, p in enumerate(parts)])


def default_local_ip(spark, sf_dir):
    return _flows(spark, sf_dir).select("flow_id", codec.default_local_ip(F.col("flow_id")).alias("ip"))


def minmax_scale(spark, sf_dir):
    flows = _flows(spark, sf_dir).select("flow_id", "byt", "pkt", "td")
    scaled = scaling.minmax_scale(flows, scaling.fit_minmax(flows, ["byt", "pkt", "td"]))
    return scaled.select("flow_id", *[_r(f"{n}_normed", 9) for n in ("byt", "pkt", "td")])


def ordinal_encode(spark, sf_dir):
    flows = _flows(spark, sf_dir).select("flow_id", "pr", "sa")
    return scaling.ordinal_encode(flows, ["pr", "sa"]).select("flow_id", "pr_normed", "sa_normed")


def ln_byte_buckets(spark, sf_dir):
    return with_ln_byte_bucket(_flows(spark, sf_dir), "bucket", F.col("byt")).groupBy("bucket").agg(
        F.count("*").alias("flows")
    )


def pearson(spark, sf_dir):
    flows = _ln_sizes(spark, sf_dir)
    return series.pearson(flows, "x", "y").select("dataset", _r("corr_xy", 9), _r("corr_xx1", 9))


def _ln_sizes(spark, sf_dir):
    return _datasets(spark, sf_dir).select(
        "dataset", "te", "flow_id", c.ln(F.col("byt")).alias("x"), c.ln(F.col("pkt")).alias("y")
    )


def mse_same_row(spark, sf_dir):
    return series.mse_same_row(_ln_sizes(spark, sf_dir), "x", "y", REAL).select(
        "dataset", _r("slope"), _r("intercept"), _r("mse")
    )


def mse_temporal(spark, sf_dir):
    return series.mse_temporal(_ln_sizes(spark, sf_dir), "x", "y", REAL).select(
        "dataset", _r("bx"), _r("by"), _r("intercept"), _r("mse")
    )


def masked_features(spark, sf_dir):
    plan = cfg.flow_plan()
    rows = windows.masked_features(_windows(spark, sf_dir), plan, 3)
    start = plan.dim * plan.window
    past = F.aggregate(F.slice("features", 1, start), F.lit(0.0), lambda s, v: s + v)
    current = [F.round(F.col("features")[start + i], 9).alias(n) for i, n in enumerate(cfg.ENCODED_COLUMNS)]
    return rows.select("flow_id", F.round(past, 6).alias("past"), *current)


def custom_encoder(spark, sf_dir):
    """Windows of another encoder passed in as a plain DataFrame transform, with its own label."""
    def transfer(flows: DataFrame) -> DataFrame:
        encoded = windows.encode_flows(flows, "this_ip", "te", "flow_id", "chunk", "halo")
        return encoded.withColumn("td_x", F.sqrt("td_x"))

    rows = windows.prepare_windows(
        _flows(spark, sf_dir), agg=1, transfer=transfer, label=F.array(F.col("td_x"), F.col("lport_x"))
    )
    return rows.select(
        "flow_id", "user", F.round(F.col("ctx")[4], 9).alias("td_before"),
        F.round(F.col("ctx")[20], 9).alias("td_now"), F.round(F.col("label")[0], 9).alias("td_label"),
    )


DETERMINISTIC = [
    read_raw_flows, read_flow_pieces, read_windows, write_user_flows, read_one_user, write_windows, write_reports,
    recover_user_list, folder_totals, prepare_windows,
    on_day, touches_internal, extract_users, extract_user, by_direction, by_protocol, by_port_class,
    external_endpoints, drop_invalid, metric_columns,
    flows_of_listed_users, still_present, aligned_histograms, system_ports_side_by_side,
    user_ports_side_by_side, system_ports_by_direction, user_ports_by_direction,
    directed_system_port_top, directed_system_port_hist, directed_user_port_hist,
    endpoint_occurrences, outgoing_num, incoming_num, user_type, user_type_counts, user_stats,
    user_stats_of_day, protocol_share, protocol_value_counts, system_port_top, system_port_hist,
    user_port_hist, ip_occurrence_curve, ip_volume_curve, ip_occurrence_by_dataset, ip_volume_by_dataset,
    user_stats_by_dataset, scale_check, histogram_cut,
    histogram_cut_shared, density_hist, hist2d, max_over_sets, laplace_smooth, plain_distribution,
    js_divergence, kl_divergence, js_scorecard, js_scorecard_shared, rule_report, js_scorecard_by_piece, rule_report_by_piece,
    lag1, lead1, acf, autocorrelation, context_window, label_row, inter_arrival, middle_half,
    cumulative_clock,
    top20_users, ranked_destinations, sample_flows, sampled_ip_curve, pick_users, head_flows,
    shuffled_batches,
    endpoints_union, pieces_union, train_test_union, swap_local,
    ln_sizes, ln1p_sizes, protocol_code, protocol_one_hot, split_address, octets_scaled, port_scaled,
    port_class, label_port, direction_one_hot, local_remote, encode_flows, decode_port, decode_flows,
    decode_flows_compat, day_fraction, scaled_maxima, label_octet, default_local_ip, minmax_scale,
    ordinal_encode, ln_byte_buckets, pearson, mse_same_row, mse_temporal, masked_features,
    custom_encoder,
]

QUERIES = {q.__name__: q for q in DETERMINISTIC}
QUERIES |= {f"rule_{name}": _rule(name) for name in RULES}


# --- learned operators ------------------------------------------------------
# Parameters and draws have no SQL counterpart; these queries fit and sample over the whole
# tables and report counts and properties, which SQL can state, or the scores themselves.

PLAN = cfg.flow_plan()
ITERATIONS = 8
MODEL_BATCH, MODEL_EPOCHS = 2_048, 2
POOL_WINDOWS = 512


def _model_windows(spark, sf_dir) -> DataFrame:
    return windows.prepare_windows(_flows(spark, sf_dir), hour_max=24, clip=True)


def _model_path(spark, sf_dir) -> str:
    """The store of the model of a folder of tables: a fit that is there already is read, not repeated."""
    name = hashlib.md5(f"{spark.sparkContext.applicationId}:{sf_dir}".encode()).hexdigest()
    return f"{shared_root(spark).rstrip('/')}/model-{name}"


def _model(spark, sf_dir) -> tuple[fitting.Fitted, DataFrame]:
    return fitting.fit_batches(_model_windows(spark, sf_dir), PLAN, MODEL_EPOCHS, MODEL_BATCH, path=_model_path(spark, sf_dir))


def _pool(spark, sf_dir):
    _model(spark, sf_dir)
    return generating.window_pool(open_training(spark, f"{_model_path(spark, sf_dir)}/training").rows, PLAN, POOL_WINDOWS)


def mixture_nll(spark, sf_dir):
    """Score of the mixture with all parameters zero: equal standard normal components."""
    zero = {col: 0.0 * flat for col, flat in fitting.initial_mixtures(PLAN).items()}
    losses = fitting.column_losses(_model_windows(spark, sf_dir), fitting.Fitted(PLAN, zero), binned=False)
    return losses.select("col", _r("loss"), "n")


def binned_nll(spark, sf_dir):
    """The same mixture scored by bins."""
    zero = {col: 0.0 * flat for col, flat in fitting.initial_mixtures(PLAN).items()}
    losses = fitting.column_losses(_model_windows(spark, sf_dir), fitting.Fitted(PLAN, zero))
    return losses.select("col", "kind", _r("loss", 3), "n")


def fit_continuous(spark, sf_dir):
    """Continuous columns with their losses before and after fitting."""
    rows = _model_windows(spark, sf_dir)
    fitted, _ = _model(spark, sf_dir)
    start = fitting.Fitted(PLAN, fitting.initial_mixtures(PLAN))
    before = fitting.column_losses(rows, start).select("col", F.col("loss").alias("before"))
    after = fitting.column_losses(rows, fitting.Fitted(PLAN, fitted.mixtures))
    return after.join(before, "col").select("col", "n", (F.col("loss") < F.col("before")).alias("improved"))


def fit_discrete(spark, sf_dir):
    """Logistic regressions: discrete columns with the classes seen, and whether fitting beats an even guess."""
    rows = materialize(_model_windows(spark, sf_dir))
    heads = fitting.fit_all_discrete(rows, PLAN, max_iter=ITERATIONS)
    losses = fitting.column_losses(rows, fitting.Fitted(PLAN, heads=heads))
    seen = F.create_map(*[x for col, h in heads.items() for x in (F.lit(col), F.lit(len(h.classes)))])
    classes = seen[F.col("col")]
    return losses.select(
        "col", classes.cast("long").alias("classes"), "n", (F.col("loss") < F.log(classes)).alias("improved")
    )


def cross_entropy(spark, sf_dir):
    """Loss of heads that know nothing, and whether the fitted ones do better."""
    rows, (fitted, _) = _model_windows(spark, sf_dir), _model(spark, sf_dir)
    even = fitting.fitted_from(PLAN, fitting.initial_heads(PLAN))
    learned = fitting.column_losses(rows, fitting.Fitted(PLAN, heads=fitted.heads)).select("col", F.col("loss").alias("learned"))
    return fitting.column_losses(rows, even).join(learned, "col").select(
        "col", "kind", _r("loss"), "n", (F.col("learned") < F.col("loss")).alias("improved"))


def validate_loss(spark, sf_dir):
    """The loss of each column in one row equals that of the table of losses."""
    rows, (fitted, _) = _model_windows(spark, sf_dir), _model(spark, sf_dir)
    row = fitting.validate_loss(rows, fitted, epoch=1)
    known = fitting.column_losses(rows, fitted).agg(F.sum("loss").alias("sum"), F.count("*").alias("columns"))
    total = sum((F.col(c) for c in row.columns if c.startswith("loss_")), F.lit(0.0))
    return row.crossJoin(F.broadcast(known)).select(
        "epoch", "columns", (F.col("seconds") > 0).alias("timed"), (F.abs(total - F.col("sum")) < 1e-6).alias("same"))


def _log_rows(log: DataFrame) -> DataFrame:
    """What every epoch of a training log must show: its steps, how many columns have a finite loss, its time."""
    losses = [F.col(c) for c in log.columns if c.startswith("loss_")]
    finite = sum((F.coalesce(~F.isnan(c) & (F.abs(c) < 1e6), F.lit(False)).cast("long") for c in losses), F.lit(0).cast("long"))
    total = sum(losses, F.lit(0.0))
    first = F.first_value(total).over(Window.partitionBy(F.lit(0)).orderBy("epoch"))  # one row per epoch
    return log.select("epoch", "steps", finite.alias("columns"), (F.col("seconds") > 0).alias("timed"), (total <= first).alias("lower"))


def fit_batches(spark, sf_dir):
    """The committed log of the fit by batches: one row per epoch, all columns."""
    return _log_rows(_model(spark, sf_dir)[1])


def fit_resumed(spark, sf_dir):
    """A fit ended after its first epoch and gone on with, beside one run through: largest difference of any parameter."""
    rows, path = _model_windows(spark, sf_dir), shared_path(spark, "ended")

    @inheritable_thread_target
    def resumed():
        fitting.fit_batches(rows, PLAN, 1, MODEL_BATCH, path=path)
        return fitting.fit_batches(rows, PLAN, MODEL_EPOCHS, MODEL_BATCH, path=path)

    with ThreadPoolExecutor(1) as beside:
        ended = beside.submit(resumed)
        whole, _ = _model(spark, sf_dir)
        again, log = ended.result()
    far = {c: float(abs(again.mixtures[c] - whole.mixtures[c]).max()) for c in PLAN.continuous}
    far |= {c: float(max(abs(again.heads[c].weights - whole.heads[c].weights).max(), abs(again.heads[c].bias - whole.heads[c].bias).max()))
            for c in PLAN.discrete}
    table = spark.createDataFrame(sorted(far.items()), "col int, far double")
    epochs = log.agg(F.count("*").alias("epochs"))
    return table.crossJoin(F.broadcast(epochs)).select("col", "epochs", (F.col("far") < 1e-6).alias("same"))


def epoch_batches(spark, sf_dir):
    """Batches read by their ranges of positions, two epochs of the training table: rows and distinct flows of each."""
    _model(spark, sf_dir)
    training = open_training(spark, f"{_model_path(spark, sf_dir)}/training")
    read = functools.reduce(DataFrame.unionByName, [
        training.read(e).select(F.lit(e).alias("epoch"), "batch", "flow_id") for e in (0, 1)])
    dealt = functools.reduce(DataFrame.unionByName, [
        training.numbered(e).select(F.lit(e).alias("epoch"), "batch", F.col("flow_id").alias("f")) for e in (0, 1)])
    both = read.join(dealt.hint("merge"), (read["epoch"] == dealt["epoch"]) & (read["batch"] == dealt["batch"]) & (F.col("flow_id") == F.col("f")), "left")
    return both.groupBy(read["epoch"], read["batch"]).agg(
        F.count("*").alias("flows"), F.count_distinct("flow_id").alias("distinct_flows"), F.count("f").alias("as_dealt"))


def fit_whole_table(spark, sf_dir):
    """Two full-table steps on the density: the log of the continuous columns."""
    path = shared_path(spark, "whole")
    store = FitStore(spark, path, PLAN.continuous)
    training = training_table(_model_windows(spark, sf_dir), f"{path}/training")
    fitting.fit_columns(training, PLAN, 2, store, by_batch=False)
    return _log_rows(store.log())


def save_and_load_models(spark, sf_dir):
    """Losses of a model before it was saved and after it was loaded."""
    rows, (fitted, _) = _model_windows(spark, sf_dir), _model(spark, sf_dir)
    path = shared_path(spark, "models")
    fitting.save_models(spark, fitted, path, "ep0")
    loaded = fitting.load_models(spark, PLAN, path, "ep0")
    before = fitting.column_losses(rows, fitted).select("col", F.col("loss").alias("before"))
    return fitting.column_losses(rows, loaded).join(before, "col").select(
        "col", "kind", "n", (F.abs(F.col("loss") - F.col("before")) < 1e-9).alias("same"))


def _per_user(spark, sf_dir) -> DataFrame:
    return _flows(spark, sf_dir).groupBy(F.col("this_ip").alias("seq_id")).agg(F.count("*").alias("rows"))


def sample_rows(spark, sf_dir):
    """As many generated rows for each user as it has flows, every row one-hot in both groups."""
    fitted, _ = _model(spark, sf_dir)
    rows = generating.flow_columns(generating.sample_rows(_per_user(spark, sf_dir), fitted), PLAN)
    direction, protocol = F.col("out_x") + F.col("in_x"), F.col("tcp_x") + F.col("udp_x") + F.col("other_x")
    return rows.groupBy("seq_id").agg(
        F.count("*").alias("rows"), F.count_if((direction == 1) & (protocol == 1)).alias("one_hot"),
        F.max("step").alias("last_step"),
    )


SPAN = 8_640.0


def sample_time_span(spark, sf_dir):
    """Generated until 8640 s: the clock passes the span with the last row, and only then."""
    fitted, _ = _model(spark, sf_dir)
    seqs = _per_user(spark, sf_dir).withColumn("span", F.lit(SPAN))
    rows = generating.flow_columns(generating.sample_time_span(seqs, fitted), PLAN)
    seconds = F.floor(F.col("delta_x") * cfg.DELTA_MAX)
    inside = [F.col(n).between(0, 1) for n in ("hour_x", "delta_x", "byt_x", "pkt_x", "td_x")]
    scaled = inside[0]
    for x in inside[1:]:
        scaled = scaled & x
    spans = rows.groupBy("seq_id").agg(
        F.sum(seconds).alias("clock"), F.max_by(seconds, "step").alias("last"), F.every(scaled).alias("scaled"),
    )
    return spans.select(
        "seq_id", (F.col("clock") >= SPAN).alias("reached"), (F.col("clock") - F.col("last") < SPAN).alias("needed"),
        "scaled",
    )


def _in_bounds():
    """Whether a decoded record lies in the domain of flow records."""
    ports = F.col("sp").between(0, cfg.PORT_MAX) & F.col("dp").between(0, cfg.PORT_MAX)
    sizes = F.col("time_duration").between(0, cfg.TD_MAX) & F.col("time_delta").between(0, cfg.DELTA_MAX + 1) & (F.col("byt") >= 0) & (F.col("pkt") >= 0)
    return ports & sizes & F.col("hour").between(0, 23) & F.col("pr").isin("TCP", "UDP", "Other")


def generate_flows(spark, sf_dir):
    """Records of 8640 s for every user, in legs of an hour: the clock, the bounds and the one local address of each."""
    fitted, _ = _model(spark, sf_dir)
    seqs = _per_user(spark, sf_dir).withColumn("span", F.lit(SPAN))
    flows = generating.generate_flows(seqs, fitted, pool=_pool(spark, sf_dir), leg_seconds=3_600)
    local = codec.default_local_ip(F.col("seq_id"))
    return flows.groupBy("seq_id").agg(
        (F.sum(F.floor(F.col("time_delta") + 1e-6)) >= SPAN).alias("reached"), F.count_distinct("leg").alias("legs"),
        F.every(_in_bounds()).alias("in_bounds"), F.every((F.col("sa") == local) | (F.col("da") == local)).alias("local"))


def generate_many_users(spark, sf_dir):
    """Two days of flow records for every user of the table, a day being 8640 s in three legs."""
    fitted, _ = _model(spark, sf_dir)
    users = _per_user(spark, sf_dir).select(F.col("seq_id").alias("user"))
    flows = generating.generate_many_users(users, 2, fitted, span=SPAN, pool=_pool(spark, sf_dir), leg_seconds=3_600)
    seconds = F.floor(F.col("time_delta") + 1e-6)
    legs = flows.groupBy("user", "day", "leg").agg(
        F.sum(seconds).alias("seconds"), F.every(_in_bounds() & ((F.col("sa") == F.col("user")) | (F.col("da") == F.col("user")))).alias("in_bounds"))
    # every leg but the last ends on its hour exactly
    exact = F.when(F.col("leg") < 2, F.col("seconds") == 3_600).otherwise(F.col("seconds") >= SPAN - 7_200)
    return legs.groupBy("user", "day").agg(F.count("*").alias("legs"), F.every(exact).alias("clock"), F.every("in_bounds").alias("in_bounds"))


def generate_long_request(spark, sf_dir):
    """One user's request of as many rows as the table has, in legs of 500: every step once, legs behind real windows."""
    fitted, _ = _model(spark, sf_dir)
    total = _flows(spark, sf_dir).agg(F.count("*").alias("rows")).withColumn("seq_id", F.lit("42.219.1.1"))
    rows = generating.sample_rows(total, fitted, pool=_pool(spark, sf_dir), leg_rows=500)
    return rows.groupBy("seq_id").agg(
        F.count("*").alias("rows"), F.count_distinct("step").alias("steps"), F.max("step").alias("last_step"),
        F.count_distinct("leg").alias("legs"))


def artificial_series(spark, sf_dir):
    """A two-column series per user, as long as the user has flows."""
    rows = generating.artificial_series(_per_user(spark, sf_dir), [0.9, 0.9])
    return rows.groupBy("seq_id").agg(F.count("*").alias("rows"), F.max("step").alias("last_step"))


def artificial_correlation(spark, sf_dir):
    """Correlation of the generated columns with each other and of the first with its past."""
    rows = generating.artificial_series(_per_user(spark, sf_dir), [0.9, 0.9])
    past = rows.select("seq_id", (F.col("step") + 1).alias("step"), F.col("x0").alias("x0_prev"))
    # generated rows are many more than the planner takes them for: not one copy of all of them for every task
    return rows.join(past.hint("merge"), ["seq_id", "step"]).agg(
        F.corr("x0", "x1").alias("corr_xy"), F.corr("x0", "x0_prev").alias("corr_xx1"), F.count("*").alias("pairs")
    )


def _task_rows(spark, sf_dir):
    flows = _datasets(spark, sf_dir).select(
        "dataset", "flow_id", "sp", "dp", "td", c.ln(F.col("byt")).alias("ln_byt"),
        c.ln(F.col("pkt")).alias("ln_pkt"), c.protocol_code(F.col("pr")).cast("double").alias("code"),
    )
    return flows.filter(F.col("dataset") == GENERATED), flows.filter(F.col("dataset") == REAL)


def flow_classifier(spark, sf_dir):
    """Protocol of real flows by a classifier fitted on generated ones: rows per actual class.

    The protocol of these flows does not follow from their sizes and ports, so the share of the
    most frequent one is all that a fitted classifier can reach; an unfitted one stays far below it.
    """
    train, test = _task_rows(spark, sf_dir)
    inputs = ["sp", "dp", "td", "ln_byt", "ln_pkt"]
    task = tasks.flow_classifier(train, test, inputs, "code", epochs=100)
    table = tasks.classification_table(task.predict(test), "code")
    rows = table.groupBy("actual").agg(
        F.sum("rows").alias("rows"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("rows")).otherwise(0)).alias("right"))
    every = Window.partitionBy(F.lit(0))  # three rows
    return rows.select("actual", "rows", (F.sum("right").over(every) >= 0.95 * F.max("rows").over(every)).alias("near_majority"))


def flow_confusion(spark, sf_dir):
    """Cells of the table of actual and predicted classes: they add up to the rows of each class."""
    train, test = _task_rows(spark, sf_dir)
    inputs = ["sp", "dp", "td", "ln_byt", "ln_pkt"]
    task = tasks.flow_classifier(train, test, inputs, "code", epochs=100)
    table = tasks.classification_table(task.predict(test), "code")
    return table.groupBy("actual").agg(
        F.sum("rows").alias("rows"), F.every(F.col("predicted").isin(0, 1, 2)).alias("known"),
        (F.count("*") == F.count_distinct("predicted")).alias("distinct_cells"))


def flow_regressor(spark, sf_dir):
    """Bytes of a flow from 25 values, the five flows before it: error of prediction and of the mean."""
    columns = ["delta_x", "byt_x", "pkt_x", "td_x", "lport_x"]
    at = [cfg.ENCODED_COLUMNS.index(n) for n in columns]
    width = len(cfg.ENCODED_COLUMNS)
    inputs = {f"x{back}_{n}": F.col("ctx")[back * width + i]
              for back in range(cfg.FLOW_WINDOW) for n, i in zip(columns, at)}
    rows = _model_windows(spark, sf_dir).select(
        "flow_id", *[v.alias(n) for n, v in inputs.items()], F.col("label")[2].alias("target")
    )
    rows = materialize(rows)
    train, test = rows.filter(F.col("flow_id") % 2 == 1), rows.filter(F.col("flow_id") % 2 == 0)
    task = tasks.flow_regressor(train, test, list(inputs), "target", rounds=5)
    error = F.col("prediction") - F.col("target")
    scored = task.predict(test).agg(
        F.avg(error * error).alias("mse"), F.var_pop("target").alias("mse_of_mean"), F.count("*").alias("rows")
    )
    return scored.select("rows", (F.col("mse") < 1.1 * F.col("mse_of_mean")).alias("near_mean"))


# --- streaming --------------------------------------------------------------

def _as_they_arrive(spark, sf_dir, label, job, steps=4, order=None):
    """Start ``job`` again and again while the events arrive in ``steps`` files; gives its folder.

    Files hold ranges of time, earliest first, or with ``order`` another number of the step of
    each event.  Each start takes all files that are new as one batch, so state and carried rows
    pass from batch to batch and over restarts.
    """
    folder, path = shared_path(spark, "arriving"), shared_path(spark, label)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = events.agg(F.percentile_approx(at, [i / steps for i in range(1, steps)])).first()[0] or []
    step = sum((F.coalesce(at >= cut, F.lit(False)).cast("int") for cut in cuts), F.lit(0))
    step = step if order is None else order(step)
    for i in range(len(cuts) + 1):
        events.filter(step == i).write.mode("append").parquet(folder)
        job(jobs.stream_flows(spark, folder, "*.parquet", files=1_000_000), path)
    return path


def streaming_user_stats(spark, sf_dir):
    return jobs.read_user_stats(spark, _as_they_arrive(spark, sf_dir, "stream-stats", jobs.running_user_stats))


def streaming_rule_rates(spark, sf_dir):
    return jobs.read_rule_rates(spark, _as_they_arrive(spark, sf_dir, "stream-rules", jobs.rule_rates))


def streaming_late_flows(spark, sf_dir):
    """Flows reported and late per day, the events arriving in no order of time: together they are the input."""
    path = _as_they_arrive(spark, sf_dir, "stream-late", jobs.rule_rates, order=lambda _: F.col("event_id") % 4)
    return jobs.read_window_flows(spark, path)


def streaming_late_windows(spark, sf_dir):
    """Windows of events whose files arrive latest first: every window is as if they had come in order."""
    path = _as_they_arrive(spark, sf_dir, "stream-reversed", jobs.carried_windows, order=lambda step: 3 - step)
    return _position_sums(jobs.read_carried_windows(spark, path))


def streaming_windows(spark, sf_dir):
    path = _as_they_arrive(spark, sf_dir, "stream-windows", jobs.carried_windows)
    return _position_sums(jobs.read_carried_windows(spark, path))


def streaming_user_sink(spark, sf_dir):
    path = _as_they_arrive(spark, sf_dir, "stream-users", jobs.user_sink)
    return jobs.read_user_sink(spark, path).groupBy("user").agg(
        F.count("*").alias("flows"), F.sum("byt").alias("byt")
    )


LEARNED = [
    mixture_nll, binned_nll, fit_continuous, fit_discrete, cross_entropy, validate_loss, fit_batches,
    fit_resumed, epoch_batches, fit_whole_table, save_and_load_models, sample_rows, sample_time_span, generate_flows,
    generate_many_users, generate_long_request, artificial_series, artificial_correlation, flow_classifier, flow_confusion,
    flow_regressor,
]
STREAMING = [streaming_user_stats, streaming_rule_rates, streaming_late_flows, streaming_windows, streaming_late_windows, streaming_user_sink]
QUERIES |= {q.__name__: q for q in LEARNED + STREAMING}
