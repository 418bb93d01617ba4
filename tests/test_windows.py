"""Context windows, series and the codec, whole and with heavy users cut into chunks."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom import config as cfg
from netloom.functions import columns as c
from netloom.operators import chunks, codec, series, windows

T0 = dt.datetime(2024, 1, 5, 23, 0, 0)


def _user_flows(make_flows):
    """A heavy user, one with exactly five flows, one with one flow, interleaved; tied times; a burst."""
    rows = []
    for i in range(120):
        burst = T0 + dt.timedelta(seconds=50)
        rows.append({"te": burst if 40 <= i < 90 else T0 + dt.timedelta(seconds=i), "this_ip": "42.219.1.1", "byt": 41 + i})
        if i < 5:
            rows.append({"te": T0 + dt.timedelta(seconds=2 * i), "this_ip": "42.219.1.2", "sa": "7.7.7.7", "da": "42.219.1.2"})
    rows.append({"te": T0, "this_ip": "42.219.1.3", "sa": "42.219.1.3", "pr": "GRE", "sp": 65535, "dp": 1023})
    rows.append({"te": T0 - dt.timedelta(days=20_000), "this_ip": "42.219.1.1", "byt": 9_999})
    return make_flows(*rows)


def _brute_force(rows, agg):
    """Row i of a user sees rows i .. i + agg of the user's matrix with ``agg`` rows of zeros on top."""
    out = {}
    for _, user in rows.sort_values(["te", "flow_id"]).groupby("this_ip"):
        padded = np.vstack([np.zeros((agg, len(cfg.ENCODED_COLUMNS))), user[list(cfg.ENCODED_COLUMNS)].to_numpy(float)])
        out |= {flow: padded[i:i + agg + 1].ravel().tolist() for i, flow in enumerate(user.flow_id)}
    return out


@pytest.mark.parametrize("target", [chunks.TARGET_ROWS, 50, 7, 2])
def test_windows_equal_brute_force_however_cut(make_flows, target):
    flows = _user_flows(make_flows)
    encoded = windows.encode_flows(windows.inter_arrival(flows), "flow_id", "this_ip", "te").toPandas()
    want = _brute_force(encoded, 5)
    got = {r.flow_id: list(r.ctx) for r in windows.prepare_windows(flows, target_rows=target).collect()}
    assert got == want


@pytest.mark.parametrize("target", [40, 7])
def test_chunks_follow_time_and_stay_near_the_target(make_flows, target):
    part = chunks.chunked(_user_flows(make_flows), "this_ip", halo=3, target_rows=target)
    copies = part.df.filter("halo").groupBy("chunk").count().collect()
    assert copies and all(r["count"] == min(3, r["count"]) for r in copies)
    heavy = part.df.filter("this_ip = '42.219.1.1' AND NOT halo").toPandas().sort_values(["te", "flow_id"])
    assert heavy.chunk.is_monotonic_increasing
    assert heavy.groupby("chunk").size().max() <= 2 * target
    assert part.split and set(part.df.filter("this_ip = '42.219.1.3'").toPandas().chunk) == {-1}


@pytest.mark.parametrize("target", [chunks.TARGET_ROWS, 7])
def test_inter_arrival_and_clock(make_flows, target):
    flows = _user_flows(make_flows)
    got = series.cumulative_clock(flows, target_rows=target).toPandas().sort_values(["te", "flow_id"])
    for _, user in got.groupby("this_ip"):
        seconds = user.te.diff().dt.total_seconds().fillna(0)
        assert user.delta.tolist() == seconds.tolist()
        before = np.floor(seconds).cumsum() - np.floor(seconds)
        assert user.clock.tolist() == before.tolist()


def test_series_are_the_same_when_cut(flows):
    data = flows.withColumn("dataset", F.when(F.col("flow_id") % 3 == 0, "a").otherwise("b"))
    for f, args in ((series.acf, ("byt",)), (series.autocorrelation, ("byt",)), (series.pearson, ("byt", "pkt")),
                    (series.mse_temporal, ("byt", "pkt", "a"))):
        whole = f(data, *args).toPandas().sort_values(["dataset"] + (["lag"] if f in (series.acf, series.autocorrelation) else []))
        cut = f(data, *args, target_rows=30).toPandas().sort_values(whole.columns[:2].tolist() if "lag" in whole else ["dataset"])
        for name in whole.columns:
            if name != "dataset":
                assert np.allclose(whole[name].astype(float), cut[name].astype(float), rtol=1e-9, atol=1e-9)


def test_autocorrelation_formula(flows):
    data = flows.withColumn("dataset", F.lit("a"))
    got = [r.autocorrelation for r in series.autocorrelation(data, "byt").orderBy("lag").collect()]
    x = flows.orderBy("te", "flow_id").toPandas().byt.to_numpy(dtype=float)
    d, n = x - x.mean(), len(x)
    want = [(d[: n - k] * d[k:]).sum() / (x.var() * (n - k)) for k in range(5)]
    assert np.allclose(got, want)


def test_known_label_values(spark):
    """Ports, octets and bytes of a published window row."""
    row = (0.2651865415426871, 0.1232928969253071, 0.7215686274509804, 0.07058823529411765, 0.8470588235294118, 0.4)
    df = spark.createDataFrame([row], "lp double, rp double, a double, b double, c double, d double")
    got = df.select(
        c.label_port(F.col("lp")), c.label_port(F.col("rp")), *[c.label_octet(F.col(n)) for n in "abcd"]
    ).first()
    assert tuple(got) == (1187, 1094, 184, 18, 216, 102)
    assert math.log(44) / cfg.LN_BYT_MAX == pytest.approx(0.1879954136028209, abs=1e-15)


def test_encoded_row(make_flows):
    flows = make_flows({"te": T0, "sa": "1.2.3.255", "da": "42.219.1.1", "sp": 65535, "dp": 32768, "pr": "ICMP",
                        "byt": 1, "pkt": 1, "td": 363.0}).withColumn("delta", F.lit(1430.0))
    row = list(windows.encode_flows(flows).first())
    assert row == [1.0, 1.0, 0.0, 0.0, 1.0, 32768 / 65535, 1.0, 1.0, 3 / 255, 2 / 255, 1 / 255, 0, 1, 0, 0, 1]


def test_rows_without_logarithm_are_dropped(make_flows):
    got = windows.prepare_windows(make_flows({"byt": 0}, {"byt": 41}, {"pkt": 0})).collect()
    assert [r.flow_id for r in got] == [1]


def test_port_classes(spark):
    ports = spark.range(65536).select(F.col("id").cast("int").alias("p"))
    rows = ports.select("p", c.port_class(F.col("p")).alias("cls")).toPandas()
    want = [p if p < 1024 else (p - 1024) // 100 + 1024 for p in range(65536)]
    assert rows.sort_values("p").cls.tolist() == want
    assert rows.cls.nunique() == rows.cls.max() + 1 <= cfg.PORT_CLASSES
    shifted = ports.filter(c.label_port(c.port_scaled(F.col("p"))) != c.port_class(F.col("p"))).count()
    assert shifted == 328


def test_decode_is_inverse_of_encode(make_flows):
    flows = make_flows(
        {"te": T0, "sp": 0, "dp": 1023, "byt": 1, "pkt": 1}, {"te": T0, "sp": 1024, "dp": 65535, "byt": 92109, "pkt": 7},
        {"te": T0, "sa": "255.0.10.255", "da": "42.219.1.1", "sp": 32768, "dp": 443, "pr": "UDP"},
        {"te": T0, "sa": "9.8.7.6", "da": "42.219.1.1", "pr": "ICMP", "td": 3.25},
    )
    rows = windows.encode_flows(flows.withColumn("delta", F.lit(12.5)), "flow_id", "this_ip", hour_max=24)
    rows = rows.withColumns({
        "lport_class": c.port_class(F.rint(F.col("lport_x") * 65535)),
        "rport_class": c.port_class(F.rint(F.col("rport_x") * 65535)),
    })
    got = {r.flow_id: r for r in codec.decode_flows(rows, F.col("this_ip"), "flow_id").collect()}
    for want in flows.collect():
        r = got[want.flow_id]
        assert (r.hour, r.sa, r.da, r.byt, r.pkt) == (23, want.sa, want.da, want.byt, want.pkt)
        assert r.pr == (want.pr if want.pr in ("TCP", "UDP") else "Other")
        assert r.time_delta == pytest.approx(12.5) and r.time_duration == pytest.approx(want.td)
        for port, real in ((r.sp, want.sp), (r.dp, want.dp)):
            assert port == real if real < 1024 else abs(port - real) < 100 and port <= 65535


def test_draw_picks_every_port_of_a_class(spark):
    df = spark.range(5000).select(c.decode_port(F.lit(1030), c.uniform(F.col("id"))).alias("p"))
    ports = [r.p for r in df.distinct().orderBy("p").collect()]
    assert ports == list(range(1624, 1724))


def test_masked_features_follow_the_order(make_flows):
    plan = cfg.flow_plan()
    rows = windows.prepare_windows(make_flows({"te": T0}))
    seen = windows.masked_features(rows, plan, 13).first().features[80:]
    full = rows.first().ctx[80:]
    assert [s for s, v in enumerate(zip(seen, full)) if v[0] != v[1]] == [
        i for i, v in enumerate(full) if i > 1 and v != 0
    ]


def test_carried_rows_are_limited_before_the_shuffle(make_flows):
    part = chunks.chunked(_user_flows(make_flows), "this_ip", halo=3, target_rows=40)
    plan = part.df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
