"""Host profiles, extraction and rules on hand-made flows."""

from __future__ import annotations

import datetime as dt

import pytest

from netloom.functions.rules import multicast_only_destination
from netloom.operators import filters, profile
from netloom.operators.rule_report import rule_summary, rule_verdicts

A, B, OUT, OUT2 = "42.219.1.1", "42.219.1.2", "8.8.8.8", "9.9.9.9"


@pytest.fixture
def ends(make_flows):
    return make_flows(
        {"sa": A, "da": A}, {"sa": A, "da": B}, {"sa": A, "da": OUT}, {"sa": OUT, "da": B}, {"sa": OUT, "da": OUT2}
    )


def test_self_flow_counts_twice_and_peers_decide_direction(ends):
    rows = {r.ip: tuple(r)[:1] + tuple(r)[2:] for r in profile.user_stats(ends).collect()}
    assert rows == {A: (4, 0, 1, 1), B: (2, 1, 0, 2)}


def test_type_counts_keep_zeros(ends):
    counts = {r.user_type: r.users for r in profile.user_type_counts(profile.user_stats(ends)).collect()}
    assert counts == {0: 0, 1: 1, 2: 1, 3: 0}


def test_flow_between_listed_users_is_extracted_for_both(spark, ends):
    users = spark.createDataFrame([(A,), (B,), (A,)], "user string")
    got = sorted((r.user, r.flow_id) for r in filters.extract_users(ends, users).collect())
    assert got == [(A, 0), (A, 1), (A, 2), (B, 1), (B, 3)]


def test_extract_users_without_broadcast_is_the_same(spark, ends, monkeypatch):
    users = spark.createDataFrame([(A,), (B,)], "user string")
    want = sorted((r.user, r.flow_id) for r in filters.extract_users(ends, users).collect())
    monkeypatch.setattr(filters, "broadcast_if_small", lambda df: df)
    got = sorted((r.user, r.flow_id) for r in filters.extract_users(ends, users).collect())
    assert got == want


def test_ties_are_ordered_by_address_text(make_flows):
    flows = make_flows({"sa": "42.219.1.9", "da": OUT}, {"sa": "42.219.1.10", "da": OUT})
    order = [r.ip for r in profile.ordered_stats(profile.user_stats(flows)).collect()]
    assert order == ["42.219.1.9", "42.219.1.10"]


def test_middle_half_positions(spark):
    rows = [(100 - i, f"42.219.0.{i}", 1, 1, 0) for i in range(10)] + [(500, "42.219.9.9", 0, 1, 1)]
    stats = spark.createDataFrame(
        rows, "number_of_rows long, ip string, incoming_num long, outgoing_num long, user_type int"
    )
    assert sorted(r.position for r in profile.middle_half(stats).collect()) == [2, 3, 4, 5, 6]


def test_day_filter_reaches_the_scan(flows):
    plan = filters.on_day(flows, "2024-01-05")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_day_edges(make_flows):
    times = [dt.datetime(2024, 1, 4, 23, 59, 59, 999999), dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 6)]
    flows = make_flows(*[{"te": t} for t in times])
    assert [r.flow_id for r in filters.on_day(flows, "2024-01-05").collect()] == [1]


def test_drop_invalid(spark):
    rows = [(1, 1.0), (2, None), (3, float("inf")), (4, float("-inf")), (5, float("nan"))]
    assert [r.k for r in filters.drop_invalid(spark.createDataFrame(rows, "k int, x double")).collect()] == [1]


RULE_CASES = [
    ("one_end_internal", {"sa": A, "da": OUT}, True),
    ("one_end_internal", {"sa": "0.0.0.0", "da": OUT}, True),
    ("one_end_internal", {"sa": OUT, "da": "255.255.255.255"}, True),
    ("one_end_internal", {"sa": OUT, "da": OUT2}, False),
    ("web_is_tcp", {"dp": 443, "pr": "TCP"}, True),
    ("web_is_tcp", {"sp": 80, "dp": 5, "pr": "UDP"}, False),
    ("web_is_tcp", {"sp": 5, "dp": 6}, None),
    ("dns_is_udp", {"dp": 53, "pr": "UDP"}, True),
    ("dns_is_udp", {"sp": 52, "pr": "TCP"}, False),
    ("dns_is_udp", {"dp": 80}, None),
    ("multicast_only_destination", {"sa": OUT, "da": "224.0.0.1"}, True),
    ("multicast_only_destination", {"sa": OUT, "da": "192.1.1.255"}, True),
    ("multicast_only_destination", {"sa": "239.0.0.1", "da": OUT}, False),
    ("multicast_only_destination", {"sa": "239.0.0.1", "da": "239.0.0.2"}, False),
    ("multicast_only_destination", {"sa": "192.1.1.255", "da": OUT}, None),
    ("netbios_stays_inside", {"sa": A, "da": "42.219.1.255", "dp": 137, "pr": "UDP"}, True),
    ("netbios_stays_inside", {"sa": A, "da": "42.219.1.254", "dp": 138, "pr": "UDP"}, False),
    ("netbios_stays_inside", {"dp": 139}, None),
    ("no_reserved_address", {"sa": A, "da": "192.168.0.0"}, False),
    ("no_reserved_address", {"sa": A, "da": "192.168.0.1"}, True),
    ("bytes_fit_packets", {"pkt": 2, "byt": 82}, True),
    ("bytes_fit_packets", {"pkt": 2, "byt": 81}, False),
    ("bytes_fit_packets", {"pkt": 1, "byt": 65536}, True),
    ("bytes_fit_packets", {"pkt": 1, "byt": 65537}, False),
    ("one_packet_is_short", {"pkt": 1, "td": 0.99}, True),
    ("one_packet_is_short", {"pkt": 1, "td": 1.0}, False),
    ("one_packet_is_short", {"pkt": 2, "td": 9.0}, None),
]


def test_rules(make_flows):
    verdicts = rule_verdicts(make_flows(*[fields for _, fields, _ in RULE_CASES]), "flow_id").collect()
    got = {r.flow_id: r for r in verdicts}
    for i, (rule, fields, want) in enumerate(RULE_CASES):
        assert got[i][rule] == want, (rule, fields)


def test_strict_multicast(make_flows):
    flows = make_flows({"sa": "192.1.1.255", "da": OUT})
    assert flows.select(multicast_only_destination(strict=True).alias("v")).first().v is False


def test_rule_without_sample_has_no_share(make_flows):
    rows = {r.rule: r for r in rule_summary(make_flows({"dp": 22, "sp": 23})).collect()}
    assert rows["dns_is_udp"].total == 0 and rows["dns_is_udp"].share is None
    assert rows["no_reserved_address"].share == 1.0
