"""Streams over several files end where the batch jobs end."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import FLOW, FLOW_DDL, SF_DIR
from netloom import session
from netloom.operators import profile, windows
from netloom.operators.rule_report import rule_summary
from netloom.sources.flows import load_flows
from netloom.streaming import jobs, levels


@pytest.fixture(scope="module")
def arriving(spark, tmp_path_factory):
    """The events in five files, in time order of arrival."""
    folder = str(tmp_path_factory.mktemp("arriving"))
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    cuts = events.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [0.2, 0.4, 0.6, 0.8])).first()[0]
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    edges = [0, *cuts, 2**62]
    for lo, hi in zip(edges, edges[1:]):
        events.filter((at >= lo) & (at < hi)).coalesce(1).write.mode("append").parquet(folder)
    return folder


def _stream(spark, folder):
    return jobs.stream_flows(spark, folder, "*.parquet")


def test_user_stats(spark, flows, arriving, tmp_path):
    jobs.running_user_stats(_stream(spark, arriving), str(tmp_path))
    got = sorted(tuple(r) for r in jobs.read_user_stats(spark, str(tmp_path)).select("ip", "number_of_rows", "user_type").collect())
    want = sorted((r.ip, r.number_of_rows, r.user_type) for r in profile.user_stats(flows).collect())
    assert got == want
    assert len(jobs._user_levels(spark, str(tmp_path)).runs()) == 5


def test_rule_rates_of_all_windows(spark, flows, arriving, tmp_path):
    jobs.rule_rates(_stream(spark, arriving), str(tmp_path))
    day = F.date_trunc("day", "te")
    want = rule_summary(flows.withColumn("day", day), "day")
    want = sorted((int((r.day - r.day.__class__(1970, 1, 1)).total_seconds()), r.rule, r.true_count, r.total) for r in want.collect())
    got = sorted(tuple(r) for r in jobs.read_rule_rates(spark, str(tmp_path)).collect())
    assert got == want


@pytest.mark.parametrize("target", [2_000_000, 10])
def test_windows_are_carried_across_batches(spark, flows, arriving, tmp_path, target):
    jobs.carried_windows(_stream(spark, arriving), str(tmp_path), target_rows=target)
    got = {r.flow_id: (r.user, r.ctx, r.label) for r in jobs.read_carried_windows(spark, str(tmp_path)).collect()}
    want = {r.flow_id: (r.user, r.ctx, r.label) for r in windows.prepare_windows(flows).collect()}
    assert got == want


@pytest.mark.parametrize("cell", [86_400, 3_600])
def test_late_files_are_repaired(spark, flows, tmp_path, cell):
    """Files in reverse order of time, the middle of every user's flows last."""
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    folder, at = str(tmp_path / "late"), F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = events.agg(F.percentile_approx(at, [0.4, 0.6])).first()[0]
    for part in (at >= hi, at < lo, (at >= lo) & (at < hi) & (F.col("event_id") % 2 == 0), (at >= lo) & (at < hi) & (F.col("event_id") % 2 == 1)):
        events.filter(part).coalesce(1).write.mode("append").parquet(folder)
        jobs.carried_windows(_stream(spark, folder), str(tmp_path / "out"), cell_seconds=cell, target_rows=50)
    got = {r.flow_id: (r.user, r.ctx, r.label) for r in jobs.read_carried_windows(spark, str(tmp_path / "out")).collect()}
    want = {r.flow_id: (r.user, r.ctx, r.label) for r in windows.prepare_windows(flows).collect()}
    assert got == want
    void = spark.read.parquet(f"{tmp_path}/out/retracted").count()
    assert 0 < void < len(want)


def test_windows_are_written_once(spark, flows, arriving, tmp_path, monkeypatch):
    """Windows, far wider than flows, go to their own files only; no copy of them is kept in between."""
    kept = []
    monkeypatch.setattr(jobs, "materialize", lambda df: kept.append(df.columns) or session.materialize(df))
    jobs.carried_windows(_stream(spark, arriving), str(tmp_path))
    assert kept and not any("ctx" in names for names in kept)
    assert jobs.read_carried_windows(spark, str(tmp_path)).columns == windows.prepare_windows(flows).columns


def test_levels_keep_few_runs_and_survive_a_repeated_batch(spark, tmp_path):
    state = levels.Levels(spark, str(tmp_path / "sums"), levels.sums("k"), fan=3)
    for n in range(20):
        state.add(spark.createDataFrame([(n % 4, 1), (9, n)], "k long, v long"), n)
        assert len(state.runs()) <= 2 * 3
    # run again, as after a failure behind the write: the list before it is the start
    state.add(spark.createDataFrame([(3, 1), (9, 19)], "k long, v long"), 19)
    assert {r.k: r.v for r in state.read().collect()} == {0: 5, 1: 5, 2: 5, 3: 5, 9: 190}
    assert {r.k: r.v for r in state.read(before=19).collect()} == {0: 5, 1: 5, 2: 5, 3: 4, 9: 171}
    names = session.list_path(spark, str(tmp_path / "sums" / "runs"))
    assert len(names) <= 4 * 3 and len(session.list_path(spark, str(tmp_path / "sums" / "lists"))) <= 4
    newest = levels.Levels(spark, str(tmp_path / "latest"), levels.latest("k"), fan=2)
    for n in range(5):
        newest.add(spark.createDataFrame([(0, n, n), (n, n, n)], "k long, v long, batch long").dropDuplicates(["k"]), n)
    assert {r.k: r.v for r in newest.read().collect()} == {0: 4, 1: 1, 2: 2, 3: 3, 4: 4}
    assert levels.Levels(spark, str(tmp_path / "none"), levels.sums("k")).read() is None


def test_late_flows_are_counted(spark, tmp_path):
    def arrive(*rows):
        spark.createDataFrame(rows, FLOW_DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(FLOW_DDL).parquet(str(tmp_path / "in"))
        jobs.rule_rates(stream, str(tmp_path / "out"), every="1 hour", late="10 minutes")

    def flow(i, hour, minute=0):
        return tuple((FLOW | {"flow_id": i, "te": hour if hour is None else dt.datetime(2024, 1, 5, hour, minute)})[k] for k in FLOW)

    arrive(flow(0, 8), flow(1, 9, 5), flow(2, None))
    # the watermark is 8:55: the window of 8 is still open
    arrive(flow(3, 8, 30), flow(4, 9, 10))
    # now it is 9:00
    arrive(flow(5, 8, 59), flow(6, 9, 1), flow(7, 12))
    arrive(flow(8, 9, 59), flow(9, 11, 0), flow(10, 12, 1))
    at = {h: int(dt.datetime(2024, 1, 5, h, tzinfo=dt.UTC).timestamp()) for h in (8, 9, 11, 12)}
    got = {r.window_start: (r.reported, r.late) for r in jobs.read_window_flows(spark, str(tmp_path / "out")).collect()}
    assert got == {at[8]: (2, 1), at[9]: (3, 1), at[11]: (1, 0), at[12]: (2, 0), None: (0, 1)}
    rates = {(r.window_start, r.rule): r.total for r in jobs.read_rule_rates(spark, str(tmp_path / "out")).collect()}
    assert rates[at[8], "one_end_internal"] == 2 and rates[at[9], "one_end_internal"] == 3


def test_user_sink(spark, flows, arriving, tmp_path):
    jobs.user_sink(_stream(spark, arriving), str(tmp_path))
    got = {r.user: r["count"] for r in jobs.read_user_sink(spark, str(tmp_path)).groupBy("user").count().collect()}
    ends = flows.select(F.explode(F.array_distinct(F.array("sa", "da"))).alias("user")).filter("user LIKE '42.219.%'")
    assert got == {r.user: r["count"] for r in ends.groupBy("user").count().collect()}


def test_restart_goes_on_where_it_stopped(spark, arriving, tmp_path):
    jobs.user_sink(_stream(spark, arriving), str(tmp_path))
    before = jobs.read_user_sink(spark, str(tmp_path)).count()
    jobs.user_sink(_stream(spark, arriving), str(tmp_path))
    assert jobs.read_user_sink(spark, str(tmp_path)).count() == before
    assert load_flows(spark, SF_DIR).count() <= before
