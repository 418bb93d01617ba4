"""Files written and read back, and the shared folder."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from netloom import session
from netloom.operators import windows
from netloom.plans import workflows
from netloom.sources import flows as src
from netloom.sources import sinks


def test_raw_round_trip(spark, flows, tmp_path):
    raw = src.raw_columns(flows)
    sinks.write_raw_flows(raw, str(tmp_path / "raw"))
    back = src.read_raw_flows(spark, str(tmp_path / "raw"))
    assert back.columns == [f.name for f in src.FLOW_SCHEMA]
    assert back.exceptAll(raw).isEmpty() and raw.exceptAll(back).isEmpty()


def test_raw_times_with_and_without_fraction(spark, tmp_path):
    (tmp_path / "f.csv").write_text(
        "2016-04-11 00:00:01,0.5,1.1.1.1,2.2.2.2,1,2,TCP,.AP.SF,0,0,3,150,background\n"
        "2016-04-11 00:00:01.25,0.5,1.1.1.1,2.2.2.2,1,2,TCP,.AP.SF,0,0,3,150,background\n"
    )
    times = [r.te.microsecond for r in src.read_raw_flows(spark, str(tmp_path / "f.csv")).collect()]
    assert times == [0, 250000]


def test_windows_round_trip(spark, flows, tmp_path):
    rows = windows.prepare_windows(flows)
    sinks.write_windows(rows, str(tmp_path / "w"))
    sinks.export_windows(spark, str(tmp_path / "w"), str(tmp_path / "text"))
    back = src.read_windows(spark, str(tmp_path / "text"), 6, 16)
    assert back.select("ctx", "label").exceptAll(rows.select("ctx", "label")).isEmpty()
    assert back.count() == rows.count()


def test_exported_windows_are_compressed(spark, make_flows, tmp_path):
    rows = windows.prepare_windows(make_flows(*[{"sp": 2000 + i} for i in range(50)]))
    sinks.write_windows(rows, str(tmp_path / "w"))
    sinks.export_windows(spark, str(tmp_path / "w"), str(tmp_path / "text"))
    text = spark.read.text(str(tmp_path / "text"))
    assert text.count() == 50 and src.read_windows(spark, str(tmp_path / "text"), 6, 16).count() == 50
    names = [p.name for p in (tmp_path / "text").glob("part-*")]
    assert names and all(n.endswith(".gz") for n in names)


def test_user_folders_append(spark, flows, tmp_path):
    path = str(tmp_path / "u")
    users = flows.withColumn("user", F.col("this_ip"))
    sinks.write_user_flows(users, path)
    sinks.write_user_flows(users, path)
    listed = sinks.recover_user_list(spark, path)
    want = {r.this_ip: 2 * r["count"] for r in flows.groupBy("this_ip").count().collect()}
    assert {r.user: r.rows for r in listed.collect()} == want
    assert sinks.folder_total(listed).first().total_rows == 2 * flows.count()


def test_reports_append(spark, flows, tmp_path):
    data = flows.withColumn("dataset", F.when(F.col("flow_id") % 2 == 0, "real").otherwise("made"))
    path = str(tmp_path / "r")
    workflows.evaluate(data, "real", path, run="one")
    workflows.evaluate(data, "real", path, run="two")
    rows = sinks.read_reports(spark, path).groupBy("report").pivot("run").count().collect()
    assert len(rows) == len(workflows.evaluation_reports(data, "real"))
    assert all(r.one == r.two for r in rows)


def test_a_repeated_run_replaces_its_reports(spark, tmp_path):
    for _ in range(2):
        sinks.write_report(spark.range(3), str(tmp_path), "ids", "one")
    assert sorted(r.row for r in sinks.read_reports(spark, str(tmp_path)).collect()) == ['{"id":0}', '{"id":1}', '{"id":2}']


def test_user_names_stay_text(spark, tmp_path):
    names = ["007", "1.50", "fe80::1", "2024-01-01"]
    sinks.write_user_flows(spark.createDataFrame([(n, 1) for n in names], "user string, byt int"), str(tmp_path))
    assert {r.user for r in sinks.read_user_flows(spark, str(tmp_path)).collect()} == set(names)
    assert {r.user: r.rows for r in sinks.recover_user_list(spark, str(tmp_path)).collect()} == dict.fromkeys(names, 1)


def test_clustered_storage_reads_few_files(spark, tmp_path):
    path = str(tmp_path / "users")
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), F.format_string("%04d", F.col("id") % 500))).alias("user"),
        F.col("id").alias("flow_id"), F.lit(1).alias("byt"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_user_flows(rows, path, part="a")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sinks.stored_files(spark, path).collect()
    # files do not follow the 501 users, and the heavy one is spread over some
    assert 4 <= len(files) <= 8 and sum(f.rows for f in files) == 20_000 and max(f.rows for f in files) < 20_000 / 3
    assert sum(f.first <= "hot" <= f.last for f in files) >= 2
    one = sinks.read_user_flows(spark, path, "u0001")
    assert one.count() == rows.filter("user = 'u0001'").count() and len(one.inputFiles()) <= 2
    assert {r.user: r["count"] for r in sinks.read_user_flows(spark, path, "u0007", "hot", "nobody").groupBy("user").count().collect()} == {
        r.user: r["count"] for r in rows.filter("user IN ('u0007', 'hot')").groupBy("user").count().collect()}
    assert sinks.read_user_flows(spark, path, "nobody").count() == 0
    # a part that is written again replaces itself; one without an index was never committed
    sinks.write_user_flows(rows.limit(10), path, part="a")
    rows.limit(7).write.parquet(f"{path}/data/part=lost")
    assert sinks.read_user_flows(spark, path).count() == 10
    sinks.write_user_flows(rows.limit(5), path)
    assert sinks.folder_total(sinks.recover_user_list(spark, path)).first().total_rows == 15


def test_pieces_go_by_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("sa,da,byt,pkt\n1.1.1.1,2.2.2.2,100,3\n")
    (tmp_path / "b.csv").write_text("pkt,byt,sa,da\n4,200,3.3.3.3,4.4.4.4\n")
    schema = src.T.StructType([f for f in src.FLOW_SCHEMA if f.name in ("sa", "da", "pkt", "byt")])
    paths = [str(tmp_path / n) for n in ("a.csv", "b.csv")]
    rows = src.read_flow_pieces(spark, {"x": paths}, schema).collect()
    assert sorted((r.piece, r.sa, r.da, r.pkt, r.byt) for r in rows) == [(0, "1.1.1.1", "2.2.2.2", 3, 100), (1, "3.3.3.3", "4.4.4.4", 4, 200)]
    with pytest.raises(Exception):  # one piece of two headers
        src.read_flow_pieces(spark, {"x": [str(tmp_path)]}, schema).collect()
    (tmp_path / "c.csv").write_text("pkt,byt,sa,da\n4,1.5e3x,3.3.3.3,4.4.4.4\n")
    with pytest.raises(Exception):
        src.read_flow_pieces(spark, {"x": [str(tmp_path / "c.csv")]}, schema).collect()


def test_profile_and_extract(spark, flows, tmp_path):
    stats = workflows.profile_and_extract(flows, None, str(tmp_path / "x"), users=5)
    written = sinks.read_user_flows(spark, str(tmp_path / "x"))
    counts = {r.user: r["count"] for r in written.groupBy("user").count().collect()}
    assert len(counts) == 5
    occurrences = {r.ip: r.number_of_rows for r in stats.collect()}
    assert all(counts[u] == occurrences[u] for u in counts)


def test_synthesize_end_to_end(spark, flows):
    users = flows.select(F.col("this_ip").alias("user")).distinct()
    made, fitted, losses = workflows.synthesize(flows, users, 1, epochs=1, span=3000.0, batch_rows=500)
    rows = made.toPandas()
    assert set(rows.user) == {r.user for r in users.collect()}
    assert set(fitted.mixtures) | set(fitted.heads) == set(fitted.plan.order)
    assert losses.count() == 1 and len([c for c in losses.columns if c.startswith("loss_")]) == 13
    assert rows.byt.ge(1).all() and rows.hour.between(0, 23).all()


def test_shared_folder_comes_from_the_session(spark):
    root = session.shared_root(spark)
    first, second = session.shared_path(spark, "a"), session.shared_path(spark, "a")
    assert first.startswith(root) and first != second


def test_broadcast_only_below_the_bound(spark):
    small = session.broadcast_if_small(spark.range(5), 5)._jdf.queryExecution().logical().toString()
    large = session.broadcast_if_small(spark.range(6), 5)._jdf.queryExecution().logical().toString()
    assert "broadcast" in small and "broadcast" not in large


@pytest.mark.parametrize("name", ["read_raw_flows", "read_flow_pieces"])
def test_missing_folder_is_an_error(spark, name):
    with pytest.raises(Exception):
        if name == "read_raw_flows":
            src.read_raw_flows(spark, "/no/such/folder").count()
        else:
            src.read_flow_pieces(spark, {"a": ["/no/such/folder"]}, src.FLOW_SCHEMA).count()
