"""Histograms, divergences, ranks and samples against brute force."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from netloom.functions.binning import with_left_closed_bin, with_ln_byte_bucket
from netloom.operators import divergence, sampling, scaling
from netloom.operators.ranking import rank_rows
from pyspark.sql import functions as F


def _counts(spark, values, bins, **how):
    df = spark.createDataFrame([("a", float(v)) for v in values], "dataset string, x double")
    return [r.n for r in divergence.histograms(df, ["x"], bins, **how).orderBy("bin").collect()]


@pytest.mark.parametrize("values", [
    np.random.default_rng(1).normal(size=500),
    np.arange(0, 609) / 2,
    np.repeat([1, 2, 3, 305], 5),
    np.random.default_rng(2).integers(0, 1000, 400) / 7,
    [5.0] * 9,
    [0.0] * 3,
])
@pytest.mark.parametrize("bins", [10, 304])
def test_right_closed_like_cut(spark, values, bins):
    want = pd.cut(np.asarray(values, dtype=float), bins).value_counts().tolist()
    assert _counts(spark, values, bins) == want


@pytest.mark.parametrize("values", [
    np.random.default_rng(3).normal(size=500), np.arange(100) / 10, np.random.default_rng(4).integers(0, 50, 300),
    [2.0] * 4,
])
def test_left_closed_like_histogram(spark, values):
    want = np.histogram(np.asarray(values, dtype=float), bins=50)[0].tolist()
    assert _counts(spark, values, 50, closed="left") == want


def test_nulls_are_not_counted(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0)], "dataset string, x double")
    assert [r.n for r in divergence.histograms(df, ["x"], 2).orderBy("bin").collect()] == [1, 1]


def test_ln_byte_buckets_like_edges(spark):
    edges = np.concatenate([[0], np.linspace(3.3322045101752034, 20.153654225990877, 304)])
    byt = [1, 2, 27, 28, 29, 1500, 10**6, 5 * 10**8, 10**9]
    df = spark.createDataFrame([(b,) for b in byt], "byt long")
    got = [r.b for r in with_ln_byte_bucket(df, "b", F.col("byt")).collect()]
    want = [int(np.searchsorted(edges, math.log(b), side="right")) - 1 if math.log(b) <= edges[-1] else None for b in byt]
    assert got == want


def test_outside_values_have_no_left_closed_bin(spark):
    df = spark.createDataFrame([(-1.0,), (1.0,), (1.1,), (-1.1,), (0.0,)], "x double")
    rows = with_left_closed_bin(df, "b", F.col("x"), F.lit(-1.0), F.lit(1.0), 50).collect()
    assert [r.b for r in rows] == [0, 49, None, None, 25]


def test_divergence_properties(spark):
    rng = np.random.default_rng(5)
    x = rng.exponential(size=400)
    rows = [("real", v) for v in x] + [("same", v) for v in x] + [("other", v) for v in rng.normal(size=300)]
    df = spark.createDataFrame([(d, float(v)) for d, v in rows], "dataset string, x double")
    smooth = divergence.laplace_smooth(divergence.histograms(df, ["x"]))
    sums = smooth.groupBy("dataset").agg(F.sum("p").alias("p")).collect()
    assert all(abs(r.p - 1) < 1e-12 for r in sums)
    got = {r.dataset: r for r in divergence.divergences(divergence.align(smooth, "real")).collect()}
    assert abs(got["same"].js) < 1e-15 and abs(got["same"].kl_forward) < 1e-15
    assert 0 < got["other"].js < math.log(2)

    def dist(v):
        n = pd.cut(v, 304).value_counts().to_numpy() + 1.0
        return n / n.sum()

    p, q = dist(x), dist(np.array([v for d, v in rows if d == "other"]))
    m = (p + q) / 2
    js = ((p * np.log(p / m)).sum() + (q * np.log(q / m)).sum()) / 2
    assert got["other"].js == pytest.approx(js, rel=1e-12)
    assert got["other"].kl_reverse == pytest.approx((q * np.log(q / p)).sum(), rel=1e-12)


def test_plain_divergence_is_infinite_for_a_bin_only_one_has(spark):
    df = spark.createDataFrame(
        [("real", 0.0), ("real", 1.0), ("real", 2.0), ("gen", 0.0), ("gen", 2.0)], "dataset string, x double"
    )
    plain = divergence.plain_distribution(divergence.histograms(df, ["x"], 3))
    row = divergence.divergences(divergence.align(plain, "real")).first()
    assert row.kl_forward == math.inf and math.isfinite(row.kl_reverse) and row.js < math.log(2)


def test_rank_rows_over_partitions(spark):
    df = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(7)).alias("v"), "id").repartition(13)
    got = rank_rows(df, F.desc("v"), F.asc("id")).toPandas().sort_values("rank")
    want = df.toPandas().sort_values(["v", "id"], ascending=[False, True])
    assert got["rank"].tolist() == list(range(1, 5001))
    assert got["id"].tolist() == want["id"].tolist()


@pytest.mark.parametrize("n", [0, 1, 777, 5000, 9999])
def test_sample_has_exact_size_and_no_repeats(spark, n):
    df = spark.range(5000)
    ids = [r.id for r in sampling.sample_n(df, n, "id").collect()]
    assert len(ids) == len(set(ids)) == min(n, 5000)


def test_sample_does_not_depend_on_partitions(spark):
    one = {r.id for r in sampling.sample_n(spark.range(5000).repartition(1), 100, "id").collect()}
    many = {r.id for r in sampling.sample_n(spark.range(5000).repartition(17), 100, "id").collect()}
    other = {r.id for r in sampling.sample_n(spark.range(5000), 100, "id", seed=7).collect()}
    assert one == many != other


@pytest.mark.parametrize("small", [100_000, 20, 1])
def test_sample_is_the_smallest_hashes_whatever_a_slice_holds(spark, monkeypatch, small):
    monkeypatch.setattr(sampling, "SLICE_ROWS", small)
    monkeypatch.setattr(sampling, "REFINE_BITS", 3)
    frame = spark.range(2_000).withColumn("name", F.concat(F.lit("n"), "id"))
    hashed = sorted((r.h, r.id) for r in frame.select("id", sampling.sample_hash(131, "name").alias("h")).collect())
    for n in (1, 137, 1_999, 2_000, 2_001):
        got = sampling.sample_n(frame, n, "name").collect()
        assert sorted(r.id for r in got) == sorted(i for _, i in hashed[:n])
    assert sampling.sample_n(frame, 0, "name").count() == 0


def test_sample_of_repeated_keys_and_rows(spark):
    frame = spark.range(1_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 50).alias("v"), F.lit(None).cast("string").alias("n"))
    for n in (1, 300, 500, 700, 999):
        got = sampling.sample_n(frame, n, "k", "n")
        assert got.count() == n and got.columns == frame.columns
        assert got.exceptAll(frame).count() == 0
    plan = sampling.sample_n(frame, 500, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan


def test_batches_hold_every_row_once_and_exactly_their_size(spark):
    rows = sampling.shuffled_batches(spark.range(5000), 512, "id").groupBy("batch").agg(F.count("*").alias("n"), F.count_distinct("id").alias("d")).collect()
    assert {r.batch: (r.n, r.d) for r in rows} == {b: (512, 512) for b in range(9)} | {9: (392, 392)}
    first = {(r.id, r.batch) for r in sampling.shuffled_batches(spark.range(100), 10, "id", epoch=0).collect()}
    second = {(r.id, r.batch) for r in sampling.shuffled_batches(spark.range(100), 10, "id", epoch=1).collect()}
    assert len(first & second) < 40
    assert sampling.shuffled_batches(spark.range(0), 10, "id").count() == 0


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, "b"), (3.0, "a"), (5.0, "b"), (5.0, None)], "x double, c string")
    fitted = scaling.fit_minmax(df, ["x"])
    assert fitted == {"x": (1.0, 5.0)}
    assert [r.x_normed for r in scaling.minmax_scale(df, fitted).collect()] == [0, 0.5, 1, 1]
    coded = scaling.ordinal_encode(df, ["c"]).collect()
    assert sorted((r.c or "", r.c_normed) for r in coded) == [("", None), ("a", 0.0), ("b", 1.0), ("b", 1.0)]


def test_sampled_curve_holds_every_external_end(spark, tmp_path):
    """More ends than any fixed sample of 5,000."""
    from netloom.plans import catalog

    events = spark.range(6_000).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-05 00:00:00' AS ts", "id % 40 AS user_id", "'view' AS event_type", "CAST(id % 90 AS DOUBLE) AS value", "'{}' AS props")
    events.write.parquet(str(tmp_path / "events.parquet"))
    curve = catalog.sampled_ip_curve(spark, str(tmp_path)).collect()
    whole = {r.ip: r.value for r in catalog.ip_occurrence_curve(spark, str(tmp_path)).collect()}
    assert sum(whole.values()) > 5_000 and {r.ip: r.value for r in curve} == whole
