"""Column plan, mixture gradients, fitting, stored parameters and sampling."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from netloom import config as cfg
from netloom.models import fitting, generating, mixture, tasks, training
from netloom.models.store import FitStore, losses_by_column
from netloom.operators import sampling, windows

PLAN = cfg.ColumnPlan(dim=3, window=1, classes={1: 5, 2: 2})


def test_column_plan_of_flows():
    plan = cfg.flow_plan()
    assert plan.continuous == (0, 1, 2, 3, 4)
    assert plan.discrete == (5, 6, 7, 8, 9, 10, 11, 13)
    assert [plan.class_count(c) for c in plan.discrete] == [1670, 1670, 256, 256, 256, 256, 2, 3]
    assert plan.visible(0) == [] and plan.visible(13) == [0, 1]
    assert plan.visible(11) == [0, 1, 13, 14, 15]
    assert plan.visible(4) == [0, 1, 2, 3, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
    assert plan.input_dim == 96 and sum(plan.feature_mask(11)) == 80 + 5


def test_default_order_and_context_only_mode():
    plan = cfg.ColumnPlan(dim=6, window=2, one_hot=((1, 2),), classes={4: 7}, mode="A")
    assert plan.order == (0, 3, 5, 1, 4)
    assert plan.input_dim == 12 and plan.visible(4) == [] and plan.feature_mask(4) == [1.0] * 12


def test_bad_plans():
    with pytest.raises(ValueError):
        cfg.ColumnPlan(dim=2, window=1, mode="C")
    with pytest.raises(ValueError):
        cfg.ColumnPlan(dim=2, window=1, order=(0,))


@pytest.mark.parametrize("binned", [False, True])
def test_gradient_against_differences(binned):
    rng = np.random.default_rng(0)
    d, k = 4, 3
    flat = mixture.initial(d, k, 1)
    x, y = rng.normal(size=(6, d)), rng.uniform(size=6)
    loss, grad = mixture.loss_and_gradient(flat, x, y, k, binned)
    assert loss == pytest.approx(mixture.row_loss(flat, x, y, k, binned).sum())
    for i in rng.choice(len(flat), 40, replace=False):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        up = mixture.row_loss(flat + step, x, y, k, binned).sum()
        down = mixture.row_loss(flat - step, x, y, k, binned).sum()
        assert grad[i] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-6)


def test_bin_mass_is_density_times_width():
    flat = 0.0 * mixture.initial(2, 2, 0)
    x, y = np.zeros((1, 2)), np.array([0.3])
    dense = mixture.row_loss(flat, x, y, 2, False)[0]
    assert dense == pytest.approx(-math.log(math.exp(-0.045) / math.sqrt(2 * math.pi)), abs=1e-6)
    assert mixture.row_loss(flat, x, y, 2, True)[0] == pytest.approx(dense - math.log(0.005), abs=1e-4)


@pytest.fixture(scope="module")
def table(spark):
    """Windows of a series whose column 0 follows column 0 before it, and column 1 its own past."""
    rng = np.random.default_rng(3)
    rows, x, cls = [], 0.5, 0
    for i in range(600):
        before = [x, float(cls) / 4, 0.0]
        x = min(1.0, max(0.0, 0.2 + 0.6 * x + 0.05 * rng.normal()))
        cls = (cls + (1 if rng.uniform() < 0.9 else 2)) % 5
        two = int(x > 0.5)
        rows.append((i, before + [x, cls / 4, float(two)], [x, float(cls), float(two)]))
    return spark.createDataFrame(rows, "flow_id long, ctx array<double>, label array<double>")


@pytest.fixture(scope="module")
def fitted(table):
    return fitting.fit(table, PLAN, epochs=25, max_iter=30)


def test_fit_lowers_the_loss(table, fitted):
    model, log = fitted
    assert log.count() == 25 and log.filter("steps = 1 and seconds > 0").count() == 25
    losses = {r.epoch: r.loss for r in losses_by_column(log).collect()}
    first, last = losses[0], losses[24]
    assert last < first - 0.5
    scored = {r.col: r for r in fitting.column_losses(table, model, binned=False).collect()}
    assert {c: r.kind for c, r in scored.items()} == {0: "mixture_nll", 1: "cross_entropy", 2: "cross_entropy"}
    assert scored[0].n == 600 and scored[0].loss < last + 0.2
    assert scored[1].loss < 1.2 < math.log(5)


@pytest.mark.parametrize(("rows", "batch_rows"), [(600, 100), (333, 50), (7, 100), (40, 1), (1, 1)])
def test_batches_are_exact_and_differ_by_epoch(spark, tmp_path, monkeypatch, rows, batch_rows):
    monkeypatch.setattr(training, "SHELF_ROWS", 100)
    frame = spark.range(rows).select(F.col("id").alias("flow_id"), F.array(F.lit(0.0)).alias("ctx"), F.array(F.lit(0.0)).alias("label"))
    made = training.training_table(frame, str(tmp_path), batch_rows=batch_rows)
    want = [min(batch_rows, rows - b * batch_rows) for b in range(made.batches)]
    mixes = []
    for epoch in (0, 3):
        dealt = {}
        for r in made.numbered(epoch).collect():
            dealt.setdefault(r.batch, set()).add(r.flow_id)
        assert [len(dealt[b]) for b in range(made.batches)] == want
        assert set().union(*dealt.values()) == set(range(rows))
        # what is read by ranges of positions is what the numbers say
        for b in sorted({0, made.batches // 2, made.batches - 1}):
            ranges = made.ranges(epoch, b)
            assert sum(end - low for low, end in ranges) == want[b] and len(ranges) <= training.BUCKETS_PER_BATCH + 4
            assert {r.flow_id for r in made.batch(epoch, b).collect()} == dealt[b]
        mixes.append(dealt)
    if rows > 300:
        assert sum(len(mixes[0][b] & mixes[1][b]) for b in mixes[0]) < rows / 2
    again = training.training_table(frame.limit(0), str(tmp_path), batch_rows=999)
    assert (again.total, again.batch_rows) == (rows, batch_rows)


def test_dealt_pieces_hold_the_rows_of_each_batch(spark, tmp_path, monkeypatch):
    for name, value in {"PIECE_ROWS": 16, "SEGMENT_ROWS": 150, "SEGMENT_FILES": 3}.items():
        monkeypatch.setattr(training, name, value)
    frame = spark.range(333).select(F.col("id").alias("flow_id"), F.array("id", -F.col("id")).cast("array<double>").alias("ctx"), F.array(F.col("id") * 2.0).alias("label"))
    made = training.training_table(frame, str(tmp_path), batch_rows=50)
    numbered = {}
    for r in made.numbered(1).collect():
        numbered.setdefault(r.batch, set()).add(r.flow_id)
    read = {}
    for r in made.read(1).collect():
        read.setdefault(r.batch, set()).add(r.flow_id)
    assert read == numbered
    dealt, jobs = made.deal(1), spark.sparkContext
    for b in range(made.batches):
        batch = dealt.batch(b)
        pieces = [v for _, v in jobs.runJob(batch.pieces, lambda rows: rows, batch.parts)]
        assert len(pieces) <= 4 and all(n <= 16 for _, _, n in pieces)
        ids = [x for ctx, _, n in pieces for x in np.frombuffer(ctx).reshape(n, 2)[:, 0].tolist()]
        assert len(ids) == len(numbered[b]) and set(ids) == numbered[b]
        assert [x for _, label, _ in pieces for x in np.frombuffer(label).tolist()] == [2 * i for i in ids]
    dealt.close()


def test_batch_gradients_need_no_shuffle_and_equal_those_of_the_table(table, tmp_path):
    made = training.training_table(table, str(tmp_path), batch_rows=150)
    params = fitting.initial_mixtures(PLAN) | fitting.initial_heads(PLAN)
    dealt = made.deal(0)
    for b in (0, 3):
        quick, plain = fitting._gradient_job(dealt.batch(b), PLAN, params, True), fitting._gradient_job(made.batch(0, b), PLAN, params, True)
        assert all(quick[c][0] == pytest.approx(plain[c][0]) and np.allclose(quick[c][1], plain[c][1], atol=1e-12) for c in params)
    dealt.close()


def test_positions_and_places_are_those_of_the_definition(spark, tmp_path, monkeypatch):
    """Rows are moved once, without a sampling pass; equal and null keys too get positions of their own."""
    monkeypatch.setattr(training, "PART_ROWS", 100)
    frame = spark.range(1_000).select((F.col("id") * 3).alias("flow_id"), F.array(F.lit(0.0)).alias("ctx"), F.array(F.lit(0.0)).alias("label"))
    made = training.training_table(frame, str(tmp_path / "a"), batch_rows=70)
    want = {r.flow_id: r.pos for r in sampling.dense_positions(frame, "flow_id").collect()}
    assert {r.flow_id: r.pos for r in made.rows.collect()} == want
    for epoch in (0, 2):
        places = made.placed(epoch).withColumn("want", made.place(F.col("pos"), epoch)).collect()
        assert len(places) == 1_000 and all(r.place == r.want for r in places)
    odd = frame.withColumn("flow_id", F.when(F.col("flow_id") % 2 == 0, F.lit(8)).when(F.col("flow_id") > 1_500, F.col("flow_id")))
    positions = [r.pos for r in training.training_table(odd, str(tmp_path / "b"), batch_rows=70).rows.collect()]
    assert sorted(positions) == list(range(1_000))


def test_batches_read_the_files_of_their_positions_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(training, "SHELF_ROWS", 100)
    frame = spark.range(5_000).select(F.col("id").alias("flow_id"), F.array(F.lit(0.0)).alias("ctx"), F.array(F.lit(0.0)).alias("label"))
    made = training.training_table(frame, str(tmp_path), batch_rows=32)
    shelves = {int(f.split("shelf=")[1].split("/")[0]) for f in made.batch(0, 3).select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert shelves == {low // 100 for low, _ in made.ranges(0, 3)} | {(end - 1) // 100 for _, end in made.ranges(0, 3)}
    assert len(shelves) <= 20 < 50


def test_permutation_is_one_to_one_and_undone(spark):
    for total in (1, 2, 3, 10, 97, 1_000):
        moved = {r.x: r.y for r in spark.range(total).select(F.col("id").alias("x"), sampling.permuted(F.col("id"), total, 5, 2).alias("y")).collect()}
        assert sorted(moved.values()) == list(range(total))
        assert all(sampling.position_at(y, total, 5, 2) == x for x, y in moved.items())
    assert spark.range(1).select(F.xxhash64(F.lit(-5).cast("long"), F.lit(7).cast("long")).alias("h")).first().h % (1 << 64) == sampling.hash_long(
        7, sampling.hash_long(-5 % (1 << 64)))


def test_a_stopped_fit_goes_on_where_it_was(spark, table, tmp_path, monkeypatch):
    whole, whole_log = fitting.fit_batches(table, PLAN, 4, 150, path=str(tmp_path / "whole"))
    path, calls, job = str(tmp_path / "stopped"), [], fitting._gradient_job

    def fails_later(*args):
        calls.append(1)
        if len(calls) == 11:  # in the third epoch
            raise RuntimeError("lost")
        return job(*args)

    monkeypatch.setattr(fitting, "_gradient_job", fails_later)
    with pytest.raises(RuntimeError):
        fitting.fit_batches(table, PLAN, 4, 150, path=path)
    store = FitStore(spark, path, tuple(sorted(PLAN.order)))
    assert store.last_epoch() == 1
    # a version without a log entry does not count
    spark.createDataFrame([(0, "flat", [9.0])], "col int, name string, data array<double>").write.parquet(f"{path}/parameters/version=lost")
    monkeypatch.setattr(fitting, "_gradient_job", job)
    again, log = fitting.fit_batches(table, PLAN, 4, 150, path=path)
    assert np.allclose(again.mixtures[0], whole.mixtures[0], atol=1e-9)
    assert all(np.allclose(again.heads[c].weights, whole.heads[c].weights, atol=1e-9) for c in (1, 2))
    assert log.columns == ["epoch", "seconds", "steps", "optimizer_step", "version", "loss_0", "loss_1", "loss_2"]
    for a, b in zip(log.orderBy("epoch").collect(), whole_log.orderBy("epoch").collect(), strict=True):
        assert (a.epoch, a.steps, a.optimizer_step) == (b.epoch, 4, b.optimizer_step)
        assert [a.loss_0, a.loss_1, a.loss_2] == pytest.approx([b.loss_0, b.loss_1, b.loss_2])
    with pytest.raises(KeyError):
        store.load(9)


def test_many_batches_are_walked_by_segments(spark, table, tmp_path, monkeypatch):
    """A job a segment and share of columns, not a batch, to the parameters and losses of steps that are a job each."""
    monkeypatch.setattr(fitting, "STEPPED_BATCHES", 8)
    stepped, stepped_log = fitting.fit_batches(table, PLAN, 2, 75, path=str(tmp_path / "stepped"))
    monkeypatch.setattr(fitting, "STEPPED_BATCHES", 7)
    monkeypatch.setattr(fitting, "_gradient_job", None)
    monkeypatch.setattr(training, "SEGMENT_ROWS", 230)
    monkeypatch.setattr(training, "PIECE_ROWS", 20)
    monkeypatch.setattr(training, "SEGMENT_FILES", 3)
    walks, walk = [], fitting._walk
    monkeypatch.setattr(fitting, "_walk", lambda *a: walks.append(a[1]) or walk(*a))
    path = str(tmp_path / "walked")
    fitting.fit_batches(table, PLAN, 1, 75, path=path)
    walked, log = fitting.fit_batches(table, PLAN, 2, 75, path=path)
    assert sorted(walks) == sorted([0, 1, 2] * 2 * len(fitting._shares(PLAN, fitting.initial_mixtures(PLAN) | fitting.initial_heads(PLAN))))
    assert np.allclose(walked.mixtures[0], stepped.mixtures[0], atol=1e-9)
    assert all(np.allclose(walked.heads[c].weights, stepped.heads[c].weights, atol=1e-9) for c in (1, 2))
    for a, b in zip(log.orderBy("epoch").collect(), stepped_log.orderBy("epoch").collect(), strict=True):
        assert (a.epoch, a.steps, a.optimizer_step) == (b.epoch, 8, b.optimizer_step)
        assert [a.loss_0, a.loss_1, a.loss_2] == pytest.approx([b.loss_0, b.loss_1, b.loss_2])


def test_steps_of_a_walk_take_the_gradient_of_the_batch():
    plan, rng = cfg.flow_plan(), np.random.default_rng(2)
    params = {c: p + 0.1 * rng.normal(size=p.shape) for c, p in (fitting.initial_mixtures(plan) | fitting.initial_heads(plan)).items()}
    x, label = rng.uniform(size=(700, 96)), rng.uniform(size=(700, 16))
    for col in (5, 6, 7, 8, 9, 10):
        label[:, col] = rng.integers(0, plan.class_count(col), 700)
    whole = fitting._gradients(params, plan, True, x, label)
    for col, (loss, grad) in fitting._step_gradients(params, plan, True, x, label).items():
        assert loss == pytest.approx(whole[col][0] / 700, rel=1e-6) and np.allclose(grad, whole[col][1] / 700, atol=fitting.GUARD)


def test_columns_of_a_walk_are_shared_out():
    plan = cfg.flow_plan()
    params = fitting.initial_mixtures(plan) | fitting.initial_heads(plan)
    shares = fitting._shares(plan, params)
    assert sorted(c for s in shares for c in s) == sorted(plan.order) and [5] in shares and [6] in shares and len(shares) < 9


def test_softmax_gradient_against_differences():
    rng = np.random.default_rng(0)
    flat, x, cls = rng.normal(size=4 * 4), rng.normal(size=(5, 3)), np.array([0, 3, 1, 1, 2])
    loss, grad = fitting._softmax_gradient(flat, x, cls, 4)
    for i in range(len(flat)):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        up, down = (fitting._softmax_gradient(flat + d, x, cls, 4)[0] for d in (step, -step))
        assert grad[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_gradient_job_does_not_depend_on_partitions(table):
    params = fitting.initial_mixtures(PLAN)
    one = fitting._gradient_job(table.repartition(1), PLAN, params, False)[0]
    many = fitting._gradient_job(table.repartition(40), PLAN, params, False)[0]
    assert one[0] == pytest.approx(many[0]) and np.allclose(one[1], many[1])


def test_label_hook_changes_the_classes(table):
    head = fitting.fit_discrete(table, PLAN, 1, max_iter=3, label_hook=lambda c: (c % 2).cast("int"))
    assert head.classes.tolist() == [0, 1]


def test_regression_gradient_is_the_slope():
    rng = np.random.default_rng(1)
    flat, cls = rng.normal(size=4 * 4), np.array([0, 3, 1, 1, 2])
    x = np.hstack([rng.normal(size=(5, 3)), np.ones((5, 1))]).astype(np.float32)
    loss, grad = fitting._regression_gradient(flat, x, cls)
    want = fitting._softmax_gradient(flat, x[:, :-1].astype(float), cls, 4)
    assert loss == pytest.approx(want[0], rel=1e-5) and np.allclose(grad, want[1], atol=1e-4)


def test_regressions_share_their_passes(spark, table, monkeypatch):
    """All discrete columns are fitted by the same jobs, to what a fit of each column alone gives."""
    passes = []
    job = fitting._regression_job
    monkeypatch.setattr(fitting, "_regression_job", lambda *a: passes.append(sorted(a[-1])) or job(*a))
    heads = fitting.fit_all_discrete(table, PLAN, max_iter=30, reg=0.01)
    assert passes[0] == [1, 2] and len(passes) < 60
    rows = table.select("ctx", "label").collect()
    x = np.array([r.ctx[:PLAN.input_dim] for r in rows])
    for col, head in heads.items():
        alone = fitting.fit_discrete(table, PLAN, col, max_iter=30, reg=0.01)
        assert head.classes.tolist() == alone.classes.tolist() and np.allclose(head.weights, alone.weights, atol=1e-3)
        # the loss is flat in every direction but for the weights' own pull
        seen = x * np.array(PLAN.feature_mask(col))
        cls = np.searchsorted(head.classes, [int(v) for v in fitting._classes(np.array([r.label for r in rows]), PLAN, col)])
        flat = np.hstack([head.weights, head.bias[:, None]])
        _, grad = fitting._softmax_gradient(flat.ravel(), seen, cls, len(head.classes))
        pull = np.hstack([0.01 * head.weights, np.zeros((len(flat), 1))])
        assert np.abs(grad.reshape(flat.shape) / len(rows) + pull).max() < 5e-3


def test_rows_of_classes_not_listed_are_left_out(spark, table):
    head = fitting.fit_discrete(table, PLAN, 1, max_iter=3, label_hook=lambda c: F.when(c % 3 != 2, c % 3).cast("int"))
    assert head.classes.tolist() == [0, 1] and np.isfinite(head.weights).all()


def test_single_class_needs_no_fit(spark, table):
    constant = table.withColumn("label", F.array(F.lit(0.5), F.lit(3.0), F.lit(1.0)))
    head = fitting.fit_discrete(constant, PLAN, 1)
    assert head.classes.tolist() == [3] and head.log_probabilities(np.ones((2, 6))).tolist() == [[0.0], [0.0]]


def test_stored_parameters(spark, fitted, tmp_path):
    model, _ = fitted
    path = str(tmp_path / "models")
    fitting.save_models(spark, model, path, "ep1")
    other = fitting.Fitted(PLAN, {0: model.mixtures[0] + 1.0}, model.heads)
    fitting.save_models(spark, other, path, "ep2")
    loaded = fitting.load_models(spark, PLAN, path, "ep1")
    assert np.array_equal(loaded.mixtures[0], model.mixtures[0])
    assert all(np.array_equal(loaded.heads[c].weights, model.heads[c].weights) for c in (1, 2))
    mixed = fitting.load_models(spark, PLAN, path, {0: "ep2", 1: "ep1", 2: "ep1"})
    assert np.array_equal(mixed.mixtures[0], model.mixtures[0] + 1.0)
    with pytest.raises(KeyError):
        fitting.load_models(spark, PLAN, path, "ep3")


def test_validate_loss_is_one_row(table, fitted):
    row = fitting.validate_loss(table, fitted[0], epoch=7).collect()
    assert len(row) == 1 and row[0].epoch == 7 and {"loss_0", "loss_1", "loss_2"} <= set(row[0].asDict())


def _sequences(spark, n, rows):
    return spark.range(n).select(F.col("id").cast("string").alias("seq_id"), F.lit(rows).alias("rows"))


def test_sampled_rows_do_not_depend_on_spread(spark, fitted):
    model, _ = fitted
    seqs = _sequences(spark, 20, 15)
    one = generating.sample_rows(seqs, model, seed=1, partitions=1).orderBy("seq_id", "step").collect()
    many = generating.sample_rows(seqs, model, seed=1, partitions=9).orderBy("seq_id", "step").collect()
    assert len(one) == len(many) == 300
    for a, b in zip(one, many):
        assert (a.seq_id, a.step, a.cls) == (b.seq_id, b.step, b.cls) and np.allclose(a.row, b.row)
    other = generating.sample_rows(seqs, model, seed=2, partitions=1).orderBy("seq_id", "step").collect()
    assert one != other


def test_legs_of_a_long_request(spark, table, fitted):
    model, _ = fitted
    pool = generating.window_pool(table, PLAN, 50)
    assert pool.shape == (50, 1, 3)
    real = {tuple(r.ctx[3:]) for r in table.collect()}
    assert {tuple(p[0]) for p in pool} <= real
    one = spark.createDataFrame([("u", 2_005), ("v", 3), ("w", 0)], "seq_id string, rows long")
    parts = generating.sample_rows(one, model, seed=1, partitions=3, pool=pool, leg_rows=100)
    assert parts.rdd.getNumPartitions() == 3
    spread = generating.sample_rows(one, model, seed=1, partitions=13, pool=pool, leg_rows=100).toPandas().sort_values(["seq_id", "step"], ignore_index=True)
    parts = parts.toPandas().sort_values(["seq_id", "step"], ignore_index=True)
    assert parts[["seq_id", "leg", "step"]].equals(spread[["seq_id", "leg", "step"]])
    assert np.allclose(np.vstack(parts.row), np.vstack(spread.row))
    u = parts[parts.seq_id == "u"]
    assert u.step.tolist() == list(range(2_005)) and u.leg.tolist() == [s // 100 for s in range(2_005)]
    assert parts[parts.seq_id == "v"].step.tolist() == [0, 1, 2] and "w" not in set(parts.seq_id)
    # legs are not copies of each other, and the first is what an uncut request begins with
    assert len({tuple(r) for r in u[u.step % 100 == 4].row}) == 21
    uncut = generating.sample_rows(one.filter("seq_id = 'u'"), model, seed=1).filter("step < 100").orderBy("step").toPandas()
    assert np.allclose(np.vstack(uncut.row), np.vstack(u[u.leg == 0].row))


def test_sampled_series_follow_the_data(spark, table, fitted):
    rows = generating.sample_rows(_sequences(spark, 40, 50), fitted[0], seed=5)
    x = rows.select(F.col("row")[0].alias("x"), F.col("cls")[0].alias("c")).toPandas()
    real = table.select(F.col("label")[0].alias("x")).toPandas().x
    assert abs(x.x.mean() - real.mean()) < 0.15
    assert set(x.c) == {0, 1, 2, 3, 4}


def test_long_sequences_are_flushed_in_parts(spark, fitted, monkeypatch):
    monkeypatch.setattr(generating, "FLUSH_ROWS", 7)
    rows = generating.sample_rows(_sequences(spark, 3, 10), fitted[0]).collect()
    assert sorted((r.seq_id, r.step) for r in rows) == [(str(s), t) for s in range(3) for t in range(10)]


def test_draws_are_uniform_and_distinct():
    keys = np.arange(20_000, dtype=np.int64)
    u = generating.draws(keys, 1, 2, 3)
    assert len(set(u)) == len(u) and abs(u.mean() - 0.5) < 0.01 and abs(u.std() - math.sqrt(1 / 12)) < 0.01
    z = generating.normal_draws(keys, 4)
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03
    assert not np.allclose(generating.draws(keys, 1, 2, 4), u)


def test_time_span_of_a_flow_model(spark):
    """An untrained flow model: the clock, the bounds and the decoded records."""
    plan = cfg.flow_plan(arch="A")
    heads = {
        c: fitting.SoftmaxHead(np.arange(plan.class_count(c)), np.zeros((plan.class_count(c), 96)),
                               np.zeros(plan.class_count(c)))
        for c in plan.discrete
    }
    model = fitting.Fitted(plan, fitting.initial_mixtures(plan), heads)
    users = spark.createDataFrame([("42.219.1.1",), ("42.219.1.2",)], "user string")
    flows = generating.generate_many_users(users, 3, model, span=20_000.0, seed=1).toPandas()
    assert set(zip(flows.user, flows.day)) == {(u, d) for u in ("42.219.1.1", "42.219.1.2") for d in range(3)}
    for _, one in flows.sort_values("step").groupby(["user", "day"]):
        clock = np.floor(one.time_delta + 1e-9).cumsum()
        assert clock.iloc[-1] >= 20_000 > clock.iloc[-1] - one.time_delta.iloc[-1]
        assert one.hour.tolist() == [int(t // 3600) for t in clock - np.floor(one.time_delta + 1e-9)]
        assert ((one.sa == one.user) | (one.da == one.user)).all()
    assert flows.sp.between(0, 65535).all() and flows.dp.between(0, 65535).all()
    assert flows.time_duration.between(0, 363).all() and set(flows.pr) <= {"TCP", "UDP", "Other"}


def test_legs_of_a_time_span(spark):
    """Legs end on their last second exactly, and all but the first start behind a window of their hour."""
    plan = cfg.flow_plan(arch="A")
    model = fitting.Fitted(plan, fitting.initial_mixtures(plan), fitting.fitted_from(plan, fitting.initial_heads(plan)).heads)
    pool = np.zeros((48, plan.window, plan.dim))
    pool[:, -1, 0] = (np.arange(48) % 24) / 24
    pool[:, -1, 2] = np.arange(48) / 100
    seqs = spark.createDataFrame([("a", 10_000.0), ("b", 7_200.0), ("c", 50.0)], "seq_id string, span double")
    rows = generating.sample_time_span(seqs, model, seed=3, pool=pool, leg_seconds=3_600)
    flat = generating.flow_columns(rows, plan).toPandas()
    flat["seconds"] = np.floor(flat.delta_x * cfg.DELTA_MAX)
    sums = flat.groupby(["seq_id", "leg"]).seconds.sum()
    assert [sums["a", 0], sums["a", 1], sums["b", 0]] == [3_600] * 3
    assert sums["a", 2] >= 2_800 and sums["b", 1] >= 3_600 and sums["c", 0] >= 50 and len(sums) == 6
    assert flat.delta_x.between(0, 1).all()
    for (_, leg), part in flat.sort_values("step").groupby(["seq_id", "leg"]):
        clock = leg * 3_600 + part.seconds.cumsum() - part.seconds
        assert np.allclose(part.hour_x, np.floor(clock / 3_600) / 24)
    hours = np.floor(pool[:, -1, 0] * 24 + 1e-6)
    start = generating._opening(pool, hours, np.arange(9), 1, np.array([0, 1, 2] * 3), np.array([0.0, 3_600, 90_000] * 3), (9, plan.window + 1, plan.dim))
    assert not start[::3].any() and set(start[1::3, -2, 0] * 24) == {1.0} == set(start[2::3, -2, 0] * 24)
    with pytest.raises(PythonException, match="does not reach"):
        still = fitting.Fitted(plan, {c: 0.0 * p - (c == 1) * 9.0 for c, p in model.mixtures.items()}, model.heads)
        generating.sample_time_span(seqs, still, still_steps=50).count()


def test_artificial_series(spark):
    series = spark.createDataFrame([("a", 3000), ("b", 1), ("c", 0)], "seq_id string, rows int")
    rows = generating.artificial_series(series, [0.9, 0.8], seed=2).toPandas()
    assert rows.groupby("seq_id").size().to_dict() == {"a": 3000, "b": 1}
    a = rows[rows.seq_id == "a"].sort_values("step")
    assert np.corrcoef(a.x0[1:], a.x0[:-1])[0, 1] == pytest.approx(0.9, abs=0.05)
    noise = (a.x0.to_numpy()[1:] - 0.9 * a.x0.to_numpy()[:-1]) / 0.1
    assert abs(noise.mean()) < 0.1 and noise.std() == pytest.approx(1, abs=0.1)


def test_generated_rows_and_positions_are_not_broadcast(spark, tmp_path):
    from conftest import SF_DIR
    from netloom.plans import catalog

    frame = spark.range(40).select(F.col("id").alias("flow_id"), F.array(F.lit(0.0)).alias("ctx"), F.array(F.lit(0.0)).alias("label"))
    for joined in (catalog.artificial_correlation(spark, SF_DIR), training.training_table(frame, str(tmp_path), batch_rows=10).read(0)):
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_tasks_learn(spark):
    rng = np.random.default_rng(0)
    rows = [(float(a), float(b), float(a + b > 1) + float(a + b > 1.5), float(3 * a - b)) for a, b in rng.uniform(size=(600, 2))]
    df = spark.createDataFrame(rows, "a double, b double, cls double, y double")
    train, test = df.randomSplit([0.5, 0.5], seed=1)
    classes = tasks.flow_classifier(train, test, ["a", "b"], "cls", epochs=100).predict(test)
    assert tasks.accuracy(classes, "cls") > 0.85
    assert tasks.classification_table(classes, "cls").agg(F.sum("rows")).first()[0] == test.count()
    values = tasks.flow_regressor(train, test, ["a", "b"], "y", rounds=15).predict(test)
    assert tasks.mean_squared_error(values, "y") < 0.1


def test_prepared_flow_windows_fit(flows):
    rows = windows.prepare_windows(flows, hour_max=24, clip=True)
    labels = rows.select(F.array_min("label").alias("x")).agg(F.min("x")).first()[0]
    assert labels >= 0
    worst = rows.select(F.array_max("ctx").alias("m")).agg(F.max("m")).first()[0]
    assert worst <= 1.0
