"""Fitting one conditional model per column from a window table.

Continuous columns are conditional mixtures, discrete ones softmax heads, both fitted by
gradient steps.  Steps on few or large batches are one Spark job each, in which every task sums its rows'
gradients.  Many small batches are walked through: no column's step needs another column, so columns
go side by side, a task taking a few of them through a segment of batches.  Over a whole table, discrete columns are multinomial
logistic regressions, minimized side by side: one job evaluates the next point of every column.
Only parameters, whose size does not depend on the number of flows, ever reach the driver.
"""

from __future__ import annotations

import itertools
import math
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, inheritable_thread_target
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.config import ColumnPlan
from netloom.models import mixture
from netloom.models.store import PARTS, FitStore
from netloom.models.training import SEGMENT_ROWS, Batch, Dealt, Training, training_table
from netloom.session import shared_path

BATCH_ROWS = 512
# Gradient sums are added up in this many groups per column before the last addition.
GRADIENT_GROUPS = 16
# An epoch of more batches than this, each of a segment's rows at most, is walked through by segments.
STEPPED_BATCHES = 16
# Rows whose scores and gradients are worked out at a time in a walk; time a mixture's parameter, and any column, takes beside a softmax one.
WALKED_ROWS, MIXTURE_COST, COLUMN_COST = 256, 5, 15_000
# A walk scores heads of so many classes in single precision: rounding of a mean gradient stays below GUARD.
SINGLE_CLASSES = 64
# Optimizer constants: moment decays and their guard, learning-rate decay and its period.
DECAY_1, DECAY_2, GUARD = 0.9, 0.999, 1e-8
RATE_DECAY, RATE_EPOCHS = 0.9, 10
# Rows whose class scores are held at a time: they stay in the processor's cache.
SCORED_ROWS = 1_024
# Logistic regressions: steps remembered, relative change that ends them, points tried per line, its two conditions.
MEMORY, TOLERANCE, LINE_POINTS, DECREASE, CURVATURE = 10, 1e-6, 12, 1e-4, 0.9
# Stands for a null class; no class may have this number.
NO_CLASS = -(2**31)


@dataclass
class SoftmaxHead:
    classes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights.T + self.bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


@dataclass
class Fitted:
    """Fitted parameters: flat mixture parameters and softmax heads by column."""

    plan: ColumnPlan
    mixtures: dict = field(default_factory=dict)
    heads: dict = field(default_factory=dict)


def _block(batch: pa.RecordBatch, plan: ColumnPlan) -> tuple[np.ndarray, np.ndarray]:
    """Context and label arrays of an Arrow batch, one row each."""
    def matrix(name):
        column = batch.column(name)
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    return matrix("ctx")[:, : plan.input_dim], matrix("label")


def _classes(label: np.ndarray, plan: ColumnPlan, col: int) -> np.ndarray:
    """Class numbers of a discrete column in a block of label rows."""
    if col in plan.group_of:
        return label[:, list(plan.group_of[col])].argmax(axis=1)
    return label[:, col].astype(int)


def _softmax_gradient(flat: np.ndarray, x: np.ndarray, cls: np.ndarray, count: int) -> tuple[float, np.ndarray]:
    """Cross-entropy and its gradient, both summed over the rows; ``flat`` holds weights and bias of every class."""
    block = flat.reshape(count, -1)
    z = x @ block[:, :-1].T + block[:, -1]
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=1, keepdims=True)
    row = np.arange(len(cls))
    loss = -np.log(np.maximum(p[row, cls], mixture.FLOOR)).sum()
    p[row, cls] -= 1.0
    return float(loss), np.hstack([p.T @ x, p.sum(axis=0)[:, None]]).ravel()


def _gradients(params: dict, plan: ColumnPlan, binned: bool, x: np.ndarray, label: np.ndarray) -> dict:
    """Loss and gradient per column, summed over a block of rows."""
    out = {}
    for col, flat in params.items():
        seen = x * np.array(plan.feature_mask(col))
        if col in plan.continuous:
            out[col] = mixture.loss_and_gradient(flat, seen, label[:, col], plan.components, binned)
        else:
            out[col] = _softmax_gradient(flat, seen, _classes(label, plan, col), plan.class_count(col))
    return out


def _gradient_job(rows: DataFrame | Batch, plan: ColumnPlan, params: dict, binned: bool) -> dict:
    """Mean loss and mean gradient per column: one job over the rows."""
    if isinstance(rows, Batch):
        return _batch_gradients(rows, plan, params, binned)
    shared = rows.sparkSession.sparkContext.broadcast(params)

    def partial(batches):
        sums, losses, n = {}, dict.fromkeys(shared.value, 0.0), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x, label = _block(batch, plan)
            n += len(x)
            for col, (loss, grad) in _gradients(shared.value, plan, binned, x, label).items():
                losses[col] += loss
                sums[col] = sums[col] + grad if col in sums else grad
        if n:
            group = TaskContext.get().partitionId() % GRADIENT_GROUPS
            yield pa.RecordBatch.from_pydict({
                "col": pa.array(list(sums), pa.int32()),
                "part": pa.array([group] * len(sums), pa.int32()),
                "grad": pa.array([sums[c] for c in sums], pa.list_(pa.float64())),
                "loss": pa.array([losses[c] for c in sums], pa.float64()),
                "n": pa.array([n] * len(sums), pa.int64()),
            })

    partials = rows.select("ctx", "label").mapInArrow(
        partial, "col int, part int, grad array<double>, loss double, n long"
    )
    out = _added(partials)
    shared.destroy()
    return out


def _added(partials: DataFrame) -> dict:
    """Mean loss and mean gradient per column of the sums ``(col, part, grad, loss, n)``."""
    sums = partials.select("col", "part", array_to_vector("grad").alias("grad"), "loss", "n")
    for keys in (["col", "part"], ["col"]):
        sums = sums.groupBy(*keys).agg(
            Summarizer.sum(F.col("grad")).alias("grad"), F.sum("loss").alias("loss"), F.sum("n").alias("n")
        )
    return {r.col: (r.loss / r.n, r.grad.toArray() / r.n) for r in sums.collect()}


def _batch_gradients(batch: Batch, plan: ColumnPlan, params: dict, binned: bool) -> dict:
    """The same for a batch in pieces: one task each and no shuffle; the driver adds up as many sums as a batch has pieces."""
    sc = batch.pieces.context
    shared = sc.broadcast(params)

    def partial(pieces):
        for _, (ctx, label, n) in pieces:
            x = np.frombuffer(ctx).reshape(n, -1)[:, : plan.input_dim]
            yield n, _gradients(shared.value, plan, binned, x, np.frombuffer(label).reshape(n, -1))

    sums, rows = {}, 0
    for n, found in sc.runJob(batch.pieces, partial, batch.parts):
        rows += n
        for col, (loss, grad) in found.items():
            before = sums.get(col, (0.0, 0.0))
            sums[col] = before[0] + loss, before[1] + grad
    shared.destroy()
    return {col: (loss / rows, grad / rows) for col, (loss, grad) in sums.items()}


@dataclass
class Optimizer:
    """Adaptive moment estimation on flat parameter vectors."""

    rate: float
    step: int = 0
    moments: dict = field(default_factory=dict)

    def update(self, params: dict, grads: dict, epoch: int) -> None:
        self.step += 1
        rate = self.rate * RATE_DECAY ** (epoch // RATE_EPOCHS)
        for col, grad in grads.items():
            first, second = self.moments.get(col, (0.0, 0.0))
            first = DECAY_1 * first + (1 - DECAY_1) * grad
            second = DECAY_2 * second + (1 - DECAY_2) * grad * grad
            self.moments[col] = first, second
            hat_1 = first / (1 - DECAY_1**self.step)
            hat_2 = second / (1 - DECAY_2**self.step)
            params[col] = params[col] - rate * hat_1 / (np.sqrt(hat_2) + GUARD)


def _shares(plan: ColumnPlan, params: dict) -> list[list[int]]:
    """Columns that a task takes together: as many tasks as make none slower than the slowest column."""
    cost = {c: COLUMN_COST + len(p) * (MIXTURE_COST if c in plan.continuous else 1) for c, p in params.items()}
    shares: list[list[int]] = []
    for col in sorted(params, key=lambda c: (-cost[c], c)):
        free = [s for s in shares if sum(cost[c] for c in (*s, col)) <= max(cost.values())]
        if free:
            min(free, key=lambda s: sum(cost[c] for c in s)).append(col)
        else:
            shares.append([col])
    return shares


def _batches(rows: Iterator[pa.RecordBatch], pieces_of_batch: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Context and label arrays of one batch after the other, of pieces in their order."""
    pieces = (p for some in rows for p in zip(some.column("piece").to_pylist(), *(some.column(n) for n in ("n", "ctx", "label"))))
    for _, held in itertools.groupby(pieces, lambda p: p[0] // pieces_of_batch):
        arrays = [[np.frombuffer(x.as_buffer()).reshape(n.as_py(), -1) for x in parts] for _, n, *parts in held]
        ctx, label = zip(*arrays)
        yield np.vstack(ctx), np.vstack(label)


def _step_gradients(params: dict, plan: ColumnPlan, binned: bool, x: np.ndarray, label: np.ndarray) -> dict:
    """Mean loss and mean gradient per column over a batch, by blocks that stay in the processor's cache."""
    out, floor = {}, -math.log(mixture.FLOOR)
    blocks = [slice(at, at + WALKED_ROWS) for at in range(0, len(x), WALKED_ROWS)]
    for col, flat in params.items():
        if col in plan.discrete and plan.class_count(col) >= SINGLE_CLASSES:
            seen = np.hstack([x * np.array(plan.feature_mask(col)), np.ones((len(x), 1))]).astype(np.float32)
            cls = _classes(label, plan, col)
            found = [_regression_gradient(flat, seen[b], cls[b], floor) for b in blocks]
        else:
            found = [_gradients({col: flat}, plan, binned, x[b], label[b])[col] for b in blocks]
        out[col] = sum(loss for loss, _ in found) / len(x), sum(grad for _, grad in found) / len(x)
    return out


def _walk(dealt: Dealt, segment: int, plan: ColumnPlan, params: dict, optimizer: Optimizer, binned: bool, epoch: int) -> dict:
    """Steps of some columns through the batches of a segment, by one task; gives the sum of their mean losses.

    The task reads the segment in the order of its batches.  Only parameters and moments come back, and are put
    into ``params`` and ``optimizer``.
    """
    shared, pieces_of_batch = dealt.spark.sparkContext.broadcast((params, optimizer)), dealt.pieces_of_batch

    def walked(batches):
        before, steps = shared.value
        own, steps, losses = dict(before), Optimizer(steps.rate, steps.step, dict(steps.moments)), dict.fromkeys(before, 0.0)
        for x, label in _batches(batches, pieces_of_batch):
            found = _step_gradients(own, plan, binned, x[:, : plan.input_dim], label)
            steps.update(own, {c: g for c, (_, g) in found.items()}, epoch)
            for c, (loss, _) in found.items():
                losses[c] += loss
        yield pa.RecordBatch.from_pydict({
            "col": pa.array(list(own), pa.int32()), "step": pa.array([steps.step] * len(own), pa.int64()),
            "loss": pa.array(list(losses.values()), pa.float64()),
            **{name: pa.array([x.tobytes() for x in parts], pa.binary())
               for name, parts in zip(PARTS, zip(*((own[c], *steps.moments[c]) for c in own)))},
        })

    rows = dealt.segment(segment).coalesce(1).sortWithinPartitions("piece")
    ended = rows.mapInArrow(walked, "col int, step long, loss double, " + ", ".join(f"{n} binary" for n in PARTS)).toArrow().to_pylist()
    shared.destroy()
    for r in ended:
        params[r["col"]], *moments = (np.frombuffer(r[name]) for name in PARTS)
        optimizer.moments[r["col"]], optimizer.step = tuple(moments), r["step"]
    return {r["col"]: r["loss"] for r in ended}


def _walk_epoch(dealt: Dealt, plan: ColumnPlan, params: dict, optimizer: Optimizer, binned: bool, epoch: int) -> dict:
    """Steps through all batches of an epoch: shares of the columns side by side, each by one segment behind the other.

    No column's step needs another column, so no share waits for another.  ``params`` and ``optimizer`` are
    brought to the end of the epoch; gives the sum of the batches' mean losses per column.
    """
    @inheritable_thread_target
    def walk(share: list[int]) -> tuple[dict, Optimizer, dict]:
        own = {c: params[c] for c in share}
        steps = Optimizer(optimizer.rate, optimizer.step, {c: m for c, m in optimizer.moments.items() if c in own})
        sums = dict.fromkeys(share, 0.0)
        for segment in range(dealt.segments):
            for c, loss in _walk(dealt, segment, plan, own, steps, binned, epoch).items():
                sums[c] += loss
        return own, steps, sums

    shares = _shares(plan, params)
    with ThreadPoolExecutor(len(shares)) as beside:
        ended = list(beside.map(walk, shares))
    losses = {}
    for own, steps, sums in ended:
        params.update(own)
        optimizer.moments.update(steps.moments)
        losses |= sums
    optimizer.step = ended[0][1].step
    return losses


def initial_mixtures(plan: ColumnPlan, seed: int = 0) -> dict:
    return {c: mixture.initial(plan.input_dim, plan.components, seed + c) for c in plan.continuous}


def initial_heads(plan: ColumnPlan) -> dict:
    return {c: np.zeros(plan.class_count(c) * (plan.input_dim + 1)) for c in plan.discrete}


def fit_columns(
    training: Training, plan: ColumnPlan, epochs: int, store: FitStore, by_batch: bool = True, binned: bool | None = None,
    seed: int = 0, params: dict | None = None,
) -> dict:
    """Gradient steps on the columns of ``store`` together, up to ``epochs`` epochs in all; returns their parameters.

    ``by_batch`` steps through the exact batches of each epoch on bin likelihoods (by ``_walk_epoch`` if they
    are many), otherwise an epoch is one step over the whole table on densities.  Every epoch is committed to the
    store with its losses; a store that holds epochs already is gone on with.
    """
    binned = by_batch if binned is None else binned
    params = dict(params or {c: p for c, p in (initial_mixtures(plan, seed) | initial_heads(plan)).items() if c in store.columns})
    optimizer = Optimizer(plan.learning_rate)
    last = store.last_epoch()
    if last is not None:
        optimizer.step, state = store.load(last)
        params = {c: flat for c, (flat, _, _) in state.items()}
        optimizer.moments = {c: (first, second) for c, (_, first, second) in state.items()}
    for epoch in range(0 if last is None else last + 1, epochs):
        start = time.time()
        sums, steps = dict.fromkeys(params, 0.0), training.batches if by_batch else 1
        dealt = training.deal(epoch) if by_batch else None
        walks = by_batch and steps > STEPPED_BATCHES and training.batch_rows <= SEGMENT_ROWS
        if walks:
            sums = _walk_epoch(dealt, plan, params, optimizer, binned, epoch)
        for step in range(0 if walks else steps):
            result = _gradient_job(dealt.batch(step) if dealt else training.rows, plan, params, binned)
            optimizer.update(params, {c: g for c, (_, g) in result.items()}, epoch)
            for c, (loss, _) in result.items():
                sums[c] += loss
        if dealt:
            dealt.close()
        losses = {c: total / steps for c, total in sums.items()}
        state = {c: (flat, *optimizer.moments[c]) for c, flat in params.items()}
        store.commit(epoch, time.time() - start, steps, optimizer.step, losses, state)
    return params


def fitted_from(plan: ColumnPlan, params: dict) -> Fitted:
    """The model that flat parameters stand for."""
    heads = {}
    for c in plan.discrete:
        if c in params:
            block = params[c].reshape(plan.class_count(c), -1)
            heads[c] = SoftmaxHead(np.arange(len(block)), block[:, :-1], block[:, -1])
    return Fitted(plan, {c: params[c] for c in plan.continuous if c in params}, heads)


def class_label(plan: ColumnPlan, col: int) -> Column:
    """Class number of a discrete column: position of the indicator, or the label itself."""
    if col in plan.group_of:
        members = plan.group_of[col]
        return sum((F.col("label")[c] * i for i, c in enumerate(members)), F.lit(0.0)).cast("int")
    return F.col("label")[col].cast("int")


def _class_counts(labels: DataFrame, cols: list) -> dict:
    """Rows of every class that occurs in each column: one aggregate, bounded by the plan."""
    each = labels.select(F.posexplode("cls").alias("at", "cls")).filter("cls is not null").groupBy("at", "cls").count()
    counts = {col: {} for col in cols}
    for r in each.collect():
        counts[cols[r["at"]]][r["cls"]] = r["count"]
    return counts


def _regression_gradient(flat: np.ndarray, x: np.ndarray, cls: np.ndarray, most: float = math.inf) -> tuple[float, np.ndarray]:
    """Cross-entropy (``most`` a row) and its gradient, summed over a block whose last column is ones; scores in single precision."""
    z = x @ flat.reshape(-1, x.shape[1]).T.astype(np.float32)
    z -= z.max(axis=1, keepdims=True)
    row = np.arange(len(cls))
    own = z[row, cls].astype(float)
    p = np.exp(z, out=z)
    total = p @ np.ones(p.shape[1], np.float32)
    p[row, cls] -= total
    return float(np.minimum(np.log(total.astype(float)) - own, most).sum()), (p.T @ (x / total[:, None])).ravel().astype(float)


def _regression_job(rows: DataFrame, scale: np.ndarray, inputs: dict, classes: dict, points: dict) -> dict:
    """Mean loss and mean gradient of each column's regression at its point: one job over the rows for all of them."""
    sc = rows.sparkSession.sparkContext
    at = {col: i for i, col in enumerate(classes)}
    shared = sc.broadcast((scale, inputs, classes, points))

    def partial(batches):
        scale, inputs, classes, points = shared.value
        sums, losses, n = {c: np.zeros(len(p)) for c, p in points.items()}, dict.fromkeys(points, 0.0), dict.fromkeys(points, 0)
        for whole in batches:
            for start in range(0, whole.num_rows, SCORED_ROWS):
                batch = whole.slice(start, SCORED_ROWS)
                x, cls = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("x", "cls"))
                x = np.hstack([x * scale, np.ones((len(x), 1))]).astype(np.float32)
                for col, flat in points.items():
                    number = np.minimum(np.searchsorted(classes[col], cls[:, at[col]]), len(classes[col]) - 1)
                    known = classes[col][number] == cls[:, at[col]]
                    own = x[np.ix_(known, [*inputs[col], -1])]
                    loss, grad = _regression_gradient(flat, own, number[known])
                    losses[col] += loss
                    sums[col] += grad
                    n[col] += int(known.sum())
        if any(n.values()):
            group = TaskContext.get().partitionId() % GRADIENT_GROUPS
            yield pa.RecordBatch.from_pydict({
                "col": pa.array(list(sums), pa.int32()),
                "part": pa.array([group] * len(sums), pa.int32()),
                "grad": pa.array(list(sums.values()), pa.list_(pa.float64())),
                "loss": pa.array(list(losses.values()), pa.float64()),
                "n": pa.array(list(n.values()), pa.int64()),
            })

    out = _added(rows.mapInArrow(partial, "col int, part int, grad array<double>, loss double, n long"))
    shared.destroy()
    return out


def _descent(point: np.ndarray, max_iter: int):
    """Limited-memory quasi-Newton steps: yields points, takes loss and gradient there, returns the last point.

    Steps are halved or lengthened until the loss has fallen enough and the slope has flattened.
    """
    loss, grad = yield point
    steps = []
    for _ in range(max_iter):
        way, weights = -grad, []
        for s, y in reversed(steps):
            weights.append((s @ way) / (s @ y))
            way = way - weights[-1] * y
        if steps:
            s, y = steps[-1]
            way = way * ((s @ y) / (y @ y))
        for (s, y), w in zip(steps, reversed(weights), strict=True):
            way = way + (w - (y @ way) / (s @ y)) * s
        slope = way @ grad
        if slope >= 0:
            way, slope, steps = -grad, -(grad @ grad), []
        if slope > -1e-14:
            break
        lo, hi, t, best = 0.0, None, 1.0 if steps else 1.0 / np.sqrt(-slope), None
        for _ in range(LINE_POINTS):
            tried = point + t * way
            its_loss, its_grad = yield tried
            if its_loss > loss + DECREASE * t * slope:
                hi = t
            else:
                if best is None or its_loss < best[1]:
                    best = tried, its_loss, its_grad
                if way @ its_grad >= CURVATURE * slope:
                    break
                lo = t
            if hi is not None:
                t = (lo + hi) / 2.0
            else:  # to where the slope would end if it went on flattening like this
                flatter = way @ its_grad - slope
                t *= min(max(-slope / flatter, 2.0), 50.0) if flatter > 0 else 2.0
        if best is None:
            break
        s, y = best[0] - point, best[2] - grad
        if s @ y > 0:
            steps = [*steps, (s, y)][-MEMORY:]
        gained = loss - best[1]
        point, loss, grad = best
        if gained <= TOLERANCE * max(abs(loss), 1e-12):
            break
    return point


def _fit_regressions(training: DataFrame, plan: ColumnPlan, labels: dict, max_iter: int = 20, reg: float = 0.0, classes: dict | None = None) -> dict:
    """Multinomial logistic regressions of several class columns, each on its visible inputs; rows of other classes are left out."""
    cols = list(labels)
    rows = training.select(F.slice("ctx", 1, plan.input_dim).alias("x"), F.array(*labels.values()).alias("cls"))
    counts = _class_counts(rows, cols)
    if classes is not None:
        counts = {c: {v: counts[c].get(v, 0) for v in classes[c]} for c in cols}
    heads, inputs = {}, {}
    for c, of in counts.items():
        if len(of) == 1:
            heads[c] = SoftmaxHead(np.array(list(of)), np.zeros((1, plan.input_dim)), np.zeros(1))
        else:
            inputs[c] = np.flatnonzero(np.array(plan.feature_mask(c)))
    if not inputs:
        return {c: heads[c] for c in cols}
    spread = rows.select(Summarizer.std(array_to_vector("x")).alias("s")).first()["s"].toArray()
    scale = np.divide(1.0, spread, out=np.zeros_like(spread), where=spread > 0)
    rows = rows.withColumn("cls", F.transform("cls", lambda v: F.coalesce(v, F.lit(NO_CLASS))))
    seen = {c: np.array(sorted(of), np.int64) for c, of in counts.items()}

    def penalty(c: int, flat: np.ndarray) -> tuple[float, np.ndarray]:
        # on the weights as they will be, not as they are scaled; the bias is free
        block = flat.reshape(len(seen[c]), -1)
        w = np.hstack([reg * block[:, :-1] * scale[inputs[c]] ** 2, np.zeros((len(block), 1))]).ravel()
        return 0.5 * float(w @ flat), w

    descents, points, ended = {}, {}, {}
    for c in inputs:
        share = np.log(np.maximum([counts[c][v] for v in seen[c].tolist()], 0.5))
        start = np.hstack([np.zeros((len(share), len(inputs[c]))), (share - share.mean())[:, None]]).ravel()
        descents[c] = _descent(start, max_iter)
        points[c] = next(descents[c])
    while points:
        found = _regression_job(rows, scale, inputs, seen, points)
        for c in list(points):
            loss, grad = found[c]
            more, pull = penalty(c, points[c]) if reg else (0.0, 0.0)
            try:
                points[c] = descents[c].send((loss + more, grad + pull))
            except StopIteration as end:
                ended[c] = end.value
                del points[c]
    for c, flat in ended.items():
        block = flat.reshape(len(seen[c]), -1)
        block = block - block.mean(axis=0)
        weights = np.zeros((len(block), plan.input_dim))
        weights[:, inputs[c]] = block[:, :-1] * scale[inputs[c]]
        heads[c] = SoftmaxHead(seen[c], weights, block[:, -1])
    return {c: heads[c] for c in cols}


def fit_discrete(
    training: DataFrame, plan: ColumnPlan, col: int, max_iter: int = 20, reg: float = 0.0, label_hook=None,
    classes: list | None = None,
) -> SoftmaxHead:
    """Multinomial logistic regression of one discrete column on its visible inputs.

    Only classes that occur get weights; there are at most as many as the plan declares.
    ``label_hook`` may turn the class column into another one before fitting.
    """
    label = class_label(plan, col)
    label = label_hook(label) if label_hook else label
    return _fit_regressions(training, plan, {col: label}, max_iter, reg, None if classes is None else {col: classes})[col]


def fit_all_discrete(training: DataFrame, plan: ColumnPlan, max_iter: int = 20, reg: float = 0.0) -> dict:
    """All discrete columns together: every pass over the table serves each of them."""
    return _fit_regressions(training, plan, {c: class_label(plan, c) for c in plan.discrete}, max_iter, reg)


def column_losses(windows: DataFrame, fitted: Fitted, binned: bool = True) -> DataFrame:
    """Mean loss of every column over all windows, in one job: (col, kind, loss, n).

    Mixtures are scored by bin or density, softmax heads by cross-entropy; a class the
    head never saw counts with the likelihood floor.
    """
    plan = fitted.plan
    shared = windows.sparkSession.sparkContext.broadcast(fitted)

    def score(batches):
        model = shared.value
        for batch in (b.slice(at, SCORED_ROWS) for b in batches for at in range(0, b.num_rows, SCORED_ROWS)):
            x, label = _block(batch, plan)
            cols, sums = [], []
            for col in plan.order:
                seen = x * np.array(plan.feature_mask(col))
                if col in model.mixtures:
                    loss = mixture.row_loss(model.mixtures[col], seen, label[:, col], plan.components, binned)
                elif col in model.heads:
                    head = model.heads[col]
                    cls = _classes(label, plan, col)
                    at = np.minimum(np.searchsorted(head.classes, cls), len(head.classes) - 1)
                    p = np.exp(head.log_probabilities(seen)[np.arange(len(cls)), at]) * (head.classes[at] == cls)
                    loss = -np.log(np.maximum(p, mixture.FLOOR))
                else:
                    continue
                cols.append(col)
                sums.append(float(loss.sum()))
            yield pa.RecordBatch.from_pydict({
                "col": pa.array(cols, pa.int32()),
                "loss": pa.array(sums, pa.float64()),
                "n": pa.array([len(x)] * len(cols), pa.int64()),
            })

    partials = windows.select("ctx", "label").mapInArrow(score, "col int, loss double, n long")
    kind = F.when(F.col("col").isin(list(plan.discrete)), "cross_entropy").otherwise(
        "binned_nll" if binned else "mixture_nll"
    )
    return partials.groupBy("col").agg((F.sum("loss") / F.sum("n")).alias("loss"), F.sum("n").alias("n")).select(
        "col", kind.alias("kind"), "loss", "n"
    )


def validate_loss(windows: DataFrame, fitted: Fitted, epoch: int = 0) -> DataFrame:
    """One row: epoch, seconds and the loss of each column."""
    start = time.time()
    cols = sorted(set(fitted.mixtures) | set(fitted.heads))
    losses = [F.max(F.when(F.col("col") == c, F.col("loss"))).alias(f"loss_{c}") for c in cols]
    row = column_losses(windows, fitted).agg(*losses).first()
    spark = windows.sparkSession
    schema = "epoch int, seconds double, " + ", ".join(f"loss_{c} double" for c in cols)
    return spark.createDataFrame([(epoch, time.time() - start, *row)], schema)


def fit_batches(
    windows: DataFrame, plan: ColumnPlan, epochs: int, batch_rows: int = BATCH_ROWS, seed: int = 0,
    key: str = "flow_id", path: str | None = None,
) -> tuple[Fitted, DataFrame]:
    """Fit all columns batch by batch; returns the model and the log, one row per epoch.

    ``path`` keeps the training table, the parameters of every epoch and the log; a fit that
    was ended there goes on after its last finished epoch.
    """
    path = path or shared_path(windows.sparkSession, "fit")
    store = FitStore(windows.sparkSession, path, tuple(sorted(plan.order)))
    training = training_table(windows, f"{path}/training", key, batch_rows)
    return fitted_from(plan, fit_columns(training, plan, epochs, store, seed=seed)), store.log()


def fit(windows: DataFrame, plan: ColumnPlan, epochs: int = 100, max_iter: int = 20, seed: int = 0,
        key: str = "flow_id", path: str | None = None) -> tuple[Fitted, DataFrame]:
    """Fit all columns on the whole table: one gradient step per epoch on densities, logistic regressions for classes."""
    path = path or shared_path(windows.sparkSession, "fit")
    store = FitStore(windows.sparkSession, path, tuple(sorted(plan.continuous)))
    training = training_table(windows, f"{path}/training", key)
    mixtures = fit_columns(training, plan, epochs, store, by_batch=False, seed=seed)
    return Fitted(plan, mixtures, fit_all_discrete(training.rows, plan, max_iter=max_iter)), store.log()


# --- stored parameters ------------------------------------------------------

PARAMETERS = "tag string, col int, kind string, name string, shape array<int>, data array<double>"


def save_models(spark: SparkSession, fitted: Fitted, path: str, tag: str) -> None:
    """Append one row per parameter block to a parquet table, partitioned by tag."""
    rows = [
        (tag, col, "mixture", "flat", [len(flat)], flat.tolist()) for col, flat in fitted.mixtures.items()
    ] + [
        (tag, col, "softmax", name, list(block.shape), block.astype(float).ravel().tolist())
        for col, head in fitted.heads.items()
        for name, block in (("classes", head.classes), ("weights", head.weights), ("bias", head.bias))
    ]
    spark.createDataFrame(rows, PARAMETERS).write.mode("append").partitionBy("tag").parquet(path)


def load_models(spark: SparkSession, plan: ColumnPlan, path: str, tag) -> Fitted:
    """Read the parameters of one tag, or of a tag per column given as a dict."""
    table = spark.read.schema(PARAMETERS).parquet(path)
    tags = {c: tag for c in plan.order} if isinstance(tag, str) else tag
    wanted = F.array(*[F.struct(F.lit(c).alias("col"), F.lit(t).alias("tag")) for c, t in tags.items()])
    rows = table.filter(F.col("tag").isin(sorted(set(tags.values())))).filter(
        F.array_contains(wanted, F.struct("col", "tag"))
    ).collect()
    blocks = {(r.col, r.name): np.array(r.data).reshape(r["shape"]) for r in rows}
    fitted = Fitted(plan)
    for col, name in blocks:
        if name == "flat":
            fitted.mixtures[col] = blocks[col, name]
        elif name == "classes":
            fitted.heads[col] = SoftmaxHead(
                blocks[col, "classes"].astype(int), blocks[col, "weights"], blocks[col, "bias"]
            )
    missing = set(tags) - set(fitted.mixtures) - set(fitted.heads)
    if missing:
        raise KeyError(f"no stored parameters for columns {sorted(missing)}")
    return fitted
