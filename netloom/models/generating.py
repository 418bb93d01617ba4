"""Sampling new rows from fitted models, many sequences side by side.

Rows follow from the rows before them, so a task advances the sequences of an Arrow batch in
step, one array operation for all of them.  A long request is cut into legs that run
independently: a leg after the first does not wait for the rows before it but starts behind a real
window drawn by hash from a pool, and, in a time span, at a fixed clock that the leg before ends at.
Every draw is a hash of seed, sequence, leg, step, column and attempt: results do not depend on
how legs are spread, and a rerun task repeats its draws.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom import config as cfg
from netloom.config import ColumnPlan
from netloom.models import mixture
from netloom.models.fitting import Fitted
from netloom.operators.codec import decode_flows, default_local_ip
from netloom.operators.sampling import sample_n

# Redraws of a value outside [0, 1] before it becomes 0.
REDRAWS = 11
# Rows a task holds before it hands them on.
FLUSH_ROWS = 20_000
# A clock that has not moved for so many steps stands still; it is reported, not cut.
STILL_STEPS = 100_000
# Legs that one task advances, rows and seconds of a leg, real windows of a pool, legs listed at a time.
TASK_SEQUENCES = 1_000
LEG_ROWS = 10_000
LEG_SECONDS = 86_400
POOL_WINDOWS = 4_096
LISTED = 100_000

GENERATED = "seq_id string, leg long, step long, row array<double>, cls array<int>"

_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]


def _scramble(x: np.ndarray) -> np.ndarray:
    x = x + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def draws(keys: np.ndarray, *counters: int) -> np.ndarray:
    """Uniform draws in (0, 1), one per key, a pure function of key and counters."""
    with np.errstate(over="ignore"):
        x = _scramble(keys.astype(np.uint64))
        for counter in counters:
            x = _scramble(x ^ np.uint64(counter & 0xFFFFFFFFFFFFFFFF))
    return ((x >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def normal_draws(keys: np.ndarray, *counters: int) -> np.ndarray:
    radius = np.sqrt(-2.0 * np.log(draws(keys, *counters, 1)))
    return radius * np.cos(2.0 * np.pi * draws(keys, *counters, 2))


def _draw_value(flat, x, components, keys, *counters):
    weights, mean, sd = mixture.mixture(flat, x, components)
    at = (weights.cumsum(axis=1) < draws(keys, *counters, 0)[:, None]).sum(axis=1)
    at = np.minimum(at, components - 1)
    row = np.arange(len(x))
    return mean[row, at] + sd[row, at] * normal_draws(keys, *counters)


def _draw_class(head, x, keys, *counters):
    p = np.exp(head.log_probabilities(x)).cumsum(axis=1)
    at = (p < draws(keys, *counters, 0)[:, None]).sum(axis=1)
    return head.classes[np.minimum(at, len(head.classes) - 1)]


def class_value(plan: ColumnPlan, col: int, cls: np.ndarray) -> np.ndarray:
    """A class as an input value, on the scale the encoder uses for that column."""
    count = plan.class_count(col)
    if col in plan.ports:
        middle = (cls - cfg.FIRST_USER_PORT) * cfg.PORT_CLASS_WIDTH + cfg.FIRST_USER_PORT + cfg.PORT_CLASS_WIDTH // 2
        return np.minimum(np.where(cls < cfg.FIRST_USER_PORT, cls, middle), cfg.PORT_MAX) / cfg.PORT_MAX
    return cls / max(count - 1, 1)


def _advance(fitted: Fitted, window, keys, seed, step, clock, until=None):
    """Fill the current row of every window in generation order; returns the classes drawn.

    With a ``clock`` column 0 is the hour it shows, column 1 advances it, and continuous
    values outside [0, 1] are drawn again; a clock that would pass ``until`` stops there.
    """
    plan = fitted.plan
    n = len(keys)
    classes = np.zeros((n, len(plan.discrete)), dtype=np.int32)
    for col in plan.order:
        x = window.reshape(n, -1)[:, : plan.input_dim] * np.array(plan.feature_mask(col))
        if col in fitted.heads:
            cls = _draw_class(fitted.heads[col], x, keys, seed, step, col)
            classes[:, plan.discrete.index(col)] = cls
            if col in plan.group_of:
                window[np.arange(n), -1, col + cls] = 1.0
            else:
                window[:, -1, col] = class_value(plan, col, cls)
            continue
        if clock is not None and col == 0:
            window[:, -1, 0] = np.floor(clock / 3600) / 24.0
            continue
        value = _draw_value(fitted.mixtures[col], x, plan.components, keys, seed, step, col, 0)
        if clock is not None:
            for attempt in range(1, REDRAWS + 1):
                again = (value < 0) | (value > 1)
                if not again.any():
                    break
                value[again] = _draw_value(
                    fitted.mixtures[col], x[again], plan.components, keys[again], seed, step, col, attempt
                )
            value[(value < 0) | (value > 1)] = 0.0
        if clock is not None and col == 1:
            left = until - clock
            # half a second more, so that the whole seconds come back from the scaled value
            value = np.where(np.floor(value * cfg.DELTA_MAX) > left, (left + 0.5) / cfg.DELTA_MAX, value)
            clock += np.floor(value * cfg.DELTA_MAX)
        window[:, -1, col] = value
    return classes


def _opening(pool, hours, keys, seed, legs, clock, shape):
    """Windows to start from: all zero for a first leg, else rows of a real window, of the clock's hour if there is one."""
    window = np.zeros(shape)
    for i in np.flatnonzero(legs > 0):
        at = np.flatnonzero(hours == int(clock[i] // 3600) % 24) if clock is not None else np.zeros(0, int)
        choices = at if len(at) else np.arange(len(pool))
        window[i, :-1] = pool[choices[int(draws(keys[i:i + 1], seed, -1)[0] * len(choices))]]
    return window


def _generator(shared, pool, seed: int, timed: bool, still_steps: int):
    def generate(batches):
        fitted = shared.value
        plan = fitted.plan
        real = pool.value if pool else None
        hours = np.floor(real[:, -1, 0] * 24 + 1e-6) % 24 if pool else None
        out, held = [], 0

        def flush():
            ids, legs, steps, rows, classes = (np.concatenate(part) for part in zip(*out))
            return pa.RecordBatch.from_pydict({
                "seq_id": pa.array(ids, pa.string()),
                "leg": pa.array(legs, pa.int64()),
                "step": pa.array(steps, pa.int64()),
                "row": pa.array(list(rows), pa.list_(pa.float64())),
                "cls": pa.array(list(classes), pa.list_(pa.int32())),
            })

        for batch in batches:
            ids = np.array(batch.column("seq_id").to_pylist(), dtype=object)
            keys, legs, start, limit, final = (
                batch.column(c).to_numpy(zero_copy_only=False) for c in ("seq_key", "leg", "start", "end", "final"))
            clock, mark = start.astype(float), np.full(len(ids), -1.0)
            limit, at = limit.astype(float), start.astype(np.int64) if not timed else np.zeros(len(ids), np.int64)
            until = np.where(final, np.inf, limit)
            window = _opening(real, hours, keys, seed, legs, clock if timed else None, (len(ids), plan.window + 1, plan.dim))
            step = 0
            while True:
                on = (clock if timed else at + step) < limit
                if not on.all():
                    ids, keys, legs, at, limit, until, clock, mark, window = (
                        a[on] for a in (ids, keys, legs, at, limit, until, clock, mark, window))
                if not len(ids):
                    break
                if timed and step % still_steps == 0:
                    if (clock <= mark).any():
                        raise RuntimeError(f"sequence {ids[clock <= mark][0]} does not reach its time span")
                    mark = clock.copy()
                classes = _advance(fitted, window, keys, seed, step, clock if timed else None, until)
                out.append((ids, legs, at + step, window[:, -1].copy(), classes))
                held += len(ids)
                if held >= FLUSH_ROWS:
                    yield flush()
                    out, held = [], 0
                window[:, :-1] = window[:, 1:].copy()
                window[:, -1] = 0.0
                step += 1
        if held:
            yield flush()

    return generate


def _legs(seqs: DataFrame, size: str, length: int | None, partitions: int | None) -> DataFrame:
    """``seq_id, leg, start, end, final, seq_key``: requests cut into legs of ``length`` (None: uncut), over all cores or more tasks."""
    asked = seqs.select(F.col("seq_id").cast("string").alias("seq_id"), F.col(size).cast("double").alias("size"))
    long = F.lit(float(length)) if length else F.greatest(F.col("size"), F.lit(1.0))
    count = F.greatest(F.ceil(F.col("size") / long), F.lit(1)).cast("long")
    # in two turns, so that no row holds the list of all legs of a very long request
    parts = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((count - 1) / LISTED))))
    first = F.col("part") * LISTED
    legs = parts.withColumn("leg", F.explode(F.sequence(first, F.least(count, first + LISTED) - 1)))
    cut = legs.select(
        "seq_id", "leg", (F.col("leg") * long).alias("start"), F.least(F.col("size"), (F.col("leg") + 1) * long).alias("end"),
        (F.col("leg") == count - 1).alias("final"),
        F.when(F.col("leg") == 0, F.xxhash64("seq_id")).otherwise(F.xxhash64("seq_id", "leg")).alias("seq_key"))
    n = partitions or max(seqs.sparkSession.sparkContext.defaultParallelism, -(-cut.count() // TASK_SEQUENCES))
    return cut.repartition(n, "seq_id", "leg")


def window_pool(windows: DataFrame, plan: ColumnPlan, n: int = POOL_WINDOWS, key: str = "flow_id", seed: int = 0) -> np.ndarray:
    """Rows of ``n`` real windows chosen by hash, for legs to start behind: a bounded sample, each the latest rows of one flow."""
    chosen = sample_n(windows.select(key, "ctx"), n, key, seed=seed).orderBy(key).select("ctx").toArrow()
    flat = np.array(chosen["ctx"].to_pylist(), float).reshape(-1, plan.window + 1, plan.dim)
    return flat[:, 1:]


def _sample(seqs, size, fitted, pool, length, seed, partitions, timed, still_steps=STILL_STEPS):
    sc = seqs.sparkSession.sparkContext
    usable = pool is not None and len(pool) > 0
    legs = _legs(seqs, size, length if usable else None, partitions)
    generate = _generator(sc.broadcast(fitted), sc.broadcast(pool) if usable else None, seed, timed, still_steps)
    return legs.mapInArrow(generate, GENERATED)


def sample_rows(
    seqs: DataFrame, fitted: Fitted, seed: int = 0, partitions: int | None = None, pool: np.ndarray | None = None,
    leg_rows: int = LEG_ROWS,
) -> DataFrame:
    """``rows`` generated rows for every ``seq_id``, numbered by ``step``, from an all-zero window on.

    With a ``pool`` of real windows every ``leg_rows`` rows are a leg of their own; without, a
    sequence is one task's work.
    """
    return _sample(seqs, "rows", fitted, pool, leg_rows, seed, partitions, timed=False)


def sample_time_span(
    seqs: DataFrame, fitted: Fitted, seed: int = 0, partitions: int | None = None, pool: np.ndarray | None = None,
    leg_seconds: int = LEG_SECONDS, still_steps: int = STILL_STEPS,
) -> DataFrame:
    """Rows for every ``seq_id`` until its summed deltas reach ``span`` seconds, in order of ``leg, step``.

    With a ``pool`` every ``leg_seconds`` whole seconds are a leg of their own, whose last row falls on
    its end; choose them long against the time between flows.
    """
    return _sample(seqs, "span", fitted, pool, leg_seconds, seed, partitions, timed=True, still_steps=still_steps)


def flow_columns(generated: DataFrame, plan: ColumnPlan) -> DataFrame:
    """Named encoded columns, and the port classes, of generated flow rows."""
    named = [F.col("row")[i].alias(n) for i, n in enumerate(cfg.ENCODED_COLUMNS)]
    port = {name: F.col("cls")[plan.discrete.index(col)].alias(name)
            for col, name in ((5, "lport_class"), (6, "rport_class"))}
    return generated.select("seq_id", "leg", "step", *named, *port.values())


def generate_flows(seqs: DataFrame, fitted: Fitted, seed: int = 0, pool: np.ndarray | None = None, leg_seconds: int = LEG_SECONDS) -> DataFrame:
    """Decoded flow records of every sequence; its address is ``this_ip`` or a default one."""
    rows = flow_columns(sample_time_span(seqs, fitted, seed, pool=pool, leg_seconds=leg_seconds), fitted.plan)
    return decode_flows(rows, default_local_ip(F.col("seq_id"), seed=seed), "seq_id", "leg", "step")


def generate_many_users(
    users: DataFrame, days: int, fitted: Fitted, span: float = 86_400.0, seed: int = 0, pool: np.ndarray | None = None,
    leg_seconds: int = LEG_SECONDS,
) -> DataFrame:
    """Flow records of every user for every day: one sequence per user and day, in legs with a ``pool``."""
    seqs = users.select(
        F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("day"), "user"
    ).select(F.concat_ws("|", "user", "day").alias("seq_id"), F.lit(span).alias("span"))
    rows = flow_columns(sample_time_span(seqs, fitted, seed, pool=pool, leg_seconds=leg_seconds), fitted.plan)
    user = F.expr("left(seq_id, length(seq_id) - length(substring_index(seq_id, '|', -1)) - 1)")
    flows = decode_flows(rows, user, "seq_id", "leg", "step")
    return flows.withColumns({
        "user": user,
        "day": F.substring_index("seq_id", "|", -1).cast("int"),
    }).drop("seq_id")


def artificial_series(series: DataFrame, weights: list[float], seed: int = 0, partitions: int | None = None) -> DataFrame:
    """Autoregressive series: ``rows`` rows for every ``seq_id``, one column per weight.

    Column 0 mixes its previous value with noise by the first weight (noise alone on the
    first row); every other column mixes the column before it with noise by its own.
    """
    def simulate(batches):
        for batch in batches:
            ids = np.array(batch.column("seq_id").to_pylist(), dtype=object)
            keys = batch.column("seq_key").to_numpy(zero_copy_only=False)
            limit = batch.column("end").to_numpy(zero_copy_only=False)
            last, step, out, held = np.zeros(len(ids)), 0, [], 0
            while len(ids):
                on = step < limit
                ids, keys, limit, last = ids[on], keys[on], limit[on], last[on]
                noise = [normal_draws(keys, seed, step, col) for col in range(len(weights))]
                value = noise[0] if step == 0 else weights[0] * last + (1 - weights[0]) * noise[0]
                columns = [value]
                for w, e in zip(weights[1:], noise[1:]):
                    columns.append(w * columns[-1] + (1 - w) * e)
                last = value
                out.append((ids, np.full(len(ids), step), np.stack(columns, axis=1)))
                held += len(ids)
                step += 1
                if held >= FLUSH_ROWS or not len(ids):
                    i, s, v = (np.concatenate(part) for part in zip(*out))
                    yield pa.RecordBatch.from_pydict({
                        "seq_id": pa.array(i, pa.string()), "step": pa.array(s, pa.int32()),
                        **{f"x{c}": pa.array(v[:, c], pa.float64()) for c in range(len(weights))},
                    })
                    out, held = [], 0

    schema = "seq_id string, step int, " + ", ".join(f"x{c} double" for c in range(len(weights)))
    return _legs(series, "rows", None, partitions).mapInArrow(simulate, schema)
