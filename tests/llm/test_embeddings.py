from __future__ import annotations

import numpy as np
import pytest

from netloom.llm import embeddings

from .brute import classes


def _brute(rows, cosine=0.9):
    good = {}
    for i, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float32).astype(float)

    def linked(a, b):
        x, y = good.get(a), good.get(b)
        return x is not None and y is not None and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine

    n = [sum(linked(i, j) for j in range(len(rows)) if i != j) for i in range(len(rows))]
    return n, classes(range(len(rows)), linked)


def _world(seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8))
    vecs = [c + rng.normal(size=8) * spread for c in centres for _ in range(18)] + list(rng.normal(size=(60, 8)))
    vecs += [vecs[3]] * 5 + [vecs[3] * 2.5, -vecs[3]]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vecs)]
    n = len(rows)
    odd = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [1.0, 2.0], [1.0, 2.1]]
    return rows + [(n + i, v) for i, v in enumerate(odd)]


@pytest.mark.parametrize(("per_pivot", "block", "spread", "kind"), [(20, 16, 0.25, "float"), (4096, 4096, 0.3, "float"), (3, 5, 0.6, "float"), (20, 16, 0.25, "double")])
def test_equals_all_pairs(spark, monkeypatch, per_pivot, block, spread, kind):
    monkeypatch.setattr(embeddings, "PER_PIVOT", per_pivot)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = _world(per_pivot, spread)
    n, component = _brute(rows)
    out = embeddings.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(4)).collect()
    assert len(out) == len(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out} == {i: (n[i], component[i], component[i] == i) for i in range(len(rows))}
    assert any(n)


def test_bounds_exclude_far_cells(spark):
    d = np.array([[0.1, 1.4, 1.2], [1.3, 0.2, 0.9], [1.0, 0.9, 0.5]])
    cell, copy = embeddings._reached(d, np.array([0.0, 0.0, 0.0]), np.array([0.2, 0.6, 0.6]), 0.4)
    assert cell.tolist() == [0, 1, 2] and copy.tolist() == [[False] * 3, [False] * 3, [False, True, False]]


def test_doubles_are_compared_as_doubles(spark):
    # 0.9 lies between the two cosines; in single precision both components are the same number
    near, far = 0.9 + 1e-12, 0.9 - 1e-12
    rows = [(0, [1.0, 0.0])] + [(i, [c, np.sqrt(1 - c * c)]) for i, c in ((1, near), (2, far))]
    out = embeddings.near_duplicates(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"]: r["n_links"] for r in out} == {0: 1, 1: 2, 2: 1}
    whole = spark.createDataFrame([(0, [1, 0]), (1, [2, 0]), (2, [0, 5])], "vec_id long, embedding array<int>")
    assert {r["vec_id"]: r["component_id"] for r in embeddings.near_duplicates(whole).collect()} == {0: 0, 1: 0, 2: 2}


def test_repeated_and_null_ids(spark):
    rows = [(5, [1.0, 0.0]), (5, [1.0, 0.0]), (None, [1.0, 0.01]), (None, None), (7, [0.0, 1.0])]
    out = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in out) == [(0, 0, 0), (0, 2, 5), (5, 2, 5), (5, 2, 5), (7, 0, 7)]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(empty).count() == 0


def test_cells_are_divided_again(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "PER_PIVOT", 40)
    monkeypatch.setattr(embeddings, "BLOCK", 32)
    monkeypatch.setattr(embeddings, "FAN", 6)
    levels = []
    division = embeddings._division
    monkeypatch.setattr(embeddings, "_division", lambda rows, radius, level: levels.append(level) or division(rows, radius, level))
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 3))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 30] + rng.normal(size=3) * (0.02 if i % 7 else 0.2)]) for i in range(900)]
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.99
    seen, root = set(), {}
    for i in range(900):
        todo = [] if i in seen else [i]
        while todo:
            j = todo.pop()
            if j not in seen:
                seen.add(j)
                root[j] = i
                todo += np.flatnonzero(near[j]).tolist()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    out = embeddings.near_duplicates(df, 0.99).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out} == {i: (int(near[i].sum()) - 1, root[i]) for i in range(900)}
    assert len(levels) > 2
    cells = embeddings._cells(embeddings.classes(embeddings.with_class(df)), np.sqrt(0.02) + embeddings.SLACK)
    assert cells.filter("home").count() == 900 and cells.count() < 5 * 900


def test_no_cell_is_divided_in_vain(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "PER_PIVOT", 40)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(400)]
    cells = embeddings._cells(embeddings.classes(embeddings.with_class(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))), np.sqrt(0.2))
    assert cells.count() == 400
