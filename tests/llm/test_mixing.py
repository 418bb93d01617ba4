from __future__ import annotations

import random
import time
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from netloom.llm import mixing

from .brute import documents, words


def _targets(sizes, weights=(3, 1, 2), budget=1.5):
    """Resharing as told: by weight, capped at twice the size, the excess reshared among the others."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), budget * sum(sizes.values())
    while open_:
        unit = left / sum(w[s] for s in open_)
        over = {s for s in open_ if unit * w[s] > 2 * sizes[s]}
        if not over:
            target |= {s: unit * w[s] for s in open_}
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= 2 * sizes[s]
        open_ -= over
    return target


def test_fit_budget_is_as_near_as_any_choice_allows():
    rng = random.Random(2)
    for _ in range(200):
        lengths = rng.sample(range(1, 40), rng.randint(1, 5))
        counts = [rng.randint(1, 4) for _ in lengths]
        rest = rng.randint(0, sum(a * b for a, b in zip(lengths, counts)))
        taken = mixing.fit_budget(lengths, counts, rest)
        assert all(0 <= t <= c for t, c in zip(taken, counts))
        sums = {sum(a * b for a, b in zip(c, lengths)) for c in product(*(range(n + 1) for n in counts))}
        assert sum(a * b for a, b in zip(taken, lengths)) == max(s for s in sums if s <= rest)
    assert mixing.fit_budget([0, 5], [3, 2], 7) == [0, 1]


def test_fit_budget_of_a_large_histogram_is_exact():
    rng = random.Random(3)
    lengths = rng.sample(range(1, 20000), 3000)
    counts = [rng.randint(1, 1000) for _ in lengths]
    rest = sum(a * b for a, b in zip(lengths, counts)) // 3 + 1
    taken = mixing.fit_budget(lengths, counts, rest)
    assert all(0 <= t <= c for t, c in zip(taken, counts))
    assert sum(a * b for a, b in zip(taken, lengths)) == rest


def test_fit_budget_with_very_long_documents_is_bounded():
    rng = random.Random(5)
    lengths = sorted({rng.randint(1, 300_000) for _ in range(9_999)} | {1_000_000})
    counts = [rng.randint(1, 3) for _ in lengths]
    for share in (0.001, 0.37, 0.999):
        rest = int(sum(a * b for a, b in zip(lengths, counts)) * share)
        start = time.monotonic()
        taken = mixing.fit_budget(lengths, counts, rest)
        assert time.monotonic() - start < 20
        assert all(0 <= t <= c for t, c in zip(taken, counts))
        assert rest - sum(a * b for a, b in zip(lengths, taken)) == 0
    # only long ones: as many as fit
    assert mixing.fit_budget([400_000, 1_000_000], [3, 2], 1_900_000) == [2, 1]
    assert mixing.fit_budget([1_000_000], [1], 999_999) == [0]
    assert mixing.fit_budget([5, 1_000_000], [2, 1], 999_999) == [2, 0]


def _docs(n=600):
    rng = random.Random(4)
    names = ["hot", "b", "Z", "é", None, "tiny"]
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else rng.choice(names[:5])
        rows.append((i, " ".join(["w"] * rng.choice([0, 7, 7, 7, rng.randint(1, 90)])), "en", source))
    return [*rows, (n, "just three words", "en", "tiny"), (n + 1, None, "en", "tiny"), (n + 2, None, "en", "void")]


def test_targets_and_taken_words(spark):
    rows = _docs()
    docs = documents(spark, rows)
    out = mixing.mix_documents(docs).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want, source = _targets(sizes), {r[0]: r[3] for r in rows}
    text = {r[0]: r[1] for r in rows}
    assert len(out) == len(rows)
    taken = Counter()
    for r in out:
        assert r["size"] == len(words(text[r["doc_id"]])) and r["source_size"] == sizes[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[source[r["doc_id"]]] += r["taken"]
    longest = max(r["size"] for r in out)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1 or s == "tiny" and abs(taken[s] - want[s]) < longest
    again = mixing.mix_documents(docs.repartition(5)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


def test_the_mix_holds_each_document_as_often_as_taken(spark):
    docs = documents(spark, _docs(90)).withColumn("size", F.lit("x")).withColumn("row", F.lit("y")).withColumn("copies", F.lit(1))
    mix = mixing.mixed_documents(docs)
    assert mix.columns == docs.columns
    words_of = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix_documents(docs).collect()}
    got = Counter(r["doc_id"] for r in mix.collect())
    for doc, (size, taken) in words_of.items():
        if size:
            assert got[doc] * size == taken


def test_repeats_nulls_and_empty(spark):
    docs = documents(spark, [(1, "a b c", "en", "s")] * 5 + [(None, "d e", "en", "t"), (None, None, None, None)])
    out = mixing.mix_documents(docs).collect()
    assert len(out) == 7 and all(r["taken"] <= 2 * r["size"] for r in out)
    assert mixing.mix_documents(docs.limit(0)).count() == 0
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
    void = documents(spark, [(1, None, "en", "s"), (2, "", "en", None)])
    assert {r["taken"] for r in mixing.mix_documents(void).collect()} == {0}
