from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from netloom.llm import lm

from .brute import documents


def _tokens(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()


def _symbols(text, depth):
    data = b" " * depth + b"".join(t + b" " for t in _tokens(text)) + b"\n"
    return [(data[i - depth:i], data[i]) for i in range(depth, len(data))]


def _tree_scores(train, texts, depth):
    """log2 probabilities of texts by the textbook recursion: dictionaries of nodes, no shared tables."""
    counts = Counter()
    for pair, n in Counter(p for text in train for p in _symbols(text, depth)).items():
        ctx, byte = pair
        for d in range(depth + 1):
            for k in range(8):
                counts[ctx[depth - d:], (byte + 256) >> (8 - k), byte >> (7 - k) & 1] += n
    children = {}
    for ctx, node, _ in counts:
        if ctx:
            children.setdefault((ctx[1:], node), set()).add(ctx)

    def kt(ctx, node):
        a, b = counts[ctx, node, 0], counts[ctx, node, 1]
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    weighted = {}

    def pw(ctx, node):
        if (ctx, node) not in weighted:
            own = kt(ctx, node)
            if len(ctx) < depth:
                below = sum(pw(c, node) for c in children.get((ctx, node), ()))
                top = max(own, below)
                own = top + math.log(math.exp(own - top) + math.exp(below - top)) - math.log(2)
            weighted[ctx, node] = own
        return weighted[ctx, node]

    def predict(ctx, d, node, bit):
        part = ctx[depth - d:]
        a, b = counts[part, node, 0], counts[part, node, 1]
        own = ((b if bit else a) + .5) / (a + b + 1)
        if d == depth:
            return own
        w = math.exp(kt(part, node) - math.log(2) - pw(part, node))
        return w * own + (1 - w) * predict(ctx, d + 1, node, bit)

    made = {}

    def bits(ctx, byte):
        if (ctx, byte) not in made:
            made[ctx, byte] = sum(math.log2(predict(ctx, 0, (byte + 256) >> (8 - k), byte >> (7 - k) & 1)) for k in range(8))
        return made[ctx, byte]

    return [sum(bits(*p) for p in _symbols(t, depth)) for t in texts]


@pytest.mark.parametrize(("depth", "common", "pairs", "piece"), [(3, 5, 40, 100), (7, 200_000, 2_000_000, 2_000_000), (6, 0, 0, 7), (1, 9, 9, 50)])
def test_equals_textbook_tree(spark, monkeypatch, depth, common, pairs, piece):
    monkeypatch.setattr(lm, "COMMON", common)
    monkeypatch.setattr(lm, "COMMON_PAIRS", pairs)
    monkeypatch.setattr(lm, "PIECE", piece)
    monkeypatch.setattr(lm, "GROUP_PAIRS", max(50, pairs))
    rng = random.Random(depth)
    vocab = ["the", "The", "then", "é", "ouvre", "a", "ab", "abc", "thé", "x" * 30]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(0, 30))) for _ in range(30)] + [None, "", "\t\n", "unseen" + "q" * 9, "the " * 300]
    ids = [*range(len(texts) - 1), None]
    out = {r["doc_id"]: r for r in lm.lm_scores(documents(spark, list(zip(ids, texts))), depth).collect()}
    assert len(out) == len(texts)
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i in ids}
    train = Counter(t for i, x in zip(ids, texts) if not held[i] for t in [*_tokens(x), b"\n"])
    total, distinct = sum(train.values()), len(train)
    bits = _tree_scores([x for i, x in zip(ids, texts) if not held[i]], texts, depth)
    for i, x, b in zip(ids, texts, bits, strict=True):
        ts, r = [*_tokens(x), b"\n"], out[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ts), sum(t in train for t in ts), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[t] + .1) / (total + .1 * (distinct + 1))) for t in ts), rel=1e-9)
        assert r["score"] == pytest.approx(math.log10(2) * b, rel=1e-7)
        assert r["bits_per_byte"] == pytest.approx(-b / len(_symbols(x, depth)), rel=1e-7)


def test_word_order_counts(spark):
    learned = [(i, "red fox ran home") for i in range(100, 140)]
    rows = [*learned, (1, "red fox ran home"), (2, "home ran fox red")]
    out = {r["doc_id"]: r for r in lm.lm_scores(documents(spark, rows)).collect()}
    assert out[1]["base_score"] == pytest.approx(out[2]["base_score"]) and out[1]["score"] > out[2]["score"] + 1


def test_counts_are_passed_on_in_parts(spark, monkeypatch):
    rows = documents(spark, [(i, " ".join(f"w{j * 7 % 53}" for j in range(i, i + 90))) for i in range(60)])
    whole = {r["key"]: r["n"] for r in lm.pair_counts(rows, 4).collect()}
    for name, value in (("COUNTED_PAIRS", 50), ("TEXTS", 3), ("PIECE", 64)):
        monkeypatch.setattr(lm, name, value)
    assert {r["key"]: r["n"] for r in lm.pair_counts(rows, 4).collect()} == whole


def test_values_of_all_keys_and_no_others():
    rng = np.random.default_rng(5)
    keys = np.append(0, np.unique(rng.integers(-(1 << 62), 1 << 62, 5000)))
    values = lm._Values(keys[::2], np.arange(len(keys))[::2] / 4)
    assert [None if np.isnan(v) else v for v in values.of(keys)] == [i / 4 if i % 2 == 0 else None for i in range(len(keys))]
    assert np.isnan(lm._Values(keys[1:1], np.zeros(0)).of(keys)).all()


def test_probabilities_of_bytes_sum_to_one(spark):
    pairs = [(((0x202061 if d else 0x202020) << 8 | b), b % 7) for d in (0, 1) for b in range(256)]
    scores = lm.pair_scores(spark.createDataFrame(pairs, "key long, n long"), 3).collect()
    for ctx in (0x202061, 0x202020):
        assert sum(2 ** r["bits"] for r in scores if r["key"] >> 8 == ctx) == pytest.approx(1.0, abs=1e-9)


def test_untrained_and_empty(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    out = lm.lm_scores(documents(spark, [(i, "ab") for i in held])).collect()
    assert all(r["score"] == pytest.approx(-math.log10(2) * 8 * 4) and r["n_known"] == 0 and r["train_tokens"] == 0 for r in out)
    assert lm.lm_scores(documents(spark, [(1, "x")]).limit(0)).count() == 0
