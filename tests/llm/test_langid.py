from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.llm import langid

from .brute import documents

SYLLABLES = {"aa": ["ka", "to", "mi", "ren", "shi"], "bb": ["sch", "ung", "ver", "ö", "keit"], "cc": ["ère", "eau", "tion", "ç", "qu"]}


def _all_paths(scores, moves):
    """Probability of every labelling of one short sequence."""
    n, labels = scores.shape
    odds = {p: np.exp(sum(scores[i, y] for i, y in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:])))
            for p in itertools.product(range(labels), repeat=n)}
    total = sum(odds.values())
    return {p: o / total for p, o in odds.items()}


def test_marginals_equal_all_paths():
    rng = np.random.default_rng(1)
    moves = rng.normal(size=(3, 3))
    sizes = np.array([1, 4, 0, 6, 2])
    scores = rng.normal(size=(sizes.sum(), 3)) * 3
    got, at = langid.marginals(scores, sizes, moves), 0
    for n in sizes:
        paths = _all_paths(scores[at: at + n], moves) if n else {}
        for i in range(n):
            for y in range(3):
                assert got[at + i, y] == pytest.approx(sum(p for path, p in paths.items() if path[i] == y), abs=1e-12)
        at += n


def test_chunks_pass_messages_exactly(monkeypatch):
    rng = np.random.default_rng(2)
    moves = rng.normal(size=(4, 4)) * 2
    sizes = np.array([700, 1, 32, 33, 64, 0, 65, 5])
    scores = rng.normal(size=(sizes.sum(), 4)) * 2
    parts = langid.marginals(scores, sizes, moves)
    monkeypatch.setattr(langid, "CHUNK", 1_000)
    assert np.allclose(parts, langid.marginals(scores, sizes, moves), atol=1e-10)


def test_gradient_equals_differences():
    rng = np.random.default_rng(3)
    sizes = np.array([3, 1, 5])
    scores, moves = rng.normal(size=(9, 3)), rng.normal(size=(3, 3))
    truth = rng.integers(0, 3, 9)
    loss, by_score, by_move = langid.loss_and_gradient(scores, truth, sizes, moves)
    at, want = 0, 0.0
    for n in sizes:
        want -= np.log(_all_paths(scores[at: at + n], moves)[tuple(truth[at: at + n])])
        at += n
    assert loss == pytest.approx(want)
    for array, grad in ((scores, by_score), (moves, by_move)):
        for i in np.ndindex(array.shape):
            array[i] += 1e-6
            up = langid.loss_and_gradient(scores, truth, sizes, moves)[0]
            array[i] -= 2e-6
            down = langid.loss_and_gradient(scores, truth, sizes, moves)[0]
            array[i] += 1e-6
            assert grad[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def _plain_grams(word):
    out = [("letter", c) for c in word]
    for n in (1, 2, 3):
        if n <= len(word):
            out += [("prefix", word[:n]), ("suffix", word[-n:])]
    for n in (2, 3):
        out += [("inner", word[i: i + n]) for i in range(len(word) - n + 1)]
    return out


def test_every_word_has_its_features():
    distinct = ["a", "ab", "wörter", "日本語", "abcab"]
    grams = langid._grams(distinct)
    rows = {}
    for found, owners in zip(grams.rows, grams.owners):
        for row, owner in zip(found.tolist(), owners.tolist()):
            rows.setdefault(distinct[owner], []).append(row)
    assert {w: len(r) for w, r in rows.items()} == {w: len(_plain_grams(w)) for w in distinct}
    assert set(rows["a"]) & set(rows["ab"])  # a letter and a prefix in common


def _texts(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        out.append((i, " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(1, 60))) + ".", lang))
    return out


def test_held_out_accuracy_and_defined_cases(spark):
    rows = _texts(1, 300)
    rows += [(300, None, "aa"), (301, "", "bb"), (302, "12 34 --- !", "cc"), (303, "kato miren " * 40_000, None), (None, "schung verkeit", "bb"),
             (304, "schung" * 50_000, None), (7, rows[7][1], rows[7][2])]
    table = documents(spark, rows).withColumn("found", F.lit("own")).withColumn("lang_pred", F.lit("own"))
    out = langid.predicted_languages(table, sample=400, steps=10)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r for r in got}
    truth = {r[0]: r[2] for r in rows[:300]}
    kept = [d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    assert {d for d in truth if by_id[d]["held_out"]} == set(kept)
    assert sum(by_id[d]["lang_pred"] == truth[d] for d in kept) >= 0.97 * len(kept)
    assert [(by_id[d]["lang_pred"], by_id[d]["score"]) for d in (300, 301, 302)] == [("und", 0.0)] * 3
    assert by_id[303]["lang_pred"] == "aa" and by_id[304]["lang_pred"] == "bb"
    assert by_id[None]["held_out"] and by_id[None]["lang_pred"] == "bb"


def test_words_of_code_switched_text_are_labelled(spark):
    model = langid.learn(documents(spark, _texts(2, 200)), sample=400, steps=10)
    text = "Kato miren shito kami. Schverung keitöver ungsch, tionère eauçère qution eau"
    runs = documents(spark, [(1, text), (2, None)]).select("doc_id", langid.language_runs(spark, F.col("text"), model).alias("runs")).collect()
    by_id = {r["doc_id"]: r["runs"] for r in runs}
    assert [(r["lang"], r["words"], text[r["start"]: r["end"]].split()[0]) for r in by_id[1]] == [("aa", 4, "Kato"), ("bb", 3, "Schverung"), ("cc", 4, "tionère")]
    assert by_id[2] == []
    assert model.moves.diagonal().mean() > model.moves.mean()


def test_nothing_to_learn_from(spark):
    rows = documents(spark, [(1, "some words", None), (2, None, "aa")])
    assert {(r["lang_pred"], r["score"]) for r in langid.predicted_languages(rows).collect()} == {("und", 0.0)}
    assert langid.predicted_languages(rows.limit(0)).count() == 0
