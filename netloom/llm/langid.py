"""Language identification by a linear-chain conditional random field over words (operator 13).

Every word of a text, a run of letters, is labelled with a language.  Its evidence is the sum of
learned weights of its features: letters, prefixes and suffixes of up to three, n-grams inside, all hashed to
``FEATURES`` rows, and what the lexicon says of it.  The lexicon counts all words of all training
documents by language in ``LEXICON`` hashed cells, so its size is fixed.  Learned transitions tie neighbouring
words; forward-backward gives each word's probability of each language, and a document's language
is the one with the largest sum over its letters.

Weights are fitted on a bounded sample: ``SAMPLE`` segments of 4 to 15 words per language are expected, taken by
hash from all over the training texts, and about four of different documents follow each other in a
training sequence, so that transitions are learned from switches.  Each step is one Spark job; each of its
``TASKS`` tasks adds up gradients and hands the driver one array of the fixed size of the weights.  In training, a word's own
occurrence is taken out of the lexicon.

Long texts are cut into chunks of words: the product of a chunk's transitions says what passes
through it, so messages cross chunk by chunk and all chunks of a batch are run at once, which is exact.
A run of letters longer than ``WORD`` is read as several words.

Null texts and texts without a letter, and all texts if there is nothing to learn from, are ``und`` with
score 0; equal sums go to the language that is first by code point; at most ``LANGUAGES`` languages are learned, those
with most training documents; a null ``doc_id`` is held out; repeated rows give repeated results; empty
tables give empty results; other columns are neither read nor changed.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.session import materialize

#: Bounds of the classifier: languages, hashed features, lexicon cells, training segments expected per language.
LANGUAGES, FEATURES, LEXICON, SAMPLE = 64, 1 << 16, 1 << 18, 6_000
#: Words of a segment (least, and how many more), segments in a training sequence, letters of a word, words of a chunk.
SHORT, LONGER, SEQUENCE, WORD, CHUNK = 4, 12, 4, 32, 32
#: Gradient steps, their rate and decay constants, weight of the squared weights in the loss.
STEPS, RATE, DECAY_1, DECAY_2, GUARD, SHRINK = 15, 0.3, 0.9, 0.99, 1e-8, 1e-5
#: Tasks of a gradient job (the sample is bounded) and weights in a block of a gradient.
TASKS, BLOCK = 8, 1 << 14
#: Letters of texts that are worked on together.
TEXT_CHARS = 1 << 20
#: Steps in which the lexicon's certainty of its first language is told apart.
BINS = 5
UNKNOWN = "und"

_LETTERS = re.compile(rf"[^\W\d_]{{1,{WORD}}}")


def held_out(doc_id: Column, parts: int = 5) -> Column:
    """Whether a document is kept from training: the CRC-32 of its id as text divides by ``parts``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == 0


def words(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def _cell(word: str, cells: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % cells


@dataclass
class Model:
    """Languages, lexicon counts ``(cells, languages)``, weights ``(features, languages)``, transitions."""

    languages: list[str]
    lexicon: np.ndarray
    weights: np.ndarray
    moves: np.ndarray


def feature_rows(languages: int) -> int:
    return FEATURES + BINS * languages + 1


# --- features ---------------------------------------------------------------

@dataclass
class _Grams:
    """Hashed rows of the letter features of some words, one array per kind, with the word of each."""

    rows: list[np.ndarray]
    owners: list[np.ndarray]


def _grams(distinct: list[str]) -> _Grams:
    """Letters, prefixes and suffixes of 1 to 3, inner 2- and 3-grams; a gap stands before and after each word."""
    text = np.frombuffer(("\n" + "\n".join(distinct) + "\n").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    gap = text == 10
    owner = np.cumsum(gap) - 1
    rows, owners = [], []
    state = np.zeros(len(text), np.uint64)
    for n in range(1, 5):
        state = (state[: len(text) - n + 1] * np.uint64(0x9E3779B97F4A7C15)) ^ (text[n - 1:] + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)
        state ^= state >> np.uint64(29)
        first, last = gap[: len(text) - n + 1], gap[n - 1:]
        inner = np.zeros(len(state), bool)
        for k in range(1, n - 1):
            inner |= gap[k: len(text) - n + 1 + k]
        # a window of four holds a prefix or suffix of three; longer inner grams are left out
        use = ~inner & ~(first & last) & ((first | last) if n == 4 else True)
        if n == 1:
            use = ~gap
        at = np.flatnonzero(use)
        rows.append((state[at] >> np.uint64(20)).astype(np.int64) % FEATURES)
        # a window that begins with a gap belongs to the word behind it
        owners.append(owner[at])
    return _Grams(rows, owners)


def _lexicon_rows(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Feature row of lexicon counts ``(words, languages)``: the likeliest language and how sure it is, or unseen."""
    languages = counts.shape[1]
    seen = counts.sum(axis=1) > 0
    rate = counts / np.maximum(totals, 1)
    share = rate / np.maximum(rate.sum(axis=1, keepdims=True), 1e-300)
    best = share.argmax(axis=1)
    # at one share above an even one, then halfway to certainty, and so on
    doubt = np.clip(1.0 - share[np.arange(len(best)), best], 1e-9, 1.0)
    step = np.clip(-np.log2(doubt), 0, BINS - 1).astype(np.int64)
    row = FEATURES + best * BINS + step
    return np.where(seen, row, FEATURES + BINS * languages)


def _gathered(weights: np.ndarray, grams: _Grams, n: int) -> np.ndarray:
    """Summed weights of the letter features of each of ``n`` words."""
    out = np.zeros((n, weights.shape[1]))
    for rows, owners in zip(grams.rows, grams.owners):
        if len(rows):
            starts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
            out[owners[starts]] += np.add.reduceat(weights[rows], starts, axis=0)
    return out


def _numbered(found: list[str]) -> tuple[list[str], np.ndarray]:
    """Distinct words and the number of each word among them."""
    number: dict[str, int] = {}
    at = np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, len(found))
    return list(number), at


def evidence(model: Model, found: list[str]) -> np.ndarray:
    """Summed weights of every word, ``(words, languages)``."""
    distinct, at = _numbered(found)
    out = _gathered(model.weights, _grams(distinct), len(distinct))
    cells = np.fromiter((_cell(w, len(model.lexicon)) for w in distinct), np.int64, len(distinct))
    out += model.weights[_lexicon_rows(model.lexicon[cells], model.lexicon.sum(axis=0))]
    return out[at]


# --- forward-backward -------------------------------------------------------

def _scaled(x: np.ndarray) -> np.ndarray:
    """Each vector (or matrix) over its sum."""
    axes = tuple(range(1, x.ndim))
    return x / x.sum(axis=axes, keepdims=True)


def marginals(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Probability of each label for each word of sequences that lie one behind the other in ``scores``."""
    labels = scores.shape[1]
    if not len(scores):
        return np.zeros((0, labels))
    step = np.exp(moves - moves.max())
    odds = np.exp(scores - scores.max(axis=1, keepdims=True))
    sizes = sizes[sizes > 0]
    chunks = -(-sizes // CHUNK)
    total = int(chunks.sum())
    owner = np.repeat(np.arange(len(sizes)), chunks)
    nth = np.arange(total) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    start = np.repeat(np.cumsum(sizes) - sizes, chunks) + nth * CHUNK
    length = np.minimum(CHUNK, sizes[owner] - nth * CHUNK)
    place = start[:, None] + np.arange(CHUNK)
    inside = np.arange(CHUNK) < length[:, None]
    psi = odds[np.where(inside, place, 0)]
    opening = nth == 0

    # what a chunk of a longer sequence passes on, from the label before it to its last label
    enter, leave = np.full((total, labels), 1.0 / labels), np.full((total, labels), 1.0 / labels)
    joined = np.flatnonzero(np.repeat(chunks > 1, chunks))
    if len(joined):
        through = np.repeat(np.eye(labels)[None], len(joined), axis=0)
        for t in range(CHUNK):
            on = inside[joined, t]
            moved = through @ step
            if t == 0:
                moved[opening[joined]] = np.eye(labels)
            through = np.where(on[:, None, None], _scaled(moved * psi[joined, t][:, None, :]), through)
        at = np.full(total, -1)
        at[joined] = np.arange(len(joined))
        by_nth = np.argsort(nth[joined], kind="stable")
        levels = np.split(joined[by_nth], np.flatnonzero(np.diff(nth[joined][by_nth])) + 1)
        for level in levels:
            go_on = level[nth[level] + 1 < chunks[owner[level]]]
            enter[go_on + 1] = _scaled(np.einsum("cl,clm->cm", enter[go_on], through[at[go_on]]))
        for level in reversed(levels):
            back = level[nth[level] > 0]
            leave[back - 1] = _scaled(np.einsum("clm,cm->cl", through[at[back]], leave[back]))

    forward = np.empty_like(psi)
    alpha = enter
    for t in range(CHUNK):
        moved = alpha @ step
        if t == 0:
            moved[opening] = 1.0
        alpha = np.where(inside[:, t][:, None], _scaled(moved * psi[:, t]), alpha)
        forward[:, t] = alpha
    beta = leave
    for t in reversed(range(CHUNK)):
        on = inside[:, t][:, None]
        forward[:, t] *= np.where(on, beta, 1.0)
        beta = np.where(on, _scaled((psi[:, t] * beta) @ step.T), beta)
    out = forward[inside]
    return out / out.sum(axis=1, keepdims=True)


def loss_and_gradient(scores: np.ndarray, truth: np.ndarray, sizes: np.ndarray, moves: np.ndarray):
    """Negative log likelihood of labelled sequences, its gradient by word scores and by transitions."""
    labels = scores.shape[1]
    longest = int(sizes.max())
    inside = np.arange(longest) < sizes[:, None]
    place = (np.cumsum(sizes) - sizes)[:, None] + np.arange(longest)
    place = np.where(inside, place, 0)
    psi_log, y = scores[place], truth[place]
    top = psi_log.max(axis=2, keepdims=True)
    psi = np.exp(psi_log - top)
    high = moves.max()
    step = np.exp(moves - high)
    alphas, logs = [], np.zeros(len(sizes))
    alpha = None
    for t in range(longest):
        now = psi[:, t] if t == 0 else (alpha @ step) * psi[:, t]
        norm = now.sum(axis=1, keepdims=True)
        on = inside[:, t]
        logs += np.where(on, np.log(norm[:, 0]) + top[:, t, 0] + (high if t else 0.0), 0.0)
        alpha = np.where(on[:, None], now / norm, alpha if t else now / norm)
        alphas.append(alpha)
    gold = np.take_along_axis(psi_log, y[:, :, None], 2)[:, :, 0]
    loss = float(logs.sum() - gold[inside].sum())
    both = inside[:, 1:]
    loss -= float(moves[y[:, :-1], y[:, 1:]][both].sum())
    by_score = np.empty_like(psi)
    by_move = np.zeros_like(moves)
    beta = np.full((len(sizes), labels), 1.0 / labels)
    for t in reversed(range(longest)):
        p = alphas[t] * beta
        by_score[:, t] = p / p.sum(axis=1, keepdims=True)
        if t:
            ahead = psi[:, t] * beta
            pair = alphas[t - 1][:, :, None] * step * ahead[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            by_move += pair[inside[:, t]].sum(axis=0)
            beta = np.where(inside[:, t][:, None], _scaled(ahead @ step.T), beta)
    np.add.at(by_move, (y[:, :-1][both], y[:, 1:][both]), -1.0)
    out = np.zeros_like(scores)
    out[place[inside]] = by_score[inside]
    out[np.arange(len(truth)), truth] -= 1.0
    return loss, out, by_move


# --- fitting ----------------------------------------------------------------

def lexicon(training: DataFrame, languages: list[str], cells: int = LEXICON) -> np.ndarray:
    """Words of all training texts ``(text, label)`` by hashed cell and language, ``(cells, languages)``."""
    def count(batches):
        total = np.zeros((len(languages), cells), np.int64)
        for batch in batches:
            seen: dict[int, Counter] = {}
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                seen.setdefault(label, Counter()).update(words(text))
            for label, counts in seen.items():
                at = np.fromiter((_cell(w, cells) for w in counts), np.int64, len(counts))
                np.add.at(total[label], at, np.fromiter(counts.values(), np.int64, len(counts)))
        label, cell = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({
            "label": pa.array(label, pa.int32()), "cell": pa.array(cell, pa.int32()), "n": pa.array(total[label, cell], pa.int64())})

    sums = training.select("text", "label").mapInArrow(count, "label int, cell int, n long").groupBy("label", "cell").agg(F.sum("n").alias("n"))
    rows = sums.toArrow()
    out = np.zeros((cells, len(languages)), np.int64)
    out[rows["cell"].to_numpy(), rows["label"].to_numpy()] = rows["n"].to_numpy()
    return out


def training_sequences(training: DataFrame, rates: list[float], sample: int = SAMPLE) -> DataFrame:
    """Sequences of hash-chosen segments of the training texts: ``found`` (words, blank between), ``labels`` (one per word)."""
    def cut(batches):
        for batch in batches:
            keys, labels, segments = [], [], []
            for doc, text, label in zip(*(batch.column(c).to_pylist() for c in ("name", "text", "label"))):
                found = words(text)
                at = nth = 0
                while at < len(found):
                    h = zlib.crc32(f"{doc}:{nth}".encode())
                    size = SHORT + h % LONGER
                    mix = zlib.crc32(f"{nth}:{doc}".encode())
                    if mix < rates[label] * 4294967296:
                        keys.append(h)
                        labels.append(label)
                        segments.append(" ".join(found[at: at + size]))
                    at += size
                    nth += 1
            yield pa.RecordBatch.from_pydict({
                "h": pa.array(keys, pa.int64()), "label": pa.array(labels, pa.int32()), "found": pa.array(segments, pa.string())})

    named = training.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), "text", "label")
    segments = named.mapInArrow(cut, "h long, label int, found string")
    sequences = max(1, sample * len(rates) // SEQUENCE)
    whole = F.array_sort(F.collect_list(F.struct("h", "label", "found")))
    return segments.groupBy(F.pmod("h", F.lit(sequences)).alias("seq")).agg(whole.alias("parts")).select(
        "seq", F.col("parts.label").alias("labels"), F.col("parts.found").alias("found"))


def _gradient_job(sequences: DataFrame, model: Model) -> tuple[float, int, np.ndarray, np.ndarray]:
    """Loss, words and gradients over all training sequences: one job."""
    shared = sequences.sparkSession.sparkContext.broadcast(model)
    rows, labels = model.weights.shape
    length = rows * labels + labels * labels
    blocks = -(-length // BLOCK)

    def partial(batches):
        model = shared.value
        flat, loss, n = np.zeros(blocks * BLOCK), 0.0, 0
        for batch in batches:
            found, truth, sizes = [], [], []
            for parts, marks in zip(batch.column("found").to_pylist(), batch.column("labels").to_pylist()):
                split = [p.split() for p in parts]
                found += [w for p in split for w in p]
                truth += [m for p, m in zip(split, marks) for _ in p]
                sizes.append(sum(map(len, split)))
            if not found:
                continue
            truth, sizes = np.array(truth), np.array(sizes)
            distinct, at = _numbered(found)
            grams = _grams(distinct)
            scores = _gathered(model.weights, grams, len(distinct))[at]
            cells = np.fromiter((_cell(w, len(model.lexicon)) for w in distinct), np.int64, len(distinct))
            counts = model.lexicon[cells][at].astype(float)
            counts[np.arange(len(at)), truth] -= 1  # without this occurrence
            known = _lexicon_rows(np.maximum(counts, 0), model.lexicon.sum(axis=0))
            scores += model.weights[known]
            part, by_score, by_move = loss_and_gradient(scores, truth, sizes, model.moves)
            loss += part
            n += len(found)
            grad = flat[: rows * labels].reshape(rows, labels)
            for label in range(labels):
                per_word = np.bincount(at, by_score[:, label], minlength=len(distinct))
                for row, owner in zip(grams.rows, grams.owners):
                    grad[:, label] += np.bincount(row, per_word[owner], minlength=rows)
                grad[:, label] += np.bincount(known, by_score[:, label], minlength=rows)
            flat[rows * labels: length] += by_move.ravel()
        yield pa.RecordBatch.from_pydict({
            "block": pa.array(range(blocks), pa.int32()), "grad": pa.array(list(flat.reshape(blocks, BLOCK)), pa.list_(pa.float64())),
            "loss": pa.array([loss] + [0.0] * (blocks - 1), pa.float64()), "n": pa.array([n] + [0] * (blocks - 1), pa.int64())})

    sums = sequences.mapInArrow(partial, "block int, grad array<double>, loss double, n long").toArrow()
    flat = np.zeros((blocks, BLOCK))
    np.add.at(flat, sums["block"].to_numpy(), np.vstack(sums["grad"].to_numpy()))
    flat = flat.ravel()
    shared.unpersist()
    return sum(sums["loss"].to_pylist()), sum(sums["n"].to_pylist()), flat[: rows * labels].reshape(rows, labels), flat[rows * labels: length].reshape(labels, labels)


def learn(docs: DataFrame, sample: int = SAMPLE, steps: int = STEPS) -> Model | None:
    """The model of ``(doc_id, text, lang)`` rows: every non-null ``lang`` is a label; None if there is no word to learn from."""
    labelled = docs.filter("lang is not null").select("doc_id", "text", "lang")
    common = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    languages = sorted(r["lang"] for r in common)
    if not languages:
        return None
    number = F.create_map(*[x for i, name in enumerate(languages) for x in (F.lit(name), F.lit(i))])
    training = labelled.select("doc_id", "text", number[F.col("lang")].alias("label")).filter("label is not null")
    counts = lexicon(training, languages)
    totals = counts.sum(axis=0)
    if not totals.sum():
        return None
    middle = SHORT + (LONGER - 1) / 2
    rates = [min(1.0, sample * middle / n) if n else 0.0 for n in totals.tolist()]
    sequences = materialize(training_sequences(training, rates, sample).repartition(TASKS))
    model = Model(languages, counts, np.zeros((feature_rows(len(languages)), len(languages))), np.zeros((len(languages),) * 2))
    first, second = [0.0, 0.0], [0.0, 0.0]
    for step in range(1, steps + 1):
        _, n, *grads = _gradient_job(sequences, model)
        for i, (name, grad) in enumerate(zip(("weights", "moves"), grads)):
            value = getattr(model, name)
            grad = grad / max(n, 1) + SHRINK * value
            first[i] = DECAY_1 * first[i] + (1 - DECAY_1) * grad
            second[i] = DECAY_2 * second[i] + (1 - DECAY_2) * grad * grad
            move = first[i] / (1 - DECAY_1**step) / (np.sqrt(second[i] / (1 - DECAY_2**step)) + GUARD)
            setattr(model, name, value - RATE * move)
    return model


# --- use --------------------------------------------------------------------

def _groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t) if t else 0
        if held >= TEXT_CHARS:
            yield group
            group, held = [], 0
    if group:
        yield group


def _identified(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    names, scores = [], []
    for group in _groups(texts):
        found = [words(t) for t in group]
        sizes = np.array([len(f) for f in found])
        flat = [w for f in found for w in f]
        share = marginals(evidence(model, flat), sizes, model.moves) if flat else np.zeros((0, len(model.languages)))
        share *= np.fromiter(map(len, flat), np.int64, len(flat))[:, None]
        ends = np.cumsum(sizes)
        for size, end in zip(sizes.tolist(), ends.tolist()):
            if not size:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            total = share[end - size: end].sum(axis=0)
            best = int(total.argmax())
            names.append(model.languages[best])
            scores.append(float(min(1.0, total[best] / total.sum())))
    return names, scores


def identified(spark: SparkSession, text: Column, model: Model | None) -> Column:
    """``lang_pred, score`` of a text as a struct, from the text alone."""
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, scores = _identified(shared.value, [t if isinstance(t, str) else None for t in batch])
            yield pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": pd.Series(scores, dtype=float)})

    return identify(text)


def _runs_of(model: Model, text: str | None) -> list[dict]:
    spans = [(m.start(), m.end()) for m in _LETTERS.finditer(text or "")]
    if not spans:
        return []
    found = [text[a:b].lower() for a, b in spans]
    label = marginals(evidence(model, found), np.array([len(found)]), model.moves).argmax(axis=1)
    firsts = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
    lasts = np.r_[firsts[1:], len(label)] - 1
    return [{"lang": model.languages[label[a]], "start": spans[a][0], "end": spans[b][1], "words": int(b - a + 1)}
            for a, b in zip(firsts, lasts)]


def language_runs(spark: SparkSession, text: Column, model: Model) -> Column:
    """The runs of words of one language: ``array<struct<lang, start, end, words>>``, code points, end exclusive."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<lang:string,start:long,end:long,words:long>>")
    def runs(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([_runs_of(shared.value, t if isinstance(t, str) else None) for t in batch], dtype=object)

    return runs(text)


def predicted_languages(docs: DataFrame, sample: int = SAMPLE, steps: int = STEPS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document, learned from those that are not held out."""
    out = held_out(F.col("doc_id"))
    model = learn(docs.filter(~out), sample, steps)
    found = identified(docs.sparkSession, F.col("text"), model)
    return docs.select("doc_id", out.alias("held_out"), found.alias("found")).select("doc_id", "held_out", "found.*")
