from __future__ import annotations

import math
import random
from collections import defaultdict
from itertools import product

import pytest

import corpus_pipeline
from netloom.llm import line_dedup, quality, simhash
from netloom.llm.queries import MODEL

from .brute import classes, documents, fingerprint, lines_left, words
from .brute import quality as counts
from .test_mixing import _targets

proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
library = pytest.importorskip("sentencepiece")

N_COPIES = 150


def _rows():
    """Rows ``(doc_id, text, lang, source)`` and labels: six sources of four texts, many copies of them, and what the rules reject."""
    rng = random.Random(21)
    vocab = [f"w{i}x" for i in range(500)]
    rows = []
    for i in range(24):
        text = [" ".join(rng.choices(vocab, k=rng.randint(28, 70))) for _ in range(2)]
        text.insert(rng.randint(0, 2), "all rights reserved by the owners")
        rows.append((i, "\n".join(text), "en", f"s{i % 6}"))
    rows += [(100 + k, *rng.choice(rows[:24])[1:]) for k in range(N_COPIES)]
    labels = [(r[0], 1, 0) for r in rows]
    noisy = [" ".join(w + "#" for w in rng.choices(vocab, k=60)) for _ in range(9)]
    rows += [(500 + k, text, "en", f"s{k % 6}") for k, text in enumerate(noisy)]
    labels += [(500 + k, 0, 0) for k in range(5)]
    rows += [(600, "too short", "en", "s0"), (601, None, "en", "s1"), (602, "same words here " * 30, "en", "s2"), (603, "", "en", None)]
    return rows, labels


def _plain(rows, labels):
    """``(doc_id, text)`` of the mix, stage by stage in the plainest way."""
    good = sum(q for _, q, _ in labels)
    assert (1 - quality.ALPHA) ** good <= quality.DELTA
    kept = []
    for r in rows:
        n, chars, symbols, dup, repeat = counts(r[1])
        # no good document is above the strictest cutoffs, so all of them hold
        strict = n >= 50 and 2 * repeat <= n and symbols <= 0.01 * chars and repeat <= 0.05 * n and 3.5 <= chars / n <= 8
        assert strict or (r[0], 1, 0) not in labels
        if strict:
            kept.append(r)
    texts = lines_left([(r[0], r[1], r[3]) for r in kept], line_dedup.MIN_SITES, line_dedup.MIN_WORDS)
    prints = {d: fingerprint(t, simhash.SHINGLE_WORDS) for d, t in texts.items()}
    root = classes(texts, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= simhash.MAX_BITS)
    left = sorted(d for d in texts if root[d] == d)
    source = {r[0]: r[3] for r in kept}
    groups = defaultdict(dict)
    for d in left:
        groups[source[d]][d] = len(words(texts[d]))
    out = []
    for s, target in _targets({s: sum(g.values()) for s, g in groups.items()}).items():
        sizes = list(groups[s].values())
        whole = math.floor(target / sum(sizes) + 1e-9)
        rest = math.floor(target - whole * sum(sizes) + 1e-9)
        sums = {}
        for choice in product((0, 1), repeat=len(sizes)):
            sums.setdefault(sum(a * b for a, b in zip(choice, sizes)), []).append(choice)
        best = sums[max(x for x in sums if x <= rest)]
        assert len(best) == 1  # the fixture leaves the seed no choice
        out += [(d, texts[d]) for d, more in zip(groups[s], best[0]) for _ in range(whole + more)]
    return out


def test_all_rows_equal_a_plain_version(spark, tmp_path):
    rows, labels = _rows()
    want = _plain(rows, labels)
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    model = proto.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = model.trainer_spec.UNIGRAM
    # the library adds scores in 32 bits; the pieces of blanks at -1e9 would swallow all others
    for p in model.pieces:
        p.score = max(p.score, -40000.0)
    pieces = library.SentencePieceProcessor(model_proto=model.SerializeToString())
    got = [(r["doc_id"], r["n_tokens"], list(r["ids"]), r["round_trip"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((d, len(ids := pieces.encode(t)), ids, True) for d, t in want)
    assert len({d for d, _ in want}) < len(want)
