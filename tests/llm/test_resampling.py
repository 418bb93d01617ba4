from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from netloom.llm import resampling

from .brute import documents


def test_span_crcs_equal_the_library():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 20_000).astype(np.uint8)
    sizes = [1, 2, 63, 64, 65, 127, 128, 129, 192, 193, 500, 4_096, 9_999, *rng.integers(1, 900, 300)]
    starts = np.array([rng.integers(0, len(data) - n) for n in sizes] + [0])
    ends = starts + np.array([*sizes, len(data)])
    want = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]
    assert resampling.span_crcs(data, starts, ends).tolist() == want


def test_a_long_word_is_hashed_whole():
    text = "é" * 1_000_000 + " next"
    n_words, owner, buckets = resampling.run_buckets([text], 2, 10_000)
    words = text.encode().split()
    want = [zlib.crc32(w) % 10_000 for w in [*words, b" ".join(words)]]
    assert n_words.tolist() == [2] and owner.tolist() == [0] * 3 and buckets.tolist() == want


def _features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [*w, *map(" ".join, zip(w, w[1:]))]


def _plain(docs, target, percent=25, min_words=20, seed=7):
    def bucket(f):
        return zlib.crc32(f.encode()) % 10_000

    s = Counter(bucket(f) for _, t in docs for f in _features(t)[1])
    t = Counter(bucket(f) for x in target for f in _features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for doc, text in docs:
        words, feats = _features(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in map(bucket, feats)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{doc if doc is not None else ''}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(words), len(feats), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1:4]))
    for i, r in enumerate(fit[: len(fit) * percent // 100]):
        r[5] = i + 1
    return out


def _rows(spark):
    rng = random.Random(4)
    vocab = [f"{a}{b}" for a in ("Wort", "mot", "über", "x9", "naïve", "日本") for b in range(30)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(0, 60))) for _ in range(150)]
    texts += [None, "", " .,;\n", "one", "A-B_C d'e\x00f\x7fg", "long" * 5_000 + " tail" * 30, texts[3], texts[3].upper()]
    docs = list(enumerate(texts))
    docs += [(3, texts[3]), (3, texts[3]), (5, texts[7]), (None, texts[8]), (None, None)]
    target = [" ".join(rng.choices(vocab[:60], k=rng.randint(1, 40))) for _ in range(30)] + [None, ""]
    return docs, target, documents(spark, docs), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")


def test_scores_and_ranks_equal_a_plain_version(spark):
    docs, target, table, wanted = _rows(spark)
    out = resampling.scored_documents(table, wanted).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()

    def key(r):
        return [(x is None, x or 0) for x in r]

    assert sorted([list(r) for r in out], key=key) == sorted(_plain(docs, target), key=key)


def test_drawn_documents_keep_their_columns(spark):
    docs, target, table, wanted = _rows(spark)
    clashing = table.withColumn("rank", F.lit("own")).withColumn("k1", F.lit("own")).withColumn("weight", F.lit("own"))
    drawn = resampling.drawn_documents(clashing, wanted)
    assert drawn.columns == clashing.columns and {r["rank"] for r in drawn.collect()} == {"own"}
    want = Counter(r[0] for r in _plain(docs, target) if r[5])
    assert Counter(r["doc_id"] for r in drawn.collect()) == want


def test_empty_tables(spark):
    none = documents(spark, [(0, "a b")]).limit(0)
    target = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert resampling.scored_documents(none, target).count() == 0
    rows = resampling.scored_documents(documents(spark, [(1, "word " * 30), (2, None)]), target.limit(0), percent=50).collect()
    assert sorted((r["doc_id"], r["rank"]) for r in rows) == [(1, None), (2, None)]
    assert resampling.drawn_documents(none, target).count() == 0
