from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from netloom.llm import quality
from netloom.llm.common import log_gamma

from .brute import documents
from .brute import quality as brute_quality

LABELS = "doc_id long, quality int, toxic int"


def _texts():
    rng = random.Random(8)
    vocab = ["a", "bb", "c#", "ddd", "é|", "x*y", "日本"]
    texts = [rng.choice([" ", "\n", "\t "]).join(rng.choices(vocab, k=rng.randint(0, 150))) for _ in range(80)]
    return [*texts, None, "", "\n\n", "one", "one two", "same same same same", "x\x0by\x0cz\rq", "a b c a b c a b\n\na b c\n a b c", "u v w", "w " * 20000]


def test_base_counts_equal_brute_force(spark):
    texts = _texts()
    docs = documents(spark, [(i, t) for i, t in enumerate(texts)])
    labels = spark.createDataFrame([], LABELS)
    for r in quality.quality_verdicts(docs, labels).collect():
        want = brute_quality(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] is failed and r["kept"] is (not failed)


def test_exact_binomial_tail(spark):
    cases = [(k, n, p) for n in (1, 7, 40, 900) for k in (0, 1, 3, n // 2, n) for p in (0.004, 0.1, 0.4)]
    for p in (0.004, 0.1, 0.4):
        rows = [(k, n) for k, n, q in cases if q == p]
        df = spark.createDataFrame(rows, "k long, n long")
        for r in df.withColumn("t", quality.binomial_tail(F.col("k"), F.col("n"), p)).collect():
            want = sum(math.comb(r["n"], i) * p**i * (1 - p) ** (r["n"] - i) for i in range(min(r["k"], r["n"]) + 1))
            assert math.isclose(r["t"], want, rel_tol=1e-9) if r["k"] <= r["n"] * p else r["t"] >= 0.5


def test_log_gamma(spark):
    xs = [0.5, 1.0, 1.5, 2.0, 10.0, 1234.5, 1e9]
    out = spark.createDataFrame([(x,) for x in xs], "x double").select("x", log_gamma(F.col("x")).alias("g")).collect()
    assert all(math.isclose(r["g"], math.lgamma(r["x"]), rel_tol=1e-12, abs_tol=1e-12) for r in out)


def _world(spark, n, bad_symbols):
    """``n`` good documents without symbols, as many bad ones with, and ``bad_symbols`` good ones with."""
    plain, noisy = "word " * 60, "wo#d " * 60
    rng = random.Random(n)
    vocab = [f"w{i}x" for i in range(500)]
    plain = [" ".join(rng.choices(vocab, k=60)) for _ in range(n)]
    noisy = [" ".join(w + "#" for w in rng.choices(vocab, k=60)) for _ in range(n + bad_symbols)]
    docs = [(i, t) for i, t in enumerate(plain + noisy)]
    labels = [(i, 1 if i < n or i >= 2 * n else 0, 0) for i in range(2 * n + bad_symbols)]
    return documents(spark, docs), spark.createDataFrame(labels, LABELS), n


def test_cutoffs_need_enough_good_documents(spark):
    docs, labels, n = _world(spark, 100, 0)
    assert all(r["kept"] for r in quality.quality_verdicts(docs, labels).collect())
    docs, labels, n = _world(spark, 2500, 0)
    out = quality.quality_verdicts(docs, labels).collect()
    assert all(r["kept"] == (r["doc_id"] < n) for r in out)
    # good documents with symbols, one in a hundred, forbid the cutoff
    docs, labels, n = _world(spark, 2500, 25)
    assert all(r["kept"] for r in quality.quality_verdicts(docs, labels).collect())


def test_keep_quality_keeps_columns_and_nulls(spark):
    good = " ".join(f"word{i}" for i in range(60))
    docs = documents(spark, [(1, good, None), (None, good, "en"), (2, None, "en"), (3, "", "en"), (1, good, None)])
    docs = docs.withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(False)).withColumn("row", F.lit(1)).withColumn("stratum", F.lit(1))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 0)], LABELS)
    out = quality.keep_quality(docs, labels)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect()) == [(False, 1), (False, 1), (True, 0)]
    assert quality.keep_quality(docs.limit(0), labels.limit(0)).count() == 0


def test_keep_quality_tells_a_null_text_from_a_null_language(spark):
    good = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, good, None), (1, None, good)], "doc_id long, text string, lang string")
    assert [r["text"] for r in quality.keep_quality(docs, spark.createDataFrame([], LABELS)).collect()] == [good]


def test_few_hundred_good_documents_per_language_certify(spark):
    rng = random.Random(3)
    vocab = [f"w{i}x" for i in range(500)]
    docs, labels, n = [], [], {"de": 217, "en": 600, "es": 216, "fr": 300}
    for lang, count in n.items():
        for good in [True] * count + [False] * 20:
            at = len(docs)
            end = "" if good else "#"
            docs.append((at, " ".join(w + end for w in rng.choices(vocab, k=60)), lang))
            labels.append((at, int(good), 0))
    # good documents that only a late step of another rule rejects take no cutoff from the symbols
    for k in range(30):
        docs[n["de"] + 20 + k] = (docs[n["de"] + 20 + k][0], " ".join(w + "longer" for w in rng.choices(vocab, k=60)), "en")
    out = quality.quality_verdicts(documents(spark, docs), spark.createDataFrame(labels, LABELS)).collect()
    gone = {lang: sum(not r["kept"] for r in out if docs[r["doc_id"]][2] == lang) for lang in n}
    assert gone == {"de": 20, "en": 20, "es": 0, "fr": 20}
    assert all(not labels[r["doc_id"]][1] for r in out if not r["kept"])
