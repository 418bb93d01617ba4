from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from netloom.llm import simhash

from .brute import classes, documents, fingerprint


def _texts():
    rng = random.Random(3)
    vocab = [f"w{i}é" for i in range(400)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(1, 120))) for _ in range(60)]
    for t in texts[:25]:
        w = t.split()
        w[rng.randrange(len(w))] = "Changed"
        texts.append(" ".join(w))
    return texts + [t.upper() for t in texts[:5]] + [None, "", " \t\n", "one", "One", "two words", "x y z\u000bq r", "a " * 5000]


def test_fingerprints_and_components_equal_brute_force(spark):
    texts = _texts()
    out = simhash.simhash_groups(documents(spark, [(i, t) for i, t in enumerate(texts)])).collect()
    fps = {i: fingerprint(t) for i, t in enumerate(texts)}
    want = classes(fps, lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 2)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in out} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    assert len(out) == len(texts)


@pytest.mark.parametrize(("bits", "segments"), [(1, 2), (2, 2), (3, 2), (3, 3), (4, 3)])
def test_links_find_every_pair_and_no_other(spark, bits, segments):
    rng = random.Random(bits)
    fps = {rng.getrandbits(64) for _ in range(80)}
    for f in list(fps)[:50]:
        for _ in range(3):
            g = f
            for b in rng.sample(range(64), rng.randint(1, bits + 1)):
                g ^= 1 << b
            fps.add(g)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    found = simhash.links(spark.createDataFrame(signed, "fp long"), bits, segments).collect()
    mask = (1 << 64) - 1
    want = {(a, b) for a, in signed for b, in signed if a < b and bin((a ^ b) & mask).count("1") <= bits}
    assert {(r["a"], r["b"]) for r in found} == want
    assert len(found) == len(want)


def test_long_chain_is_one_component(spark):
    fps = [(i, (1 << i) - 1 if i < 63 else -1) for i in range(0, 64)]
    out = simhash.simhash_components(spark.createDataFrame(fps, "doc_id long, fp long")).collect()
    assert {r["component_id"] for r in out} == {0}


def test_one_of_each_group_stays_with_all_columns(spark):
    a = "the quick brown fox jumps over the lazy dog again and again"
    docs = documents(spark, [(4, a), (2, a), (None, a), (2, a), (7, "something else entirely here"), (None, None), (9, "")])
    docs = docs.withColumn("k1", F.lit("x")).withColumn("fp", F.lit(1)).withColumn("row", F.lit(2)).withColumn("a.b", F.lit(3))
    out = simhash.drop_near_copies(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [2, 7, 9]


def test_null_ids_and_empty_tables(spark):
    docs = documents(spark, [(None, "only nulls here"), (None, "only nulls here")])
    assert [r["component_id"] for r in simhash.simhash_groups(docs).collect()] == [None, None]
    assert simhash.drop_near_copies(docs).count() == 1
    empty = docs.limit(0)
    assert simhash.simhash_groups(empty).count() == 0
    assert simhash.drop_near_copies(empty).count() == 0
