from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from netloom.llm import packing, sentencepiece
from netloom.llm.queries import MODEL

from .brute import documents


def _plain_best_fit(lengths, capacity):
    """Best fit decreasing by looking at every open row."""
    rows = []
    for n in sorted(lengths, reverse=True):
        fit = min((r for r in rows if r[0] >= n), default=None)
        if fit is None:
            rows.append([capacity - n])
        else:
            fit[0] -= n
    return sorted(r[0] for r in rows)


def test_rows_equal_plain_best_fit():
    rng = random.Random(6)
    for capacity in (1, 2, 3, 7, 8, 100, 2048):
        lengths = [rng.randint(1, capacity) for _ in range(400)]
        rows = packing.best_fit_decreasing(lengths, capacity)
        assert sorted(i for r in rows for i in r) == list(range(400))
        assert sorted(capacity - sum(lengths[i] for i in r) for r in rows) == _plain_best_fit(lengths, capacity)
    assert packing.best_fit_decreasing([], 5) == []


def _tokens(spark):
    rng = random.Random(7)
    rows = [(i, [rng.randrange(1, 99) for _ in range(rng.choice([1, 3, 16, 40, 100]))]) for i in range(150)]
    return rows, spark.createDataFrame([*rows, (150, None), (151, []), (None, [5] * 20), (3, [8])], "doc_id long, ids array<int>")


def test_packing_loses_nothing(spark):
    rows, df = _tokens(spark)
    packed = packing.pack_ids(df, row_tokens=16, group_tokens=400).cache()
    back = {}
    for r in packing.unpack(packed).collect():
        back.setdefault(r["doc_id"], []).append((r["offset"], r["ids"]))
    joined = {d: [t for _, ids in sorted(s) for t in ids] for d, s in back.items() if d != 3}
    assert joined == {d: ids for d, ids in rows if d != 3} | {None: [5] * 20}
    assert sorted(t for _, ids in back[3] for t in ids) == sorted([*rows[3][1], 8])
    for r in packed.withColumn("positions", packing.position_ids(F.col("cu_seqlens"))).collect():
        ids, cu = np.frombuffer(r["input_ids"], "<i4"), r["cu_seqlens"]
        assert len(ids) == 16 and cu[0] == 0 and cu[-1] == r["n_tokens"] and not ids[cu[-1]:].any()
        assert r["position_resets"] == cu[:-1] == [i for i, p in enumerate(r["positions"]) if p == 0]
        assert len(r["positions"]) == r["n_tokens"] and len(r["doc_ids"]) == len(r["doc_offsets"]) == len(cu) - 1
    assert packed.select("pack_id").distinct().count() == packed.count()
    assert packing.pack_ids(df.limit(0)).count() == 0


def test_documents_are_encoded_and_packed(spark):
    docs = documents(spark, [(1, "some words here"), (2, None), (3, ""), (4, "long " * 5000)])
    pieces = sentencepiece.read_pieces(open(MODEL, "rb").read())
    texts = {}
    for r in packing.unpack(packing.pack_documents(docs, MODEL)).orderBy("doc_id", "offset").collect():
        texts.setdefault(r["doc_id"], []).extend(r["ids"])
    assert {d: pieces.decode(np.array(ids)) for d, ids in texts.items()} == {1: "some words here", 4: "long " * 5000}


def test_text_ids_stay_text(spark):
    tokens = spark.createDataFrame([("a-1", [1, 2, 3]), (None, [4]), ("b", [5, 6])], "doc_id string, ids array<int>")
    back = packing.unpack(packing.pack_ids(tokens, row_tokens=2)).collect()
    assert sorted((r["doc_id"] or "", r["offset"], r["ids"]) for r in back) == [("", 0, [4]), ("a-1", 0, [1, 2]), ("a-1", 2, [3]), ("b", 0, [5, 6])]
