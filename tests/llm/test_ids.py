"""Ids need not be numbers: the operators on documents give for text ids what they give for numbers."""

from __future__ import annotations

from netloom.llm import line_dedup, mixing, pii, simhash

LINE = "All rights are reserved by the owners of this site"
TEXTS = [f"{LINE}\nstory {i} of {i * 7} about mail{i}@example.org and more words {i}" for i in range(12)] + ["same words in both texts here"] * 2


def _documents(spark, name):
    rows = [(name(i), t, f"s{i % 7}") for i, t in enumerate(TEXTS)] + [(None, None, None)]
    kind = "string" if isinstance(name(0), str) else "long"
    return spark.createDataFrame(rows, f"doc_id {kind}, text string, source string")


def _name(i):
    return f"doc-{i:02d}"


def test_lines_and_personal_data(spark):
    for run in (line_dedup.line_dedup_counts, pii.pii_spans):
        plain = {r["doc_id"]: tuple(r)[1:] for r in run(_documents(spark, int)).collect()}
        named = {r["doc_id"]: tuple(r)[1:] for r in run(_documents(spark, _name)).collect()}
        if run is line_dedup.line_dedup_counts:  # which copy of a line stays depends on the order of ids
            assert sorted(v[:2] for v in plain.values()) == sorted(v[:2] for v in named.values())
        else:
            assert named == {None if k is None else _name(k): v for k, v in plain.items()}


def test_near_copies_and_mix(spark):
    docs = _documents(spark, _name)
    groups = {r["doc_id"]: r["component_id"] for r in simhash.simhash_groups(docs).collect()}
    assert groups["doc-13"] == groups["doc-12"] == "doc-12"
    kept = [r["doc_id"] for r in simhash.drop_near_copies(docs).collect()]
    assert len(kept) == len(set(groups.values())) and len({"doc-12", "doc-13"} & set(kept)) == 1
    taken = {r["doc_id"]: r for r in mixing.mix_documents(docs).collect()}
    assert set(taken) == {_name(i) for i in range(14)} | {None}
    assert mixing.mixed_documents(docs).count() == sum(r["taken"] // r["size"] for r in taken.values() if r["size"])
