from __future__ import annotations

import random

from pyspark.sql import functions as F

from netloom.llm import line_dedup

from .brute import documents, lines_left


def _docs():
    rng = random.Random(1)
    shared = [f"shared line number {i} with some words" for i in range(30)]
    rows = []
    for i in range(200):
        lines = [f"own line of document {i} part {j} here" for j in range(rng.randint(0, 4))]
        lines += ["  " + rng.choice(shared) + "\t" for _ in range(rng.randint(0, 4))] + ["short one"] * 2 + [""]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), "en", f"s{rng.randrange(9)}" if i % 3 else "hot"))
    return rows


def test_equals_brute_force(spark):
    rows = _docs()
    out = line_dedup.drop_boilerplate_lines(documents(spark, rows)).collect()
    want = lines_left([(r[0], r[1], r[3]) for r in rows], line_dedup.MIN_SITES, line_dedup.MIN_WORDS)
    assert {r["doc_id"]: r["text"] for r in out} == want
    assert len(out) == len(rows) and any(want[r[0]] != r[1] for r in rows)
    assert all(r["n_chars"] == len(r["text"]) for r in out)


def test_many_sites_are_decided_by_the_sketch(spark):
    rows = [(i, "a line that every site has today", "en", f"site{i}") for i in range(3000)]
    out = line_dedup.line_dedup_counts(documents(spark, rows), min_sites=1000).collect()
    assert sorted(r["doc_id"] for r in out if r["n_removed"] == 0) == [0]


def test_near_threshold_is_exact(spark):
    for n, gone in ((399, 0), (400, 399)):
        rows = [(i, "a line near the threshold of sites", "en", f"site{i}") for i in range(n)]
        out = line_dedup.line_dedup_counts(documents(spark, rows), min_sites=400).collect()
        assert sum(r["n_removed"] for r in out) == gone


def test_nulls_repeats_and_clashing_names(spark):
    line = "five words are in this line"
    rows = [(1, line, "en", "a"), (1, line, "en", "a"), (2, line, "en", None), (None, line, "en", "b"), (3, line, "en", "c"),
            (4, line + "\nmore", "en", "d"), (5, None, "en", "e"), (6, "", "en", "f")]
    docs = documents(spark, rows).withColumn("line", F.lit("x")).withColumn("gone", F.lit(1)).withColumn("row", F.lit(1)).withColumn("k1", F.lit(0))
    out = line_dedup.drop_boilerplate_lines(docs)
    assert out.columns == docs.columns
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in out.collect() if r["doc_id"] != 5)
    assert got == [(False, 1, line), (False, 1, line), (False, 2, ""), (False, 3, ""), (False, 4, "more"), (False, 6, ""), (True, 0, "")]
    assert line_dedup.drop_boilerplate_lines(docs.limit(0)).count() == 0
    assert {r["doc_id"]: r["n_lines"] for r in line_dedup.line_dedup_counts(documents(spark, rows)).collect()}[5] == 0


def test_short_lines_need_more_sites_and_length_is_in_characters(spark):
    need = line_dedup.MIN_SITES * line_dedup.SHORT_TIMES
    chinese, phrase = "本网站的所有内容均受版权保护未经书面许可不得转载或使用", "All rights reserved."
    lines = [("Menu", need), ("Home", need - 1), (chinese, line_dedup.MIN_SITES), (phrase, line_dedup.MIN_SITES), (chinese[1:], line_dedup.MIN_SITES - 1)]
    rows = [(i, "\n".join(["", *[x for x, sites in lines if i < sites], f"own {i}"]), "en", f"site{i}") for i in range(need)]
    out = {r["doc_id"]: r["clean_text"].split("\n") for r in line_dedup.line_dedup_counts(documents(spark, rows)).collect()}
    assert out[0] == rows[0][1].split("\n")
    for i in range(1, need):
        assert out[i] == ["", *[x for x, sites in lines if i < sites and x in ("Home", chinese[1:])], f"own {i}"]
