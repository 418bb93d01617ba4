from __future__ import annotations

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from netloom.llm import pii

from .brute import documents


def _luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _base(text):
    """The patterns as they are given, over the whole text."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


TEXTS = ["mail a.b+c@x-1.example.com, or @none or a@b or a@b.c@d.e", "ip 1.2.3.4 1.2.3.4.5 256.1.1.1 0001.02.3.4 1.2.3",
         "cards 4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111111 12345", "call +1 (873) 555-4781 or +12 or +49.30.1234567 now",
         "é日本 x@y.zz 🙂 10.0.0.1", "a@b..c x@@y.z %@a.b-", "@a.b", "+1 4111 1111 1111 1111", None, "", "9" * 5000, "a@" * 2000 + "b.c", "1." * 3000]


def _random_texts():
    rng = random.Random(9)
    parts = ["@", ".", "a", "1", "25", "+", " ", "-", "(", ")", "x.y", "4111111111111111", "é"]
    return ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(400)]


def test_base_spans_equal_the_patterns(spark):
    texts = TEXTS + _random_texts()
    out = {r["doc_id"]: r for r in pii.pii_spans(documents(spark, list(enumerate(texts)))).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        base = _base(t or "")
        names = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert out[i]["base_sha256"] == hashlib.sha256(names.encode()).hexdigest(), t
        assert [out[i][f"n_{k}"] for k in pii.KINDS[:4]] == [sum(b[1] == j for b in base) for j in range(4)]
        assert set(names.split(",")) <= set(out[i]["spans"].split(","))


def _world():
    rows = [(i, f"filler text my account email is user{i}@mail.example.com thanks for reading") for i in range(30)]
    rows += [(100 + i, f"filler text my account email is ACC-77{i}31 thanks for reading") for i in range(2)]
    rows += [(200 + i, f"the part number was PX-55{i}10 in stock") for i in range(5)]
    return [*rows, (300, "nothing here at all"), (301, None), (None, "my account email is ACC-99999 thanks"), (8, rows[0][1])]


def test_sure_patterns_discover_unseen_identifiers(spark):
    out = pii.pii_spans(documents(spark, _world())).collect()
    found = {r["doc_id"]: r["n_id"] for r in out}
    assert len(out) == len(_world())
    assert {d for d, n in found.items() if n} == {100, 101, None}
    text = dict(_world())[100]
    at = text.index("ACC")
    assert next(r["spans"] for r in out if r["doc_id"] == 100) == f"id:{at}:{at + 9}"


def test_scores_equal_a_plain_version(spark):
    rng = random.Random(12)
    edges = {(f"p{rng.randrange(12)}", f"i{rng.randrange(60)}") for _ in range(260)}
    seeds = {f"i{k}" for k in range(45)}
    conf = {i: float(i in seeds) for _, i in edges}
    for _ in range(pii.ROUNDS):
        trust = {}
        for p in {p for p, _ in edges}:
            mine = [i for q, i in edges if q == p]
            if sum(i in seeds for i in mine) >= 2 and (t := sum(conf[i] for i in mine) / (len(mine) + pii.DOUBT)) >= 0.7:
                trust[p] = t
        for i in conf:
            doubt = 1.0
            for p, j in edges:
                if j == i and p in trust:
                    doubt *= 1 - trust[p]
            conf[i] = 1.0 if i in seeds else 1 - doubt
    rows = [(i, i in seeds, p) for p, i in edges for _ in range(2)]
    got = pii.sure_patterns(spark.createDataFrame(rows, "instance string, seed boolean, pattern string"), sure=0.7, min_seeds=2)
    assert {r["pattern"] for r in got.collect()} == set(trust) and trust


def test_redaction_and_edge_cases(spark):
    docs = documents(spark, _world()).withColumn("spans", F.lit("x")).withColumn("k1", F.lit(1)).withColumn("row", F.lit(2))
    out = pii.redact(docs)
    assert out.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[1] == "filler text my account email is [email] thanks for reading"
    assert texts[100] == "filler text my account email is [id] thanks for reading"
    assert texts[300] == "nothing here at all" and texts[301] is None and out.count() == len(_world())
    assert pii.pii_spans(docs.limit(0)).count() == 0


def _patterns(text):
    return {text[m["start"]:m["end"]]: set(m["patterns"]) for m in pii.mentions(text, pii.base_spans(text))}


def test_context_passes_over_quotes_and_bare_signs():
    found = _patterns('set the TOKEN = "ab12cd34ef" , please')
    assert found == {"ab12cd34ef": {"the token _", "the * _", "token _", "_ please", "token _ please"}}
    found = _patterns("mail <x@y.zz>, ip:10.0.0.1!")
    assert found["x@y.zz"] == {"mail _", "_ ip", "mail _ ip"}
    assert found["10.0.0.1"] == {"x@y.zz ip _", "x@y.zz * _", "ip _"}


def test_general_patterns_discover_behind_a_quote(spark):
    words = ["one", "two", "three", "four", "five", "six", "seven", "eight"]
    rows = [(i, f'{words[i]} secret = "user{i}@mail.example.com" {words[-i]} end') for i in range(8)]
    rows.append((100, 'nine secret = "ab12cd34ef" ten end'))
    out = {r["doc_id"]: r["spans"] for r in pii.pii_spans(documents(spark, rows)).collect()}
    assert out[100] == "id:15:25"


def test_what_a_turn_finds_supports_patterns_of_the_next(spark):
    # each pattern holds the instances of the one before and fewer new ones; only the first has seeds
    sets = [[f"{k}-{i}" for i in range(n)] for k, n in enumerate((400, 60, 9, 1))]
    rows = [(i, k == 0, f"p{max(k, 1)}") for k, group in enumerate(sets) for i in group]
    rows += [(i, False, f"p{k + 1}") for k, group in enumerate(sets[1:3], 1) for i in group]
    rows += [("9-0", False, "far"), ("9-1", False, "far"), ("9-2", False, "far")]
    got = pii.sure_patterns(spark.createDataFrame(rows, "instance string, seed boolean, pattern string"))
    assert {r["pattern"] for r in got.collect()} == {"p1", "p2", "p3"}
    assert pii.sure_patterns(spark.createDataFrame([], "instance string, seed boolean, pattern string")).count() == 0


def test_long_neighbours_and_gaps_are_read_whole():
    one, other = ["https://example.com/" + "part/" * 40 + end for end in ("x", "y")]
    near = _patterns(f"{one} {'k' * 150} AB-1234" + " " * 200 + other)["ab-1234".upper()]
    assert near == {f"{one} {'k' * 150} _", f"{one} * _", f"{'k' * 150} _", f"_ {other}", f"{'k' * 150} _ {other}"}


@pytest.mark.parametrize("text", [
    "字" * 1_000_000, "a" * 1_000_000, "7" * 1_000_000, "1." * 500_000, "1.2.3" * 200_000, "1 2-" * 250_000, "+1" + "(" * 1_000_000,
    "a@" * 500_000, "@" * 1_000_000, "a1b2c3 " * 100_000, "x." * 500_000 + "@y",
])
def test_long_texts_take_linear_time(text):
    start = time.monotonic()
    spans = pii.base_spans(text)
    pii.mentions(text, spans)
    assert time.monotonic() - start < 30


def test_ip_spans_are_those_of_the_plain_pattern():
    plain = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = random.Random(8)
    for _ in range(3_000):
        text = "".join(rng.choices("12 .9", weights=(4, 3, 1, 5, 2), k=rng.randint(0, 30)))
        assert [m.span() for m in pii.IP.finditer(text)] == [m.span() for m in plain.finditer(text)]
