from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from netloom.llm import conversations

PATTERN = re.compile(r"(s?(ua)+)?")


def _damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        left = out.setdefault(conv, [])
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        left += [(turn, role, text)] * (2 if fault == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def _faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        solid = text.rstrip(" \t\n\x0b\f\r")
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def _every_repair(rows, faults, most_inserts=2):
    """All edits, tried out: (cost, audit, lines) of those whose result fits the pattern."""
    per_row = []
    for (_, role, text), fault in zip(rows, faults):
        stay = 3 * (fault == "truncated")
        ways = [(4, "D", [])]
        if fault not in ("blank", "duplicate"):
            ways += [(stay, "K", [(role, text)])] + [(3 + stay, "R", [(r, text)]) for r in ("user", "assistant")]
        per_row.append(ways)
    gap = [(3 * k, "I" * k, [(r, "") for r in rs]) for k in range(most_inserts + 1) for rs in itertools.product(("user", "assistant"), repeat=k)]
    steps = [gap]
    for ways in per_row:
        steps += [ways, gap]
    best = None
    for path in itertools.product(*steps):
        out = [r for _, _, made in path for r in made]
        if PATTERN.fullmatch("".join(r[:1] or "?" for r, _ in out)):
            found = (sum(p[0] for p in path), "".join(p[1] for p in path), "\n".join(f"{r}:{t}" for r, t in out))
            best = min(best or found, found)
    return best


def _forward(signature):
    """Cheapest (cost, letters) of a whole conversation, plainly by tuples over (rows, state), inserts at most two in a row."""
    layer = {0: (0, "")}
    for code in [*signature, None]:
        for _ in range(2):
            for s, (c, a) in list(layer.items()):
                t = conversations.NEXT[s]
                layer[t] = min(layer.get(t, (1 << 60, "")), (c + 3, a + "I"))
        if code is None:
            break
        after = {}
        for s, (c, a) in layer.items():
            ways = [(s, c + 4, "D")]
            if code != "x":
                extra = 3 * code.isupper()
                ways.append((conversations.NEXT[s], c + 3 + extra, "R"))
                k = conversations._keep(s, code.lower())
                if k is not None:
                    ways.append((k, c + extra, "K"))
            for t, cost, letter in ways:
                after[t] = min(after.get(t, (1 << 60, "")), (cost, a + letter))
        layer = after
    return min(layer[s] for s in (0, 3) if s in layer)


def _plain(rows):
    out = {}
    for conv, left in _damage(rows).items():
        faults = _faults(left)
        turns = {t for t, _, _ in left if t is not None}
        initials = [r[:1] for _, r, _ in left]
        code = "".join("x" if f in ("blank", "duplicate") else (c if c in ("s", "u", "a") else "o").upper() if f else (c if c in ("s", "u", "a") else "o")
                       for f, c in zip(faults, initials))
        cost, audit = _forward(code)
        text = _lines(audit, left)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def _lines(audit, left):
    rows, out, after = iter(left), [], ""
    for letter in audit:
        new = "assistant" if after == "u" else "user"
        if letter == "I":
            line = (new, "")
        else:
            _, role, text = next(rows)
            if letter == "D":
                continue
            line = (role if letter == "K" else new, text)
        out.append(line)
        after = line[0][:1]
    return "\n".join(f"{r}:{t}" for r, t in out)


ROLES = ("user", "assistant", "system", "tool", "umpire", "", None)


def _random_rows(seed, convs, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "What?", " \t", "", None, "Done!  ", "open ", "a b c."]
    rows = []
    for conv in convs:
        turns = [None] * rng.randint(0, 1) + list(range(rng.randint(0, longest)))
        for turn in turns:
            if rng.random() < 0.9:
                rows.append((conv, turn, rng.choice(ROLES if rng.random() < 0.5 else ROLES[:2]), rng.choice(texts) if rng.random() < 0.4 else f"text {rng.random()}" + rng.choice([".", ""])))
    return rows


DDL = "conv_id long, turn long, role string, text string"


def _collected(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_paths_equal_trying_everything(seed):
    rng = random.Random(seed)
    for _ in range(25):
        rows = [(i, rng.choice(("user", "assistant", "system", "tool")), rng.choice(("A.", "b", "", f"t{i}."))) for i in range(rng.randint(0, 3))]
        faults = _faults(rows)
        code = "".join("x" if f in ("blank", "duplicate") else {"t": "o"}.get(r[0], r[0]).upper() if f else {"t": "o"}.get(r[0], r[0])
                       for f, (_, r, _) in zip(faults, rows))
        cost, audit = conversations.repair_whole(code)
        want = _every_repair(rows, faults)
        assert (cost, audit) == want[:2]
        assert "\n".join(conversations.replay(audit, 0, [(r, t) for _, r, t in rows])) == want[2] == _lines(audit, rows)


def test_long_paths_equal_plain_tuples():
    rng = random.Random(9)
    for _ in range(200):
        code = "".join(rng.choices("suaoSUAOx", k=rng.randint(0, 40)))
        assert conversations.repair_whole(code) == _forward(code)


@pytest.mark.parametrize("piece_rows", [1, 3, 2_048])
def test_report_equals_a_plain_version(spark, piece_rows):
    rows = _random_rows(5, [*range(60), None], 9) + _random_rows(6, [1_000], 150) + [(2_000, t, "user", "Same text.") for t in range(80)]
    rows += [(2_001, 0, "user", "Twice."), (2_001, 0, "user", "Twice."), (2_001, None, "system", "S."), (2_001, None, "system", "S.")]
    dropped = [i for i in range(3_000, 3_200) if zlib.crc32(f"{i}:0".encode()) % 20 == 0][:3]
    rows += [(i, 0, "user", "Gone.") for i in dropped]
    table = spark.createDataFrame(rows, DDL).repartition(5)
    got = conversations.repair_report(table, piece_rows)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert _collected(got) == _plain(rows)
    assert all(_collected(got)[i] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for i in dropped)


def test_other_columns_text_ids_long_texts_and_empty_tables(spark):
    rows = [("c1", 0, "user", "word " * 200_000 + "end."), ("c1", 1, "assistant", "x" * 1_000_000), ("c2", 5, None, None)]
    table = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    table = table.withColumn("copies", F.lit("own")).withColumn("h", F.lit("own")).withColumn("seen", F.lit("own"))
    assert _collected(conversations.repair_report(table)) == _plain(rows)
    assert conversations.repair_report(table.limit(0)).count() == 0
