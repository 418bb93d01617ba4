"""Conversation structure repair by an integer shortest path (operator 11).

A conversation is to become ``(s?(ua)+)?`` by role initials.  Each row may be kept, given
the role user or assistant, or deleted, and rows may be inserted; blank rows and later
copies have to go.  A path through (row, state of that pattern) has as its weight one
integer: the high digits hold the cost, below them one digit per audit letter in its
position, zeros at the end.  The plain integer minimum therefore finds the least cost and,
among equal costs, the letters that come first in ASCII order.

A conversation may hold any share of the rows, so rows are spread by ranges of (conversation,
turn), not by conversation.  What lies whole inside a range is repaired there.  Where a range
ends inside a conversation, and every ``PIECE_ROWS`` rows of a long one, a piece ends: it is
solved for each state it may begin and end in.  Inserted rows stand before a row of their
piece, so no letters of a piece begin other letters of it, and the choice between two ways
through a piece depends on their costs, what follows costs, and the order of their own
letters.  So choosing the states between pieces needs four by four costs and places per
piece.  Last, a conversation's pieces pass in order through one running SHA-256: that sum, and
the audit as one string, are sequential and bound a conversation to 2 billion letters; memory
holds a piece and the letters.

Nulls in any column count as one blank; rows come by turn, nulls first, then role, the first 64
code points of the text and its hash; equal rows are neighbours (the later are duplicates).
A conversation whose rows are all dropped has zeros, an empty audit and the hash of nothing.
Any role is read by its first character; empty tables give empty results; other columns are
neither read nor changed.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.session import broadcast_if_small, materialize, shared_path

#: Costs of the contract: a new role, a deletion, an insertion, a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows and code points after which a piece of a long conversation ends; they bound what a task holds of it.
PIECE_ROWS, PIECE_CHARS = 2_048, 1 << 24

#: States of the pattern: begun, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The state after a user or assistant row put where one may stand, and which of the two that is.
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
ROLE = ("user", "user", "assistant", "user")
#: How the pattern is completed at the end: a state, its inserted letters.
ENDING = ("", "II", "I", "")
#: Audit letters as digits in ASCII order; zero is the padding.
LETTERS = " DIKR"
DIGIT_BITS = 3
INSERTS = 2

MUST_GO = "x"
BLANKS = " \t\n\x0b\f\r"
ORDER = ["conv_id", "turn", "role", "start", "h"]


def _keep(state: int, initial: str) -> int | None:
    """The state after keeping a row of that initial, None where it may not stand."""
    if initial == "s":
        return AFTER_S if state == START else None
    if initial in "ua" and initial == ROLE[state][0]:
        return NEXT[state]
    return None


def _encoded(letters: str, cost: int, width: int) -> int:
    digits = 0
    for c in letters.ljust(width):
        digits = digits << DIGIT_BITS | LETTERS.index(c)
    return cost << DIGIT_BITS * width | digits


def _decoded(weight: int, width: int) -> tuple[int, str]:
    digits = weight & ((1 << DIGIT_BITS * width) - 1)
    letters = (LETTERS[digits >> DIGIT_BITS * (width - 1 - i) & 7] for i in range(width))
    return weight >> DIGIT_BITS * width, "".join(letters).rstrip()


def _paths(signature: str, ends: dict[int, str]) -> list[tuple[int, str] | None]:
    """Cheapest (cost, letters) from each state over the rows to a state of ``ends``, completed by its letters.

    A row is ``x`` if it must go, else its initial (``o``: any other), as a capital if truncated.
    """
    width = (INSERTS + 1) * len(signature) + INSERTS
    field = DIGIT_BITS * width
    low = (1 << field) - 1

    def before(digit: int, cost: int, weight: int) -> int:
        """The weight of a path with one more letter in front: all letters move one place, the last place being zero."""
        return ((weight >> field) + cost) << field | digit << (field - DIGIT_BITS) | (weight & low) >> DIGIT_BITS

    best = [_encoded(ends[s], INSERT * len(ends[s]), width) if s in ends else None for s in range(4)]
    d, i, k, r = (LETTERS.index(c) for c in "DIKR")
    for row in reversed(signature):
        initial, broken = row.lower(), TRUNCATED * row.isupper()
        now = []
        for state in range(4):
            ways = [] if best[state] is None else [before(d, DELETE, best[state])]
            if row != MUST_GO:
                kept = _keep(state, initial)
                if kept is not None and best[kept] is not None:
                    ways.append(before(k, broken, best[kept]))
                if best[NEXT[state]] is not None:
                    ways.append(before(r, REROLE + broken, best[NEXT[state]]))
            now.append(min(ways, default=None))
        # rows inserted before this one
        for _ in range(INSERTS):
            more = [None if now[NEXT[s]] is None else before(i, INSERT, now[NEXT[s]]) for s in range(4)]
            now = [min((w for w in pair if w is not None), default=None) for pair in zip(now, more)]
        best = now
    return [None if w is None else _decoded(w, width) for w in best]


@lru_cache(maxsize=100_000)
def repair_whole(signature: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    return _paths(signature, dict(enumerate(ENDING)))[START]


def piece_paths(signature: str) -> list[list[tuple[int, str] | None]]:
    """``[begin][end]``: cost and letters of a piece of a conversation between each two states."""
    by_end = [_paths(signature, {end: ""}) for end in range(4)]
    return [[by_end[end][begin] for end in range(4)] for begin in range(4)]


def replay(letters: str, state: int, rows: list) -> list[str]:
    """The repaired ``role:text`` lines that the letters make of ``(role, text)`` rows from a state on."""
    out, at = [], iter(rows)
    for letter in letters:
        if letter == "I":
            out.append(f"{ROLE[state]}:")
            state = NEXT[state]
            continue
        role, text = next(at)
        if letter == "R":
            role, state = ROLE[state], NEXT[state]
        elif letter == "K":
            state = _keep(state, role[:1])
        if letter != "D":
            out.append(f"{role}:{text}")
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: what is left of each row; a dropped row stays as one with no copies and null texts."""
    def shown(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    gone, text = fault == 0, shown("text")
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.when(gone, F.lit(None)).when(fault == 4, F.lit("user")).otherwise(shown("role")).alias("role"),
        F.when(gone, F.lit(None)).when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(gone, 0).when(fault == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _marked(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn as one with a count; ``seen`` if role and text occur at an earlier turn, and the columns of the order."""
    h = F.sha2(F.concat_ws("\x00", "role", "text"), 256)
    grouped = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("h", h)
    path = shared_path(rows.sparkSession, "turns")
    grouped.write.parquet(path)
    grouped = rows.sparkSession.read.parquet(path)
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = (
        grouped.filter("copies > 0").groupBy(F.col("conv_id").alias("c"), F.col("h").alias("again"))
        .agg(F.min(turn).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("h") == F.col("again"))
    marked = grouped.join(broadcast_if_small(again), same, "left")
    return marked.select(
        "conv_id", "turn", "role", "text", "copies", "h", F.substring("text", 1, 64).alias("start"),
        F.coalesce(turn > F.col("first"), F.lit(False)).alias("seen"))


class _Run:
    """The rows of one conversation, or of a piece of one, as they come."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.clear()

    def clear(self) -> None:
        self.signature, self.rows, self.initials, self.turns, self.chars = [], [], [], [], 0
        self.blank = self.duplicate = self.truncated = 0

    def add(self, turn, role: str, text: str, duplicate: bool) -> None:
        self.turns.append(turn)
        self.initials.append(role[:1])
        solid = text.rstrip(BLANKS)
        if not solid:
            self.blank += 1
            code = MUST_GO
        elif duplicate:
            self.duplicate += 1
            code = MUST_GO
        else:
            code = role[:1] if role[:1] in ("s", "u", "a") else "o"
            if solid[-1] not in ".!?":
                self.truncated += 1
                code = code.upper()
        self.signature.append(code)
        self.rows.append((role, "" if code == MUST_GO else text))
        self.chars += len(self.rows[-1][1])

    def facts(self) -> dict:
        turns = sorted({t for t in self.turns if t is not None})
        return {
            "n": len(self.rows), "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(self.initials, self.initials[1:])),
            "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(turns),
            "first": self.initials[0] if self.initials else None, "last": self.initials[-1] if self.initials else None,
        }


FACTS = "n long, blank long, duplicate long, truncated long, illegal long, low long, high long, turns long, first string, last string"
#: What the pass over the ranges returns: facts of a conversation or piece; cost, audit and hash if it is whole, else its place, rows and ways.
FOUND = (
    f"whole boolean, {FACTS}, cost long, audit string, repaired_sha256 string, "
    "place long, signature string, roles array<string>, texts array<string>, costs array<long>, ranks array<int>"
)


def _sha256(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def _whole(run: _Run) -> dict:
    cost, audit = repair_whole("".join(run.signature))
    lines = replay(audit, START, run.rows)
    return {"conv_id": run.conv_id, "whole": True, **run.facts(), "cost": cost, "audit": audit, "repaired_sha256": _sha256(lines)}


def _piece(run: _Run, place: int) -> dict:
    signature = "".join(run.signature)
    ways = [cell for row in piece_paths(signature) for cell in row]
    order = {letters: i for i, letters in enumerate(sorted(c[1] for c in ways if c))}
    return {
        "conv_id": run.conv_id, "whole": False, **run.facts(), "place": place, "signature": signature,
        "roles": [r for r, _ in run.rows], "texts": [t for _, t in run.rows],
        "costs": [c[0] if c else None for c in ways], "ranks": [order[c[1]] if c else None for c in ways],
    }


def _runs(piece_rows: int, schema: pa.Schema):
    """Rows in order -> repaired conversations, and pieces of those that may go on in another range or are long."""
    def solve(batches):
        part = TaskContext.get().partitionId()
        run, first, cut, place, out, held = None, True, False, part << 33, [], 0

        def end(more: bool):
            """What the run in hand gives; ``more`` if its conversation may go on."""
            nonlocal place, cut
            if first or cut or more:
                place += 1
                cut = True
                return _piece(run, place)
            return _whole(run)

        def batch_of(found):
            return pa.RecordBatch.from_pylist(found, schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                if run is None or row["conv_id"] != run.conv_id:
                    if run is not None:
                        out.append(end(False))
                        held += run.chars
                        first = cut = False
                    run = _Run(row["conv_id"])
                for copy in range(row["copies"]):
                    run.add(row["turn"], row["role"], row["text"], row["seen"] or copy > 0)
                    if len(run.rows) >= piece_rows or run.chars >= PIECE_CHARS:
                        out.append(end(True))
                        held += run.chars
                        run.clear()
                if held >= PIECE_CHARS or len(out) >= 1_000:
                    yield batch_of(out)
                    out, held = [], 0
        if run is not None:
            out.append(end(True))
        if out:
            yield batch_of(out)

    return solve


def _states(conv_id_field: pa.Field):
    """All pieces of a conversation, narrow -> the states each begins in, and the facts of the whole."""
    def choose(table: pa.Table) -> pa.Table:
        pieces = sorted(table.to_pylist(), key=lambda p: p["place"])
        after = [INSERT * len(e) for e in ENDING]
        ways = []
        for p in reversed(pieces):
            row, now = [], []
            for begin in range(4):
                cells = [(p["costs"][4 * begin + e] + after[e], p["ranks"][4 * begin + e], e)
                         for e in range(4) if p["costs"][4 * begin + e] is not None and after[e] is not None]
                cost, _, e = min(cells, default=(None, None, None))
                row.append(e)
                now.append(cost)
            after = now
            ways.append(row)
        total = {k: sum(p[k] for p in pieces) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
        seen = [p for p in pieces if p["n"]]
        total["illegal"] += sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(seen, seen[1:]))
        timed = [p for p in pieces if p["turns"]]
        total["turns"] -= sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:]))
        total["low"], total["high"] = (timed[0]["low"], timed[-1]["high"]) if timed else (None, None)
        out, state = [], START
        for p, row in zip(pieces, reversed(ways)):
            out.append({"conv_id": p["conv_id"], "place": p["place"], "begin": state, "end": row[state],
                        "finish": p is pieces[-1], "cost": after[START], **total})
            state = row[state]
        return pa.Table.from_pylist(out, schema=STATES.insert(0, conv_id_field))

    return choose


STATES = pa.schema([
    ("place", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("finish", pa.bool_()), ("cost", pa.int64()),
    *[(k, pa.int64()) for k in ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high")]])
STATES_DDL = (
    "place long, begin int, end int, finish boolean, cost long, blank long, duplicate long, truncated long, illegal long, "
    "turns long, low long, high long")


def _written(schema: pa.Schema):
    """Pieces with the states chosen for them -> their letters and repaired lines."""
    def write(batches):
        for batch in batches:
            for p in batch.to_pylist():
                cost_letters = _paths(p["signature"], {p["end"]: ""})[p["begin"]]
                ending = ENDING[p["end"]] if p["finish"] else ""
                letters = cost_letters[1] + ending
                lines = replay(letters, p["begin"], list(zip(p["roles"], p["texts"])))
                row = {k: p[k] for k in schema.names if k in p} | {"letters": letters, "lines": "\n".join(lines) if lines else None}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return write


def _joined(schema: pa.Schema):
    """Written pieces by conversation and place -> one row per conversation; the hash runs over the pieces."""
    def join(batches):
        conv, head, letters, digest, begun = None, None, [], None, False

        def row():
            out = {k: head[k] for k in schema.names if k in head}
            return pa.RecordBatch.from_pylist([out | {"audit": "".join(letters), "repaired_sha256": digest.hexdigest()}], schema=schema)

        for batch in batches:
            for p in batch.to_pylist():
                if head is None or p["conv_id"] != conv:
                    if head is not None:
                        yield row()
                    conv, head, letters, digest, begun = p["conv_id"], p, [], hashlib.sha256(), False
                letters.append(p["letters"])
                if p["lines"] is not None:
                    digest.update(("\n" * begun + p["lines"]).encode())
                    begun = True
        if head is not None:
            yield row()

    return join


def repaired_conversations(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row per conversation of ``rows`` (``conv_id, turn, role, text, copies``, nothing null but ids and turns).

    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.
    """
    ranged = _marked(rows).repartitionByRange(*[F.asc(c) for c in ORDER]).sortWithinPartitions(*[F.asc(c) for c in ORDER])
    id_type = rows.schema["conv_id"].dataType
    id_field = pa.field("conv_id", _arrow(id_type))

    def ddl(text: str) -> T.StructType:
        return T.StructType([T.StructField("conv_id", id_type), *T.StructType.fromDDL(text).fields])

    def arrow(text: str) -> pa.Schema:
        return pa.schema([id_field, *[pa.field(f.name, _arrow(f.dataType)) for f in T.StructType.fromDDL(text).fields]])

    found = materialize(ranged.select("conv_id", "turn", "role", "text", "copies", "seen").mapInArrow(
        _runs(piece_rows, arrow(FOUND)), ddl(FOUND)))
    pieces = found.filter("not whole")
    facts = [f.name for f in T.StructType.fromDDL(FACTS).fields]
    narrow = pieces.select("conv_id", "place", "costs", "ranks", *facts)
    states = narrow.groupBy("conv_id").applyInArrow(_states(id_field), ddl(STATES_DDL))
    kept = ["place", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "cost"]
    written_ddl = ", ".join(f"{k} long" for k in kept) + ", letters string, lines string"
    both = pieces.select("place", "signature", "roles", "texts").join(states, "place")
    written = both.mapInArrow(_written(arrow(written_ddl)), ddl(written_ddl))
    totals = "blank long, duplicate long, truncated long, illegal long, low long, high long, turns long, cost long, audit string, repaired_sha256 string"
    joined = written.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_joined(arrow(totals)), ddl(totals))
    names = [f.name for f in ddl(totals).fields]
    every = found.filter("whole").select(*names).unionByName(joined)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    return every.select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def repair_report(conversations: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Damage by the contract's rule, then repair: one row per ``conv_id``."""
    return repaired_conversations(damaged(conversations), piece_rows)
