"""Personal data by bootstrapped contextual extraction (operator 4).

Patterns find the base kinds: email, ip, card and phone.  These spans are the seeds.  Every mention -
a seed, or any other word that looks like an identifier (at least ``MIN_LENGTH`` characters, three
digits among them) - has lexical patterns: the two words before it, the word on either side, and, more
general, one word alone: next before it, second before it, or next after it.  Context words are what
is left of the words around a mention without ``EDGES`` characters; a mention beside it bounds a word
as a blank does, and what is nothing but such characters is passed over.
Patterns and instances (normalised mentions) form a graph.  Spark scores it in turns: a pattern's
confidence is the mean confidence of its distinct instances, shrunk by ``DOUBT`` imaginary bad ones;
an instance that is no seed gets the noisy-or of the patterns that are sure and have the support of
``MIN_SEEDS`` distinct instances, each a seed or as sure as a pattern must be after the turn before.  So
what one turn finds carries patterns of the next.  Confidence never falls; the turns, ``ROUNDS`` at
least, end when one makes no further pattern sure and adds next to nothing (``SETTLED``) to those that
are, so that none is still on its way.  The mentions in a sure pattern that are no base
span become spans of the kind ``id``.

Base spans always stay; an ``id`` span never overlaps one.  Offsets are code points, ends exclusive.
Null text: empty, no spans.  Repeated rows get the same spans each, and count once per distinct
instance.  Any ``doc_id``, null too, is passed through.  An empty table gives an empty one.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import field, row_keys, with_row
from netloom.session import broadcast_if_small, materialize, shared_path

KINDS = ("email", "ip", "card", "phone", "id")
MIN_LENGTH, MIN_SEEDS, ROUNDS = 6, 3, 3
#: A sure pattern's least confidence, and the imaginary instances of confidence 0 that each pattern starts with.
SURE, DOUBT = 0.8, 0.5
#: Growth of all sure patterns' confidence together below which a turn counts as the last.
SETTLED = 1e-6

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match never begins inside a run of digits nor gives part of one back: each run is read once
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DIGIT = re.compile("[0-9]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
EDGES = "\"'`.,;:!?()[]{}<>|*#$%&=/\\"


def _luhn(digits: str) -> bool:
    doubled = (2 * int(c) for c in digits[-2::-2])
    return (sum(int(c) for c in digits[::-2]) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What ``EMAIL`` finds, looked for around each ``@`` only: elsewhere it would try every start of every word."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text[start - 1]):
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` by start, then kind."""
    found = [(s, 0, e) for s, e in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _looks_like_id(word: str) -> bool:
    return len(word) >= MIN_LENGTH and sum("0" <= c <= "9" for c in word) >= 3


def _plain(word: str) -> str:
    return re.sub("[0-9]", "0", word.strip(EDGES).lower())


def _pieces(text: str, cuts: list[int]) -> tuple[list[int], list[int]]:
    """Starts and ends of the words, parted at the sorted ``cuts`` too, that are more than ``EDGES`` characters."""
    starts, ends, k = [], [], 0
    for m in WORD.finditer(text):
        at, end = m.span()
        while k < len(cuts) and cuts[k] <= at:
            k += 1
        while at < end:
            to = end
            if k < len(cuts) and cuts[k] < end:
                to, k = cuts[k], k + 1
            if text[at:to].strip(EDGES):
                starts.append(at)
                ends.append(to)
            at = to
    return starts, ends


def mentions(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds and other identifier-like words with their patterns."""
    found = [(s, e, True) for s, _, e in spans]
    k, top = 0, 0
    for m in WORD.finditer(text):
        raw = m[0]
        if not DIGIT.search(raw):
            continue
        start, end = m.start() + len(raw) - len(raw.lstrip(EDGES)), m.start() + len(raw.rstrip(EDGES))
        if end <= start or not _looks_like_id(text[start:end]):
            continue
        while k < len(spans) and spans[k][0] < end:
            top = max(top, spans[k][2])
            k += 1
        if top <= start:
            found.append((start, end, False))
    starts, ends = _pieces(text, sorted({at for s, e, _ in found for at in (s, e)})) if found else ([], [])
    out = []
    for start, end, seed in found:
        before, after = bisect_left(starts, start), bisect_left(starts, end)
        left = [_plain(text[starts[i]:ends[i]]) for i in range(max(0, before - 2), before)]
        right = _plain(text[starts[after]:ends[after]]) if after < len(starts) else ""
        patterns = []
        if len(left) == 2:
            patterns += [f"{left[0]} {left[1]} _", f"{left[0]} * _"]
        if left:
            patterns.append(f"{left[-1]} _")
        if right:
            patterns.append(f"_ {right}")
        if left and right:
            patterns.append(f"{left[-1]} _ {right}")
        out.append({"start": start, "end": end, "seed": seed, "instance": text[start:end].lower(), "patterns": patterns})
    return out


SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
MENTION = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])


def _extract(text: Column) -> Column:
    @F.arrow_udf("struct<spans:array<struct<start:int,kind:int,end:int>>,mentions:array<struct<start:int,end:int,seed:boolean,instance:string,patterns:array<string>>>>")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            spans, found = [], []
            for text in batch.to_pylist():
                base = base_spans(text or "")
                spans.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
                found.append(mentions(text or "", base))
            yield pa.StructArray.from_arrays([pa.array(spans, pa.list_(SPAN)), pa.array(found, pa.list_(MENTION))], ["spans", "mentions"])

    return extract(text)


def sure_patterns(mentioned: DataFrame, rounds: int = ROUNDS, sure: float = SURE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """``pattern`` of the sure ones, from rows ``instance, seed, pattern``."""
    edges = materialize(mentioned.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    # an instance that is a seed anywhere is one everywhere
    instances = edges.groupBy("instance").agg(F.max("seed").alias("seed"))
    belief = instances.select("instance", F.col("seed").cast("double").alias("conf"), "seed")
    turn, total, more = 0, 0.0, True
    while turn < rounds or more:
        supports = (F.col("seed") | (F.col("conf") >= sure)).cast("long")
        scored = edges.select("pattern", "instance").join(belief, "instance").groupBy("pattern").agg(
            (F.sum("conf") / (F.count("*") + F.lit(DOUBT))).alias("trust"), F.sum(supports).alias("support"))
        trusted = materialize(scored.filter((F.col("trust") >= sure) & (F.col("support") >= min_seeds)).select("pattern", "trust"))
        turn, before, total = turn + 1, total, trusted.agg(F.sum("trust")).first()[0] or 0.0
        more = total - before > SETTLED
        # no less than the surest pattern, whatever the logarithms round to
        noisy_or = F.greatest(F.max("trust"), 1.0 - F.exp(F.sum(F.log(1.0 - F.col("trust")))))
        gained = edges.join(broadcast_if_small(trusted), "pattern").groupBy("instance").agg(noisy_or.alias("gain"))
        belief = materialize(instances.join(gained, "instance", "left").select(
            "instance", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("gain", F.lit(0.0))).alias("conf"), "seed"))
    return trusted.select("pattern")


def find_pii(docs: DataFrame, rounds: int = ROUNDS, sure: float = SURE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """``doc_id, text_hash, spans`` per document; spans are ``(start, kind, end)``, kind an index of ``KINDS``."""
    path = shared_path(docs.sparkSession, "mentions")
    found = docs.select("doc_id", "text", *row_keys(F.col("doc_id"), F.col("text"))).withColumn("x", _extract(F.col("text")))
    found.select("doc_id", "k1", "k2", "x.spans", "x.mentions").write.parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    flat = rows.select("k1", "k2", F.explode("mentions").alias("m")).select("k1", "k2", "m.*")
    flat = flat.withColumn("pattern", F.explode("patterns")).drop("patterns")
    patterns = sure_patterns(flat, rounds, sure, min_seeds)
    more = flat.filter("not seed").join(broadcast_if_small(patterns), "pattern", "left_semi")
    more = more.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", F.lit(KINDS.index("id")).alias("kind"), "end")).alias("more"))
    joined = rows.drop("mentions").join(more, ["k1", "k2"], "left")
    every = F.array_sort(F.concat("spans", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    return joined.select("doc_id", "k1", "k2", F.col("spans").alias("base"), every.alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def pii_spans(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of base spans, all spans, and how many were discovered."""
    found = find_pii(docs)

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(4)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
                        (F.size("spans") - F.size("base")).cast("long").alias("n_id"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in square brackets; all columns kept."""
    rows = with_row(docs)
    keyed = rows.select("row", *row_keys(field("doc_id"), field("text")))
    spans = find_pii(docs).groupBy("k1", "k2").agg(F.first("spans").alias("spans")).filter(F.size("spans") > 0)
    joined = keyed.join(spans, ["k1", "k2"], "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,end:int>>")))

    names = F.array(*[F.lit(k) for k in KINDS])

    def step(a: Column, s: Column) -> Column:
        """Copy up to the span and put its kind; of overlapping spans only what the one before leaves."""
        start = F.greatest(s["start"], a["at"])
        between = F.substring(a["text"], a["at"] + 1, start - a["at"])
        name = F.when(s["end"] > a["at"], F.concat(F.lit("["), F.get(names, s["kind"]), F.lit("]"))).otherwise("")
        return F.struct(F.concat(a["out"], between, name).alias("out"), F.greatest(s["end"], a["at"]).alias("at"), a["text"].alias("text"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), field("text").alias("text"))
    whole = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substring(a["text"], a["at"] + 1, F.length(a["text"]))))
    text = F.when(field("text").isNull() | (F.size("spans") == 0), field("text")).otherwise(whole)
    return joined.withColumn("row", F.col("row").withField("text", text)).select("row.*")
