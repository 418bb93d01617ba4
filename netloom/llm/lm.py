"""Scoring texts with a context-tree weighted byte model (operator 9).

A text is its lower-cased words and one end, written as a running stream of bytes: each word and a blank,
then a line feed.  The context of a byte is the ``depth`` bytes before it in that stream, across words
(blanks before the start, so the context tree is whole).  Bytes are decomposed
into eight binary decisions.  A node of the tree is (context, bits of the byte so far) with the counts
of both bits; its Krichevsky-Trofimov estimate and the product of its children are mixed half and half
at every depth.  After learning, a bit's probability is the path's mixture of the KT estimates at all
depths with their posterior weights; its code length per byte is ``-log2``.

Everything follows from counts.  Tasks sort the packed (context, byte) pairs of their texts and pass on each
pair once with its number; Spark sums these.  All pairs whose contexts end alike but for the ``LOCAL`` oldest
bytes are a subtree of their own: the lowest levels of many subtrees are worked out together, group by group.
The levels above are summed one by one up to the root (one aggregate each) and the paths weighted from the
root down (one join each), then within the groups again.  A text's score is a sum over its pairs.  The most frequent pairs and words go to every worker as
tables of bounded size (``COMMON_PAIRS``, ``COMMON``): these are most of the running text, and the hot keys
of the join.  What is left of each text is counted and looked up by a shuffle join.

Null text: empty, the end only.  Null ``doc_id``: taken as the empty text, whose checksum is 0, so held
out.  Repeated rows are learned and scored each.  Empty table: empty result.  All texts held out: the
untrained model, one bit per bit.  Pairs that were never learned stand in the tree with counts of 0.
Texts of any length are read in pieces of ``PIECE`` bytes, each with the context before it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import log_gamma
from netloom.session import shared_path

#: Bytes of context; up to 7, with the byte itself, fit into a long.
DEPTH = 6
#: Words whose counts, and pairs whose scores, every worker keeps.
COMMON, COMMON_PAIRS = 200_000, 2_000_000
#: Distinct words and distinct pairs that a task counts before it passes them on.
COUNTED, COUNTED_PAIRS = 400_000, 4_000_000
#: Levels that are worked out within a subtree (one of at most ``256 ** (LOCAL + 1)`` pairs), and pairs of a group of subtrees on average.
LOCAL, GROUP_PAIRS = 2, 65_536
#: Texts, and bytes of their stream, that a task looks at together.
TEXTS, PIECE = 1024, 2_000_000
LN2 = math.log(2.0)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split() if text else []


def count_words(docs: DataFrame) -> DataFrame:
    """``word, c, n``: how often training texts and all texts have each word."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            for held, c in enumerate(counted):
                if c:
                    n = pa.array(c.values(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.binary()), pa.array(np.zeros(len(c), np.int64)) if held else n, n], ["word", "c", "n"])
                    c.clear()

        for batch in batches:
            for text, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counted[held].update(tokens(text))
                if len(counted[0]) + len(counted[1]) > COUNTED:
                    yield from flush()
        yield from flush()

    parts = docs.select("text", held_out(F.col("doc_id")).alias("held")).mapInArrow(count, "word binary, c long, n long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def _stream(texts: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The streams of texts given as words, one behind the other with ``depth`` blanks before each, and where each one starts."""
    pad = b" " * depth
    parts = [pad + b" ".join([*ws, b"\n"]) for ws in texts]
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    return np.frombuffer(b"".join(parts), np.uint8), np.append(0, ends)


def _keys(data: np.ndarray, starts: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Where a piece of the stream begins, the packed (context, byte) of its bytes, and which of these are blanks before a text."""
    room = np.append(np.zeros(7, np.uint8), data)  # eight bytes can be read up to each place
    last_eight = np.ndarray(len(data), ">u8", room.data, strides=(1,))
    before = (starts[:-1, None] + np.arange(depth)).ravel()
    for low in range(0, len(data), PIECE):
        key = (last_eight[low:low + PIECE] & np.uint64((1 << 8 * depth + 8) - 1)).astype(np.uint64).view(np.int64)
        pads = before[slice(*np.searchsorted(before, [low, low + len(key)]))] - low
        yield low, key, pads


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of the counts of each."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(n[order], first)


def pair_counts(docs: DataFrame, depth: int) -> DataFrame:
    """``key, n``: training occurrences of each packed (context, byte) of any text, also of those with none."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def merged() -> pa.RecordBatch:
            key, n = _summed(keys, counts)
            keys[:], counts[:] = [key], [n]
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

        for batch in batches:
            for part in (batch.slice(i, TEXTS) for i in range(0, batch.num_rows, TEXTS)):
                held = part.column(1).to_pylist()
                texts = [tokens(text) for text in part.column(0).to_pylist()]
                for out in (False, True):
                    for _, key, pads in _keys(*_stream([ws for ws, h in zip(texts, held, strict=True) if h == out], depth), depth):
                        distinct, n = np.unique(np.delete(key, pads), return_counts=True)
                        keys.append(distinct)
                        counts.append(np.zeros(len(n), np.int64) if out else n)
                        if sum(map(len, keys)) > COUNTED_PAIRS:
                            found = merged()
                            if found.num_rows > COUNTED_PAIRS // 2:
                                yield found
                                keys.clear()
                                counts.clear()
        if keys:
            yield merged()

    parts = docs.select("text", held_out(F.col("doc_id")).alias("held")).mapInArrow(count, "key long, n long")
    # tasks have summed their pairs already: dealt first, they are not summed once more before the shuffle
    return parts.repartition("key").groupBy("key").agg(F.sum("n").alias("n"))


def _log_kt() -> Column:
    a, b = F.col("n0").cast("double"), F.col("n1").cast("double")
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - F.lit(math.log(math.pi))


def _one() -> Column:
    """The KT probability that the next bit is 1."""
    return (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)


def _kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The logarithms of the KT estimates of whole sequences, by Stirling's series at x + 8."""
    def log_gamma_of(x: np.ndarray) -> np.ndarray:
        z = x + 8.0
        i = 1.0 / z
        series = i * (1 / 12 - i * i * (1 / 360 - i * i * (1 / 1260 - i * i * (1 / 1680 - i * i / 1188))))
        steps = sum(np.log(x + k) for k in range(8))
        return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - steps

    return log_gamma_of(n0 + 0.5) + log_gamma_of(n1 + 0.5) - log_gamma_of(n0 + n1 + 1.0) - math.log(math.pi)


class _Subtrees:
    """The nodes of whole subtrees, level by level from the deepest to depth ``top``.

    A node is its context, shifted by 8, and the bits before its decision behind a leading 1: a mask
    takes away the oldest byte.  ``levels`` holds nodes, counts and weighted logarithms; ``above`` where each
    node's parent stands in the next level; ``nodes`` the eight nodes of each pair in the deepest.
    """

    def __init__(self, key: np.ndarray, n: np.ndarray, depth: int, top: int):
        key = key.view(np.uint64)
        byte = (key & np.uint64(255)).astype(np.int64)[:, None]
        k = np.arange(8)
        self.bit = byte >> (7 - k) & 1
        node, at = np.unique((key >> np.uint64(8) << np.uint64(8))[:, None] | ((byte + 256) >> (8 - k)).astype(np.uint64), return_inverse=True)
        self.nodes = at.reshape(-1, 8)
        n1 = np.bincount(self.nodes.ravel(), (n[:, None] * self.bit).ravel(), len(node))
        n0 = np.bincount(self.nodes.ravel(), (n[:, None] * (1 - self.bit)).ravel(), len(node))
        self.levels, self.above = [(node, n0, n1, _kt(n0, n1))], []
        for d in range(depth - 1, top - 1, -1):
            below = self.levels[-1]
            node, at = np.unique(below[0] & np.uint64((1 << 8 * d + 8) - 1), return_inverse=True)
            n0, n1, product = (np.bincount(at, x, len(node)) for x in below[1:])
            self.levels.append((node, n0, n1, np.logaddexp(_kt(n0, n1), product) - LN2))
            self.above.append(at)

    def bits(self, got: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Each pair's log2 probability, from what the levels above the top give and leave to its nodes."""
        for (_, n0, n1, weighted), at in zip(self.levels[:0:-1], self.above[::-1], strict=True):
            share = left * np.minimum(1.0, np.exp(_kt(n0, n1) - LN2 - weighted))
            got, left = (got + share * (n1 + 0.5) / (n0 + n1 + 1.0))[at], (left - share)[at]
        _, n0, n1, _ = self.levels[0]
        one = (got + left * (n1 + 0.5) / (n0 + n1 + 1.0))[self.nodes]
        return np.log2(np.where(self.bit == 1, one, 1.0 - one)).sum(axis=1)


def pair_scores(pairs: DataFrame, depth: int) -> DataFrame:
    """``key, n, bits``: the log2 probability of each pair's byte in its context under the weighted tree."""
    top = max(0, depth - LOCAL)
    groups = pairs.count() // GROUP_PAIRS + 1

    def group(ctx: Column) -> Column:
        return F.pmod(F.xxhash64(ctx), F.lit(groups)).alias("g")

    def arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        key, n = table["key"].to_numpy(), table["n"].to_numpy()
        order = np.argsort(key)
        return key[order], n[order]

    def nodes(table: pa.Table) -> pa.Table:
        node, n0, n1, weighted = _Subtrees(*arrays(table), depth, top).levels[-1]
        return pa.table({"ctx": (node >> np.uint64(8)).astype(np.int64), "node": (node & np.uint64(255)).astype(np.int32),
                         "n0": n0.astype(np.int64), "n1": n1.astype(np.int64), "pw": weighted})

    def scored(table: pa.Table, path: pa.Table) -> pa.Table:
        key, n = arrays(table)
        order = np.lexsort((path["node"].to_numpy(), path["ctx"].to_numpy()))  # as the top's nodes stand
        bits = _Subtrees(key, n, depth, top).bits(path["got"].to_numpy()[order], path["left"].to_numpy()[order])
        return pa.table({"key": key, "n": n, "bits": bits})

    tail = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << 8 * top) - 1))
    grouped = pairs.select(group(tail), "key", "n").groupBy("g")
    level = _written(grouped.applyInArrow(nodes, "ctx long, node int, n0 long, n1 long, pw double"), "level")
    levels = [level]
    for d in range(top - 1, -1, -1):
        up = level.groupBy(F.col("ctx").bitwiseAND(F.lit((1 << 8 * d) - 1)).alias("ctx"), "node").agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("pw").alias("below")).withColumn("kt", _log_kt())
        larger = F.greatest("kt", "below")
        mixed = larger + F.log(F.exp(F.col("kt") - larger) + F.exp(F.col("below") - larger)) - F.lit(LN2)
        level = _written(up.select("ctx", "node", "n0", "n1", mixed.alias("pw")), "level")
        levels.append(level)
    # from the root: ``got`` is what the shallower depths give to a 1, ``left`` the weight that goes on
    share = F.col("left") * F.least(F.lit(1.0), F.exp(_log_kt() - F.lit(LN2) - F.col("pw")))
    path = levels.pop().withColumn("got", F.lit(0.0)).withColumn("left", F.lit(1.0))
    for d in range(1, top + 1):
        parent = path.select(F.col("ctx").alias("up"), "node", (F.col("got") + share * _one()).alias("got"), (F.col("left") - share).alias("left"))
        child = levels.pop().withColumn("up", F.col("ctx").bitwiseAND(F.lit((1 << 8 * (d - 1)) - 1)))
        path = child.join(parent, ["up", "node"]).drop("up")
    paths = path.select(group(F.col("ctx")), "ctx", "node", "got", "left").groupBy("g")
    return grouped.cogroup(paths).applyInArrow(scored, "key long, n long, bits double")


def _most_frequent(df: DataFrame, limit: int) -> pa.Table:
    """Rows of the greatest ``n``, at most ``limit``: all whose ``n`` reaches a bound that eighths of octaves decide."""
    octave = F.when(F.col("n") > 0, F.floor(F.log2("n") * 8)).otherwise(-1)
    sizes = sorted(df.groupBy(octave.alias("o")).count().collect(), reverse=True)  # a row per eighth of an octave
    bound, room = math.inf, limit
    for o, rows in sizes:
        if rows > room:
            break
        bound, room = o, room - rows
    return df.filter(octave >= F.lit(float(bound))).toArrow()


def _shared(spark, table: pa.Table) -> Broadcast:
    packed = pa.BufferOutputStream()
    with pa.ipc.new_stream(packed, table.schema) as stream:
        stream.write_table(table)
    return spark.sparkContext.broadcast(packed.getvalue().to_pybytes())


class _Values:
    """The value of each of some distinct keys: an open-addressed table with key and value side by side, read array by array."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (2 * len(keys)).bit_length())
        place = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        slot = self._slot(keys)
        while len(left):
            free = place[slot] < 0
            place[slot[free]] = left[free]
            lost = place[slot] != left
            left, slot = left[lost], self._next(slot[lost])
        table = np.zeros((len(place), 2), np.int64)
        table[:, 0] = np.append(keys, 0)[place]
        table[:, 1] = np.append(values, np.nan).view(np.int64)[place]  # not a number: a free slot
        self.table = table.view(np.complex128)[:, 0]  # sixteen bytes that are fetched as one element

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # Fibonacci hashing: 2^64 over the golden ratio
        return (mixed >> np.uint64(64 - self.bits)).view(np.int64)

    def _next(self, slot: np.ndarray) -> np.ndarray:
        return (slot + 1) & ((1 << self.bits) - 1)

    def _fetch(self, slot: np.ndarray) -> np.ndarray:
        return self.table.take(slot).view(np.int64).reshape(-1, 2)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, not a number for those that are not there."""
        slot = self._slot(keys)
        here = self._fetch(slot)
        out = here[:, 1].copy().view(np.float64)
        left = np.flatnonzero(here[:, 0] != keys)
        left = left[~np.isnan(out[left])]
        while len(left):
            slot[left] = self._next(slot[left])
            here = self._fetch(slot[left])
            out[left] = here[:, 1].copy().view(np.float64)
            left = left[(here[:, 0] != keys[left]) & ~np.isnan(out[left])]
        return out


def _log10_base(c: int | np.ndarray, total: int, distinct: int):
    return np.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))


def lm_scores(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    vocabulary = _written(count_words(docs), "vocabulary")
    trained = docs.filter(~held_out(F.col("doc_id"))).count()
    sums = vocabulary.agg(F.sum("c").alias("c"), F.count_if(F.col("c") > 0).alias("v")).first()
    total, distinct = (sums["c"] or 0) + trained, (sums["v"] or 0) + (trained > 0)
    scores = _written(pair_scores(_written(pair_counts(docs, depth), "pairs"), depth), "scores")
    words = _shared(spark, _most_frequent(vocabulary, COMMON).select(["word", "c"]))
    pairs = _shared(spark, _most_frequent(scores, COMMON_PAIRS).select(["key", "bits"]))
    rows = _written(_with_common(docs, depth, words, pairs, total, distinct), "rows")
    base = F.log10((F.col("c") + 0.1) / F.lit(total + 0.1 * (distinct + 1)))
    rare = rows.select("rid", F.explode("rare_words").alias("r")).select("rid", "r.word", "r.times").join(vocabulary, "word").groupBy("rid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"), F.sum(F.col("times") * base).alias("rare_base"))
    left = rows.select("rid", F.explode("rare_pairs").alias("r")).select("rid", "r.key", "r.times").join(scores, "key").groupBy("rid").agg(
        F.sum(F.col("times") * F.col("bits")).alias("rare_bits"))
    zero = F.lit(0.0)
    out = rows.drop("rare_words", "rare_pairs").join(rare, "rid", "left").join(left, "rid", "left")
    bits = F.col("bits") + F.coalesce("rare_bits", zero)
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), (F.col("n_tokens") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(trained > 0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", zero) + F.lit(float(_log10_base(trained, total, distinct)))).alias("base_score"),
        (bits * F.lit(math.log10(2.0))).alias("score"), (-bits / F.col("n_bytes")).alias("bits_per_byte"))


def _written(df: DataFrame, label: str) -> DataFrame:
    """A compressed copy in the shared folder, read again: the same rows whatever is computed twice."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _lists(owner: np.ndarray, key: np.ndarray, texts: int) -> pa.ListArray:
    """Per text its distinct keys and how often each occurs."""
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(key)))
    offsets = np.searchsorted(owner[first], np.arange(texts + 1))
    items = pa.StructArray.from_arrays([pa.array(key[first]), pa.array(times.astype(np.int32))], ["key", "times"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)


def _with_common(docs: DataFrame, depth: int, words: Broadcast, pairs: Broadcast, total: int, distinct: int) -> DataFrame:
    """A row number per document, the sums over its common words and pairs, and its other words and pairs with their counts."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = pa.ipc.open_stream(words.value).read_all()
        place = {w: i for i, w in enumerate(common["word"].to_pylist())}
        counts = common["c"].to_numpy().astype(np.int64)
        known = np.append(counts > 0, False)
        base = np.append(_log10_base(counts, total, distinct), 0.0)
        scored = pa.ipc.open_stream(pairs.value).read_all()
        values = _Values(scored["key"].to_numpy(), scored["bits"].to_numpy())
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in (batch.slice(i, TEXTS) for i in range(0, batch.num_rows, TEXTS)):
                texts = [tokens(text) for text in part.column(1).to_pylist()]
                data, starts = _stream(texts, depth)
                bits, rare_keys, rare_owners = np.zeros(len(texts)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for low, key, pads in _keys(data, starts, depth):
                    found = values.of(key)
                    found[pads] = 0.0
                    rare = np.flatnonzero(np.isnan(found))
                    found[rare] = 0.0
                    first, end = np.searchsorted(starts, [low, low + len(key)])
                    cuts = np.append([0] if first == len(starts) or starts[first] > low else [], starts[first:end] - low).astype(np.int64)
                    whose = np.arange(end - len(cuts), end)
                    bits[whose] += np.add.reduceat(found, cuts)
                    rare_keys.append(key[rare])
                    rare_owners.append(np.searchsorted(starts, rare + low, "right") - 1)
                sums: dict[str, list] = {k: [] for k in ("n_tokens", "known", "base", "rare")}
                rare_words: list[bytes] = []
                rare_times: list[int] = []
                for ws in texts:
                    at = np.fromiter(map(place.get, ws, repeat(-1)), np.int64, len(ws))
                    rare_of = Counter([ws[i] for i in np.flatnonzero(at < 0).tolist()])
                    rare_words += rare_of.keys()
                    rare_times += rare_of.values()
                    for column, value in zip(sums.values(), (len(ws), known[at].sum(), base[at].sum(), len(rare_of)), strict=True):
                        column.append(value)
                items = pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_times, pa.int32())], ["word", "times"])
                offsets = pa.array(np.append(0, np.cumsum(sums["rare"], dtype=np.int64)), pa.int32())
                arrays = {
                    "doc_id": part.column(0), "rid": pa.array(np.arange(rid, rid + len(texts))), "n_tokens": pa.array(sums["n_tokens"], pa.int64()),
                    "n_bytes": pa.array(np.diff(starts) - depth), "known": pa.array(sums["known"], pa.int64()), "base": pa.array(sums["base"], pa.float64()),
                    "bits": pa.array(bits), "rare_words": pa.ListArray.from_arrays(offsets, items),
                    "rare_pairs": _lists(np.concatenate(rare_owners), np.concatenate(rare_keys), len(texts))}
                rid += len(texts)
                yield pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(score, f"doc_id {kind}, rid long, n_tokens long, n_bytes long, known long, base double, bits double, "
                           "rare_words array<struct<word:binary,times:int>>, rare_pairs array<struct<key:long,times:int>>")
