"""Target-distribution importance resampling over hashed word runs (operator 12).

Features are runs of consecutive words; a feature's bucket is the CRC-32 of its bytes.  The
CRC is affine: it is the exclusive or of one contribution per byte, which depends on the byte
and its distance from the end only, and a constant of the length.  So the runs of a whole
Arrow batch are hashed at once: contributions are looked up by distance and byte and folded
with ``bitwise_xor.reduceat`` over the spans.  A span longer than the table is cut into
blocks from its end; neighbouring blocks are then folded pairwise, the left one advanced
over the zeros that the right one stands for.

Bucket counts of the documents and of the target are added up per task and then by bucket;
the driver sees ``buckets`` numbers, whatever the input.  Gains are log ratios of smoothed
shares; a document's weight is the floored mean of its gains, its score adds a Gumbel draw
from a hash of its id, and the highest scores are drawn without replacement.

Null and empty texts have no feature, weight 0, and are never drawn (fewer than
``min_words`` words); a null ``doc_id`` is hashed as an empty text and comes last among
equal scores; rows that repeat an id share its draw, rows alike in every returned column
are drawn in any order; empty tables give empty results, an empty target gives gains by the
documents alone; other columns are neither read nor changed.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import field, row_keys, with_row
from netloom.operators.ranking import rank_rows
from netloom.session import materialize

#: Contract of the operator: longest run of words, buckets, percent drawn, least words of a drawn document, seed.
MAX_RUN, BUCKETS, PERCENT, MIN_WORDS, SEED = 2, 10_000, 25, 20, 7
#: Fixed value: the reversed generator polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Distances from the end that the position table covers; also the length of a block of a longer span.
REACH = 64
#: Bytes of texts hashed together, and contributions looked up at a time; both bound a task's memory.
TEXT_BYTES, GATHER = 1 << 20, 1 << 20

#: What a byte of a text becomes: A-Z their small letters, what is in no word a blank.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _one_byte() -> np.ndarray:
    """The register after one byte, from a register of zero."""
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, (state >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), state >> np.uint32(1))
    return state


def _position_table(reach: int) -> np.ndarray:
    """Contribution of a byte by its distance from the end, flat: ``[distance * 256 + byte]``."""
    rows = [_one_byte()]
    for _ in range(reach - 1):
        rows.append((rows[-1] >> np.uint32(8)) ^ rows[0][rows[-1] & np.uint32(255)])
    return np.concatenate(rows)


TABLE = _position_table(REACH)
LENGTH_CONSTANTS = np.array([zlib.crc32(bytes(n)) for n in range(REACH + 1)], np.uint32)


class _Zeros:
    """Advances registers over a number of zero bytes: four look-ups, since the step is linear."""

    def __init__(self, parts: np.ndarray):
        self.parts = parts

    @classmethod
    def over(cls, n: int) -> "_Zeros":
        parts = np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32))[:, None]
        for _ in range(n):
            parts = (parts >> np.uint32(8)) ^ TABLE[:256][parts & np.uint32(255)]
        return cls(parts)

    def __call__(self, state: np.ndarray) -> np.ndarray:
        out = self.parts[0][state & np.uint32(255)]
        for j in (1, 2, 3):
            out = out ^ self.parts[j][(state >> np.uint32(8 * j)) & np.uint32(255)]
        return out

    def twice(self) -> "_Zeros":
        return _Zeros(self(self.parts))


def _spread(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The exclusive or of contributions of each span of 1 to ``REACH`` bytes."""
    out = np.empty(len(starts), np.uint32)
    sizes = ends - starts
    reach = np.cumsum(sizes)
    lo = 0
    while lo < len(starts):
        base = reach[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(reach, base + GATHER, "right")))
        n = sizes[lo:hi]
        offsets = reach[lo:hi] - n - base
        at = np.arange(int(n.sum())) + np.repeat(starts[lo:hi] - offsets, n)
        distance = np.repeat(ends[lo:hi] - 1, n) - at
        out[lo:hi] = np.bitwise_xor.reduceat(TABLE[distance * 256 + data[at]], offsets)
        lo = hi
    return out


def _fold_blocks(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One register per span from those of its blocks, of which the last ones are of ``REACH`` bytes."""
    step = _Zeros.over(REACH)
    while (counts > 1).any():
        # an empty block before a span of an odd number of blocks changes nothing
        firsts = np.cumsum(counts) - counts
        values = np.insert(values, firsts[counts % 2 == 1], 0)
        values = step(values[0::2]) ^ values[1::2]
        counts = (counts + 1) // 2
        step = step.twice()
    return values


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each non-empty span ``data[start:end]`` of bytes."""
    sizes = ends - starts
    out = np.empty(len(starts), np.uint32)
    short = sizes <= REACH
    out[short] = _spread(data, starts[short], ends[short]) ^ LENGTH_CONSTANTS[sizes[short]]
    if not short.all():
        first, last, long = starts[~short], ends[~short], sizes[~short]
        counts = -(-long // REACH)
        which = np.repeat(np.arange(len(long)), counts)
        # blocks still to come after this one in its span
        left = np.repeat(np.cumsum(counts), counts) - 1 - np.arange(len(which))
        high = last[which] - left * REACH
        blocks = _spread(data, np.maximum(high - REACH, first[which]), high)
        distinct, at = np.unique(long, return_inverse=True)
        constants = np.array([zlib.crc32(bytes(int(n))) for n in distinct], np.uint32)
        out[~short] = _fold_blocks(blocks, counts) ^ constants[at]
    return out


def run_buckets(texts: list[str | None], max_run: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words per text, and text number and bucket of every run of 1 to ``max_run`` words."""
    lines = [b" ".join(t.encode("utf-8", "replace").translate(_FOLD).split()) if t else b"" for t in texts]
    n_words = np.array([x.count(b" ") + 1 if x else 0 for x in lines], np.int64)
    data = np.frombuffer(b" ".join(x for x in lines if x), np.uint8)
    if not len(data):
        return n_words, np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(data == 0x20)
    starts, ends = np.r_[0, gaps + 1], np.r_[gaps, len(data)]
    owner = np.repeat(np.arange(len(texts)), n_words)
    owners, found = [], []
    for run in range(1, min(max_run, len(starts)) + 1):
        inside = owner[: len(owner) - run + 1] == owner[run - 1:]
        first, last = starts[: len(starts) - run + 1][inside], ends[run - 1:][inside]
        found.append(span_crcs(data, first, last).astype(np.int64) % buckets)
        owners.append(owner[run - 1:][inside])
    return n_words, np.concatenate(owners), np.concatenate(found)


def _groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts in groups of about ``TEXT_BYTES``; a longer text is a group of its own."""
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t) if t else 0
        if held >= TEXT_BYTES:
            yield group
            group, held = [], 0
    if group:
        yield group


def bucket_counts(rows: DataFrame, text: str = "text", max_run: int = MAX_RUN, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)`` over all runs of all rows: each task adds up its own, one row per bucket and task is shuffled."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for group in _groups(batch.column(0).to_pylist()):
                total += np.bincount(run_buckets(group, max_run, buckets)[2], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})

    return rows.select(F.col(text)).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, max_run: int = MAX_RUN, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket in thousandths: floored log ratio of its smoothed shares in target and documents."""
    def counts(rows: DataFrame) -> np.ndarray:
        out = np.zeros(buckets)
        for r in bucket_counts(rows, max_run=max_run, buckets=buckets).collect():
            out[r["bucket"]] = r["n"]
        return out

    s, t = counts(raw), counts(target)
    above, below = float(s.sum()) + buckets, float(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log((b + 1) * above / ((a + 1) * below))) for a, b in zip(s, t)], np.int64)


def measure(text: Column, gain: np.ndarray, max_run: int = MAX_RUN) -> Column:
    """``n_words, n_features, weight`` of a text as a struct; the weight is the floored mean gain of its features."""
    @F.pandas_udf("n_words long, n_features long, weight long")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for group in _groups([t if isinstance(t, str) else None for t in batch]):
                n_words, owner, bucket = run_buckets(group, max_run, len(gain))
                n = np.bincount(owner, minlength=len(group))
                total = np.zeros(len(group), np.int64)
                np.add.at(total, owner, gain[bucket])
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                out.append(pd.DataFrame({"n_words": n_words, "n_features": n, "weight": weight}))
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame({"n_words": [], "n_features": [], "weight": []}, dtype="int64")

    return weigh(text)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel draw in thousandths, floored, from a hash of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _ranked(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """``rank`` of the drawn rows among ``(doc_id, n_words, score, ...)``, null for the others."""
    fit = F.col("n_words") >= min_words
    draw = scored.filter(fit).count() * percent // 100
    order = [F.desc(fit), F.desc("score"), F.asc_nulls_last("doc_id"), *[F.asc(c) for c in scored.columns if c not in ("score", "doc_id")]]
    return rank_rows(scored, *order).withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")).cast("long"))


def scored_documents(
    docs: DataFrame, target: DataFrame, max_run: int = MAX_RUN, buckets: int = BUCKETS, percent: int = PERCENT,
    min_words: int = MIN_WORDS, seed: int = SEED,
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_features, weight, score, rank``; ``rank`` is null for those not drawn."""
    gain = gains(docs, target, max_run, buckets)
    measured = docs.select("doc_id", measure(F.col("text"), gain, max_run).alias("m")).select("doc_id", "m.*")
    scored = materialize(measured.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    return _ranked(scored, percent, min_words)


def drawn_documents(
    docs: DataFrame, target: DataFrame, max_run: int = MAX_RUN, buckets: int = BUCKETS, percent: int = PERCENT,
    min_words: int = MIN_WORDS, seed: int = SEED,
) -> DataFrame:
    """The drawn documents with all their columns; of rows alike in id and text any are taken, as many as are drawn."""
    gain = gains(docs, target, max_run, buckets)
    rows = with_row(docs)
    keyed = rows.select(field("doc_id").alias("doc_id"), *row_keys(field("doc_id"), field("text")),
                        measure(field("text"), gain, max_run).alias("m")).select("doc_id", "k1", "k2", "m.*")
    scored = materialize(keyed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    taken = _ranked(scored, percent, min_words).filter("rank is not null").groupBy("k1", "k2").agg(F.count("*").alias("copies"))
    alike = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k2"))
    found = rows.select("row", *row_keys(field("doc_id"), field("text"))).join(taken, ["k1", "k2"])
    return found.withColumn("nth", alike).filter("nth <= copies").select("row.*")

