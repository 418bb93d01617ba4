"""Exact-size samples and training batches decided by hashes, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.ranking import rank_rows

# Hex digits of the hash that samples are decided by: below 2^60, so that longs hold it without a sign.
HASH_DIGITS = 15
# Bits of the hash that one refinement decides, and the rows of a cut slice that need no further one.
REFINE_BITS = 12
SLICE_ROWS = 100_000
# Rounds of the keyed permutation; each swaps every position with a partner or leaves both.
ROUNDS = 32


def sample_hash(seed: int, *key: str) -> Column:
    """60 bits of an MD5 of seed and key (nulls are told from texts), as a long that is never negative."""
    parts = [F.coalesce(F.concat(F.lit(":"), F.col(k).cast("string")), F.lit("-")) for k in key]
    digest = F.md5(F.concat(F.lit(str(seed)), *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("long")


def _cut(hashes: DataFrame, n: int) -> tuple[int, int] | None:
    """The ``n``-th smallest of column ``h`` and how many rows before it are smaller; None if there are fewer than ``n``.

    Counts by leading bits tell which slice holds it; the slice is counted by its next bits
    until it is small.  Each turn is one aggregate to at most 4,096 numbers, which the driver adds up.
    """
    bits, low, below = 4 * HASH_DIGITS, 0, 0
    while bits:
        step = min(REFINE_BITS, bits)
        inside = hashes.filter(F.col("h").between(low, low + (1 << bits) - 1))
        bits -= step
        slices = inside.groupBy(F.shiftright(F.col("h") - low, bits).alias("slice")).agg(F.count("*").alias("rows"))
        for slice_, rows in sorted(slices.collect()):
            if below + rows >= n:
                low += slice_ << bits
                break
            below += rows
        else:
            return None
        if rows <= SLICE_ROWS:
            inside = hashes.filter(F.col("h").between(low, low + (1 << bits) - 1))
            # fewer rows than SLICE_ROWS, sorted where they are and merged
            found = [r.h for r in inside.orderBy("h").limit(n - below).collect()]
            return found[-1], below + sum(h < found[-1] for h in found)
    return low, below


def sample_n(df: DataFrame, n: int, *key: str, seed: int = 131) -> DataFrame:
    """``n`` rows without replacement (all rows if fewer), the ones with the smallest hash of ``key``.

    The hash at which the sample ends is found by radix selection, so rows are filtered where
    they are: no sort, no shuffle, no task that holds a share of the table.  Where the last hash occurs
    more often than it is needed, a hash of the whole rows decides in the same way, and rows that
    agree in that as well are the same row: any of them are taken.
    """
    if n <= 0:
        return df.limit(0)
    hashed = df.withColumn("_h", sample_hash(seed, *key))
    cut = _cut(hashed.select(F.col("_h").alias("h")), n)
    if cut is None:
        return df
    last, below = cut
    whole, edge = hashed.filter(F.col("_h") < last), hashed.filter(F.col("_h") == last)
    if edge.limit(n - below + 1).count() > n - below:
        # a sample of no key is one of whole rows
        edge = edge.limit(n - below) if set(key) == set(df.columns) else sample_n(edge.drop("_h"), n - below, *df.columns, seed=seed)
    return whole.drop("_h").unionByName(edge.drop("_h"))


# --- keyed permutations -----------------------------------------------------

_M64 = (1 << 64) - 1
# The five primes of XXH64.
_P1, _P2, _P3 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
_P4, _P5 = 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def _turn(x: int, n: int) -> int:
    return (x << n | x >> (64 - n)) & _M64


def hash_long(value: int, seed: int = 42) -> int:
    """XXH64 of an eight-byte integer: what ``xxhash64`` gives for a long, unsigned."""
    h = (seed + _P5 + 8) & _M64
    h ^= _turn(value * _P2 & _M64, 31) * _P1 & _M64
    h = (_turn(h, 27) * _P1 + _P4) & _M64
    h = (h ^ h >> 33) * _P2 & _M64
    h = (h ^ h >> 29) * _P3 & _M64
    return h ^ h >> 32


def round_keys(total: int, seed: int, epoch: int) -> list[int]:
    """Keys of the permutation of ``total`` positions for an epoch."""
    start = hash_long(epoch, hash_long(seed))
    return [hash_long(r, start) % total for r in range(ROUNDS)]


def permuted(position: Column, total: int, seed: int, epoch: int) -> Column:
    """The place of a position 0 .. total - 1 in the order of an epoch: a swap-or-not network, one to one for any total."""
    keys = F.array(*[F.lit(k).cast("long") for k in round_keys(total, seed, epoch)])

    def swap(x: Column, key: Column) -> Column:
        partner = F.pmod(key - x, F.lit(total))
        # partners agree on the larger of the two and so on whether they swap
        odd = F.xxhash64(key, F.greatest(x, partner)).bitwiseAND(F.lit(1)) == 1
        return F.when(odd, partner).otherwise(x)

    return F.aggregate(keys, position.cast("long"), swap)


def position_at(place: int, total: int, seed: int, epoch: int) -> int:
    """The position that ``permuted`` puts at ``place``: its swaps undone in reverse."""
    x = place
    for key in reversed(round_keys(total, seed, epoch)):
        partner = (key - x) % total
        if hash_long(max(x, partner), hash_long(key)) & 1:
            x = partner
    return x


def dense_positions(df: DataFrame, *key: str, seed: int = 131, name: str = "pos") -> DataFrame:
    """Add positions 0, 1, ... in the order of a hash of ``key``, ties by the key."""
    hashed = df.withColumn("_h", sample_hash(seed, *key))
    ranked = rank_rows(hashed, F.asc("_h"), *[F.asc(k) for k in key], name=name)
    return ranked.withColumn(name, F.col(name) - 1).drop("_h")


def shuffled_batches(df: DataFrame, size: int, *key: str, epoch: int = 0, seed: int = 131) -> DataFrame:
    """A ``batch`` number per row so that batches hold exactly ``size`` rows, the last one the rest; another mix each epoch."""
    placed = dense_positions(df, *key, seed=seed, name="_pos")
    total = placed.count()
    place = permuted(F.col("_pos"), total, seed, epoch) if total else F.lit(0)
    return placed.withColumn("batch", F.floor(place / size).cast("long")).drop("_pos")


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in the given order."""
    return df.orderBy(*order).limit(n)
