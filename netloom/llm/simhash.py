"""SimHash near-duplicates by multi-index hashing (operator 6).

A fingerprint is cut into segments.  If two fingerprints differ in at most ``r`` bits,
then, with ``m`` segments and ``r = m*a + b``, either one of the first ``b + 1`` segments
differs in at most ``a`` bits or one of the others in at most ``a - 1``.  So the small
Hamming ball around each segment is enumerated, its values are looked up in the table of
that segment, and what is found is verified on all 64 bits.

A bucket of one segment value could hold any share of the corpus.  The distance that is left
for the rest of the fingerprint is known for each member of the ball (``r`` less its
weight), so the rest, cut into that many blocks and one more, has an equal block: each
lookup carries one such block and buckets stay small whatever the data.

Copies of a fingerprint are one entry of the tables.  Null and empty texts have fingerprint
0 and are linked like any other; a null ``doc_id`` takes part but never names a component
(a component of null ids only has the id null); repeated rows give repeated results; an
empty table gives an empty one; other columns are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import components, field, row_keys, with_row
from netloom.session import materialize

#: Contract of the operator: words in a shingle, and bits in which linked fingerprints differ at most.
SHINGLE_WORDS, MAX_BITS = 3, 2
#: Shingle hashes whose bits are counted at a time; bounds the memory of one text.
HASHES_AT_A_TIME = 1 << 16


def _fingerprint(text: str | None, shingle: int) -> int:
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    if len(words) > shingle:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    else:
        grams = iter([b" ".join(words)])
    total, ones = 0, np.zeros(64, np.int64)
    hashed = map(xxhash.xxh64_intdigest, grams, repeat(42))
    while (h := np.fromiter(islice(hashed, HASHES_AT_A_TIME), np.dtype(">u8"))).size:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += h.size
        if h.size < HASHES_AT_A_TIME:
            break
    return int(np.packbits(2 * ones > total).view(">i8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE_WORDS) -> Column:
    """The 64-bit SimHash of a text as a long: lower-cased words, XXH64 of every shingle, majority per bit."""
    @F.pandas_udf("long")
    def simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([_fingerprint(t, shingle) for t in batch], dtype="int64")

    return simhash(text)


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _ball(width: int, radius: int) -> list[list[int]]:
    """The masks of ``width`` bits by their weight, 0 to ``radius``."""
    return [[sum(1 << i for i in c) for c in combinations(range(width), k)] for k in range(radius + 1)]


def _blocks(bits: list[int], n: int) -> list[int]:
    """Masks of the 64-bit positions ``bits`` cut into ``n`` blocks, as signed longs."""
    cuts = np.array_split(np.array(bits), n)
    masks = [sum(1 << int(i) for i in c) for c in cuts]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, max_bits: int = MAX_BITS, segments: int = 2) -> DataFrame:
    """All pairs ``(a, b)``, a < b, of the distinct fingerprints ``fp`` that differ in 1 to ``max_bits`` bits."""
    width = 64 // segments
    radius, rest = divmod(max_bits, segments)
    probes, tables = [], []
    for s in range(segments):
        low = s * width
        high = 64 if s == segments - 1 else low + width
        mask = _signed(sum(1 << i for i in range(low, high)))
        around = [i for i in range(64) if not low <= i < high]
        for weight, ball in enumerate(_ball(high - low, radius if s <= rest else radius - 1)):
            flips = F.explode(F.array(*[F.lit(_signed(m << low)) for m in ball]))
            blocks = F.array(*[F.lit(b) for b in _blocks(around, max_bits - weight + 1)])
            scheme = F.lit(s * 100 + weight)
            member = fps.select("fp", flips.alias("flip")).select(
                "fp", F.col("fp").bitwiseAND(F.lit(mask)).bitwiseXOR(F.col("flip")).alias("value"))
            for target, source in ((probes, member), (tables, fps.select("fp", F.col("fp").bitwiseAND(F.lit(mask)).alias("value")))):
                target.append(source.select("fp", "value", F.posexplode(blocks).alias("block", "cut")).select(
                    "fp", (scheme * 100 + F.col("block")).alias("slot"), "value", F.col("fp").bitwiseAND(F.col("cut")).alias("rest")))

    def union(parts):
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    key = ["slot", "value", "rest"]
    found = union(probes).withColumnRenamed("fp", "a").join(union(tables).withColumnRenamed("fp", "b"), key)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return found.filter((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def simhash_components(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(fp, component_id)`` for rows ``(doc_id, fp)``: the smallest id reachable over linked fingerprints."""
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(nodes.select("fp"), max_bits))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(named, "root").select("fp", "component_id", "root")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``."""
    fps = materialize(docs.select("doc_id", fingerprint(F.col("text"), shingle).alias("fp")))
    return fps.join(simhash_components(fps, max_bits), "fp").select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents without near copies: of each component the row with the smallest id stays, all columns kept.

    Of several rows with that id one stays: that with the smallest hash, or, when rows are
    the same in id and text, any one of them.
    """
    rows = with_row(docs)
    keys = row_keys(field("doc_id"), field("text"))
    fps = materialize(rows.select(*keys, field("doc_id").alias("doc_id"), fingerprint(field("text"), shingle).alias("fp")))
    groups = simhash_components(fps, max_bits).select("fp", "root")
    best = fps.join(groups, "fp").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("k1"), F.col("k2"))).alias("best"))
    stay = best.select(F.col("best.k1").alias("k1"), F.col("best.k2").alias("k2"))
    first = Window.partitionBy("k1", "k2").orderBy("k2")
    kept = rows.select("row", *keys).join(stay, ["k1", "k2"]).withColumn("n", F.row_number().over(first))
    return kept.filter("n = 1").select("row.*")
