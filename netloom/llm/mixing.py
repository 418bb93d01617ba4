"""Mixing sources to target weights by subset-sum budget fitting (operator 10).

Every source gets a target number of words.  Whole passes over the source come first; what is left
of the budget is fitted with whole documents.  Documents are counted by exact length; each length
gives its share of the rest, rounded down along falling lengths so that less than one longest
document stays open.  Some are handed back, so that there is a choice, and a bounded-knapsack
program over the lengths still to be had closes the gap.
Which documents of a length are taken is decided by a seeded hash.

Only counts by (source, length) meet in one place: one row per source, as long as it has distinct
lengths.  The choice within a length is a hash threshold: buckets of about the square root of the
count are counted, and only the bucket that holds the threshold is ranked, so a length that a third
of all documents share is neither sorted nor gathered.

Null text: length 0, target 0.  Null source: a source of its own, the last.  Documents without
words cost nothing and are taken as the passes say.  Rows that agree in id and text are taken or
left together.  An empty table gives an empty one.  The same table and seed give the same mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import field, row_keys, with_row
from netloom.session import broadcast_if_small, materialize

WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words, and how often a source may be repeated at most.
BUDGET, MAX_PASSES = 1.5, 2
SEED = 17
#: Words that the knapsack program fits at least; eight longest of its documents if that is more; and at most.
WINDOW, MAX_WINDOW = 1 << 14, 1 << 20


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """Never null, in code point order, null last."""
    return F.when(source.isNull(), F.lit("z")).otherwise(F.concat(F.lit("s"), source))


def targets(sizes: DataFrame, budget: float = BUDGET, weights: tuple[int, ...] = WEIGHTS, passes: int = MAX_PASSES) -> DataFrame:
    """``sk, source_size, target`` from one row ``sk, source_size`` per source.

    Resharing ends at the level ``x`` with sum(min(passes * size, x * weight)) = budget.  With the
    sources sorted by cap over weight, it is the largest of the levels that come of capping the
    first none, one, two ... of them: each rightly capped source raises it, each other lowers it.
    """
    every = Window.partitionBy()
    by_name, by_ratio = Window.orderBy("sk"), Window.orderBy("ratio", "sk")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    df = sizes.withColumn("w", w).withColumn("cap", (F.col("source_size") * passes).cast("double"))
    df = df.withColumn("ratio", F.col("cap") / F.col("w")).withColumn("total", F.sum("source_size").over(every) * F.lit(budget))
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("caps", F.sum("cap").over(upto)).withColumn("below", F.sum("w").over(upto)).withColumn("all_w", F.sum("w").over(every))
    level = (F.col("total") - (F.col("caps") - F.col("cap"))) / (F.col("all_w") - (F.col("below") - F.col("w")))
    df = df.withColumn("x", F.max(level).over(every))
    return df.select("sk", "source_size", F.least("cap", F.coalesce(F.col("x") * F.col("w"), F.col("cap"))).alias("target"))


def fit_budget(lengths: list[int], counts: list[int], rest: int) -> list[int]:
    """How many documents of each length make up ``rest`` words, as nearly as can be from below."""
    order = sorted((i for i in range(len(lengths)) if lengths[i] > 0), key=lambda i: -lengths[i])
    total = sum(lengths[i] * counts[i] for i in order)
    taken = [0] * len(lengths)
    rest = min(rest, total)
    if rest <= 0:
        return taken
    seen = 0
    for i in order:
        before, seen = seen * rest // total, seen + counts[i]
        taken[i] = seen * rest // total - before
    gap = rest - sum(lengths[i] * taken[i] for i in order)
    short = [i for i in order if 8 * lengths[i] <= MAX_WINDOW]
    if len(short) < len(order):
        for i in order:
            more = min(counts[i] - taken[i], gap // lengths[i])
            taken[i], gap = taken[i] + more, gap - more * lengths[i]
        order = short
    if not order:
        return taken
    # hand some back, of all lengths in turn, so that the program has documents to choose from
    window, more = max(WINDOW, 8 * lengths[order[0]]), True
    if gap > window:
        return taken  # all documents that fit are taken
    while more:
        more = False
        for i in order:
            if taken[i] and gap + lengths[i] <= window:
                taken[i], gap, more = taken[i] - 1, gap + lengths[i], True
    # bounded knapsack: the bits of ``reach`` are the sums that can be made; each remembers the length that made it first
    reach, full, last = 1, (1 << (gap + 1)) - 1, np.full(gap + 1, -1, np.int32)
    for i in order:
        size, front = lengths[i], reach
        for _ in range(min(counts[i] - taken[i], gap // size)):
            front = (front << size) & full & ~reach
            if not front:
                break
            reach |= front
            bits = np.unpackbits(np.frombuffer(front.to_bytes(gap // 8 + 1, "little"), np.uint8), bitorder="little")
            last[np.flatnonzero(bits)] = i
        if reach >> gap & 1:
            break
    at = reach.bit_length() - 1
    while at:
        i = int(last[at])
        taken[i], at = taken[i] + 1, at - lengths[i]
    return taken


def _fitted(lengths: Column, counts: Column, rest: Column) -> Column:
    @F.pandas_udf("array<long>")
    def fitted(rows: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for batch in rows:
            yield pd.Series([fit_budget([int(x) for x in a], [int(x) for x in b], int(r)) for a, b, r in zip(*batch, strict=True)], dtype=object)

    return fitted(lengths, counts, rest)


def _bucket(n: Column) -> Column:
    """The hash ``h``, 63 bits of it, as one of ``n`` equal buckets."""
    return F.floor(F.shiftrightunsigned("h", 1).cast("double") / F.lit(2.0 ** 63) * n).cast("long")


def mix_plan(sized: DataFrame, budget: float = BUDGET, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """For each ``sk, size``: the passes of all its documents, and the hash up to which one more copy is taken.

    ``sized`` has ``sk, size, h, k1`` for every document.
    """
    by_length = materialize(sized.groupBy("sk", "size").agg(F.count("*").alias("n")))
    aims = targets(by_length.groupBy("sk").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), budget, weights)
    aims = aims.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    aims = aims.withColumn("rest", F.floor(F.col("target") - F.col("passes") * F.col("source_size") + 0.5).cast("long"))
    lists = by_length.groupBy("sk").agg(F.collect_list(F.struct("size", "n")).alias("all"))
    fitted = lists.join(aims, "sk").withColumn("m", _fitted(F.col("all.size"), F.col("all.n"), F.col("rest")))
    chosen = F.explode(F.zip_with("all", "m", lambda a, m: F.struct(a["size"].alias("size"), a["n"].alias("n"), m.alias("m"))))
    plan = fitted.select("sk", "source_size", "target", "passes", chosen.alias("c")).select("sk", "source_size", "target", "passes", "c.*")
    plan = materialize(plan.withColumn("buckets", F.ceil(F.sqrt(F.col("n").cast("double"))).cast("long")))
    open_ = plan.filter("m > 0 and m < n").select("sk", "size", "m", "buckets")
    placed = sized.join(broadcast_if_small(open_), ["sk", "size"]).withColumn("bucket", _bucket(F.col("buckets")))
    counted = placed.groupBy("sk", "size", "m", "bucket").agg(F.count("*").alias("c"))
    upto = Window.partitionBy("sk", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = counted.withColumn("upto", F.sum("c").over(upto)).filter("upto >= m and upto - c < m").select(
        "sk", "size", "bucket", (F.col("m") - (F.col("upto") - F.col("c"))).alias("more"))
    ranked = placed.join(broadcast_if_small(cut), ["sk", "size", "bucket"])
    nth = F.row_number().over(Window.partitionBy("sk", "size").orderBy("h", "k1"))  # within one bucket, where buckets order like hashes
    edge = ranked.withColumn("nth", nth).filter("nth = more").select("sk", "size", F.struct("h", "k1", "bucket").alias("edge"))
    return plan.join(edge, ["sk", "size"], "left")


def _sized(rows: DataFrame, seed: int) -> DataFrame:
    keys = row_keys(field("doc_id"), field("text"))
    return rows.select("row", _source_key(field("source")).alias("sk"), n_words(field("text")).alias("size"), keys[0],
                       F.xxhash64(F.lit(seed), keys[1]).alias("h"))


def _copies(sized: DataFrame, plan: DataFrame) -> DataFrame:
    df = sized.join(broadcast_if_small(plan), ["sk", "size"])
    at = F.struct(_bucket(F.col("buckets")).alias("bucket"), F.col("h").alias("h"), F.col("k1").alias("k1"))
    until = F.struct(F.col("edge.bucket").alias("bucket"), F.col("edge.h").alias("h"), F.col("edge.k1").alias("k1"))
    more = F.when(F.col("m") == 0, 0).when(F.col("m") >= F.col("n"), 1).when(at <= until, 1).otherwise(0)
    return df.withColumn("copies", F.col("passes") + more)


def mix_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``."""
    sized = _sized(with_row(docs.select("doc_id", "text", "source")), seed)
    sized = materialize(sized.select(field("doc_id").alias("doc_id"), "sk", "size", "k1", "h"))
    mixed = _copies(sized, materialize(mix_plan(sized)))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, all columns kept."""
    rows = _sized(with_row(docs), seed)
    plan = materialize(mix_plan(materialize(rows.drop("row"))))
    mixed = _copies(rows, plan).filter("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
