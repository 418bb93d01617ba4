"""What the operators share: words, row keys, log-gamma, and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.session import materialize

#: What parts words: the blank and the control characters from tab to carriage return.
GAP = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def with_row(docs: DataFrame) -> DataFrame:
    """One column ``row`` holding all columns, so that columns added later cannot clash with any of them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def field(name: str) -> Column:
    return F.col("row").getField(name)


def row_keys(doc_id: Column, text: Column, *more: Column) -> list[Column]:
    """Two columns, never null, that tell rows apart unless they agree in the id and the hashed text.

    The first is the id itself where it is a whole number or the text of one, else a hash of the id.
    """
    hashed = F.when(doc_id.isNotNull(), F.xxhash64(doc_id))
    return [F.coalesce(doc_id.try_cast("long"), hashed, F.lit(-1).cast("long")).alias("k1"), F.xxhash64(doc_id, text, *more).alias("k2")]


def log_gamma(x: Column) -> Column:
    """ln Γ(x) for x > 0: Stirling's series at x + 8, carried back by the recurrence; good to 1e-13 of the value."""
    z = x + F.lit(8.0)
    shift = F.log(x)
    for k in range(1, 8):
        shift = shift + F.log(x + F.lit(float(k)))
    i = F.lit(1.0) / z
    i2 = i * i
    series = i * (F.lit(1 / 12) - i2 * (F.lit(1 / 360) - i2 * (F.lit(1 / 1260) - i2 * (F.lit(1 / 1680) - i2 * F.lit(1 / 1188)))))
    return (z - F.lit(0.5)) * F.log(z) - z + F.lit(0.9189385332046727) + series - shift


def _total(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"] or 0


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links ``(a, b)``: rows ``(node, root)`` for every node that has a link.

    ``root`` is the smallest node of the component.  Alternates two contractions: every
    neighbour above a node is tied to the smallest neighbour of that node, then every
    neighbour below.  Each turn is two aggregates and two joins on narrow rows and is
    written to the checkpoint folder; the driver sees a count and a checksum only.
    """
    pairs = edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = materialize(pairs)
    before = _total(pairs)
    if before[0] == 0:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, F.col("a") == F.col("u")).select(
            F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.filter("a > b").groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        tied = large.filter("a > b").join(down, F.col("a") == F.col("u"))
        small = tied.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        pairs = materialize(small.filter("a != b").distinct())
        now = _total(pairs)
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
