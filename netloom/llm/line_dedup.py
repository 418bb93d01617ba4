"""Cross-site boilerplate lines (operator 3); DataFrame functions only.

A line (trimmed) is boilerplate when documents of at least ``MIN_SITES`` distinct sources have
it.  Every line hash gets a HyperLogLog sketch of its sources, merged by partial aggregation, so a
line that a third of all documents share is one small sketch per task.  Estimates clearly above the
threshold decide; those near it (within ``MARGIN`` of it) get an exact distinct count.

A boilerplate line stays once: in the document with the smallest id, at its first place.
Every other occurrence goes; other lines stay as they are, in order.  Short lines - fewer than
``MIN_WORDS`` words and fewer than ``MIN_CHARS`` characters, so that a script without blanks is not
short for that - repeat by chance: they need ``SHORT_TIMES`` as many sites.  Empty lines never count.

Null texts stay null, empty ones empty.  A null source is a site of its own.  A null ``doc_id`` is
above all ids.  Repeated rows are one document, so both keep the line or both lose it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import GAP, field, row_keys, with_row
from netloom.session import broadcast_if_small, materialize

MIN_SITES, MIN_WORDS = 5, 5
#: Characters from which a line of few words is not short, and how many times the sites a short one needs.
MIN_CHARS, SHORT_TIMES = 20, 3
#: Sketch size (relative standard error 1.04 / 2**(LG_K / 2), 1.6 %) and the half width, as a share, of "near".
LG_K, MARGIN = 12, 0.1


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def _line_key(inner: Column) -> Column:
    """A 128-bit key of a trimmed line; null for an empty one."""
    return F.when(inner != "", F.md5(inner.cast("binary")))


def _short(inner: Column) -> Column:
    return (F.length(inner) < MIN_CHARS) & (F.regexp_count(inner, F.lit(GAP)) + 1 < MIN_WORDS)


def occurrences(docs: DataFrame) -> DataFrame:
    """``k1, k2, doc_id, site, pos, line, short`` for each line that is not empty, from rows with a ``row`` column."""
    keys = row_keys(field("doc_id"), field("text"))
    # keys first: beside the generator they would be hashed from the whole text again for each of its lines
    df = docs.select(*keys, field("doc_id").alias("doc_id"), F.coalesce(field("source"), F.lit("\u0000")).alias("site"),
                     F.split(field("text"), "\n").alias("lines"))
    df = df.select("k1", "k2", "doc_id", "site", F.posexplode("lines").alias("pos", "raw"))
    inner = _trimmed(F.col("raw"))
    return df.select("k1", "k2", "doc_id", "site", "pos", _line_key(inner).alias("line"), _short(inner).alias("short")).filter("line is not null")


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN, lg_k: int = LG_K) -> DataFrame:
    """``line, keeper`` of every boilerplate line; ``keeper`` is where it stays."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("k1"), F.col("k2"), F.col("pos"))).alias("keeper")
    need = F.when(F.first("short"), min_sites * SHORT_TIMES).otherwise(min_sites).alias("need")
    # fewer occurrences than sites asked for cannot be spread over as many
    sketched = lines.groupBy("line").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.count("*").alias("n"), need, first).filter(F.col("n") >= F.col("need"))
    guessed = materialize(sketched.select("line", "need", "keeper", F.hll_sketch_estimate("sketch").alias("sites")))
    low, high = F.col("need") * (1 - margin) - 1, F.col("need") * (1 + margin) + 1
    near = guessed.filter(F.col("sites").between(low, high))
    # a counted, small side spares shuffling the lines by a key that may hold a third of them
    exact = lines.join(broadcast_if_small(near.select("line")), "line", "left_semi").select("line", "site").distinct().groupBy("line").agg(F.count("*").alias("exact"))
    sure = guessed.filter(F.col("sites") > high).select("line", "keeper")
    return sure.union(near.join(exact, "line").filter(F.col("exact") >= F.col("need")).select("line", "keeper"))


def removals(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``k1, k2, gone``: for each document that loses lines, their places."""
    lines = materialize(occurrences(docs))
    spread = spread_lines(lines, min_sites)
    hit = lines.join(spread, "line")
    gone = hit.filter((F.col("k1") != F.col("keeper.k1")) | (F.col("k2") != F.col("keeper.k2")) | (F.col("pos") != F.col("keeper.pos")))
    return gone.groupBy("k1", "k2").agg(F.collect_set("pos").alias("gone"))


def _cleaned(rows: DataFrame, min_sites: int) -> DataFrame:
    """``row``, the lines of its text, the places ``gone`` (null: none) and the text without them."""
    gone = removals(rows, min_sites)
    joined = rows.select("row", *row_keys(field("doc_id"), field("text"))).join(gone, ["k1", "k2"], "left")
    joined = joined.withColumn("lines", F.split(field("text"), "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    clean = F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n")
    return joined.withColumn("clean", F.when(F.col("gone").isNull(), field("text")).otherwise(clean))


def drop_boilerplate_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with the boilerplate lines gone from ``text``; all columns and all rows stay.

    A column ``n_chars`` is set to the length of the text that is left.
    """
    cleaned = _cleaned(with_row(docs), min_sites)
    row = F.col("row").withField("text", F.col("clean"))
    if "n_chars" in docs.columns:
        lost = F.col("gone").isNotNull()
        row = row.withField("n_chars", F.when(lost, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(field("n_chars")))
    return cleaned.withColumn("row", row).select("row.*")


def line_dedup_counts(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``doc_id, n_lines, n_removed`` per document, and the ``clean_text`` that is left."""
    return _cleaned(with_row(docs.select("doc_id", "text", "source")), min_sites).select(
        field("doc_id").alias("doc_id"), F.greatest(F.coalesce(F.size("lines"), F.lit(0)), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"), F.col("clean").alias("clean_text"))
