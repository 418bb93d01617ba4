"""Quality rules with risk-controlled thresholds (operator 1); DataFrame functions only.

Each rule compares a measure of the text with a cutoff from a fixed grid.  Cutoffs are certified per
stratum (language) on labelled documents: of the good ones that pass the base rules, ``n`` in all, a
policy - a cutoff for some rules at once - rejects ``k``.  It is certified if, were its true false
rejection rate ``ALPHA``, ``k`` or fewer rejections had a probability of at most ``DELTA / strata`` -
that is, if the exact (Clopper-Pearson) upper bound at that confidence is no higher than the rate.

Policies are nested and tested in one order from lenient to strict, each step tightening one rule; the
first that is not certified ends the sequence, so the steps need no division of ``DELTA`` (fixed-sequence
testing).  Which steps come first is read from the labelled bad documents alone, which no test counts:
each stands for the step that rejects it first in the grid order, and what a rule needs for its bad
documents comes before all else.  With probability ``1 - DELTA`` every stratum rejects at most
``ALPHA`` of its good documents.  Of the last certified policy each rule takes the strictest cutoff that
rejects at most ``ALPHA / rules`` of the good documents counted, which only makes it more lenient; a rule
without any rejects nothing in that stratum.

Null text: no words, fails the base rules.  Null language: a stratum of its own.  Null
``doc_id``: cannot be labelled, is judged like any other row.  A document with several labels
counts as good only if all say so, as bad if one does; repeated rows with one id count once, by their worst measures.
No labels or no documents: no cutoff, or an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import field, log_gamma, row_keys, with_row, words
from netloom.session import broadcast_if_small, materialize

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Share of good documents a stratum may lose to all rules together, and the chance that any stratum loses more.
ALPHA, DELTA = 0.02, 0.05
#: Measure, whether high values are bad, and the grid of cutoffs from lenient to strict.
RULES: list[tuple[str, bool, list[float]]] = [
    ("symbol_share", True, [0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05, 0.02, 0.01]),
    ("dup_line_share", True, [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1]),
    ("repeat_share", True, [0.4, 0.3, 0.2, 0.15, 0.1, 0.05]),
    ("mean_word_low", False, [1.5, 2.0, 2.5, 3.0, 3.5]),
    ("mean_word_high", True, [20.0, 15.0, 12.0, 10.0, 9.0, 8.0]),
]


def _same_as_next(sorted_: Column, name: str) -> Column:
    """The structs of a sorted array whose field ``name`` equals that of a neighbour."""
    return F.filter(sorted_, lambda s, j: (s[name] == F.get(sorted_, j - 1)[name]).eqNullSafe(True) | (s[name] == F.get(sorted_, j + 1)[name]).eqNullSafe(True))


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with one column ``row`` gets the base counts of the whole text, as longs."""
    text = F.coalesce(field("text"), F.lit(""))
    df = docs.withColumn("w", words(text))
    starts = F.when(F.size("w") >= 3, F.sequence(F.lit(0), F.size("w") - 3)).otherwise(F.array().cast("array<int>"))
    window = [lambda i, k=k: F.get(F.col("w"), i + k) for k in range(3)]
    df = df.withColumn("hashes", F.transform(starts, lambda i: F.xxhash64(*[at(i) for at in window])))
    df = df.withColumn("lines", F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    # windows found again: by hash first, which loses none, then those by their words
    numbered = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("hashed", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), numbered))
    df = df.withColumn("likely", _same_as_next(F.col("hashed"), "h"))
    spelled = F.transform("likely", lambda s: F.struct(F.concat_ws(" ", *[at(s["i"]) for at in window]).alias("x"), s["i"].alias("i")))
    df = df.withColumn("spelled", F.sort_array(spelled))
    # their places in order
    df = df.withColumn("places", F.sort_array(F.transform(_same_as_next(F.col("spelled"), "x"), lambda s: s["i"])))
    covered = F.aggregate(
        F.transform("places", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("places", j + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    counts = {
        "n_words": F.size("w"),
        "word_chars": F.length(F.array_join("w", "")),
        "n_symbols": F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", "")),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_lines": F.size("lines"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
    }
    # one row each: the optimizer moves no filter through a generator, which would repeat all these expressions in it
    each = F.explode(F.array(F.struct(*[c.cast("long").alias(name) for name, c in counts.items()])))
    return df.select(*docs.columns, each.alias("counts")).select(*docs.columns, "counts.*")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _values() -> dict[str, Column]:
    """The rules' measures, never null, oriented so that high is bad."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    mean = F.col("word_chars") / n
    return {
        "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / n,
        "mean_word_low": -mean,
        "mean_word_high": mean,
    }


def _grid(cut: float, high: bool) -> float:
    return cut if high else -cut


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exact: the term at k times the falling sum of ratios below it."""
    top = F.least(k, n).cast("double")
    nn = n.cast("double")
    log_top = (log_gamma(nn + 1.0) - log_gamma(top + 1.0) - log_gamma(nn - top + 1.0)
               + top * F.log(F.lit(p)) + (nn - top) * F.log(F.lit(1.0 - p)))
    odds = (1.0 - p) / p
    start = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))

    def step(a: Column, j: Column) -> Column:
        term = a["term"] * j.cast("double") / (nn - j.cast("double") + 1.0) * F.lit(odds)
        return F.struct((a["sum"] + term).alias("sum"), term.alias("term"))

    down = F.when(top >= 1, F.sequence(top.cast("long"), F.lit(1).cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<long>"))
    # above the mean the falling terms grow; the tail is then over a half and certifies nothing
    total = F.when(top <= nn * p, F.aggregate(down, start, step, lambda a: a["sum"]))
    return F.coalesce(F.least(F.lit(1.0), F.exp(log_top) * total), F.lit(1.0))


def _steps() -> list[tuple[int, int]]:
    """All (rule, grid point) from lenient to strict: by the share of the rule's grid, then by rule."""
    return sorted(((r, i) for r, (_, _, grid) in enumerate(RULES) for i in range(len(grid))), key=lambda s: ((s[1] + 1) / len(RULES[s[0]][2]), s[0]))


def certified_cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``stratum, cutoffs`` (a map from rule to cutoff) from rows ``doc_id, stratum`` and base counts, and ``(doc_id, quality)``."""
    said = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.count("quality").alias("c"), F.count("*").alias("n"))
    said = said.filter("q = 0 or q = 1 and c = n").select("doc_id", (F.col("q") == 1).alias("good"))
    values = _values()
    passing = measured.filter(~base_failed() & F.col("doc_id").isNotNull()).select("doc_id", "stratum", *[v.alias(r) for r, v in values.items()])
    # one row per document and stratum, so that a repeated row is no further trial
    held = passing.join(said, "doc_id").groupBy("doc_id", "stratum").agg(F.first("good").alias("good"), *[F.max(r).alias(r) for r in values])
    steps = _steps()
    place = {s: at for at, s in enumerate(steps)}
    # where each rule first rejects the document, null if nowhere
    first = []
    for r, (rule, high, grid) in enumerate(RULES):
        spared = sum(((F.col(rule) <= _grid(cut, high)).cast("int") for cut in grid), F.lit(0))
        first.append(F.get(F.array(*[F.lit(place[r, i]) for i in range(len(grid))]), spared).alias(f"f{r}"))
    held = materialize(held.select("stratum", "good", *first))
    names = [f"f{r}" for r in range(len(RULES))]
    needed = held.filter(~F.col("good")).groupBy("stratum").agg(*[F.max(F.when(F.col(f) == F.least(*names), F.col(f))).alias(f"u{r}") for r, f in enumerate(names)])
    needed = broadcast_if_small(needed.withColumnRenamed("stratum", "s"))
    # steps that bad documents need keep their places, all others come after them
    late = [F.when(F.col(f) <= F.col(f"u{r}"), F.col(f)).otherwise(F.col(f) + len(steps)) for r, f in enumerate(names)]
    good = held.filter("good").join(needed, F.col("stratum").eqNullSafe(F.col("s")), "left").withColumn("at", F.least(*late))
    counts = good.groupBy("stratum").agg(
        F.count("*").alias("n"), *[F.max(f"u{r}").alias(f"u{r}") for r in range(len(RULES))],
        F.array(*[F.count_if(F.col("at") <= t) for t in range(2 * len(steps))]).alias("k"),
        F.array(*[F.count_if(F.col(f"f{r}") <= t) for t, (r, _) in enumerate(steps)]).alias("alone"))
    strata = max(1, measured.select("stratum").distinct().count())
    rows = F.array(*[F.struct(
        F.lit(RULES[r][0]).alias("rule"), F.lit(_grid(RULES[r][2][i], RULES[r][1])).alias("cut"), F.get("alone", F.lit(t)).alias("alone"),
        F.get("k", F.when(F.col(f"u{r}") >= t, t).otherwise(t + len(steps))).alias("k")) for t, (r, i) in enumerate(steps)])
    tested = counts.select("stratum", "n", F.explode(rows).alias("t")).select("stratum", "n", "t.*")
    # the policies are nested, so their tails only grow: what passes is what comes before the first failure
    sure = tested.withColumn("tail", binomial_tail(F.col("k"), F.col("n"), alpha)).filter(F.col("tail") <= delta / strata)
    sure = sure.filter(F.col("alone") <= F.col("n") * (alpha / len(RULES)))
    strictest = sure.groupBy("stratum", "rule").agg(F.min("cut").alias("cut"))
    return strictest.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cut"))).alias("cutoffs"))


def judged(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``measured`` with ``base_failed``, ``failed_rules`` and ``kept``."""
    side = cutoffs.select(F.col("stratum").alias("s"), "cutoffs")
    df = measured.join(broadcast_if_small(side), F.col("stratum").eqNullSafe(F.col("s")), "left")
    failing = [F.when((v > F.col("cutoffs").getItem(r)).eqNullSafe(True), F.lit(r)) for r, v in _values().items()]
    df = df.withColumn("base_failed", base_failed()).withColumn("failed_rules", F.array_compact(F.array(*failing)))
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("s", "cutoffs")


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: its id, base counts, ``base_failed``, ``kept`` and the rules that reject it."""
    measured = measures(with_row(docs.select("doc_id", "text", "lang"))).withColumn("doc_id", field("doc_id")).withColumn("stratum", field("lang")).drop("row")
    measured = materialize(measured)
    return judged(measured, certified_cutoffs(measured, labels))


def _keys() -> list[Column]:
    """Rows with equal keys are equal in all that the verdict depends on."""
    return row_keys(field("doc_id"), field("text"), field("text").isNull(), field("lang"))


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that no rule rejects, all columns kept."""
    rows = with_row(docs).select("row", *_keys())
    # measured once; what stays is found again by key, so that the texts need no second pass of all expressions
    measured = measures(with_row(docs.select("doc_id", "text", "lang")).select("row", *_keys()))
    measured = materialize(measured.withColumn("doc_id", field("doc_id")).withColumn("stratum", field("lang")).drop("row"))
    stay = materialize(judged(measured, certified_cutoffs(measured, labels)).filter("kept").select("k1", "k2").distinct())
    return rows.join(broadcast_if_small(stay), ["k1", "k2"], "left_semi").select("row.*")
