"""Near-duplicate embeddings by an exact metric range join (operator 8).

On unit vectors cosine >= c is Euclidean distance <= e with e = sqrt(2 - 2c).  Pivots, drawn by hash from a
cell's own vectors, divide it: a vector's home is its nearest pivot.  If u of part j lies within e of v with
nearest pivot i, the triangle inequality gives d(v, p_j) <= d(v, p_i) + 2e, and, with the least and greatest
distance of j's members to p_j, low_j - e <= d(v, p_j) <= high_j + e; and v is at most e behind the plane half
way between p_i and p_j, on whose other side u lies.  Vectors that meet all of them are guests of j, members for
j < i only, as each pair needs one meeting place; guests of the divided cell meet all members, so they become
guests of every part in reach.

Division starts with one cell per length of vectors and goes on, level by level, in every cell of more than
``PER_PIVOT`` members as long as it pays: on one hashed chunk of the cell the parts together must need at most
``PAYS`` of its comparisons.  So cells stay small however many vectors there are, and no cell is divided in vain.
Each level deals rows in chunks of at most about ``BLOCK`` to tasks, together with their cell's pivots.  What is left
is compared in blocks of at most ``BLOCK`` rows, each pair of blocks by itself, so a cell with any share of the
table is many independent tasks.  A task passes on the number of links of each vector and a spanning forest
of its links, not the pairs.

Equal vectors are compared once, with their count.  Where vectors are spread evenly in many dimensions
the bounds exclude little and the work is that of all pairs in blocks; no exact method does better there.

Null, empty or zero vectors and those with null, NaN or infinite components link with nothing: no links,
a component of their own id.  Components may be of any number type.  Vectors of different lengths do not link.  Rows with an equal vector link
with each other, also when they repeat an id.  A null id never names a component that has another id.
An empty table gives an empty one.  Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm.common import components
from netloom.session import broadcast_if_small, materialize

COSINE = 0.9
#: One pivot for so many members of a cell, at most so many for one division, and the share of comparisons it may keep.
PER_PIVOT, FAN, PAYS = 1024, 2048, 0.8
#: Rows of a block, and rows of it that are multiplied at a time.
BLOCK, STRIP = 4096, 512
#: Room for rounding in the bounds; the cosine itself is compared as it is.
SLACK = 1e-6


def _units(arrays: pa.Array | pa.ChunkedArray, kind=np.float64) -> np.ndarray:
    """The vectors of a list column as rows of unit length, in double precision."""
    arrays = arrays.combine_chunks() if isinstance(arrays, pa.ChunkedArray) else arrays
    if not len(arrays):
        return np.zeros((0, 0))
    m = arrays.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(arrays), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _distances(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (units @ pivots.T)))


def classes(vectors: DataFrame) -> DataFrame:
    """``cls, embedding, n, first, dim`` of the distinct vectors that can link; ``vectors`` has ``vec_id, embedding, cls``."""
    valid = vectors.filter("cls is not null")
    return valid.groupBy("cls").agg(F.first("embedding").alias("embedding"), F.count("*").alias("n"), F.min("vec_id").alias("first")).withColumn("dim", F.size("embedding"))


def with_class(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding, cls``; ``cls`` is null where a vector cannot link."""
    e = F.col("embedding").cast("array<double>")
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists(e, lambda x: x != 0)
    # single precision stays as it is; any other number is compared in double precision
    single = vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType(), vectors.schema["embedding"].dataType.containsNull)
    vectors = vectors.select("vec_id", F.col("embedding") if single else e.alias("embedding"))
    return vectors.select("vec_id", "embedding", F.when(F.coalesce(sound, F.lit(False)), F.md5(F.to_json("embedding").cast("binary"))).alias("cls"))


def _reached(d: np.ndarray, low: np.ndarray, high: np.ndarray, radius: float, home: np.ndarray | None = None,
             apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest pivot, and the parts whose guest it is: of lower number for members, any for guests."""
    cell = d.argmin(axis=1)
    own = d[np.arange(len(d)), cell][:, None]
    copy = (d <= own + 2 * radius) & (d <= high + radius) & (d >= low - radius)
    if apart is not None:
        copy &= d * d - own * own <= 2 * radius * apart[cell] + SLACK
    lower = np.arange(d.shape[1]) < cell[:, None]
    return cell, copy & (lower if home is None else lower | ~home[:, None])


def _spans(rows: pa.Table, pivots: pa.Table) -> pa.Table:
    """Least and greatest distance of a chunk's members to the pivot of their part."""
    if not rows.num_rows or not pivots.num_rows:
        return pa.table({"cell": pa.array([], pa.string()), "part": pa.array([], pa.int32()), "low": pa.array([], pa.float64()), "high": pa.array([], pa.float64())})
    at, units = _units(pivots["pivots"][0].values), _units(rows["embedding"])
    nearest = [(d.argmin(axis=1), d.min(axis=1)) for d in (_distances(units[i:i + STRIP], at) for i in range(0, len(units), STRIP))]
    part, own = (np.concatenate(n) for n in zip(*nearest, strict=True))
    low, high = np.full(len(at), math.inf), np.full(len(at), -math.inf)
    np.minimum.at(low, part, own)
    np.maximum.at(high, part, own)
    held = np.unique(part)
    cell = pa.array([pivots["cell"][0].as_py()] * len(held), pa.string())
    return pa.table({"cell": cell, "part": pa.array(held.astype(np.int32)), "low": low[held], "high": high[held]})


def _placed(rows: pa.Table, pivots: pa.Table, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of a chunk's rows in parts: row number, part, and whether it is a member there."""
    at = _units(pivots["pivots"][0].values)
    low, high = np.full(len(at), math.inf), np.full(len(at), -math.inf)
    for s in pivots["spans"][0].as_py():  # one per part
        low[s["part"]], high[s["part"]] = s["low"], s["high"]
    apart, home, units = _distances(at, at), rows["home"].to_numpy(), _units(rows["embedding"])
    places = []
    for i in range(0, len(units), STRIP):
        member = home[i:i + STRIP]
        cell, guest = _reached(_distances(units[i:i + STRIP], at), low, high, radius, member, apart)
        own, (row, part) = np.flatnonzero(member), np.nonzero(guest)
        places.append((np.append(own, row) + i, np.append(cell[own], part), np.arange(len(own) + len(row)) < len(own)))
    return tuple(np.concatenate(p) for p in zip(*places, strict=True))


def _gain(radius: float):
    """The comparisons of a chunk's rows now, and after the division."""
    def gain(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        now = then = 0.0
        if rows.num_rows and pivots.num_rows:
            _, part, member = _placed(rows, pivots, radius)
            members, guests = np.bincount(part[member], minlength=FAN), np.bincount(part[~member], minlength=FAN)
            n = float(member.sum())
            now, then = n * (n / 2 + rows.num_rows - n), float((members * (members / 2 + guests)).sum())
        return pa.table({"cell": pa.array([t["cell"][0].as_py() for t in (rows, pivots) if t.num_rows][:1], pa.string()), "now": [now], "then": [then]})

    return gain


def _divide(radius: float):
    """A chunk's rows in every part in which they take part."""
    def divide(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        kept = rows.select(["cls", "n", "embedding"])
        if not rows.num_rows or not pivots.num_rows:
            kept, part, member, cell = kept.slice(0, 0), [], np.zeros(0, bool), ""
        else:
            row, part, member = _placed(rows, pivots, radius)
            kept, cell = kept.take(pa.array(row)), pivots["cell"][0].as_py()
        names = pa.array([f"{cell}/{j}" for j in part], pa.string())
        return pa.table([names, pa.array(member), *kept.columns], ["cell", "home", "cls", "n", "embedding"])

    return divide


def _together(rows: DataFrame, pivots: DataFrame):
    """Each chunk's rows beside the pivots of its cell."""
    # aliases, as both sides stem from the same columns
    side = pivots.select(*[F.col(c).alias(c) for c in pivots.columns], F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    # dealt by chunk: a partitioning by cell alone would do for grouping, but put a whole cell into one task
    return rows.repartition("cell", "chunk").groupBy("cell", "chunk").cogroup(side.repartition("cell", "chunk").groupBy("cell", "chunk"))


def _division(rows: DataFrame, radius: float, level: int) -> tuple[DataFrame, DataFrame] | None:
    """The cells whose division pays, and the rows of their parts; None if there are none."""
    sizes = rows.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count("*").alias("total"))
    large = materialize(sizes.filter(F.col("homes") > PER_PIVOT).select(
        "cell", "homes", F.least(F.lit(FAN), F.ceil(F.col("homes") / PER_PIVOT)).alias("k"), F.ceil(F.col("total") / BLOCK).alias("chunks")))
    if large.isEmpty():
        return None
    dealt = rows.join(broadcast_if_small(large), "cell").withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")))
    # about twice as many as needed are drawn, so that few rows of a cell are ranked; fewer pivots would do as well
    draw = F.shiftrightunsigned(F.xxhash64("cls", F.lit(level)), 1).cast("double") / F.lit(2.0 ** 63)
    drawn = dealt.filter("home").withColumn("draw", draw).filter(F.col("draw") * F.col("homes") < 2 * F.col("k") + 64)
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("draw", "cls"))
    pivots = materialize(drawn.withColumn("rank", rank).filter(F.col("rank") <= F.col("k")).groupBy("cell", "chunks").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "embedding"))), lambda x: x["embedding"]).alias("pivots")))
    members = dealt.filter("home").select("cell", "chunk", "embedding")
    spans = _together(members, pivots).applyInArrow(_spans, "cell string, part int, low double, high double")
    spans = spans.groupBy("cell", "part").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    spans = spans.groupBy("cell").agg(F.collect_list(F.struct("part", "low", "high")).alias("spans"))  # at most FAN each
    pivots = materialize(pivots.join(spans, "cell"))
    first = _together(dealt.filter("chunk = 0").select("cell", "chunk", "home", "embedding"), pivots.withColumn("chunks", F.lit(1).cast("long")))
    gain = first.applyInArrow(_gain(radius), "cell string, now double, then double")
    pays = materialize(gain.filter(F.col("then") < PAYS * F.col("now")).select("cell"))
    if pays.isEmpty():
        return None
    pays = broadcast_if_small(pays)
    kind = rows.schema["embedding"].dataType.simpleString()
    parts = _together(dealt.join(pays, "cell", "left_semi").select("cell", "chunk", "home", "cls", "n", "embedding"), pivots.join(pays, "cell", "left_semi"))
    return pays, materialize(parts.applyInArrow(_divide(radius), f"cell string, home boolean, cls string, n long, embedding {kind}"))


def _cells(distinct: DataFrame, radius: float) -> DataFrame:
    """``cell, home, cls, n, embedding`` for every final cell in which a vector takes part."""
    rows = distinct.select(F.col("dim").cast("string").alias("cell"), F.lit(True).alias("home"), "cls", "n", "embedding")
    done, level = None, 0
    while (division := _division(rows, radius, level)) is not None:
        pays, parts = division
        stay = rows.join(pays, "cell", "left_anti")
        done, rows, level = stay if done is None else done.union(stay), parts, level + 1
    return rows if done is None else done.union(rows)


def _block_pairs(copies: DataFrame) -> DataFrame:
    """Each copy once for every pair of blocks that it belongs to: ``cell, a, b`` and its side."""
    sizes = copies.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("guests"))
    blocks = sizes.select("cell", F.ceil(F.col("homes") / BLOCK).cast("int").alias("hb"), F.ceil(F.col("guests") / BLOCK).cast("int").alias("gb"))
    df = copies.join(broadcast_if_small(materialize(blocks)), "cell")
    mine = F.pmod(F.xxhash64("cls"), F.when(F.col("home"), F.greatest("hb", F.lit(1))).otherwise(F.greatest("gb", F.lit(1)))).cast("int")
    df = df.withColumn("mine", mine)
    # home blocks meet home blocks of no lower number and all guest blocks, numbered on from ``hb``
    as_home = F.transform(F.sequence(F.lit(0), F.col("hb") + F.col("gb") - 1), lambda o: F.struct(
        F.when(o < F.col("mine"), o).otherwise(F.col("mine")).alias("a"), F.when(o < F.col("mine"), F.col("mine")).otherwise(o).alias("b")))
    as_guest = F.transform(F.sequence(F.lit(0), F.col("hb") - 1), lambda h: F.struct(h.alias("a"), (F.col("hb") + F.col("mine")).alias("b")))
    met = F.when(F.col("home"), as_home).otherwise(F.when(F.col("hb") > 0, as_guest))
    number = F.when(F.col("home"), F.col("mine")).otherwise(F.col("hb") + F.col("mine"))
    df = df.select("cell", "cls", "n", "embedding", number.alias("block"), F.explode(met).alias("m"))
    return df.select("cell", "m.a", "m.b", (F.col("block") == F.col("m.a")).alias("left"), "cls", "n", "embedding")


def _compare(cosine: float):
    """Links of one pair of blocks: per vector the weight of its links, and the root of its tree."""
    def compare(table: pa.Table) -> pa.Table:
        names, weight, left = table["cls"].to_pylist(), table["n"].to_numpy(), table["left"].to_numpy()
        units = _units(table["embedding"])
        same = table["a"][0].as_py() == table["b"][0].as_py()
        rows = np.flatnonzero(left)
        others = rows if same else np.flatnonzero(~left)
        links, root = np.zeros(len(names), np.int64), np.arange(len(names))
        right, right_weight = units[others].T.copy(), weight[others]
        for i in range(0, len(rows), STRIP):
            strip = rows[i:i + STRIP]
            near = units[strip] @ right >= cosine
            if same:
                near[np.arange(len(strip)), np.arange(i, i + len(strip))] = False
            at, to = np.nonzero(near)
            links[strip] += np.bincount(at, right_weight[to], len(strip)).astype(np.int64)
            if not same:
                links[others] += np.bincount(to, weight[strip][at], len(others)).astype(np.int64)
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            for k, tos in zip(at[starts], np.split(to, starts[1:]), strict=False):
                tied = np.unique(root[np.append(others[tos], strip[k])])
                if len(tied) > 1:
                    root[np.isin(root, tied)] = tied[0]
        at = np.flatnonzero(links)
        return pa.table({"a": pa.array([names[i] for i in at], pa.string()), "b": pa.array([names[root[i]] for i in at], pa.string()), "links": pa.array(links[at])})

    return compare


def near_pairs(distinct: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``a, links, b``: classes with links found in some pair of blocks, and a class each is tied to there."""
    radius = math.sqrt(2.0 - 2.0 * cosine) + SLACK
    met = _block_pairs(_cells(distinct, radius)).repartition("cell", "a", "b")  # not by cell alone
    return met.groupBy("cell", "a", "b").applyInArrow(_compare(cosine), "a string, b string, links long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    rows = materialize(with_class(vectors))
    distinct = materialize(classes(rows))
    pairs = materialize(near_pairs(distinct, cosine))
    linked = pairs.groupBy("a").agg(F.sum("links").alias("links"))
    roots = components(pairs.select("a", "b"))
    per = distinct.select("cls", "n", "first").join(linked, F.col("cls") == F.col("a"), "left").join(roots, F.col("cls") == F.col("node"), "left")
    per = per.select("cls", "first", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "cls").alias("root"))
    named = per.groupBy("root").agg(F.min("first").alias("component"))
    per = per.join(named, "root").select("cls", "n_links", "component")
    out = rows.select("vec_id", "cls").join(per, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))
