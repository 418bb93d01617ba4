"""The training table: written once in a fixed random order, read by exact batches in another order each epoch.

Rows have dense positions in the order of a hash.  Files hold ranges of positions, on shelves of
a bounded number.  An epoch turns the circle of positions by its own step, cuts it into
buckets and permutes the buckets by a keyed permutation that can be inverted place by place.  A batch
is a range of places, that is a few ranges of positions, which follow from the numbers
alone; a scan for single batches prunes shelves, row groups and pages by them.

A fit deals an epoch once: one shuffle writes the rows in the order of their places, cut into segments of
many batches and pieces of few rows.  An epoch of many small batches is gone through by segments, a job each;
of few or large ones, the pieces of one segment at a time are held ready, so that a step is one
small job on the partitions of its batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators.sampling import HASH_DIGITS, hash_long, permuted, position_at, sample_hash
from netloom.session import broadcast_if_small, delete_path, shared_path

# Bits of the hash by which keys are counted, and rows of a partition sorted by hash.
SLICE_BITS, PART_ROWS = 12, 32_768
# Rows of a shelf at least, and shelves at most; buckets that make up a batch.
SHELF_ROWS = 1_000_000
SHELVES = 10_000
BUCKETS_PER_BATCH = 16
# Rows of a page, so that a bucket is read without much beside it.
PAGE_ROWS = 256
# Rows of a piece, that is of a task of a step; rows of a segment at most (one batch at least), and files it is written to.
PIECE_ROWS = 512
SEGMENT_ROWS, SEGMENT_FILES = 262_144, 8

PIECE = "segment long, piece long, ctx binary, label binary, n long"
META = "total long, shelf_rows long, batch_rows long, seed long"


@dataclass(frozen=True)
class Order:
    """The way positions are dealt to batches: numbers alone."""

    total: int
    batch_rows: int
    seed: int

    @property
    def batches(self) -> int:
        return -(-self.total // self.batch_rows)

    @property
    def bucket_rows(self) -> int:
        return max(1, self.batch_rows // BUCKETS_PER_BATCH)

    @property
    def buckets(self) -> int:
        """Whole buckets; the rows behind the last one keep their places."""
        return self.total // self.bucket_rows

    def turn(self, epoch: int) -> int:
        return hash_long(epoch, hash_long(self.seed + 1)) % self.total

    def place(self, position: Column, epoch: int) -> Column:
        """The place of a position in the order of an epoch."""
        turned = F.pmod(position + self.turn(epoch), F.lit(self.total))
        if not self.buckets:
            return turned
        bucket = F.floor(turned / self.bucket_rows)
        moved = permuted(bucket, self.buckets, self.seed, epoch) * self.bucket_rows + turned % self.bucket_rows
        return F.when(bucket < self.buckets, moved).otherwise(turned)

    def ranges(self, epoch: int, batch: int) -> list[tuple[int, int]]:
        """The positions of a batch as ranges, end exclusive."""
        at, end = batch * self.batch_rows, min(self.total, (batch + 1) * self.batch_rows)
        turn, out = self.turn(epoch), []
        while at < end:
            bucket, offset = divmod(at, self.bucket_rows)
            if bucket < self.buckets:
                n = min(end - at, self.bucket_rows - offset)
                low = position_at(bucket, self.buckets, self.seed, epoch) * self.bucket_rows + offset
            else:
                n, low = end - at, at
            low = (low - turn) % self.total
            out.append((low, min(low + n, self.total)))
            if low + n > self.total:
                out.append((0, low + n - self.total))
            at += n
        return sorted(out)


@dataclass(frozen=True)
class Training(Order):
    """A written training table and the way its batches are dealt."""

    rows: DataFrame
    shelf_rows: int

    def placed(self, epoch: int) -> DataFrame:
        """All rows with their ``place`` in the order of an epoch; buckets are permuted, not rows one by one."""
        spark, turned = self.rows.sparkSession, F.pmod(F.col("pos") + self.turn(epoch), F.lit(self.total))
        moved = permuted(F.col("id"), self.buckets, self.seed, epoch) if self.buckets else F.col("id")
        buckets = spark.range(self.buckets).select(F.col("id").alias("_bucket"), (moved * self.bucket_rows).alias("_first"))
        rows = self.rows.withColumn("_bucket", F.floor(turned / self.bucket_rows))
        # rows behind the last bucket keep their places
        place = F.coalesce(F.col("_first") + turned % self.bucket_rows, turned)
        return rows.join(broadcast_if_small(buckets), "_bucket", "left").withColumn("place", place).drop("_bucket", "_first")

    def numbered(self, epoch: int) -> DataFrame:
        """All rows with their ``batch`` of an epoch."""
        return self.placed(epoch).withColumn("batch", F.floor(F.col("place") / self.batch_rows).cast("long")).drop("place")

    def batch(self, epoch: int, batch: int) -> DataFrame:
        """The rows of a batch, read from the files of their positions only."""
        ranges = self.ranges(epoch, batch)
        shelves = sorted({s for low, end in ranges for s in range(low // self.shelf_rows, (end - 1) // self.shelf_rows + 1)})
        inside = F.lit(False)
        for low, end in ranges:
            inside = inside | F.col("pos").between(low, end - 1)
        return self.rows.filter(F.col("shelf").isin(shelves) & inside)

    def read(self, epoch: int) -> DataFrame:
        """All rows with the ``batch`` of an epoch in whose ranges of positions they lie."""
        order, schema = Order(self.total, self.batch_rows, self.seed), pa.schema([("batch", pa.int64()), ("low", pa.int64()), ("end", pa.int64())])

        def listed(batches):
            for part in batches:
                found = [(b, *r) for b in part.column(0).to_pylist() for r in order.ranges(epoch, b)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], schema=schema)

        ranges = self.rows.sparkSession.range(self.batches).mapInArrow(listed, "batch long, low long, end long")
        places = ranges.select("batch", F.explode(F.sequence("low", F.col("end") - 1)).alias("pos"))
        # the planner knows the ranges only, not how many positions they hold
        return self.rows.join(places.hint("merge"), "pos")

    def deal(self, epoch: int) -> Dealt:
        """Write the rows in the order of an epoch, for its batches to be stepped through."""
        return Dealt(self, epoch)


class Dealt:
    """An epoch in the order of its batches, written by segments, which are read one behind the other."""

    def __init__(self, training: Training, epoch: int):
        self.spark, self.batch_rows = training.rows.sparkSession, training.batch_rows
        self.path = shared_path(self.spark, "epoch")
        self.pieces_of_batch = -(-training.batch_rows // PIECE_ROWS)
        self.batches = max(1, SEGMENT_ROWS // training.batch_rows)
        self.at, self.held = None, None
        self.segments = -(-training.batches // self.batches)
        batch = F.floor(F.col("place") / self.batch_rows)
        # a batch is cut anew, so that no piece holds rows of two
        piece = batch * self.pieces_of_batch + F.floor(F.col("place") % self.batch_rows / PIECE_ROWS)
        share = -(-self.pieces // SEGMENT_FILES)
        file = F.floor(F.col("piece") / self.pieces) * SEGMENT_FILES + F.floor(F.col("piece") % self.pieces / share)
        placed = training.placed(epoch).select("place", "ctx", "label").withColumn("piece", piece)
        dealt = placed.repartitionById(self.segments * SEGMENT_FILES, file.cast("int")).sortWithinPartitions("place")
        dealt.select("piece", "ctx", "label").mapInArrow(_packed(self.pieces), PIECE).write.partitionBy("segment").parquet(self.path)

    @property
    def pieces(self) -> int:
        """Pieces of a segment."""
        return self.batches * self.pieces_of_batch

    def segment(self, number: int) -> DataFrame:
        """The pieces of a segment, ``piece, ctx, label, n``."""
        return self.spark.read.schema(PIECE).parquet(f"{self.path}/segment={number}").select("piece", "ctx", "label", "n")

    def batch(self, number: int) -> Batch:
        """A batch of the epoch; those of a segment are asked for one behind the other."""
        segment, batch = divmod(number, self.batches)
        if segment != self.at:
            self._release()
            first = segment * self.pieces
            keyed = self.segment(segment).rdd.map(lambda r: (r.piece - first, (bytes(r.ctx), bytes(r.label), r.n)))
            self.at, self.held = segment, keyed.partitionBy(self.pieces, int).persist(StorageLevel.MEMORY_AND_DISK)
        return Batch(self.held, range(batch * self.pieces_of_batch, (batch + 1) * self.pieces_of_batch))

    def _release(self) -> None:
        if self.held is not None:
            self.held.unpersist()
        self.at, self.held = None, None

    def close(self) -> None:
        """Delete what was written for the epoch."""
        self._release()
        delete_path(self.spark, self.path)


@dataclass(frozen=True)
class Batch:
    """The rows of a batch: a few partitions of pieces, each ``(number, (ctx, label, rows))`` with the bytes of doubles."""

    pieces: RDD
    parts: range


def _packed(pieces: int):
    """Rows in the order of their pieces to one row per piece, which holds their numbers as bytes."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(table: pa.Table) -> pa.RecordBatch:
            piece = table["piece"][0].as_py()
            ctx, label = (table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).tobytes() for c in ("ctx", "label"))
            row = [[piece // pieces], [piece], [ctx], [label], [table.num_rows]]
            types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], ["segment", "piece", "ctx", "label", "n"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            number = batch.column("piece").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1), len(number)]
            for low, end in zip(cuts, cuts[1:]):
                if held and held[0].column("piece")[0].as_py() != number[low]:
                    yield one(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(low, end - low))
        if held:
            yield one(pa.Table.from_batches(held))

    return pack


def _dense(rows: DataFrame, key: str, seed: int) -> tuple[DataFrame, int]:
    """Rows with the positions of ``dense_positions`` as ``pos``, to be written once, and their number.

    Slices of the hash are counted from the keys alone, so that every partition knows its first position before
    rows are moved: no pass samples the rows, and no copy of them is kept.
    """
    spark, bits = rows.sparkSession, 4 * HASH_DIGITS - SLICE_BITS
    hashed = rows.withColumn("_h", sample_hash(seed, key))
    counts = dict(hashed.groupBy(F.shiftright("_h", bits).cast("int").alias("slice")).count().collect())
    total = sum(counts.values())
    slices = max(1, (1 << SLICE_BITS) // max(1, -(-total // PART_ROWS)))  # of a partition
    parts = -(-(1 << SLICE_BITS) // slices)
    starts = [0, *accumulate(sum(counts.get(s, 0) for s in range(p * slices, (p + 1) * slices)) for p in range(parts))]
    first = spark.createDataFrame(list(enumerate(starts[:parts])), "_part int, _first long")
    cut = hashed.withColumn("_part", F.floor(F.shiftright("_h", bits) / slices).cast("int")).repartitionById(parts, "_part")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # within its partition
    at = cut.sortWithinPartitions(F.asc("_h"), F.asc(key)).withColumn("_row", row)
    return at.join(F.broadcast(first), "_part").withColumn("pos", F.col("_first") + F.col("_row")).drop("_h", "_part", "_row", "_first"), total


def training_table(windows: DataFrame, path: str, key: str = "flow_id", batch_rows: int | None = None, seed: int = 131) -> Training:
    """Write windows as a training table below ``path`` (None: one batch of all rows); an existing one is opened."""
    spark = windows.sparkSession
    found = open_training(spark, path)
    if found is not None:
        return found
    placed, total = _dense(windows.select(key, "ctx", "label"), key, seed)
    shelf_rows = max(SHELF_ROWS, -(-total // SHELVES))
    shelved = placed.withColumn("shelf", F.floor(F.col("pos") / shelf_rows).cast("long"))
    (
        shelved.sortWithinPartitions("shelf", "pos").write.mode("overwrite").partitionBy("shelf")
        .option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{path}/rows")
    )
    meta = spark.createDataFrame([(total, shelf_rows, max(1, batch_rows or total), seed)], META)
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return open_training(spark, path)


def open_training(spark: SparkSession, path: str) -> Training | None:
    """The training table below ``path``, None if none was written to its end."""
    try:
        meta = spark.read.schema(META).parquet(f"{path}/meta").first()
    except AnalysisException:
        return None
    return Training(rows=spark.read.parquet(f"{path}/rows"), **meta.asDict()) if meta else None
