"""Packing token ids into rows of equal length (operator 5).

Each document's ids become pieces: one, or, if longer than a row, full rows and a remainder, with the
offset of each piece, so that nothing is lost.  Within a group of at most ``GROUP_TOKENS`` tokens the
pieces are packed best-fit decreasing: from the longest on, each goes to the open row with the least
room that still holds it, which a segment tree over the remaining capacities finds in logarithmic time.

Groups are cut from the scan as it comes, without a shuffle: the rest that packing leaves open depends
on a group's size only, so larger groups would save little, and a task's memory is that of one group.  So which documents share
a row, and ``pack_id``, which counts within a scan partition, follow the way files are split; what is packed does not.

An output row has the ids (little-endian 32-bit integers, padded to the full length), the number of
tokens, the cumulative segment lengths (0 first), the places where positions start again, and the
document and offset of each segment.  Null and empty texts have no tokens and stand in no row;
repeated rows are packed each; null ids are passed through, whole numbers as long, other ids as text; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm import sentencepiece

ROW_TOKENS, PAD_ID = 2048, 0
GROUP_TOKENS = 1 << 22
ID_TYPES = {"long": pa.int64(), "string": pa.string()}


def _schema(kind: str) -> str:
    return ("pack_id long, input_ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, "
            f"doc_ids array<{kind}>, doc_offsets array<long>")


def _arrow(kind: str) -> pa.Schema:
    return pa.schema([("pack_id", pa.int64()), ("input_ids", pa.binary()), ("n_tokens", pa.int32()), ("cu_seqlens", pa.list_(pa.int32())),
                      ("position_resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(ID_TYPES[kind])), ("doc_offsets", pa.list_(pa.int64()))])


def _kind(id_type: T.DataType) -> str:
    """Whole numbers come out as long, any other id as its text."""
    return "long" if isinstance(id_type, T.IntegralType) else "string"


class Rooms:
    """Open rows by the room they have left; a segment tree over the rooms tells which are to be had."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        node = room + self.width
        while node and not self.tree[node]:
            self.tree[node] = 1
            node //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the least room of at least ``need``, and that room; it is no longer open."""
        node = need + self.width
        while not self.tree[node]:  # up, until something lies to the right
            while node & 1:
                node //= 2
                if node <= 1:
                    return None
            node += 1
            if node >= 2 * self.width:
                return None
        while node < self.width:
            node = 2 * node + (not self.tree[2 * node])
        room = node - self.width
        row = self.rows[room].pop()
        if not self.rows[room]:
            while node and not (node < self.width and (self.tree[2 * node] or self.tree[2 * node + 1])):
                self.tree[node] = 0
                node //= 2
        return row, room


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Which pieces go into which row; no length is above ``capacity``."""
    rooms, rows = Rooms(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = rooms.take(lengths[i])
        if found is None:
            found = len(rows), capacity
            rows.append([])
        row, room = found
        rows[row].append(i)
        if room > lengths[i]:
            rooms.add(row, room - lengths[i])
    return rows


def _pack(pieces: list[tuple], capacity: int, pad: int, first: int, arrow: pa.Schema) -> pa.RecordBatch:
    out: dict[str, list] = {name: [] for name in arrow.names}
    for n, row in enumerate(best_fit_decreasing([len(p[2]) for p in pieces], capacity)):
        ids = np.full(capacity, pad, "<i4")
        ends = np.cumsum([0] + [len(pieces[i][2]) for i in row])
        for i, at in zip(row, ends, strict=False):
            ids[at:at + len(pieces[i][2])] = pieces[i][2]
        values = (first + n, ids.tobytes(), int(ends[-1]), ends.tolist(), ends[:-1].tolist(), [pieces[i][0] for i in row], [pieces[i][1] for i in row])
        for column, value in zip(out.values(), values, strict=True):
            column.append(value)
    return pa.RecordBatch.from_pydict(out, arrow)


def _packed(documents: Iterator[tuple[int | str | None, np.ndarray]], row_tokens: int, pad_id: int, group_tokens: int, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The packed rows of one task's documents, group by group."""
    pieces, held, made = [], 0, TaskContext.get().partitionId() << 36
    for doc, ids in documents:
        for at in range(0, len(ids), row_tokens):
            piece = ids[at:at + row_tokens].astype("<i4")
            if held + len(piece) > group_tokens and pieces:
                packed = _pack(pieces, row_tokens, pad_id, made, arrow)
                made, pieces, held = made + packed.num_rows, [], 0
                yield from sentencepiece.slices(packed)
            pieces.append((doc, at, piece))
            held += len(piece)
    if pieces:
        yield from sentencepiece.slices(_pack(pieces, row_tokens, pad_id, made, arrow))


def pack_ids(tokens: DataFrame, row_tokens: int = ROW_TOKENS, pad_id: int = PAD_ID, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Packed rows from ``doc_id, ids``."""
    kind = _kind(tokens.schema["doc_id"].dataType)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | str | None, np.ndarray]]:
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if ids.is_valid:
                    yield doc, ids.values.to_numpy(zero_copy_only=False)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed(documents(batches), row_tokens, pad_id, group_tokens, _arrow(kind))

    return tokens.select(F.col("doc_id").cast(kind).alias("doc_id"), "ids").mapInArrow(pack, _schema(kind))


def position_ids(cu_seqlens: Column) -> Column:
    """The position of every token in its segment, from the cumulative lengths."""
    lengths = F.transform(F.slice(cu_seqlens, F.lit(2), F.size(cu_seqlens) - 1), lambda end, i: end - F.get(cu_seqlens, i))
    return F.flatten(F.transform(lengths, lambda n: F.sequence(F.lit(0), n - 1)))


def pack_documents(docs: DataFrame, model_path: str, row_tokens: int = ROW_TOKENS, pad_id: int = PAD_ID, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """``docs`` encoded by the pieces of a model file and packed, in one pass."""
    name = sentencepiece.ship(docs, model_path)
    kind = _kind(docs.schema["doc_id"].dataType)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | str | None, np.ndarray]]:
        pieces = sentencepiece.load(name)
        for batch in batches:
            for part in sentencepiece.slices(batch):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    yield doc, np.frombuffer(pieces.encode(text or ""), "<i4")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed(documents(batches), row_tokens, pad_id, group_tokens, _arrow(kind))

    return docs.select(F.col("doc_id").cast(kind).alias("doc_id"), "text").mapInArrow(pack, _schema(kind))


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows; the ids are one binary value of fixed length per row, so that files are id matrices."""
    packed.write.parquet(path)


def unpack(packed: DataFrame) -> DataFrame:
    """``doc_id, offset, ids`` of every segment: what was packed, to be read back."""
    kind = packed.schema["doc_ids"].dataType.elementType.simpleString().replace("bigint", "long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "offset": [], "ids": []}
            for row in batch.to_pylist():
                ids, cu = np.frombuffer(row["input_ids"], "<i4"), row["cu_seqlens"]
                for i, doc in enumerate(row["doc_ids"]):
                    out["doc_id"].append(doc)
                    out["offset"].append(row["doc_offsets"][i])
                    out["ids"].append(ids[cu[i]:cu[i + 1]])
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], ID_TYPES[kind]), pa.array(out["offset"], pa.int64()), pa.array(out["ids"], pa.list_(pa.int32()))], list(out))

    return packed.mapInArrow(read, f"doc_id {kind}, offset long, ids array<int>")
