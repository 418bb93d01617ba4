"""SentencePiece encoding and decoding (operator 2).

An Aho-Corasick automaton over the pieces runs once over the text.  At each position its
output links name every piece that ends there, longest first, and each relaxes the best
score of the position; the way back gives the ids.  Characters that no piece covers become
byte pieces.  Blanks become U+2581 and one is put in front, as the model file asks.

No piece of the usual models crosses from a letter into a following blank mark, which the
loader checks; then the best path is the joined best paths of the stretches that begin with
blanks (or after a line feed, if no piece has one), and a worker keeps the paths of short stretches it has met (at most
``REMEMBERED``).  A model with a crossing piece is run over whole texts.  Either way memory
per text is in proportion to its longest stretch.

A null text has null ids and decodes to null, an empty one has no ids; repeated rows give
repeated results; other columns stay as they are.  U+2581 itself decodes to a blank.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from struct import pack

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How pieces write a blank; here it stays one, which keeps plain texts compact.
MARK, BLANK = "▁", " "
#: Below the lowest piece by this much: the score of a character that no piece covers.
UNKNOWN_PENALTY = 10.0
#: Paths of stretches that a worker keeps, and the length up to which it keeps them.
REMEMBERED, REMEMBERED_LENGTH = 400_000, 32
#: A position not reached yet, and the step of an unknown character: no ids of its own.
LOWEST, UNSET = float("-inf"), (0, 0.0, None)
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
#: Texts whose ids are held at a time.
TEXTS_AT_A_TIME = 256


class Pieces:
    """The pieces of a model file: automaton, byte pieces, and their text."""

    def __init__(self, pieces: list[tuple[str, float, int]], dummy_prefix: bool = True):
        self.dummy_prefix = dummy_prefix
        self.unknown = min((s for _, s, kind in pieces if kind == NORMAL), default=0.0) - UNKNOWN_PENALTY
        self.byte = {int(p[3:-1], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown_id = next((i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN), 0)
        # what each id stands for; unknown and control pieces for nothing
        self.bytes = np.array([b"" if kind in (UNKNOWN, CONTROL) else p.replace(MARK, BLANK).encode() for p, _, kind in pieces], object)
        for b, i in self.byte.items():
            self.bytes[i] = bytes([b])
        self.automaton = ahocorasick.Automaton()
        for i, (p, score, kind) in enumerate(pieces):
            if p and kind in (NORMAL, USER_DEFINED):
                self.automaton.add_word(p.replace(MARK, BLANK), (len(p) - 1, score, pack("<i", i)))
        self.automaton.make_automaton()
        self.crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in pieces if kind in (NORMAL, USER_DEFINED))
        self.paths: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        # a line feed that is in no piece is always by itself
        inside = any("\n" in p for p, _, kind in pieces if kind in (NORMAL, USER_DEFINED))
        self.newline = None if inside else self.viterbi("\n")

    def viterbi(self, s: str) -> bytes:
        """The ids of the best path through ``s``, as little-endian 32-bit integers."""
        n, single = len(s), 0
        best, via = [0.0] + [LOWEST] * n, [UNSET] * (n + 1)
        for end, piece in self.automaton.iter(s):
            back, score, _ = piece  # the piece begins ``back`` before its last character
            score += best[end - back]
            if score > best[end + 1]:
                best[end + 1], via[end + 1] = score, piece
            if not back:
                single += 1
        if single < n:
            via = self._with_unknown(s)
        out, at = [], n
        while at:
            back, _, ids = via[at]
            out.append(ids if ids is not None else self._spelt(s[at - 1]))
            at -= back + 1
        out.reverse()
        return b"".join(out)

    def _spelt(self, char: str) -> bytes:
        """The ids of a character that no piece covers."""
        ids = [self.byte[b] for b in char.encode("utf-8", "replace")] if self.byte else [self.unknown_id]
        return pack(f"<{len(ids)}i", *ids)

    def _with_unknown(self, s: str) -> list[tuple]:
        """The same pass, where a character that no piece covers alone may also be an unknown piece."""
        n, done, single = len(s), 0, False
        best, via = [0.0] + [LOWEST] * n, [UNSET] * (n + 1)
        for end, piece in chain(self.automaton.iter(s), [(n, None)]):
            while done < end:  # no more pieces end before ``end``
                if not single and best[done] + self.unknown > best[done + 1]:
                    best[done + 1], via[done + 1] = best[done] + self.unknown, UNSET
                done, single = done + 1, False
            if piece:
                single |= not piece[0]
                score = piece[1] + best[end - piece[0]]
                if score > best[end + 1]:
                    best[end + 1], via[end + 1] = score, piece
        return via

    def path(self, stretch: str) -> bytes:
        """The ids of a stretch, remembered for the next time."""
        known = self.paths.get(stretch)
        if known is None:
            known = self.viterbi(stretch)
            if len(stretch) <= REMEMBERED_LENGTH and len(self.paths) < REMEMBERED:
                self.paths[stretch] = known
        return known

    def word(self, word: str) -> bytes:
        """The ids of a word behind one blank, remembered for the next time."""
        ids = self.viterbi(BLANK + word)
        if len(word) <= REMEMBERED_LENGTH and len(self.words) < REMEMBERED:
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        s = text.replace(MARK, BLANK)
        s = BLANK + s if self.dummy_prefix else s
        if self.crossing:
            return self.viterbi(s)
        if self.newline is None:
            return self._stretches(s)
        return self.newline.join(map(self._stretches, s.split("\n")))

    def _stretches(self, s: str) -> bytes:
        """The joined paths of the stretches of blanks and what follows them."""
        head, *rest = s.split(BLANK)
        out = [self.path(head)] if head else []
        if "" not in rest:  # single blanks only
            found = list(map(self.words.get, rest))
            if None in found:
                found = [ids if ids is not None else self.word(w) for ids, w in zip(found, rest, strict=True)]
            return b"".join(out + found)
        blanks = 0
        for part in rest:
            blanks += 1
            if part:
                out.append(self.path(BLANK * blanks + part))
                blanks = 0
        if blanks:
            out.append(self.path(BLANK * blanks))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(self.bytes[ids].tolist())
        if self.dummy_prefix and data.startswith(b" "):
            data = data[1:]
        return data.decode("utf-8", "replace")


def read_pieces(data: bytes) -> Pieces:
    """The pieces of a serialized model."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.ParseFromString(data)
    return Pieces([(p.piece, p.score, p.type) for p in model.pieces], model.normalizer_spec.add_dummy_prefix)


@lru_cache(maxsize=2)
def load(name: str) -> Pieces:
    """Once per worker, from the copy of the model file that Spark has brought to it."""
    with open(SparkFiles.get(name), "rb") as f:
        return read_pieces(f.read())


def ship(df: DataFrame, model_path: str) -> str:
    """Have Spark bring the model file to every executor; gives the name to load it by."""
    df.sparkSession.sparkContext.addFile(model_path)
    return model_path.rsplit("/", 1)[-1]


def _id_lists(pieces: Pieces, texts: list[str | None]) -> pa.ListArray:
    ids = [pieces.encode(t) if t is not None else None for t in texts]
    sizes = np.cumsum([0] + [len(x) // 4 if x else 0 for x in ids])
    values = pa.array(np.frombuffer(b"".join(x for x in ids if x), "<i4"), pa.int32())
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values, mask=pa.array([x is None for x in ids], pa.bool_()))


def _texts(pieces: Pieces, ids: pa.ListArray) -> list[str | None]:
    """The decoded texts, one list of ids after the other."""
    return [None if not x.is_valid else pieces.decode(x.values.to_numpy(zero_copy_only=False)) for x in ids]


def slices(batch, size: int = TEXTS_AT_A_TIME):
    return (batch.slice(i, size) for i in range(0, len(batch), size))


def encode(text: Column, name: str) -> Column:
    """The ids of a text as ``array<int>``."""
    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = load(name)
        for batch in batches:
            parts = [_id_lists(pieces, part.to_pylist()) for part in slices(batch)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return encoded(text)


def decode(ids: Column, name: str) -> Column:
    """The text of an ``array<int>`` of ids."""
    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = load(name)
        for batch in batches:
            yield pa.array(_texts(pieces, batch), pa.string())

    return decoded(ids)


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, n_tokens, ids, round_trip``; the last tells whether decoding the ids gives the text back."""
    name = ship(docs, model_path)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(name)
        for batch in batches:
            for part in slices(batch):
                texts = part.column(1).to_pylist()
                ids = _id_lists(pieces, texts)
                same = pa.array([a == b for a, b in zip(texts, _texts(pieces, ids), strict=True)], pa.bool_())
                n = pa.array(np.diff(ids.offsets.to_numpy()), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), n, ids, same], ["doc_id", "n_tokens", "ids", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(both, f"doc_id {kind}, n_tokens long, ids array<int>, round_trip boolean")
