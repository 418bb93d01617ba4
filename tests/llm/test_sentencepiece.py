from __future__ import annotations

import random

import pytest

from netloom.llm import sentencepiece as sp
from netloom.llm.queries import MODEL

from .brute import documents

proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")


@pytest.fixture(scope="module")
def model():
    m = proto.ModelProto()
    with open(MODEL, "rb") as f:
        m.ParseFromString(f.read())
    return m


TEXTS = ["Hello the  world\n日本 thonher 𐍈x", " lead and trail  ", "a", "    ", "tab\there\r\nand\nlines", "éèç ouonre ß Ünd 12.5 %%% &amp;",
         "x" * 300, "café ​ zero", "\x00\x01 control", "🙂🙂 emoji🙂"]


def _random_texts():
    rng = random.Random(5)
    alphabet = "abcdefghij  \n.,éß日🙂The"
    return ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(200)]


def test_best_paths_equal_the_library_in_unigram_mode(model):
    import sentencepiece

    unigram = proto.ModelProto()
    unigram.CopyFrom(model)
    unigram.trainer_spec.model_type = 1
    # the library adds scores in 32 bits; the pieces of blanks at -1e9 would swallow all others
    for p in unigram.pieces:
        p.score = max(p.score, -40000.0)
    library = sentencepiece.SentencePieceProcessor(model_proto=unigram.SerializeToString())
    pieces = sp.read_pieces(unigram.SerializeToString())
    for text in TEXTS + _random_texts():
        ids = pieces.encode(text)
        assert [int.from_bytes(ids[i:i + 4], "little") for i in range(0, len(ids), 4)] == library.encode(text), text


def test_stretches_and_whole_text_agree(model):
    pieces, whole = sp.read_pieces(model.SerializeToString()), sp.read_pieces(model.SerializeToString())
    assert not pieces.crossing
    whole.crossing = True
    for text in TEXTS + _random_texts():
        assert pieces.encode(text) == whole.encode(text), text


def test_unknown_without_byte_pieces():
    pieces = sp.Pieces([("<unk>", 0.0, 2), ("a", -1.0, 1), ("ab", -1.5, 1), ("▁", -2.0, 1), ("▁a", -2.5, 1)])
    ids = pieces.encode("aba z")
    assert [ids[i] for i in range(0, len(ids), 4)] == [3, 2, 1, 3, 0]


def test_round_trip_in_spark(spark):
    texts = [*TEXTS, *_random_texts(), None, "", "word " * 30000, "▁mark"]
    docs = documents(spark, list(enumerate(texts)))
    out = {r["doc_id"]: r for r in sp.encode_documents(docs, MODEL).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        assert out[i]["round_trip"] is (t != "▁mark"), t
        assert out[i]["n_tokens"] == len(out[i]["ids"] or [])
    assert out[len(texts) - 4]["ids"] is None and out[len(texts) - 3]["ids"] == []
    assert sp.encode_documents(docs.limit(0), MODEL).count() == 0
