"""Ids against the public library's own, exact round trips, and a small unigram model by brute force."""

import itertools
import random
import struct

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import Row

from strandline.llm import sentencepiece as S
from strandline.llm.queries import PIECES


@pytest.fixture(scope="module")
def both():
    model = S.load(PIECES)
    return sentencepiece.SentencePieceProcessor(model_file=PIECES), S.Encoder(model), model


def ids(encoder, text):
    return np.frombuffer(encoder.encode([text])[0], np.int32).tolist()


def test_random(both):
    library, own, model = both
    rng = random.Random(5)
    letters = " abcdefghijklmnoprstuwxABCDEFZ,.\\'-()\"=\n\t:;/<>0123456789éüñß▁привет你好😀\x00_#*"
    for _ in range(6000):
        if rng.random() < 0.5:
            text = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 30)))
        else:
            text = "".join(rng.choice(model.pieces[259:]) for _ in range(rng.randrange(1, 6))).replace("▁", " ")
        got = ids(own, text)
        assert got == library.encode(text), text
        assert own.decode(got) == library.decode(got)
        if "▁" not in text:
            assert own.decode(got) == text


def test_given(both, spark, sf):
    library, own, model = both
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in S.encode(df, model, check=True).collect()}
    for r in df.collect():
        assert got[r.doc_id].ids == library.encode(r.text) and got[r.doc_id].decodes and got[r.doc_id].n_tokens == len(got[r.doc_id].ids)


def test_edges(both, spark):
    model = both[2]
    rows = [Row(1, None, "x", [1]), Row(1, None, "x", [1]), Row(2, "", "x", None), Row(None, " ", None, None), Row(3, "a  b\n" * 100_000, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string, ids array<int>")
    out = S.encode(df, model)
    assert out.columns == ["doc_id", "text", "n_tokens", "ids", "_n_tokens", "_ids"]
    back = S.decode(out, model, "_ids")
    for r in back.collect():
        assert r.text_decoded == r.text and (r._n_tokens is None) == (r.text is None)
        assert r.text is None or r._n_tokens == len(r._ids)
    assert S.encode(df.limit(0), model).count() == 0


def test_memory_bound(both, monkeypatch):
    library, _, model = both
    monkeypatch.setattr(S, "REMEMBERED", 5)
    own = S.Encoder(model)
    for i in range(20):
        text = f"words number {i} and {i * 7} again words"
        assert ids(own, text) == library.encode(text)
        assert len(own.words) < 20


def number(field, kind, value):
    return bytes([field << 3 | kind]) + value


def message(field, data):
    return number(field, 2, bytes([len(data)]) + data)


def test_unigram():
    pieces = {"▁": -4.0, "a": -3.0, "b": -3.5, "ab": -4.0, "▁a": -5.0, "ba": -4.5, "aba": -9.0}
    data = message(1, message(1, b"<unk>") + number(3, 0, b"\x02"))
    for p, s in pieces.items():
        data += message(1, message(1, p.encode()) + number(2, 5, struct.pack("<f", s)))
    data += message(2, number(3, 0, b"\x01")) + message(3, number(3, 0, b"\x01") + number(4, 0, b"\x00"))
    model = S.Model(data)
    own = S.Encoder(model)

    def least(text):
        best = None
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            parts, last = [], 0
            for i, c in enumerate([*cuts, 1], 1):
                if c:
                    parts.append(text[last:i])
                    last = i
            if all(p in pieces for p in parts):
                cost = -sum(pieces[p] for p in parts)
                best = cost if best is None or cost < best else best
        return best

    for n in range(1, 7):
        for text in map("".join, itertools.product("ab", repeat=n)):
            got = ids(own, text)
            assert abs(-sum(model.scores[i] for i in got) - least("▁" + text)) < 1e-6
            assert own.decode(got) == text
    assert ids(own, "axb")[2] == model.unknown or model.unknown in ids(own, "axb")


def test_unknown_runs_are_one_piece():
    """Without byte fallback, the ids of the public library."""
    for pieces in ({"\u2581": -4.0, "a": -3.0, "b": -3.5, "ab": -4.0, "\u2581a": -5.0}, {"a": -3.0, "b": -3.5, "ab": -4.0}):
        data = message(1, message(1, b"<unk>") + number(3, 0, b"\x02"))
        for p, s in pieces.items():
            data += message(1, message(1, p.encode()) + number(2, 5, struct.pack("<f", s)))
        trainer = message(2, number(3, 0, b"\x01"))
        normaliser = message(3, message(1, b"identity") + number(3, 0, b"\x01") + number(4, 0, b"\x00") + number(5, 0, b"\x01"))
        library = sentencepiece.SentencePieceProcessor()
        library.LoadFromSerializedProto(data + trainer + normaliser)
        own = S.Encoder(S.Model(data + trainer + normaliser))
        for text in ("axxxb", "xx", "x y", "ab xxab", "xxa xx xb", "a"):
            assert ids(own, text) == library.encode(text), text


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        S.Model(message(2, number(3, 0, b"\x03")))
