"""Pieces met lately are found by their place, without a search, and give the ids of the library."""

import numpy as np
import pyarrow as pa
import pytest

from seclog.llm import tokens as T

TEXTS = ["Die größte Übung, naïve cafés!", "plain words, plain words.", "", None, "ÿ ß à über-über 12;34 ...", "日本 语 text\nnew line", "a,b;;", ",,"]


def whole(encoder, texts):
    return [encoder.library.encode(t or "", add_special_tokens=False).ids for t in texts]


def rows(found):
    ids, first = found
    return [ids[a:b].tolist() for a, b in zip(first, first[1:])]


def test_known_pieces_need_no_search(monkeypatch):
    encoder = T.Encoder(T.default_vocabulary())
    column = pa.array(TEXTS, pa.string())
    assert rows(encoder.encode(column)) == whole(encoder, TEXTS)

    def search(*args, **kwargs):
        raise AssertionError("searched again")

    monkeypatch.setattr(T.np, "unique", search)
    assert rows(encoder.encode(column)) == whole(encoder, TEXTS)


@pytest.mark.parametrize("keep, bits", [(3, 18), (40, 2), (1_000_000, 1)])
def test_crowded_places_and_forgetting_change_nothing(monkeypatch, keep, bits):
    monkeypatch.setattr(T, "KEEP", keep)
    monkeypatch.setattr(T, "PLACES_BITS", bits)
    encoder, random = T.Encoder(T.default_vocabulary()), np.random.default_rng(5)
    for _ in range(6):
        texts = [" ".join("w%d" % i for i in random.integers(0, 30, 20)) for _ in range(5)] + TEXTS
        assert rows(encoder.encode(pa.array(texts, pa.string()))) == whole(encoder, texts)
