"""Coding holds few copies of a segment's ids; pieces learned lately stand apart from those kept long."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from seclog.llm import idcoder, tokens as T


def _peak(call, *args):
    tracemalloc.start()
    try:
        return call(*args), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_memory_of_a_segment():
    ids = (np.random.default_rng(3).pareto(0.7, 1_500_000) * 20).clip(0, 49_000).astype(np.uint32)
    coded, most = _peak(idcoder.encode, ids)
    again, read = _peak(idcoder.decode, coded)
    assert (again == ids).all()
    assert most < 22 * len(ids) and read < 15 * len(ids)  # bytes for each id of 4


@pytest.mark.parametrize("recent", [0, 3, 25])
def test_pieces_learned_lately_and_long_ago(monkeypatch, recent):
    monkeypatch.setattr(T, "RECENT", recent)
    monkeypatch.setattr(T, "PLACES_BITS", 2)
    encoder, random = T.Encoder(T.default_vocabulary()), np.random.default_rng(8)
    for _ in range(8):
        texts = [" ".join("wört%d" % i for i in random.integers(0, 60, 12)) + ", Plain words." for _ in range(4)]
        ids, first = encoder.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [encoder.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(encoder.known[0]) + len(encoder.recent[0]) >= 60 and len(encoder.recent[0]) <= max(recent, 0)
