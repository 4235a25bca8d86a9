"""The coder's state fits a core's cache; frequent ids and pieces keep their places."""

import numpy as np
import pyarrow as pa
import pytest

from seclog.llm import idcoder, tokens as T


def test_tables_of_a_block_are_small():
    ids = (np.random.default_rng(3).pareto(0.9, 40 * idcoder.BLOCK) * 20).clip(0, 9_000).astype(np.uint32)
    counts = np.bincount(ids)
    model = idcoder._Model(40, idcoder._Order0(np.flatnonzero(counts), counts[counts > 0]), True)
    held = sum(x.nbytes for x in vars(model).values() if isinstance(x, np.ndarray))
    assert held < 3.5 * len(ids)  # bytes; 6.9 an id before


def test_frequent_ids_do_not_displace_each_other():
    chain = np.random.default_rng(4).permutation(500) * 97
    ids = np.tile(chain, 60).astype(np.uint32)  # each id says which comes next
    coded = idcoder.encode(ids)
    assert (idcoder.decode(coded) == ids).all()
    assert 8 * len(coded) < 3 * len(ids)  # 5.9 bits an id before


@pytest.mark.parametrize("distinct", [1, 2, 16_383, 16_384, 65_536])
@pytest.mark.parametrize("extra", [-1, 0, 1])
def test_segments_around_whole_blocks_and_narrow_entries(distinct, extra):
    n = -(-distinct // idcoder.BLOCK + 1) * idcoder.BLOCK + idcoder.BLOCK + extra
    n = max(n, distinct + idcoder.BLOCK + extra)
    ids = np.concatenate([np.arange(distinct), np.random.default_rng(5).integers(0, distinct, n - distinct)]).astype(np.uint32)
    assert (idcoder.decode(idcoder.encode(ids)) == ids).all()


def test_pieces_with_a_place_outlive_forgetting(monkeypatch):
    monkeypatch.setattr(T, "KEEP", 300)
    monkeypatch.setattr(T, "PLACES_BITS", 7)
    encoder, learned = T.Encoder(T.default_vocabulary()), []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda hashes, pieces: learned.extend(pieces) or learn(hashes, pieces))
    for i in range(120):
        texts = ["often seen words " + " ".join("rare%dx" % k for k in range(9 * i, 9 * i + 9))]
        ids, _ = encoder.encode(pa.array(texts, pa.string()))
        assert ids.tolist() == encoder.library.encode(texts[0], add_special_tokens=False).ids
        assert len(encoder.known[0]) + len(encoder.recent[0]) <= 300
    assert all(learned.count(x) < 3 for x in ("often", "seen", "words"))  # 4 times before


def test_short_and_long_pieces_have_hashes_of_their_own():
    random = np.random.default_rng(6)
    padded = np.concatenate([random.integers(97, 99, 4000), np.zeros(8)]).astype(np.uint8)
    a = random.integers(0, 3700, 20_000)
    b = a + random.integers(1, 300, len(a))
    found = {}
    for x, y, k in zip(a.tolist(), b.tolist(), T._hashes(padded, a, b).tolist()):
        assert found.setdefault(padded[x:y].tobytes(), k) == k
    assert len(set(found.values())) == len(found)


@pytest.mark.parametrize("text", ["a" * 70 + " " + "a" * 64 + " " + "a" * 65, "é" * 40 + ", x", "wort" * 3000 + "! " + "wort" * 16, "12345678 123456789 1234567", "", " \n "])
def test_pieces_of_every_length(text):
    encoder = T.encoder(T.default_vocabulary())
    ids, first = encoder.encode(pa.array([text, None, text], pa.string()))
    want = encoder.library.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want * 2 and first.tolist() == [0, len(want), len(want), 2 * len(want)]
