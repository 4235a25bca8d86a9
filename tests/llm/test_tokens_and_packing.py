import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from corpus import documents, frame
from seclog.llm import idcoder, idfile
from seclog.llm.packing import Plan, pack
from seclog.llm.store import Scratch
from seclog.llm.tokens import default_vocabulary, encoder

LIBRARY = Tokenizer.from_file(default_vocabulary())
ODD = list("abcXYZ éÉàß÷·Σσ.,!?'s\t\n\ŕñ中文🙂0123<|>-_&\"İ…\x85 ") + ["<|endoftext|>", "<|StartOfText|>", " 's", "'re "]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_library_s():
    rng = random.Random(2)
    texts = [None, "", " "] + ["".join(rng.choices(ODD, k=rng.randint(0, 40))) for _ in range(1500)] + [r[1] for r in documents()]
    found, first = encoder(default_vocabulary()).encode(pa.array(texts, pa.string()))
    assert all(found[a:b].tolist() == ids(t) for t, a, b in zip(texts, first, first[1:]))


@given(st.lists(st.integers(1, 64), max_size=300), st.integers(0, 40))
@settings(max_examples=150, deadline=None)
def test_a_plan_places_every_piece_once(lengths, full):
    counts = np.bincount(lengths + [64] * full, minlength=65)
    plan = Plan(counts, 64)
    used, ranks = {}, {}
    table = plan.table()
    for i, (length, first, base, per, offset) in enumerate(table.tolist()):
        nxt = table[i + 1][1] if i + 1 < len(table) and table[i + 1][0] == length else counts[length]
        for k in range(int(nxt) - first):
            used.setdefault(base + k // per, []).append((offset + k % per * length, length))
            ranks.setdefault(length, []).append(first + k)
    assert {k: len(v) for k, v in ranks.items()} == {int(n): int(c) for n, c in enumerate(counts) if c}
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(lengths) + 64 * full
    assert len(used) == plan.sequences >= -(-total // 64)
    assert plan.sequences <= max(1, -(-total // 64) * 11 / 9 + 1)  # what best fit, longest first, guarantees


def test_dominance_fixes_exact_pairs():
    plan = Plan(np.bincount([60, 4, 60, 4, 33, 31], minlength=65), 64)
    assert plan.fixed == plan.sequences == 3


def test_packing_of_whole_documents(spark):
    rows = documents() + [documents()[12]] * 2
    out = pack(frame(spark, rows), size=256).collect()
    want = []
    for i, t, *_ in rows:
        own = ids(t) + [1]
        want += [(i, p // 256, p, len(own[p:p + 256]), zlib.crc32(np.array(own[p:p + 256], "<u4").tobytes())) for p in range(0, len(own), 256)]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        assert [a for a, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
        assert sum(n for _, n in places) <= 256
    assert len(sequences) <= 11 / 9 * sum(w[3] for w in want) / 256 + 1
    assert pack(frame(spark, [], "doc_id long, text string")).count() == 0


@given(st.lists(st.integers(0, 65535), max_size=400), st.integers(0, 3), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_the_coder_gives_the_ids_back(some, repeats, spread):
    stream = np.array((some * (repeats + 1)) + [x % spread for x in some], np.uint32)
    assert idcoder.decode(idcoder.encode(stream)).tolist() == stream.tolist()


def test_blocks_are_checked_and_small():
    stream = np.arange(20000, dtype=np.uint32) % 7
    coded = bytearray(idcoder.encode(stream))
    assert len(coded) < 2000
    coded[-9] ^= 1
    with pytest.raises(ValueError):
        idcoder.decode(bytes(coded))
    with pytest.raises(ValueError):
        idcoder.encode(np.array([1 << 16]))


def test_id_files_give_back_every_text(spark, monkeypatch):
    rows = [r[:2] for r in documents()]
    want, at = [], 0
    for i, t in sorted(rows):
        own = ids(t) + [2]
        want.append((i, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        at += len(own)
    monkeypatch.setattr(idfile, "PART_BYTES", 20_000)
    path = Scratch(spark, "t").path("ids")
    idfile.write(frame(spark, rows, "doc_id long, text string"), path)
    assert sorted(map(tuple, idfile.digest(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want
    back = {r.doc_id: r.ids for r in idfile.read(spark, path).collect()}
    assert all(back[i] == ids(t) + [2] for i, t in rows)


def test_id_files_of_odd_tables(spark):
    path = Scratch(spark, "t").path("ids")
    idfile.write(frame(spark, [], "doc_id long, text string"), path)
    assert idfile.digest(spark, path).count() == 0
    rows = [(None, "b"), (3, "y"), (3, "x"), (3, "x"), (1, None)]
    path = Scratch(spark, "t").path("ids")
    idfile.write(frame(spark, rows, "doc_id long, text string"), path)
    out = sorted(((r.start, r.doc_id, r.n_tokens) for r in idfile.digest(spark, path).collect()))
    assert [r[1] for r in out] == [None, 1, 3, 3, 3] and [r[0] for r in out] == [0, 2, 3, 5, 7]


def test_coded_ids_are_smaller_than_their_order_0_entropy(sf):
    texts = pq.read_table(f"{sf}/documents.parquet", columns=["text"]).column(0).to_pylist() * 3
    stream = np.concatenate([np.array(ids(t) + [2], np.uint32) for t in texts if t])
    counts = np.bincount(stream)
    share = counts[counts > 0] / len(stream)
    coded = idcoder.encode(stream)
    assert (idcoder.decode(coded) == stream).all()
    assert 8 * len(coded) / len(stream) < -(share * np.log2(share)).sum()


@pytest.mark.parametrize("stream", [np.arange(65536), np.full(5000, 65535), np.random.default_rng(1).integers(0, 65536, 200_000)])
def test_every_id_can_be_coded(stream):
    assert (idcoder.decode(idcoder.encode(stream.astype(np.uint32))) == stream).all()


def test_damage_anywhere_is_noticed():
    stream = np.random.default_rng(2).integers(0, 300, 9000).astype(np.uint32)
    coded = idcoder.encode(stream)
    for place in [*range(0, 60, 6), *range(60, len(coded), len(coded) // 20)]:
        broken = bytearray(coded)
        broken[place] ^= 16
        try:
            assert (idcoder.decode(bytes(broken)) == stream).all()  # bits after a block's last id say nothing
        except ValueError:
            pass


def test_one_id_on_all_rows_fills_many_parts(spark, monkeypatch):
    monkeypatch.setattr(idfile, "PART_BYTES", 1000)
    path = Scratch(spark, "t").path("ids")
    rows = [(7, f"words of row {i % 40} " * 5, 1, "x") for i in range(200)]
    idfile.write(frame(spark, rows, "doc_id long, text string, part int, coded string"), path)
    assert spark.read.parquet(path).select("part").distinct().count() > 5
    assert sorted(r.ids for r in idfile.read(spark, path).collect()) == sorted(ids(t) + [2] for _, t, *_ in rows)
