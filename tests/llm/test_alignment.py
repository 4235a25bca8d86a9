"""Alignment of two tokenizers against sets of overlapping byte ranges."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from corpus import DOCS, documents, frame
from seclog.llm import alignment

ODD = ["▁ mark", "a ▁b", "tab\there", " lead", "trail ", "two  spaces", "a  b c", "x  y", "x   y", "　 z", "<|endoftext|> and <s> </s> <unk>",
       "<0x41> byte", "null\x00byte", "\x85next line", "line\nbreak \n\n end", "\U0001f600 \U0001f600\U0001f468‍\U0001f469", "café café x", "don't we'll I'M",
       "中文字 中", "1 22 333 4444", "a" * 3000, "ab" * 500 + " c", "   ", "\n", "\r\n x", "​ zero", "ﬁ ①", "a ́b", "﻿bom"]


def plain(texts):
    """Token ids, byte ranges, groups and links of whole texts, straight from the definition."""
    both = alignment.aligner(*alignment.default_vocabularies())
    out = []
    for t in texts:
        a = both.library.encode(" " + t, add_special_tokens=False).ids
        b = both.second.encode(t)
        if not t or b"".join(both.a.tokens[i] for i in a) != (" " + t).encode() or b"".join(both.b.tokens[i] for i in b) != (" " + t).encode():
            out.append(([], [], [], []))
            continue
        a_end, b_end = np.cumsum([len(both.a.tokens[i]) for i in a]).tolist(), np.cumsum([len(both.b.tokens[i]) for i in b]).tolist()
        a_set, b_set = set(a_end), set(b_end)
        groups, i, j = [], 0, 0
        for end in sorted(a_set & b_set):
            x, y = a_end.index(end, i) + 1, b_end.index(end, j) + 1
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
        found, j = [], 0
        for i, end in enumerate(a_end):
            start = a_end[i - 1] if i else 0
            while j and b_end[j - 1] > start:
                j -= 1
            while j < len(b) and (b_end[j - 1] if j else 0) < end:
                if b_end[j] > start:
                    found.append((a[i], b[j]))
                j += 1
        out.append((a, b, groups, found))
    return out


def expected(texts):
    parts = plain(texts)
    counts = Counter(p for _, _, _, found in parts for p in set(found))
    highest = {}
    for (a, _), n in counts.items():
        highest[a] = max(highest.get(a, 0), n)
    rows = []
    for a, b, groups, found in parts:
        name = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((len(a), len(b), len(groups), len(found), sum(counts[p] == highest[p[0]] for p in found), sum(counts[p] for p in found),
                     hashlib.sha256(name.encode()).hexdigest() if name else ""))
    return rows


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 40, 0])
def test_report_equals_the_definition(spark, frequent):
    rows = documents(n=25)[:-1]
    rows += [(1000 + i, t, None, None, None, "own", 0, None, "x") for i, t in enumerate(ODD)]
    rows += [rows[12]] * 3 + [(None, "null id here", None, None, None, None, None, None, None)] * 2
    got = alignment.report(frame(spark, rows), frequent=frequent).collect()
    want = expected([r[1] or "" for r in rows])
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted((str(row[0]), *w) for row, w in zip(rows, want))


def test_random_texts_piece_by_piece():
    rng = random.Random(4)
    letters = "ab Z9.,'\n\t  é 中▁ \U0001f600-_́\x1c\x85"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    both = alignment.Aligner(*alignment.default_vocabularies())
    assert both.cuts and both.ranks is not None
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    for _ in range(2):  # with new pieces, and with kept ones
        sizes, names, pairs, times, at = both.rows(data, offsets)
        for i, (a, b, groups, found) in enumerate(plain(texts)):
            assert sizes[i].tolist() == [len(a), len(b), len(groups), len(found)], texts[i]
            assert names[i].decode() == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            assert dict(zip(pairs[at[i]:at[i + 1]].tolist(), times[at[i]:at[i + 1]].tolist())) == Counter(x * both.width + y for x, y in found)
    both.cuts = False  # without cuts, and with the library's own encoder
    whole = both.rows(data, offsets)
    both.ranks = None
    assert both.ranks is None and whole[1] == names == both.rows(data, offsets)[1] and np.array_equal(whole[2], pairs)


def test_pointers_double_to_the_end_of_the_group():
    rng = random.Random(8)
    for n in (1, 2, 7, 5000):
        a = sorted(rng.sample(range(1, 2 * n), n - 1)) + [2 * n]
        b = sorted(rng.sample(range(1, 2 * n), n - 1)) + [2 * n]
        label = alignment.terminals(alignment.pointers(np.array(a), np.array(b)))
        ends = sorted(set(a) & set(b))
        assert [ends.index(b[k - n]) for k in label.tolist()] == [next(i for i, e in enumerate(ends) if e >= x) for x in a + b]
    chain_a, chain_b = np.arange(2, 20002, 2), np.append(np.arange(1, 19999, 2), 20000)  # one group: each token overlaps the next
    assert len(set(alignment.terminals(alignment.pointers(chain_a, chain_b)).tolist())) == 1


def test_no_rows_and_whole_texts(spark):
    assert alignment.report(frame(spark, [], DOCS)).count() == 0
    found = alignment.align(frame(spark, documents(n=3))).collect()
    assert all(r.groups.count(";") + 1 == r.n_groups or not r.groups for r in found) and max(r.n_a for r in found) > 9000
