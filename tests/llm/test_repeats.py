import collections
import hashlib
import random

import numpy as np
import pytest

from corpus import DOCS, documents, frame
from seclog.llm import repeats as R


def brute(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[s:s + 200] for _, b in texts for s in range(len(b) - 199))
    out = []
    for i, b in texts:
        edge = np.zeros(len(b) + 1, int)
        for s in range(len(b) - 199):
            if seen[b[s:s + 200]] > 1:
                edge[s] += 1
                edge[s + 200] -= 1
        covered = np.cumsum(edge)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~covered].tobytes()
        out.append((i, len(b), int(covered.sum()), len(R.spans(covered)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def passages(seed=5, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    shared = [" ".join(word() for _ in range(k)) for k in (38, 39, 40, 41, 45, 60, 100, 200)]
    rows = [(0, None), (1, ""), (2, "x" * 199), (3, "x" * 200), (4, "x" * 201), (5, "y" * 900), (6, "ab" * 300)]
    for i in range(7, n):
        parts = []
        for _ in range(rng.randint(1, 5)):
            own = rng.choice(shared)[rng.choice([0, 0, rng.randint(0, 30)]):]
            if rng.random() < 0.4:
                k = rng.randrange(len(own))
                own = own[:k] + "Z" + own[k + 1:]
            parts += [" ".join(word() for _ in range(rng.randint(0, 30))), own]
        rows.append((i, " ".join(parts)))
    return rows + [(n + k, t) for k, (_, t) in enumerate(rows[20:35])] + [rows[20]]


@pytest.mark.parametrize("group,merge_rows", [(4096, 40), (6, 20_000)])
def test_every_repeated_byte_goes(spark, monkeypatch, group, merge_rows):
    monkeypatch.setattr(R, "GROUP", group)
    monkeypatch.setattr(R, "MERGE_ROWS", merge_rows)
    rows = passages()
    out = R.report(frame(spark, rows, "doc_id long, text string"))
    assert sorted(map(tuple, out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())) == brute(rows)


def test_clashing_columns_and_an_empty_table(spark):
    rows = documents()
    out = R.report(frame(spark, rows))
    assert sorted(map(tuple, out.collect())) == brute([r[:2] for r in rows])
    assert R.report(frame(spark, [], DOCS)).count() == 0


def test_the_loser_tree_merges_and_knows_prefixes():
    rng = random.Random(3)
    words = sorted("".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(500))
    runs = [sorted(words[i::7]) for i in range(7)]
    tree = R.LoserTree([R.Run(*R.front_code(run), [None] * len(run)) for run in runs])
    out = list(tree)
    assert [s for _, s, _ in out] == words
    assert [n for n, _, _ in out][1:] == [R.common_prefix(a, b) for a, b in zip(words, words[1:])]


def test_anchors_own_every_window_once():
    data = np.frombuffer(("abc " * 100 + "some other text " * 40).encode(), np.uint8)
    found = R.Anchors(data, np.array([0, 400, len(data)]))
    windows = [s for a, b in zip(found.first, found.last) for s in range(a, b + 1)]
    assert windows == list(range(0, 201)) + list(range(400, len(data) - 199))
    assert ((found.at >= found.last) & (found.at < found.first + R.REACH)).all()
