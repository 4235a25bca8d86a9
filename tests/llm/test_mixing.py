"""The mix: targets, whole copies, Pareto order and its SQL."""

import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from corpus import DOCS, documents, frame, sentence
from seclog.llm import mixing


def shares(words, weights=(1, 2, 3), repeats=3):
    """Targets by resharing the excess until none is above its limit."""
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), sum(words.values())
    while True:
        left = total - sum(repeats * words[s] for s in full)
        free = sum(weight[s] for s in words if s not in full)
        out = {s: repeats * words[s] if s in full else left * weight[s] / free for s in words}
        above = {s for s in words if s not in full and out[s] > repeats * words[s]}
        if not above:
            return out
        full |= above


def corpus_rows(seed=3, n=900):
    rng = random.Random(seed)
    rows = [(i, sentence(rng, int(rng.paretovariate(0.9)) * 5 % 3000 + 1), "en", rng.choice(["b", "b", "b", "a", "é", "\U0001f600", "￿", None]), 1, "own", i, None, "here") for i in range(n)]
    rows += [(5000 + i, t, None, "b", None, "own", 1, None, "here") for i, t in enumerate([None, "", " \t\n", "one", "x" * 50000])]
    rows += [(6000 + i, "copied text of a third of all rows", None, "hot", None, None, None, None, None) for i in range(n // 2)]
    rows += [(7000, sentence(rng, 3000), None, "long", None, None, None, None, None), (7001, "tiny one", None, "long", None, None, None, None, None)]
    rows += [(7002, None, None, "empty", None, None, None, None, None)]
    return rows


def test_targets_counts_and_limits(spark):
    rows = corpus_rows()
    got = mixing.report(frame(spark, rows, parts=7)).collect()
    size = {r[0]: len((r[1] or "").encode().split()) for r in rows}
    words, target, taken = Counter(), {}, Counter()
    source = {r[0]: r[3] for r in rows}
    for i, s in source.items():
        words[s] += size[i]
    want = shares(words)
    assert len(got) == len(rows)
    for r in got:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == words[s] and abs(r.target - want[s]) <= 1e-9 * max(1, want[s])
        assert r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        assert not r.size or int(want[s] / words[s] + 1e-12) <= r.taken // r.size <= int(want[s] / words[s]) + 1
        taken[s] += r.taken
    for s in words:
        smallest = min((size[i] for i in size if source[i] == s and size[i]), default=0)
        near = 3 * smallest if s in ("a", "b", "é", "hot") else max((size[i] for i in size if source[i] == s), default=0)
        assert abs(taken[s] - want[s]) <= near + 1, s
    again = mixing.report(frame(spark, random.Random(1).sample(rows, len(rows)), parts=2)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_inclusion_follows_the_probabilities(spark):
    rng = random.Random(6)
    texts = [sentence(rng, 10 if i % 2 else 90) for i in range(400)]
    rows = [(i, t, None, "a", None, None, None, None, None) for i, t in enumerate(texts)] + [(9999, sentence(rng, 25000), None, "b", None, None, None, None, None)]
    times = Counter()
    runs = 6
    for seed in range(runs):
        for r in mixing.report(frame(spark, rows, parts=2), weights=(1, 3), seed=seed).filter("doc_id < 400").collect():
            times[r.size] += r.taken // r.size
            target = r.target
    slope = (target) / (200 * (10 * 10 ** 0.5 + 90 * 90 ** 0.5)) if target < 20000 else None
    if slope is None:  # one whole copy of each comes first
        slope = (target - 20000) / (200 * (10 * 10 ** 0.5 + 90 * 90 ** 0.5))
        times = {s: n - 200 * runs for s, n in times.items()}
    for s, n in times.items():
        assert abs(n / (200 * runs) - min(1, slope * s ** 0.5)) < 0.06


def test_mix_repeats_whole_rows(spark):
    rows = documents(n=30)
    rows += [rows[15]] * 4 + [(None, "no id", None, None, None, None, None, None, None)] * 2
    docs = frame(spark, rows)
    got = Counter(tuple(r) for r in mixing.mix(docs).collect())
    wanted = Counter()
    for r in mixing.report(docs).collect():
        if r.size:
            wanted[r.doc_id, r.size] += r.taken // r.size
    found = Counter()
    for row, n in got.items():
        assert row in rows
        if len((row[1] or "").encode().split()):
            found[row[0], len((row[1] or "").encode().split())] += n
    assert found == +wanted


@pytest.mark.parametrize("stretch", [mixing.STRETCH, 7])
def test_equals_its_sql(spark, monkeypatch, stretch):
    monkeypatch.setattr(mixing, "STRETCH", stretch)
    rows = corpus_rows(seed=9, n=400)
    rows += [rows[20]] * 5
    docs = frame(spark, rows, parts=4)
    connection = duckdb.connect()
    connection.register("documents", docs.select("doc_id", "text", "source").toArrow())
    want = connection.execute(mixing.ORACLE).fetchall()
    def plain(rows):
        return sorted((i, n, s, round(t, 6), k) for i, n, s, t, k in rows)
    assert plain(map(tuple, mixing.report(docs).collect())) == plain(want)


def test_no_rows(spark):
    empty = frame(spark, [], DOCS)
    assert mixing.report(empty).count() == 0 and mixing.mix(empty).columns == empty.columns and mixing.mix(empty).count() == 0
    nothing = frame(spark, [(1, None, None, None, 1, None, 1, 1, None), (2, " ", None, "a", 1, None, 1, 1, None)])
    assert sorted(tuple(r) for r in mixing.report(nothing).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
