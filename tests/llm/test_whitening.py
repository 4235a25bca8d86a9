"""Whitening against numpy's eigenvectors and exact fractions."""

from fractions import Fraction

import numpy as np
import pytest

from seclog.llm import whitening as Wh

SCHEMA = "vec_id long, embedding array<double>, label int, n long, deviation string, component int, whitened double"


def rows(vectors, first=0):
    return [(first + i, None if v is None else [None if x is None else float(x) for x in v], None, 7, "own", None, 0.5) for i, v in enumerate(vectors)]


def symmetric(values, seed=3):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    a = q @ np.diag(values) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("values", [
    [1.0], [2.0, 1.0], list(np.linspace(1, 50, 64)), list(np.geomspace(1e-9, 1e6, 40)), [5.0] * 6 + [1.0] * 6, [3.0, 3.0 + 1e-9, 1.0, 0.0, 0.0], [7.0] * 5,
    [0.0, 0.0, 1e-3], list(np.random.default_rng(1).exponential(size=100))])
def test_divide_and_conquer_gives_eigenvectors(values):
    a = symmetric(np.array(values))
    n = len(values)
    found, vectors = Wh.eigen(a, n)
    scale = max(values)
    assert np.allclose(found, np.sort(values)[::-1], rtol=0, atol=2e-14 * n * scale)
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-13 * n
    assert np.abs(a @ vectors - vectors * found).max() < 1e-14 * n * scale
    few, leading = Wh.eigen(a, min(n, 3))
    assert np.allclose(few, found[:3], rtol=0, atol=2e-14 * n * scale) and leading.shape == (n, min(n, 3))


def test_sign_of_a_shifted_matrix():
    a = symmetric(np.array([4.0, 1e-10, -1e-12, -3.0]))
    values, vectors = np.linalg.eigh(a)
    assert np.allclose(Wh.polar(a), vectors @ np.diag(np.sign(values)) @ vectors.T, atol=1e-4)
    u = Wh.polar(symmetric(np.array([4.0, 1.0, -2.0, -3.0])))
    assert np.abs(u @ u - np.eye(4)).max() < 1e-14


def expected(vectors, k=4):
    x = [[int(np.floor(256 * float(c))) for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n = len(fit)
    sums = [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums)] for v in fit])
    values, turned = np.linalg.eigh(centred.T @ centred / n)
    return x, n, sums, values[::-1][:k], turned.T[::-1][:k], np.trace(centred.T @ centred / n)


def check(got, ids, vectors, k=4):
    x, n, sums, values, turned, trace = expected(vectors, k)
    assert len(got) == len(ids) * min(k, len(values))
    mean = np.array([s / n for s in sums])
    signs = {}
    by_id = {i: v for i, v in zip(ids, x)}
    for r in got:
        v = by_id[r.vec_id]
        c = r.component - 1
        assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(v, sums))
        want = float(turned[c] @ (np.array(v) - mean) / np.sqrt(values[c]))
        if abs(want) > 1e-3:
            signs.setdefault(c, np.sign(want * r.whitened))
            assert abs(r.whitened * signs[c] - want) < 1e-9 * max(1, abs(want))
        assert abs(r.explained / (values[c] / trace) - 1) < 1e-10 and r.identity_error < 1e-10


def test_report_equals_numpy(spark):
    rng = np.random.default_rng(5)
    vectors = list(rng.standard_normal((300, 12)) * np.geomspace(1, 0.2, 12) + 0.3)
    vectors += [vectors[0]] * 150  # a third of all rows are one vector
    vectors += [vectors[1] + 1e-9, -vectors[2] * 0]
    odd = [None, [], [1.0] * 11, [float("nan")] + [1.0] * 11, [float("inf")] + [0.0] * 11, [None] + [1.0] * 11]
    table = spark.createDataFrame(rows(vectors) + rows(odd, 9000), SCHEMA).repartition(7)
    check(Wh.report(table).collect(), list(range(len(vectors))), vectors)
    a, b = Wh.fit(table, 4), Wh.fit(table.repartition(2), 4)
    assert np.array_equal(a.vectors, b.vectors) and a.sums == b.sums and a.n == b.n


def test_embeddings_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    found = [(r.vec_id, r.embedding) for r in table.collect()]
    check(Wh.report(table).collect(), [i for i, _ in found], [v for _, v in found])
    every = Wh.fit(table, 64)
    assert len(every.values) == 64 and every.identity_error < 1e-11 and abs(sum(every.explained) - 1) < 1e-12


def test_null_ids_repeats_and_few_components(spark):
    table = spark.createDataFrame([(None, [1.0, 2.0], 1, 1, "", 1, 0.0)] * 3 + [(4, [3.0, 5.0], 1, 1, "", 1, 0.0)], SCHEMA)
    got = Wh.report(table).collect()  # two distinct vectors: one component has variance
    assert sorted((str(r.vec_id), r.component, r.n, round(abs(r.whitened), 9)) for r in got) == [("4", 1, 2, 1.0)] + [("None", 1, 2, 1.0)] * 3


def test_without_variance_or_rows(spark):
    for vectors in ([], [None], [[float("nan")]], [[1.0, 2.0]] * 5):
        assert Wh.report(spark.createDataFrame(rows(vectors), SCHEMA)).count() == 0


def test_values_beyond_doubles_of_whole_numbers(spark):
    vectors = [[1e17, 1.0], [-1e17, 2.0], [5e300, 3.0], [0.0, -4.0]]
    table = spark.createDataFrame(rows(vectors), SCHEMA)
    got = Wh.report(table).collect()
    assert {r.deviation for r in got} == {None} and all(np.isfinite(r.whitened) for r in got)
    big = Wh.products(np.array([[1 << 40, -3], [-(1 << 40), 5]]), np.array([1, 0]))
    assert big[1].tolist() == [[((1 << 40) - 1) ** 2 + ((1 << 40) + 1) ** 2, -3 * ((1 << 40) - 1) - 5 * ((1 << 40) + 1)], [-3 * ((1 << 40) - 1) - 5 * ((1 << 40) + 1), 34]]
    assert Wh.whole(np.array([-0.0, 1 / 256, -1 / 512])).tolist() == [0, 1, -1]
