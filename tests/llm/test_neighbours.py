import numpy as np

from seclog.llm.neighbours import Tree, nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, every):
    good = {i: np.array(v, float) for i, v, *_ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in good:
        if q % every == 0:
            out[q] = sorted((-float(good[q] @ v), i) for i, v in good.items() if i != q)[:k]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.4 * rng.normal(size=16)).astype(np.float32).tolist(), 0) for i in range(3000)]
    got = {}
    for r in nearest(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(rows, 20, 20)
    assert set(got) == set(want)
    vectors = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows}
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(abs(s - vectors[q] @ vectors[i]) < 1e-12 for _, i, s in found)
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(found, found[1:]))
        hits += len({i for _, i, _ in found} & {i for _, i in want[q]})
    assert hits / (20 * len(want)) >= 0.9


def test_odd_vectors_copies_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (20, [0.0, 2.0], None), (40, None, 1), (60, [0.0, 0.0], 1), (80, [nan, 1.0], 1), (100, [inf, 1.0], 1), (120, [None, 1.0], 1),
            (None, [1.0, 1.0], 1), (5, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (140, [1.0, 2.0, 3.0], 1)]
    out = nearest(spark.createDataFrame(rows, SCHEMA)).collect()
    found = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found == {0: [3, 5, 20], 20: [0, 3, 5]}
    assert nearest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_vector_shared_by_most_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 0.5, 0.25], 0) for i in range(900)] + [(i, rng.normal(size=3).astype(np.float32).tolist(), 0) for i in range(900, 1300)]
    got = {}
    for r in nearest(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(rows, 20, 20)
    assert set(got) == set(want)
    assert all(set(got[q]) == {i for _, i in want[q]} for q in range(0, 900, 20))


def test_visits_widen_to_all_leaves():
    rng = np.random.default_rng(1)
    tree = Tree(rng.normal(size=(400, 8)), 10)
    assert sorted(tree.best_bins(rng.normal(size=8), tree.leaves)) == list(range(tree.leaves))
