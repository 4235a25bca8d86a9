"""Every query gets min(20, candidates) rows, also one far from all clusters."""

import numpy as np

from seclog.llm.neighbours import Tree, nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def test_outliers_of_clustered_data_get_all_their_rows(spark):
    rng = np.random.default_rng(9)
    centres = 5 * rng.normal(size=(30, 31))
    rows = [(i, [*(centres[i % 30] + 0.3 * rng.normal(size=31)).tolist(), 0.0], 0) for i in range(5400)]
    # Outliers in a direction of their own, in clusters of a row or few; four of them are queries.
    rows += [(i, [0.0] * 31 + [20.0 * 2 ** n], 0) for n, i in enumerate([5400, 5420, 5440, 5460, *range(5461, 5469)])]
    counts = {r.query_id: r["count"] for r in nearest(spark.createDataFrame(rows, SCHEMA)).groupBy("query_id").count().collect()}
    assert len(counts) == 274 and set(counts.values()) == {20}


def test_leaves_go_on_until_they_hold_enough():
    rng = np.random.default_rng(1)
    tree = Tree(rng.normal(size=(400, 8)), 10)
    query = rng.normal(size=8)
    order, sizes = tree.best_bins(query, tree.leaves), {leaf: 3 for leaf in range(tree.leaves)}
    assert tree.best_bins(query, 2, sizes, 21) == order[:7]
    assert tree.best_bins(query, 9, sizes, 21) == order[:9]
    assert tree.best_bins(query, 1, sizes, 10**6) == order
