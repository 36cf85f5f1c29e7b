"""Hard negatives against all pairs; the tree on vectors where it eliminates much, and on one where it cannot."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from offsetlake.llm import hard_negatives, hyperplane_tree
from offsetlake.llm.common import Work

SCHEMA = "vec_id long, label int, vector array<long>"
SMALL = {"sample_rows": 64, "leaf_sample": 8, "branches": 4, "block_rows": 7, "lane_rows": 20}


def brute(rows, is_anchor, positives=5, negatives=10, window=(30, 90)):
    """Every anchor row against every other row."""
    dims = max((len(v) for _, _, v in rows if v is not None), default=1)
    live = [(i, l, np.array([*v, *[0] * (dims - len(v))])) for i, l, v in rows if None not in (i, l) and v is not None]
    out = []
    for n, (anchor, label, vector) in enumerate(live):
        if not is_anchor(anchor):
            continue
        scored = sorted(((-int(vector @ v), i, l) for m, (i, l, v) in enumerate(live) if m != n), key=lambda x: x[:2])
        for score, positive, _ in [x for x in scored if x[2] == label][:positives]:
            hits = [x for x in scored if x[2] != label and window[0] * -score <= 100 * -x[0] <= window[1] * -score]
            out += [(anchor, positive, rank, x[1], -score, -x[0]) for rank, x in enumerate(hits[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, modulus=5, **shape):
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "uid", "leaf", "lane", "ask", "score", "rank", "block", "part", "square", "low", "high"):
        frame = frame.withColumn(name, F.lit("x"))
    frame = frame.withColumnsRenamed({"vec_id": "the key", "label": "the label"})
    found = hard_negatives.mine(frame, F.col("id") % modulus == 0, key="the key", label="the label", **shape)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def clusters(seed, n, dims=6, groups=5, labels=3):
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, 300, (groups, dims))
    made = centres[draw.integers(groups, size=n)] + draw.normal(0, 20, (n, dims))
    return [(int(i), int(draw.integers(labels)), np.floor(v).astype(int).tolist()) for i, v in enumerate(made)]


@pytest.mark.parametrize("shape", [{}, SMALL])
def test_equals_all_pairs(spark, shape):
    rows = clusters(1, 150)
    assert mined(spark, rows, **shape) == brute(rows, lambda i: i % 5 == 0)


def test_hard_rows(spark):
    """Nulls, repeated rows and keys, ties, zero and short vectors, very large ones, a hot vector."""
    hot = [3, -2, 5]
    rows = [
        (None, 1, [1, 2, 3]), (5, None, [1, 2, 3]), (10, 1, None), (15, 1, [0, 0, 0]), (20, 1, [7]), (20, 2, [7]), (20, 1, [7]),
        (25, 2, [1, 1, 1]), (26, 1, [1, 1, 1]), (27, 2, [1, 1, 1]), (30, 1, [-9, -9, 4]), (35, 0, [200_000_000, 5, 5]), (36, 1, [150_000_000, 1, 0]), (37, 0, []),
    ]
    rows += [(100 + i, i % 3, hot) for i in range(60)] + [(130, 0, hot)] * 3
    assert mined(spark, rows, **SMALL) == brute(rows, lambda i: i % 5 == 0)


def test_empty_tables_and_single_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(None, 1, [1])]) == []
    assert mined(spark, [(5, 1, [1, 2])]) == []
    rows = [(5, 1, [10, 2]), (6, 1, [9, 2]), (7, 2, [6, 2])]
    assert mined(spark, rows) == brute(rows, lambda i: i % 5 == 0) == [(5, 6, 1, 7, 94, 64)]


def test_siblings_are_eliminated(spark):
    """On clustered rows a window reaches few leaves, and none that holds an answer is lost."""
    rows = clusters(4, 3000, dims=4, groups=30)
    frame = spark.createDataFrame(rows, SCHEMA)
    work = Work(spark, "t")
    index = hyperplane_tree.build(hyperplane_tree.numbered(frame, work, "vec_id", "label", "vector"), work, sample_rows=600, leaf_sample=20, branches=6)
    data = np.array([v for _, _, v in rows])
    queries = data[::50]
    products = queries @ data.T
    low, high = (0.93 * (queries**2).sum(1)).astype(np.int64), (1.05 * (queries**2).sum(1)).astype(np.int64)
    n = np.arange(len(queries))
    asks = hyperplane_tree.Asks(n, -n, n, queries, low, high)
    alive = hyperplane_tree.reachable(index.square, index.tree, asks)
    leaf = index.tree.place(hyperplane_tree.lifted(data, index.square))
    inside = (products >= low[:, None]) & (products <= high[:, None])
    assert inside.sum() > 500
    assert all(alive[q, leaf[r]] for q, r in np.argwhere(inside))
    assert index.tree.leaves > 20 and alive.mean() < 0.35


def test_ranges_hold_all_rows(spark):
    """Ranges are of all rows, not of the sample that the tree was grown on."""
    rows = clusters(7, 500)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    work = Work(spark, "t")
    index = hyperplane_tree.build(hyperplane_tree.numbered(frame, work, "vec_id", "label", "vector"), work, **SMALL)
    data = hyperplane_tree.lifted(np.array([v for _, _, v in rows]), index.square)
    mine = hyperplane_tree.Tree(data[:0])
    mine.nodes, mine.leaves, mine.branches = index.tree.nodes, index.tree.leaves, 4
    mine.low, mine.high = np.full_like(index.tree.low, np.inf), np.full_like(index.tree.high, -np.inf)
    mine.place(data, widen=True)
    assert np.allclose(mine.low, index.tree.low) and np.allclose(mine.high, index.tree.high)
    held = [r for r in index.blocks.collect()]
    assert sum(len(r.uids) // 8 for r in held) == 500 and max(len(r.uids) // 8 for r in held) <= 7


def test_long_vectors_are_whole(spark):
    rows = [(i, i % 2, [j % (i + 2) for j in range(3000)]) for i in range(12)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 5 == 0)
