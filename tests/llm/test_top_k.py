import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from offsetlake.llm import top_k

SCHEMA = "vec_id long, embedding array<float>, vector string, score long"


def brute(rows, k):
    """All inner products of different rows, whatever their keys."""
    good = []
    for key, v in rows:
        if key is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((key, [math.floor(64 * float(np.float32(x))) for x in v]))
    out = []
    for own, (query, q) in enumerate(good):
        if query % 20:
            continue
        scored = sorted((-sum(map(lambda a, b: a * b, q, v)), key) for row, (key, v) in enumerate(good) if row != own)
        out += [(query, rank, key, -score) for rank, (score, key) in enumerate(scored[:k], 1)]
    return sorted(out)


def found(spark, rows, k=5, **options):
    frame = spark.createDataFrame([(key, v, "x", 0) for key, v in rows], SCHEMA).repartition(3)
    vectors = frame.select("vec_id", top_k.integers(F.col("embedding")).alias("vector"), "score")
    return sorted(map(tuple, top_k.top_k(vectors, F.col("vec_id") % 20 == 0, k=k, **options).collect()))


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_equals_all_products(spark, scale):
    draw = np.random.default_rng(2)
    base = draw.normal(size=(6, 8))
    rows = [(i, (scale * draw.exponential() * (base[i % 6] + draw.normal(size=8) / 4)).tolist()) for i in range(300)]
    assert found(spark, rows, block_rows=32, query_rows=4) == brute(rows, 5)


def test_ties_go_to_the_smaller_key(spark):
    rows = [(i, [1.0, 0.0]) for i in range(90)] + [(200 + i, [0.0, 0.0]) for i in range(30)]
    assert found(spark, rows, k=7, block_rows=16, query_rows=2) == brute(rows, 7)


def test_bad_rows_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -2.0]), (20, [0.5, 0.25]), (20, [0.5, 0.125]), (20, [0.5, 0.25]), (3, [1.0, None]), (4, [nan, 1.0])]
    rows += [(5, [inf, 1.0]), (6, [-inf, 1.0]), (7, None), (None, [9.0, 9.0]), (40, None), (8, [-0.01, 0.0]), (9, [0.0, 0.0])]
    assert found(spark, rows) == brute(rows, 5)


def test_rows_that_repeat_a_key_are_all_candidates(spark):
    rows = [(0, [1.0, 1.0]), (1, [5.0, 5.0]), (1, [2.0, 2.0]), (1, [5.0, 5.0]), (0, [1.0, 1.0]), (0, [3.0, -1.0])]
    rows += [(i % 7 * 10, [float(i % 5), float(i % 3)]) for i in range(60)]
    assert found(spark, rows, block_rows=4, query_rows=2) == brute(rows, 5)


def test_short_vectors_and_empty_tables(spark):
    got = found(spark, [(0, [1.0]), (1, [1.0, 1.0]), (2, [])])
    assert got == [(0, 1, 1, 4096), (0, 2, 2, 0)]
    assert found(spark, []) == []
    assert found(spark, [(0, [])]) == []
    assert found(spark, [(0, [1.0])]) == []


def test_bounds_prune_and_keep_the_best():
    draw = random.Random(3)
    block = np.array(sorted(([draw.randint(-50, 50) for _ in range(8)] for _ in range(2000)), key=lambda v: -sum(x * x for x in v)))
    queries = block[::400]
    rotate = np.linalg.eigh(block.T @ block)[1][:, ::-1]
    ids, own = np.arange(2000), np.full(len(queries), -1)
    best = top_k.search(queries, own, np.full(len(queries), -np.inf), block, ids, ids, rotate, 10)
    for i, q in enumerate(queries):
        scores = block @ q
        order = np.lexsort((ids, -scores))[:10]
        assert best.ids[i].tolist() == order.tolist() and best.scores[i].tolist() == scores[order].tolist()
