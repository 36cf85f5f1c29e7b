"""The bucketed helpers against plain folds, with one hot key."""

import random

import pytest
from pyspark.sql import functions as F

from offsetlake import schemas
from offsetlake.operators import bounds, skew, snapshot


@pytest.fixture(scope="module")
def hot(spark):
    """A third of all rows on one key; the order column is unique but full of gaps."""
    rng = random.Random(7)
    rows = [
        ("hot" if rng.random() < 0.34 else f"k{rng.randrange(5)}", at, rng.randrange(-3, 9))
        for at in rng.sample(range(5000), 900)
    ]
    return rows, spark.createDataFrame(rows, "key STRING, at LONG, v LONG").cache()


def folded(rows, step):
    out, by_key = {}, {}
    for key, at, v in sorted(rows, key=lambda r: r[1]):
        by_key.setdefault(key, []).append((at, v))
    for key, seen in by_key.items():
        for i, (at, _) in enumerate(seen):
            out[key, at] = step(seen, i)
    return out


def got(frame):
    return {(r.key, r.at): r.x for r in frame.collect()}


@pytest.mark.parametrize("size", [1, 64, 100_000])
def test_ordered_helpers(hot, size):
    rows, frame = hot
    slot, value = F.expr(f"at div {size}"), F.col("v")
    assert got(skew.running_sum(frame, ["key"], "at", value, slot, "x")) == folded(
        rows, lambda seen, i: sum(v for _, v in seen[: i + 1])
    )
    assert got(skew.earlier_max(frame, ["key"], "at", value, slot, "x")) == folded(
        rows, lambda seen, i: max((v for _, v in seen[:i]), default=None)
    )
    assert got(skew.dense_index(frame, ["key"], ["at"], slot, "x")) == folded(rows, lambda seen, i: i)
    assert got(skew.following(frame, ["key"], "at", slot, "x")) == folded(
        rows, lambda seen, i: seen[i + 1][0] if i + 1 < len(seen) else None
    )


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_control_is_the_same_beyond_the_bound(spark, hot, how):
    _, frame = hot
    control = spark.createDataFrame([("hot", 1), ("k1", 2), ("zz", 3)], "key STRING, c INT")
    if how in ("left_semi", "left_anti"):
        control = control.select("key")
    want = sorted(map(tuple, frame.join(control, "key", how).collect()), key=repr)
    small = skew.join_control(frame, control, ["key"], how)
    large = skew.join_control(frame, control, ["key"], how, max_rows=2, spread=5)
    assert "Broadcast" in small._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, small.collect()), key=repr) == want
    assert large.columns == small.columns
    assert sorted(map(tuple, large.collect()), key=repr) == want


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_a_repeated_control_table_is_never_broadcast(spark, hot, how):
    control = spark.createDataFrame([("hot",), ("k1",), ("zz",)], "key STRING")
    plan = skew.join_control(hot[1], control, ["key"], how, max_rows=2)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_pin_is_bounded(spark):
    assert skew.pin(spark.range(10), 9) is None
    assert skew.pin(spark.range(10), 10).count() == 10


def test_gaps_and_resequence(spark):
    offsets = [0, 1, 2, 9, 10, 11, 20, 39, 40]
    log = spark.createDataFrame([("t", 0, o) for o in offsets], "topic STRING, partition INT, offset LONG")
    gaps = bounds.offset_gaps(log, bucket=10).collect()
    assert sorted((g.gap_start, g.gap_end) for g in gaps) == [(3, 9), (12, 20), (21, 39)]
    new = bounds.resequence(log, batch_records=4, bucket=10).collect()
    assert sorted((r.offset, r.new_offset, r.batch) for r in new) == [
        (o, i, i // 4) for i, o in enumerate(offsets)
    ]


def test_nested_rows_are_not_held(spark):
    assert skew.pin(spark.createDataFrame([([1],)], "a ARRAY<INT>")) is None


def test_hot_partition_is_split(spark):
    """One partition with all records: its offset buckets land in different tasks."""
    log = spark.range(1000).selectExpr("'t' AS topic", "0 AS partition", "id AS offset")
    rows = bounds.resequence(log, batch_records=10, bucket=50)
    tasks = rows.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) > 1
    assert max(t["count"] for t in tasks) < 900


def test_ranges_without_a_broadcast(spark, monkeypatch):
    """A vector beyond the bound takes the salted join and gives the same rows."""
    log = spark.range(300).selectExpr(
        "'t' AS topic", "CAST(id % 3 AS INT) AS partition", "id div 3 AS offset"
    )
    low = spark.createDataFrame([("t", 0, 5), ("t", 1, 0)], schemas.OFFSETS)
    high = spark.createDataFrame([("t", 0, 9), ("t", 1, 3), ("t", 2, 7)], schemas.OFFSETS)
    want = sorted(map(tuple, snapshot.read_range(log, low, high).collect()))
    assert want == [("t", 0, o) for o in range(5, 9)] + [("t", 1, o) for o in range(3)]
    monkeypatch.setattr(snapshot, "pin", lambda *_: None)
    monkeypatch.setattr(skew, "pin", lambda *_: None)
    assert sorted(map(tuple, snapshot.read_range(log, low, high).collect())) == want
