"""Record-balanced splits, and replays that go on after a crash."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from offsetlake import fixtures, schemas
from offsetlake.operators import bounds, snapshot, splits
from offsetlake.operators.audit import ViolationError
from offsetlake.sources import table as tables
from offsetlake.streaming import follow as following
from tests.test_delivery import USER, counts, records, target

TOPIC = "records.input"


def vector(spark, *offsets, topic=TOPIC):
    return spark.createDataFrame([(topic, p, o) for p, o in enumerate(offsets)], schemas.OFFSETS)


def brute(offsets, start, end, size):
    inside = [o for o in sorted(offsets) if start <= o < end]
    starts = [start] + inside[size::size]
    ends = [*starts[1:], end]
    return [(n, s, e, len([o for o in inside if s <= o < e])) for n, (s, e) in enumerate(zip(starts, ends, strict=True))]


@pytest.mark.parametrize(("size", "bucket", "seed"), [(1, 10, 0), (7, 10, 1), (10, 10, 2), (25, 7, 3), (1000, 50, 4)])
def test_splits_have_equal_counts_whatever_the_gaps(spark, size, bucket, seed):
    draw = random.Random(seed)
    # A hot partition, one with a long gap, one without records in its range, and one whose range is empty.
    held = {0: range(300), 1: [o for o in range(400) if not 50 <= o < 260 and draw.random() < 0.4], 2: range(5), 3: range(50)}
    rows = [(TOPIC, p, o) for p, offsets in held.items() for o in offsets]
    log = spark.createDataFrame(rows, schemas.OFFSETS).repartition(3)
    low, high = (3, 40, 20, 9), (290, 390, 33, 9)
    found = splits.plan_splits(log, vector(spark, *low), vector(spark, *high), size, bucket).collect()
    got = {p: sorted((r.split, r.start, r.end, r["rows"]) for r in found if r.partition == p) for p in held}
    assert got == {p: brute(held[p], low[p], high[p], size) if low[p] < high[p] else [] for p in held}


def test_waves_take_one_split_of_each_partition(spark):
    log = spark.createDataFrame([(TOPIC, p, o) for p, n in ((0, 10), (1, 3)) for o in range(n)], schemas.OFFSETS)
    found = splits.plan_splits(log, vector(spark, 0, 0), vector(spark, 10, 3), 4).collect()
    steps = splits.waves(found, {(TOPIC, 0): 0, (TOPIC, 1): 0}, {(TOPIC, 0): 10, (TOPIC, 1): 3})
    assert [tuple(high.values()) for _, high in steps] == [(4, 3), (8, 3), (10, 3)]
    assert splits.waves([], {}, {}) == []


def test_no_split_of_no_records(spark):
    with pytest.raises(ValueError, match="one record"):
        splits.plan_splits(spark.createDataFrame([], schemas.OFFSETS), vector(spark, 0), vector(spark, 1), 0)


def replay(spark, log, to, limits, starts=(0, 0, 0), ends=(30, 30, 28), size=10):
    return following.replay_until(log, vector(spark, *starts), vector(spark, *ends), limits, to, "r-1", records_per_split=size)


def files(to):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{to.path}/data/**/*.parquet", recursive=True)}


@pytest.mark.parametrize("crash", [0, 1, 2])
def test_a_crash_leaves_the_splits_before_it(spark, path, monkeypatch, crash):
    """The run goes on after its last commit and writes none of the earlier splits again."""
    log, to = records(spark, 0, 90), target(path)
    limits = bounds.log_bounds(log)
    real, calls = tables.write_ledger, []

    def dies(*args):
        calls.append(args)
        if len(calls) == crash + 1:
            raise RuntimeError("lost the driver")
        return real(*args)

    with monkeypatch.context() as patch:
        patch.setattr(tables, "write_ledger", dies)
        with pytest.raises(RuntimeError):
            replay(spark, log, to, limits)
    visible = {r.batch_id for r in tables.read_ledger(spark, to.path).collect()}
    assert visible == {f"r-1-replay-{n}" for n in range(crash)}
    before = {f: t for f, t in files(to).items() if any(f"batch_id={b}/" in f for b in visible)}
    assert replay(spark, log, to, limits)
    assert before.items() <= files(to).items()
    assert counts(spark, to) == (88, 88)
    sizes = {r.batch_id: r["sum(rows)"] for r in tables.read_ledger(spark, to.path).groupBy("batch_id").sum("rows").collect()}
    # Each split has ten records of every partition, the last one what is left; then the vector.
    assert sizes == {"r-1-replay-0": 30, "r-1-replay-1": 30, "r-1-replay-2": 28} | ({"r-1-vector": 0} if "r-1-vector" in sizes else {})
    assert not replay(spark, log, to, limits) and counts(spark, to) == (88, 88)
    following.require_at(to, vector(spark, 30, 30, 28))


def test_bounds_are_fetched_before_every_split(spark, path):
    """Retention overtakes the run: what is committed stays, the rest is refused."""
    log, to, asked = records(spark, 0, 90), target(path), []

    def limits():
        asked.append(1)
        low = 0 if len(asked) <= 2 else 15
        return spark.createDataFrame([(TOPIC, p, low, 30) for p in range(3)], schemas.LOG_BOUNDS)

    with pytest.raises(ViolationError, match="range-start-expired"):
        replay(spark, log, to, limits, ends=(30, 30, 30))
    assert counts(spark, to) == (30, 30) and len(asked) == 3


def test_what_is_behind_a_resumed_run_may_expire(spark, path, monkeypatch):
    log, to = records(spark, 0, 90), target(path)
    limits = lambda low: spark.createDataFrame([(TOPIC, p, low, 30) for p in range(3)], schemas.LOG_BOUNDS)
    with monkeypatch.context() as patch:
        real = following.append_decoded
        patch.setattr(following, "append_decoded", lambda rows, to, key, *a: real(rows, to, key, *a) if key.endswith("-0") else 1 / 0)
        with pytest.raises(ZeroDivisionError):
            replay(spark, log, to, limits(0), ends=(30, 30, 30))
    kept = log.filter("offset >= 10")
    assert replay(spark, kept, to, limits(10), ends=(30, 30, 30))
    assert counts(spark, to) == (90, 90)


def test_a_run_does_not_change_its_range(spark, path):
    log, to = records(spark, 0, 90), target(path)
    replay(spark, log, to, bounds.log_bounds(log))
    with pytest.raises(ViolationError, match="replay-plan-differs"):
        replay(spark, log, to, bounds.log_bounds(log), ends=(30, 30, 30))


def test_a_range_without_records_moves_the_vector(spark, path):
    log, to = records(spark, 0, 90), target(path)
    replay(spark, log.filter("offset < 5"), to, bounds.log_bounds(log), starts=(10, 10, 10), ends=(30, 30, 30))
    following.require_at(to, vector(spark, 30, 30, 30))
    assert tables.read_table(spark, to.path, USER).count() == 0


def test_ranges_filter_each_topic_by_its_own_offsets(spark):
    """Rows outside the range of their own topic are dropped before the join, not by the hull of all topics alone."""
    ranges = spark.createDataFrame([("a", 0, 0, 10), ("a", 1, 5, 20), ("b", 0, 90, 100)], "topic string, partition int, _start long, _target long")
    records = spark.createDataFrame([(t, 0, o) for t in "abc" for o in (0, 19, 20, 89, 90, 99, 100)], "topic string, partition int, offset long")
    found = records.filter(snapshot._coarse_bounds(ranges)).collect()
    assert sorted((r.topic, r.offset) for r in found) == [("a", 0), ("a", 19), ("b", 90), ("b", 99)]


def test_vectors_of_one_pass_are_those_of_each_cut(spark):
    days = [f"2024-01-{day:02d} 00:00:00" for day in (5, 12, 25)]
    rows = [(t, p, o, days[o % 3] if p else days[2]) for t in (fixtures.EVENTS, fixtures.ORDERS) for p in (0, 1) for o in range(31)]
    records = spark.createDataFrame(rows, "topic string, partition int, offset long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    cuts = ["2024-01-10", None, "2024-01-20"]
    for cut, got in zip(cuts, fixtures.vectors(records, cuts), strict=True):
        wanted = fixtures.vector(records, cut)
        assert got.dtypes == wanted.dtypes and sorted(got.collect()) == sorted(wanted.collect())
