"""The journal as a stream addressed by offset vectors."""

import json
import os
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from offsetlake import schemas
from offsetlake.operators.audit import ViolationError
from offsetlake.sources import log as logs
from offsetlake.sources import table as tables
from offsetlake.sources import zones
from offsetlake.sources.vector_stream import LEAST_TASK_OFFSETS, Zone, admitted, dealt, lost, read_from_vector
from offsetlake.streaming import follow as following
from tests.test_delivery import USER, records, target

TOPIC = "records.input"


def vector(spark, *offsets):
    return spark.createDataFrame([(TOPIC, p, o) for p, o in enumerate(offsets) if o is not None], schemas.OFFSETS)


def append(spark, journal, rows, size=10):
    logs.write_segments(rows, journal, size)
    zones.update_zones(spark, journal)


def run(stream, checkpoint, trigger=None):
    """The (partition, offset) of every batch."""
    got = []

    def hold(batch, number):
        got.append(sorted((r.partition, r.offset) for r in batch.select("partition", "offset").collect()))

    writer = stream.writeStream.foreachBatch(hold).option("checkpointLocation", checkpoint)
    if trigger is None:
        writer.trigger(availableNow=True).start().awaitTermination()
    else:
        query = writer.trigger(processingTime=trigger).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    return got


def span(partition, start, end):
    return [(partition, o) for o in range(start, end)]


tps = st.tuples(st.just("t"), st.integers(0, 4))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(tps, st.integers(0, 50)), st.dictionaries(tps, st.integers(0, 90)), st.integers(1, 60))
def test_admission(at, available, limit):
    ends = admitted(at, available, limit)
    steps = {tp: end - at.get(tp, 0) for tp, end in ends.items()}
    left = {tp: max(0, available.get(tp, 0) - at.get(tp, 0)) for tp in ends}
    assert all(0 <= steps[tp] <= left[tp] for tp in ends)
    assert sum(steps.values()) == min(limit, sum(left.values()))


def test_lost_ranges():
    held = [Zone("a", "t", 0, 5, 9), Zone("b", "t", 0, 12, 20)]
    assert not lost(held, {("t", 0): 5}, {("t", 0): 20})
    assert not lost(held, {("t", 0): 10}, {("t", 0): 11})
    assert not lost(held, {("t", 0): 30}, {("t", 0): 30})
    assert len(lost(held, {("t", 0): 4}, {("t", 0): 20})) == 1
    assert len(lost(held, {("t", 0): 6}, {("t", 0): 21})) == 1
    assert len(lost(held, {}, {("t", 1): 1})) == 1


def test_small_files_share_a_task_and_large_ones_are_cut():
    """As many files of 10,000 offsets as there may be make few tasks; each offset is in one of them."""
    zones = [Zone(f"f{n}", "t", n % 5, n // 5 * 10_000, n // 5 * 10_000 + 10_000) for n in range(9_000)]
    tasks = dealt(zones, 1_000_000, 32)
    assert len(tasks) == 90 and [z for one in tasks for z in one] == zones
    assert 32 <= len(dealt(zones[:200], 1_000_000, 32)) <= 40
    assert len(dealt(zones[:10], 1_000_000, 32)) == 10 * 10_000 // LEAST_TASK_OFFSETS
    cut = dealt([Zone("a", "t", 0, 5, 30), Zone("b", "t", 0, 30, 33)], 10, 1)
    assert [[(z.low, z.high) for z in one] for one in cut] == [[(5, 15)], [(15, 25)], [(25, 30), (30, 33)]]
    assert dealt([], 10, 4) == []


def test_a_stream_is_its_range_record_by_record(spark, path):
    journal = path("journal")
    rows = records(spark, 0, 300).withColumn(
        "headers", F.when(F.col("offset") % 2 == 0, F.array(F.struct(F.lit("h").alias("key"), F.col("key").alias("value"))))
    )
    rows = rows.withColumn("timestamp", F.expr("timestamp '2024-01-01 10:00:00.123456' + make_interval(0, 0, 0, 0, 0, 0, offset)"))
    append(spark, journal, rows)
    starts, targets = vector(spark, 85, 0, 50), vector(spark, 100, 12, 50)
    out = path("out")
    stream = read_from_vector(spark, journal, starts, targets, task_offsets=7)
    query = stream.writeStream.option("checkpointLocation", path("checkpoint")).trigger(availableNow=True).start(out, format="parquet")
    query.awaitTermination()
    got = spark.read.schema(schemas.LOG).parquet(out)
    want = rows.filter("partition = 0 AND offset >= 85 OR partition = 1 AND offset < 12").select(*schemas.LOG.names)
    assert got.count() == 27 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_triggers_are_bounded_and_restarts_go_on_from_the_vector(spark, path):
    journal, checkpoint = path("journal"), path("checkpoint")
    append(spark, journal, records(spark, 0, 150))
    starts = vector(spark, 20, 40, 50)

    def stream(limit=None):
        return read_from_vector(spark, journal, starts, max_offsets=limit)

    first = run(stream(15), checkpoint, "0 seconds")
    assert [len(b) for b in first] == [15, 15, 10]
    assert sorted(sum(first, [])) == span(0, 20, 50) + span(1, 40, 50)
    assert run(stream(), checkpoint) == []
    append(spark, journal, records(spark, 150, 210))
    assert [len(b) for b in run(stream(25), checkpoint)] == [25]
    rest = run(stream(), checkpoint)
    assert [len(b) for b in rest] == [35]
    stored = json.loads(Path(checkpoint, "offsets", "4").read_text().splitlines()[-1])
    assert stored == {TOPIC: {"0": 70, "1": 70, "2": 70}}


def test_files_count_when_the_map_has_them(spark, path):
    """An append that is still being published may have shown its last file first."""
    journal, checkpoint = path("journal"), path("checkpoint")
    starts = vector(spark, 0, 0, 0)
    assert sum(run(read_from_vector(spark, journal, starts), checkpoint), []) == []
    append(spark, journal, records(spark, 0, 30))
    logs.write_segments(records(spark, 60, 90), journal, 10)
    found = run(read_from_vector(spark, journal, starts), checkpoint)
    assert sum(found, []) == span(0, 0, 10) + span(1, 0, 10) + span(2, 0, 10)
    append(spark, journal, records(spark, 30, 60))
    found = run(read_from_vector(spark, journal, starts), checkpoint)
    assert sum(found, []) == span(0, 10, 30) + span(1, 10, 30) + span(2, 10, 30)


def test_gaps_are_not_lost_and_new_partitions_begin_at_zero(spark, path):
    journal = path("journal")
    append(spark, journal, records(spark, 0, 90).filter("offset % 10 < 3 OR offset = 29"))
    found = run(read_from_vector(spark, journal, vector(spark, 5, 25)), path("checkpoint"))
    kept = {o for o in range(30) if o % 10 < 3 or o == 29}
    assert sum(found, []) == [(p, o) for p, low in ((0, 5), (1, 25), (2, 0)) for o in sorted(kept) if o >= low]


@pytest.mark.parametrize("mapped", [True, False])
def test_a_truncated_journal_fails_the_query(spark, path, mapped):
    journal = path("journal")
    if mapped:
        append(spark, journal, records(spark, 0, 150))
        folder = Path(journal, f"topic={TOPIC}", "partition=1", "segment=2")
        for file in folder.iterdir():
            os.remove(file)
    else:
        append(spark, journal, records(spark, 90, 150))
    with pytest.raises(StreamingQueryException, match="has lost"):
        run(read_from_vector(spark, journal, vector(spark, 30, 25, 30)), path("checkpoint"))
    found = run(read_from_vector(spark, journal, vector(spark, 30, 30, 30)), path("checkpoint"))
    assert sum(found, []) == span(0, 30, 50) + span(1, 30, 50) + span(2, 30, 50)


def test_follow_by_vectors(spark, path):
    journal, checkpoint, to = path("journal"), path("checkpoint"), target(path)
    append(spark, journal, records(spark, 0, 120))
    starts = vector(spark, 20, 30, 40)
    limits = starts.select("topic", "partition", F.lit(0).cast("long").alias("low"), F.lit(60).cast("long").alias("high"))

    def follow(checkpoint):
        following.follow_journal(journal, starts, limits, to, checkpoint).awaitTermination()
        return tables.read_table(spark, to.path, USER).count()

    assert follow(checkpoint) == 30
    append(spark, journal, records(spark, 120, 150))
    assert follow(checkpoint) == 60
    # A lost checkpoint: the stream starts where the table stands, so no record comes twice.
    append(spark, journal, records(spark, 150, 180))
    assert follow(path("checkpoint")) == 90
    # The first checkpoint is behind now; its next batch is refused.
    with pytest.raises(StreamingQueryException):
        follow(checkpoint)
    assert tables.read_table(spark, to.path, USER).count() == 90
    with pytest.raises(ViolationError):
        following.follow_journal(journal, starts, limits.withColumn("low", F.lit(99).cast("long")), to, path("checkpoint"))
