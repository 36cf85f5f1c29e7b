"""Replay of a finite range into a table, and live follow from an exact vector."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from offsetlake.functions import ledger_key
from offsetlake.operators.audit import ViolationError, diff_rows, require
from offsetlake.operators.bounds import TP, audit_ranges
from offsetlake.operators.ledger import (
    audit_progress,
    fold_ledger,
    rehydrate,
    vector_to_ledger,
)
from offsetlake.operators.recovery import audit_targets
from offsetlake.operators.snapshot import read_range
from offsetlake.operators.splits import Vector, plan_splits, waves
from offsetlake.schemas import INT, LONG, OFFSETS, STRING, struct
from offsetlake.sources import storage
from offsetlake.sources import table as tables
from offsetlake.sources.vector_stream import read_from_vector
from offsetlake.streaming.deliver import Target, append_decoded, deliver

Bounds = DataFrame | Callable[[], DataFrame]
SPLIT_RECORDS = 5_000_000
SPLITS = struct(topic=STRING, partition=INT, split=LONG, start=LONG, end=LONG, rows=LONG)


def state_rows(target: Target, spark: SparkSession) -> DataFrame:
    """The folded ledger of a table as (key, min_offset, max_offset, state)."""
    folded = fold_ledger(tables.read_ledger(spark, target.path))
    return folded.select(
        ledger_key(F.col("topic"), F.col("partition")).alias("key"),
        "min_offset",
        "max_offset",
        "state",
    )


def current(bounds: Bounds) -> DataFrame:
    """The bounds of the log as they are now: a frame, or a call that fetches them again."""
    return bounds() if callable(bounds) else bounds


def replay_plan(log: DataFrame, starts: DataFrame, targets: DataFrame, path: str, records: int) -> list[Row]:
    """The splits of a run, planned once and stored beside the table; one row each reaches the driver.

    A run that goes on must cut where it cut before, even if the log has lost records since. A stored plan
    of another range is refused.
    """
    spark = log.sparkSession
    if not storage.exists(spark, f"{path}/_SUCCESS"):
        storage.overwriting(plan_splits(log, starts, targets, records).coalesce(1)).parquet(path)
    stored = spark.read.schema(SPLITS).parquet(path)
    covered = stored.groupBy("topic", "partition").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    wanted = starts.withColumnRenamed("offset", "start").join(targets.withColumnRenamed("offset", "end"), TP).filter("start < end")
    order = [*TP, "start", "end"]
    if diff_rows(covered.select(order), wanted.select(order)).take(1):
        raise ViolationError([Row(rule="replay-plan-differs", subject=path, detail=None)])
    return stored.collect()


def replay_until(
    log: DataFrame,
    starts: DataFrame,
    targets: DataFrame,
    bounds: Bounds,
    target: Target,
    run_id: str,
    tolerance: str = "all",
    records_per_split: int = SPLIT_RECORDS,
) -> bool:
    """Append ``[start, target)`` of a log once, and leave the table exactly at the vector.

    The range is cut into splits of ``records_per_split`` records of each partition, whatever its gaps. Split n of all
    partitions is one ledger commit, ``<run>-replay-<n>``, so a run that died goes on after its last commit
    and writes none of the earlier ones again. Before each split the bounds are fetched, if ``bounds`` is a
    call, and all that is still to be read must lie inside. The first check comes before the first row.
    Running it again with the same ``run_id`` does nothing. A bounded read needs no stream; with Kafka it
    is a batch read with ``endingOffsets``.
    """
    spark = log.sparkSession
    require(audit_targets(starts, targets))
    first, last = (_held(v) for v in (starts, targets))
    plan_path = f"{target.path}/replay/run={run_id}"
    if not storage.exists(spark, f"{plan_path}/_SUCCESS"):
        require(audit_ranges(starts, targets, current(bounds)))
    steps = waves(replay_plan(log, starts, targets, plan_path, records_per_split), first, last)
    target.ends = tables.folded_ends(spark, target.path)
    done = False
    for n, (low, high) in enumerate(steps):
        key = f"{run_id}-replay-{n}"
        if tables.is_committed(spark, target.path, key):
            continue
        low_vector, high_vector = (_vector(spark, v) for v in (low, high))
        ahead = _vector(spark, {tp: offset for tp, offset in low.items() if offset < last[tp]})
        require(audit_ranges(ahead, targets.join(ahead.select(*TP), TP, "left_semi"), current(bounds)))
        done |= append_decoded(read_range(log, low_vector, high_vector), target, key, tolerance)
    tables.set_vector(spark, target.path, targets, f"{run_id}-vector")
    return done


def _held(vector: DataFrame) -> Vector:
    return {(r.topic, r.partition): r.offset for r in vector.collect()}


def _vector(spark: SparkSession, offsets: Vector) -> DataFrame:
    return spark.createDataFrame([(t, p, o) for (t, p), o in offsets.items()], OFFSETS)


def require_at(target: Target, targets: DataFrame) -> None:
    """A bounded recovery must still stand at its vector."""
    folded = fold_ledger(tables.read_ledger(targets.sparkSession, target.path))
    now = folded.select("topic", "partition", (F.col("max_offset") + 1).alias("offset"))
    moved = diff_rows(now.select(OFFSETS.names), targets.filter("offset > 0").select(OFFSETS.names))
    if moved.take(1):
        raise ViolationError([Row(rule="recovery-moved-beyond", subject=target.path, detail=None)])


def follow(
    stream: DataFrame,
    starts: DataFrame,
    bounds: DataFrame,
    target: Target,
    checkpoint: str,
    tolerance: str = "all",
    interval: str | None = None,
) -> StreamingQuery:
    """Keep a table following the log from an exact vector.

    An empty ledger is initialised to the vector. A table that moved on before is accepted if it
    only moved forward. Records below the ledger are dropped, and a log that no longer reaches
    back to where the table stands is an error, never a silent gap.
    """
    standing_at(starts, bounds, target)
    return deliver(stream, [target], checkpoint, tolerance, interval=interval)


def follow_journal(
    journal: str,
    starts: DataFrame,
    bounds: DataFrame,
    target: Target,
    checkpoint: str,
    tolerance: str = "all",
    interval: str | None = None,
    max_offsets: int | None = None,
) -> StreamingQuery:
    """``follow`` a journal by its zone map and vectors; nothing from before where the table stands is read.

    Once there is a checkpoint, the stream goes on from its vector. A table that was moved by something else since
    then refuses the next batch.
    """
    standing = standing_at(starts, bounds, target)
    stream = read_from_vector(starts.sparkSession, journal, standing, topics=target.topics, max_offsets=max_offsets)
    return deliver(stream, [target], checkpoint, tolerance, interval=interval, exact=True)


def standing_at(starts: DataFrame, bounds: DataFrame, target: Target) -> DataFrame:
    """The vector at which a table can be followed on from ``starts``; an empty ledger is initialised to it."""
    spark = starts.sparkSession
    initial = vector_to_ledger(starts)
    actual = state_rows(target, spark)
    if actual.isEmpty():
        tables.set_vector(spark, target.path, starts, "vector")
        conflicts = rehydrate(
            initial.select("key", F.col("max_offset").alias("min_offset"), "max_offset", "state"),
            state_rows(target, spark),
        )
        if conflicts.take(1):
            raise ViolationError([Row(rule="follow-vector-differs", subject=target.path, detail=None)])
    else:
        require(audit_progress(actual, initial, starts))
    ends = tables.folded_ends(spark, target.path)
    now = [
        (r.topic, r.partition, ends.get((r.topic, r.partition), r.offset - 1) + 1)
        for r in starts.collect()
    ]
    standing = spark.createDataFrame(now, OFFSETS)
    require(audit_ranges(standing, standing, bounds))
    return standing


