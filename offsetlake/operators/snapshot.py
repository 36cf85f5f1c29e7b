"""Reads of a log or table that are bounded by offset vectors."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offsetlake.operators.bounds import TP
from offsetlake.operators.ledger import exact_offsets, fold_ledger
from offsetlake.operators.skew import join_control, pin

HULLS = 32  # topics with a filter of their own


def _coarse_bounds(ranges: DataFrame) -> Column:
    """A literal filter that every row of the held ranges passes: the topics, the hull of all offsets, and that of each topic.

    Literals reach the Parquet scan, where they prune topic directories and row groups; the join
    that follows is exact. The hulls of topics spare rows outside them the work before the join.
    """
    rows = ranges.collect()
    if not rows:
        return F.lit(False)
    low, high = min(r._start for r in rows), max(r._target for r in rows)
    whole = F.col("topic").isin(sorted({r.topic for r in rows})) & (F.col("offset") >= low) & (F.col("offset") < high)
    hulls: dict[str, tuple[int, int]] = {}
    for r in rows:
        start, end = hulls.get(r.topic, (r._start, r._target))
        hulls[r.topic] = min(start, r._start), max(end, r._target)
    if not 1 < len(hulls) <= HULLS:
        return whole
    own = [(F.col("topic") == t) & (F.col("offset") >= start) & (F.col("offset") < end) for t, (start, end) in sorted(hulls.items())]
    return whole & reduce(or_, own)


def read_range(records: DataFrame, starts: DataFrame, targets: DataFrame) -> DataFrame:
    """Records with ``start <= offset < target`` of their topic-partition."""
    ranges = targets.select(*TP, F.col("offset").alias("_target")).join(
        starts.select(*TP, F.col("offset").alias("_start")), TP
    )
    return _within(records, ranges)


def snapshot_at(records: DataFrame, offsets: DataFrame) -> DataFrame:
    """Records below the vector. A topic-partition outside the vector contributes nothing."""
    return _within(
        records,
        offsets.select(*TP, F.lit(0).cast("long").alias("_start"), F.col("offset").alias("_target")),
    )


def _within(records: DataFrame, ranges: DataFrame) -> DataFrame:
    ranges = ranges.filter("_start < _target")
    held = pin(ranges)
    if held is None:
        joined = join_control(records, ranges, TP)
    else:
        joined = records.filter(_coarse_bounds(held)).join(F.broadcast(held), TP)
    return joined.filter("offset >= _start AND offset < _target").select(*records.columns)


def blocks_below(blocks: DataFrame, offsets: DataFrame) -> DataFrame:
    """Blocks that hold at least one record below the vector; works on block rows only.

    ``whole`` tells whether the entire block is below it. A vector taken from the ledger never
    splits a block; a user's target may, and then records need ``snapshot_at`` as well.
    """
    vector = offsets.select(*TP, F.col("offset").alias("_target"))
    return (
        join_control(blocks, vector, TP)
        .filter("min_offset < _target")
        .withColumn("whole", F.expr("max_offset < _target"))
        .drop("_target")
    )


def barrier_cut(ledger: DataFrame, pipelines: DataFrame) -> DataFrame:
    """One consistent vector per table, over all pipelines that feed it.

    The ledger is read and folded once, and blocks are immutable, so the vector is a cut of
    everything committed at that read and delivery need not pause. Tables are cut one by one;
    there is no atomic time across tables.
    """
    exact = exact_offsets(pipelines, fold_ledger(ledger))
    feeds = pipelines.select("table", "connector", "topic")
    return exact.join(feeds, "topic").select("table", "connector", *TP, "offset")
