"""Resumable copy of a log range into a bounded replay journal.

Layout::

    data/step=<n>/topic=<t>/partition=<p>/*.parquet   records of one step
    progress/<n>.json                                 per topic-partition: next source offset, next journal offset

A step becomes visible with its progress file; a rerun overwrites a step that has none.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offsetlake import schemas
from offsetlake.operators.audit import ViolationError, require
from offsetlake.operators.bounds import TP, audit_ranges, log_bounds, renumber
from offsetlake.operators.recovery import audit_targets
from offsetlake.operators.skew import join_control
from offsetlake.operators.snapshot import read_range
from offsetlake.sources import storage
from offsetlake.streaming.follow import Bounds, current

STEP = T.StructField("step", T.IntegerType())
COPIED = T.StructType(
    [
        *schemas.LOG.fields,
        T.StructField("source_offset", T.LongType()),
        T.StructField("batch", T.LongType()),
    ]
)


def _save(spark: SparkSession, dest: str, step: int, at: dict) -> None:
    text = json.dumps([[t, p, source, new] for (t, p), (source, new) in sorted(at.items())])
    if not storage.publish_text(spark, f"{dest}/progress/{step:09d}.json", text):
        raise ViolationError([Row(rule="copy-concurrent-writer", subject=dest, detail=str(step))])


def _vector(spark: SparkSession, offsets: dict) -> DataFrame:
    return spark.createDataFrame([(t, p, o) for (t, p), o in offsets.items()], schemas.OFFSETS)


def _resume(spark: SparkSession, dest: str, starts: dict, ends: dict, done: int) -> dict:
    """Where every partition continues: (next source offset, next journal offset)."""
    written = [n for n in storage.children(spark, f"{dest}/data") if n.startswith("step=")]
    if len(written) > done + 1:
        raise ViolationError([Row(rule="copy-progress-expired", subject=dest, detail=None)])
    if not done:
        return {tp: (offset, 0) for tp, offset in starts.items()}
    saved = json.loads(storage.read_text(spark, f"{dest}/progress/{done - 1:09d}.json"))
    at = {(t, p): (source, new) for t, p, source, new in saved}
    outside = [
        Row(rule="copy-outside-range", subject=f"{t}-{p}", detail=str(at.get((t, p))))
        for (t, p), start in starts.items()
        if (t, p) not in at or not start <= at[(t, p)][0] <= ends[(t, p)]
    ]
    if outside:
        raise ViolationError(outside)
    return at


def copy_range(
    log: DataFrame,
    starts: DataFrame,
    targets: DataFrame,
    bounds: Bounds,
    dest: str,
    batch_records: int = 500,
    step_offsets: int | None = None,
) -> None:
    """Copy ``[start, target)`` with keys, payloads, timestamps and headers kept.

    Journal offsets are dense from 0 and follow the source order; ``batch`` numbers runs of
    ``batch_records`` records per partition. All partitions and batches are written in parallel.
    Progress is saved per step of ``step_offsets`` source offsets (default: one step); a step is
    an offset range, so with gaps it holds fewer records. Gaps are legal as long as the log still
    reaches back to the step's start, which is checked before each step; a call as ``bounds`` fetches them again.
    Payloads are read once and not shuffled, unless the step has very many gaps; see ``renumber``.
    """
    spark = log.sparkSession
    require(audit_targets(starts, targets))
    # Vectors are bounded by the partition count.
    first = {(r.topic, r.partition): r.offset for r in starts.collect()}
    ends = {(r.topic, r.partition): r.offset for r in targets.collect()}
    done = len([n for n in storage.children(spark, f"{dest}/progress") if not n.startswith(".")])
    at = _resume(spark, dest, first, ends, done)
    while any(source < ends[tp] for tp, (source, _) in at.items()):
        low = {tp: source for tp, (source, _) in at.items()}
        high = {tp: min(ends[tp], low[tp] + (step_offsets or ends[tp])) for tp in at}
        require(audit_ranges(_vector(spark, low), targets, current(bounds)))
        rows = read_range(log, _vector(spark, low), _vector(spark, high))
        base = _vector(spark, {tp: new for tp, (_, new) in at.items()})
        span = sum(high[tp] - low[tp] for tp in at)
        rows = join_control(
            renumber(rows, batch_records, span), base.withColumnRenamed("offset", "_base"), TP
        )
        new_offset = F.col("_base") + F.col("new_offset")
        rows = rows.withColumns(
            {
                "source_offset": F.col("offset"),
                "offset": new_offset,
                "batch": F.floor(new_offset / batch_records),
            }
        )
        path = f"{dest}/data/step={done}"
        storage.overwriting(rows.select(*COPIED.names)).partitionBy(*TP).parquet(path)
        copied = {
            (r.topic, r.partition): r.high
            for r in log_bounds(spark.read.schema(COPIED).parquet(path)).collect()
        }
        at = {tp: (high[tp], copied.get(tp, new)) for tp, (_, new) in at.items()}
        _save(spark, dest, done, at)
        done += 1


def read_copy(spark: SparkSession, dest: str) -> DataFrame:
    """Records of finished steps."""
    done = len([n for n in storage.children(spark, f"{dest}/progress") if not n.startswith(".")])
    if not storage.has_children(spark, f"{dest}/data"):
        return spark.createDataFrame([], COPIED)
    rows = spark.read.schema(T.StructType([*COPIED.fields, STEP])).parquet(f"{dest}/data")
    return rows.filter(F.col("step") < done).select(*COPIED.names)
