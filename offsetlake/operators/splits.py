"""Cuts of a log range into splits of equal record counts, whatever gaps its offsets have."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offsetlake.operators.bounds import BUCKET, TP
from offsetlake.operators.skew import join_control
from offsetlake.operators.snapshot import read_range

Vector = dict[tuple[str, int], int]


def plan_splits(log: DataFrame, starts: DataFrame, targets: DataFrame, records: int, bucket: int = BUCKET) -> DataFrame:
    """``topic, partition, split, start, end, rows``: every split but a partition's last has just ``records`` rows.

    Records are counted per offset bucket first, before any shuffle. A prefix sum over the buckets of a partition,
    one row each, tells which of them hold a cut; only positions in those are ordered. Splits of a
    partition touch and cover ``[start, target)``; a range without records is one split of no rows.
    """
    if records < 1:
        raise ValueError("a split holds one record at least")
    rows = read_range(log.select(*TP, "offset"), starts, targets).withColumn("_bucket", F.expr(f"offset div {bucket}"))
    counts = rows.groupBy(*TP, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*TP).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = counts.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    # The first multiple of ``records`` at or after the bucket's first record; 0 is no cut but the start.
    first = F.greatest(F.expr(f"(_base + {records - 1}) div {records}") * records, F.lit(records))
    cut = buckets.filter(first < F.col("_base") + F.col("_n")).select(*TP, "_bucket", "_base")
    inside = W.partitionBy(*TP, "_bucket").orderBy("offset")
    numbered = join_control(rows, cut, [*TP, "_bucket"]).withColumn("_at", F.col("_base") + F.row_number().over(inside) - 1)
    later = numbered.filter((F.col("_at") > 0) & (F.col("_at") % records == 0)).select(
        *TP, F.expr(f"_at div {records}").alias("split"), F.col("offset").alias("start")
    )
    ranges = targets.select(*TP, F.col("offset").alias("_target")).join(starts.select(*TP, F.col("offset").alias("start")), TP)
    ranges = ranges.filter("start < _target")
    begins = ranges.select(*TP, F.lit(0).cast("long").alias("split"), "start").unionByName(later)
    totals = counts.groupBy(*TP).agg(F.sum("_n").alias("_total"))
    order = W.partitionBy(*TP).orderBy("split")
    left = F.coalesce("_total", F.lit(0)) - F.col("split") * records
    return (
        begins.withColumn("_next", F.lead("start").over(order))
        .join(ranges.select(*TP, "_target"), TP)
        .join(totals, TP, "left")
        .select(*TP, "split", "start", F.coalesce("_next", "_target").alias("end"), F.least(left, F.lit(records)).cast("long").alias("rows"))
    )


def waves(splits: list[Row], starts: Vector, targets: Vector) -> list[tuple[Vector, Vector]]:
    """Split n of all partitions is one step ``[low, high)``; a partition without one rests at its end."""
    count = 1 + max((r.split for r in splits), default=-1)
    ends = {(r.topic, r.partition, r.split): r.end for r in splits}
    out, low = [], dict(starts)
    for n in range(count):
        high = {tp: ends.get((*tp, n), low[tp]) for tp in targets}
        out.append((low, high))
        low = high
    return out
