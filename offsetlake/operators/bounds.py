"""Log bounds, end offsets, gaps, and audits of offset vectors against the log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offsetlake.operators.audit import broken_rules, union, violation
from offsetlake.operators.skew import CONTROL_ROWS, dense_index, following, pin, running_sum

TP = ["topic", "partition"]
BUCKET = 1_000_000
RUN_SLOT = 1024  # least offsets of a slot of runs


def position_name():
    return F.concat_ws("-", "topic", F.col("partition").cast("string"))


def log_bounds(log: DataFrame) -> DataFrame:
    """``low`` = first retained offset, ``high`` = last offset + 1, per topic-partition."""
    return log.groupBy(*TP).agg(
        F.min("offset").alias("low"), (F.max("offset") + 1).alias("high")
    )


def all_partitions(pipelines: DataFrame) -> DataFrame:
    """Every configured topic-partition, with or without records."""
    # A sequence to -1 would count down; a pipeline without partitions has none.
    some = pipelines.filter("partitions > 0")
    numbers = F.sequence(F.lit(0), F.col("partitions") - 1, F.lit(1))
    return some.select("topic", F.explode(numbers).alias("partition")).distinct()


def end_offsets(committed_log: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Last committed offset + 1 per configured partition; 0 for an empty one.

    The input must already be free of aborted records (``read_committed``): a log that ends in
    an aborted transaction has a lower committed end than its high bound.
    """
    ends = committed_log.groupBy(*TP).agg((F.max("offset") + 1).alias("offset"))
    return all_partitions(pipelines).join(ends, TP, "left").select(
        *TP, F.coalesce("offset", F.lit(0)).alias("offset")
    )


def audit_ranges(starts: DataFrame, targets: DataFrame, bounds: DataFrame) -> DataFrame:
    """Can ``[start, target)`` still be read? Both ends may touch the bounds."""
    joined = (
        targets.withColumnRenamed("offset", "target")
        .join(starts.withColumnRenamed("offset", "start"), TP, "left")
        .join(bounds, TP, "left")
    )
    no_start = F.col("start").isNull()
    no_bounds = F.col("low").isNull()
    known = ~no_start & ~no_bounds
    return broken_rules(
        joined,
        position_name(),
        {
            "range-no-start": no_start,
            "range-no-bounds": no_bounds,
            "range-invalid-bounds": ~no_bounds & ((F.col("low") < 0) | (F.col("high") < F.col("low"))),
            "range-start-expired": known & (F.col("start") < F.col("low")),
            "range-target-beyond-end": ~no_bounds & (F.col("target") > F.col("high")),
        },
    )


def audit_replayable(checkpoint: DataFrame, bounds: DataFrame, complete: bool = False, by: Sequence[str] = ()):
    """Is every checkpoint offset inside the retained log, and is the partition count the same?

    ``complete`` also wants the log to start at 0, as a bounded copy must. ``by`` names the columns that tell
    several checkpoints apart; subjects begin with them.
    """
    name = lambda place: F.concat_ws("/", *by, place)
    joined = checkpoint.join(bounds, TP, "left")
    missing = F.col("low").isNull()
    low, high, offset = F.col("low"), F.col("high"), F.col("offset")
    rules = {
        "replay-no-bounds": missing,
        "replay-invalid-bounds": ~missing & ((low < 0) | (high < low)),
        "replay-expired": ~missing & (offset < low),
        "replay-beyond-end": ~missing & (offset > high),
    }
    if complete:
        rules["replay-incomplete-log"] = ~missing & (low != 0)
    expected = checkpoint.groupBy(*by, "topic").agg(F.count(F.lit(1)).alias("expected"))
    actual = bounds.groupBy("topic").agg(F.count(F.lit(1)).alias("actual"))
    counts = expected.join(actual, "topic", "left").filter(
        F.coalesce("actual", F.lit(0)) != F.col("expected")
    )
    return union(
        [
            broken_rules(joined, name(position_name()), rules),
            violation(counts, "replay-partition-count", name(F.col("topic"))),
        ]
    )


def offset_gaps(log: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Missing offset ranges ``[gap_start, gap_end)`` inside each partition.

    Gaps are legal (aborted transactions leave them); this lists them. Only the three position
    columns are shuffled, by offset bucket, so a hot partition is split over many tasks.
    """
    rows = log.select(*TP, "offset")
    split = F.expr(f"offset div {bucket}")
    return (
        following(rows, TP, "offset", split, "next")
        .filter(F.col("next") > F.col("offset") + 1)
        .select(
            *TP,
            (F.col("offset") + 1).alias("gap_start"),
            F.col("next").alias("gap_end"),
        )
    )


def resequence(rows: DataFrame, batch_records: int, bucket: int = BUCKET) -> DataFrame:
    """Dense new offsets per partition in source order, and the copy batch of each record.

    ``batch`` counts records, as a transactional copy does, so every batch of a partition but
    the last holds exactly ``batch_records`` rows whatever gaps the source has.
    """
    split = F.expr(f"offset div {bucket}")
    return dense_index(rows, TP, ["offset"], split, "new_offset").withColumn(
        "batch", F.expr(f"new_offset div {batch_records}")
    )


def dense_runs(log: DataFrame, width: int) -> DataFrame:
    """Runs of consecutive offsets, cut at every ``width`` offsets: ``topic, partition, slot, first, last, new_first``.

    ``new_first`` is the dense offset of the run's first record. Only position columns are shuffled, by slot.
    """
    at = W.partitionBy(*TP, "slot").orderBy("offset")
    rows = log.select(*TP, "offset", F.expr(f"offset div {width}").alias("slot"))
    runs = (
        rows.withColumn("_run", F.col("offset") - F.row_number().over(at))
        .groupBy(*TP, "slot", "_run")
        .agg(F.min("offset").alias("first"), F.max("offset").alias("last"))
    )
    size = F.col("last") - F.col("first") + 1
    ends = running_sum(runs, TP, "first", size, F.expr(f"first div {BUCKET}"), "_end")
    return ends.select(*TP, "slot", "first", "last", (F.col("_end") - size).alias("new_first"))


def renumber(rows: DataFrame, batch_records: int, span: int, max_rows: int = CONTROL_ROWS) -> DataFrame:
    """``resequence`` of a stored log, whose records stay where they are.

    The runs between the gaps are found from the positions and broadcast, if there are no more than
    ``max_rows``; ``span``, how many offsets the rows cover, sets the slots so that half of those are left for
    gaps, and a record meets the few runs of its slot. With more gaps records are shuffled by offset bucket.
    """
    width = max(RUN_SLOT, -(-2 * span // max_rows))
    runs = pin(dense_runs(rows, width), max_rows)
    if runs is None:
        return resequence(rows, batch_records)
    slotted = rows.withColumn("slot", F.expr(f"offset div {width}"))
    met = slotted.join(F.broadcast(runs), [*TP, "slot"]).filter("offset BETWEEN first AND last")
    new_offset = (F.col("new_first") + F.col("offset") - F.col("first")).alias("new_offset")
    return met.select(*rows.columns, new_offset).withColumn("batch", F.expr(f"new_offset div {batch_records}"))
