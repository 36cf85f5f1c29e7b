"""Retry deduplication of whole blocks inside a finite window.

Two equal logical records stay two rows. Only a block that repeats an earlier one byte for byte,
while that one is still among the last ``window`` accepted blocks of its table, is a retry.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offsetlake.functions import content_hash
from offsetlake.operators.skew import earlier_max, join_control, running_sum
from offsetlake.sources.storage import written

ROUNDS = 4  # of refinement, before what is left is folded


def block_ids(records: DataFrame, attempt: Sequence[str], content: Sequence[str]) -> DataFrame:
    """One row per attempted block with its identity: position range, size and content hash."""
    return records.groupBy(*attempt, "topic", "partition").agg(
        F.min("offset").alias("min_offset"),
        F.max("offset").alias("max_offset"),
        F.count(F.lit(1)).alias("rows"),
        content_hash("offset", *content).alias("content"),
    )


def accepted_blocks(
    attempts: DataFrame, window: int, table: str = "table", order: str = "seq", bucket: int = 100_000, rounds: int = ROUNDS
) -> DataFrame:
    """Attempts that a table with a dedup window of ``window`` blocks accepts.

    ``attempts`` are block rows with ``table``, a number ``order`` that is unique in its table,
    and the columns of ``block_ids``. A refused retry does not renew the window.

    Blocks that were tried once are accepted whatever the window holds, so they are counted once, as a fixed
    number before each attempt. Whether a repeated one is accepted depends on how many were accepted since its
    block last was, which depends on earlier decisions. Instead of a serial fold per table, those decisions are refined
    for all repeated attempts at once until none changes. An attempt's decision only depends on earlier
    ones, so each round settles at least the first open attempt, the fixed point is unique and
    equals the serial answer. A few rounds settle ordinary retries. Retries that alternate at the edge of the
    window can take a round each; after ``rounds`` rounds the repeated attempts, and only they, are
    folded in their order, one table after the other in a task, with the window as the only state.
    """
    if window < 1:
        raise ValueError("a deduplication window holds one block at least")
    identity = [table, "topic", "partition", "min_offset", "max_offset", "rows", "content"]
    slot = F.expr(f"{order} div {bucket}")
    columns = attempts.columns
    firsts = attempts.groupBy(*identity).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_tries"))
    state = attempts.join(firsts, identity)
    once = (F.col("_tries") == 1).cast("long")
    state = running_sum(state, [table], order, once, slot, "_single")
    state = written(state.withColumn("_ok", F.col(order) == F.col("_first")).drop("_first"), "dedup")
    single = state.filter("_tries = 1").select(*columns)
    repeated = state.filter("_tries > 1").drop("_tries")
    for _ in range(rounds):
        # Accepted before this attempt, and that number when its block was last accepted. The
        # number never falls, so "last" is a maximum and a much retried block can be bucketed.
        ranked = running_sum(repeated, [table], order, F.col("_ok").cast("long"), slot, "_upto")
        ranked = ranked.withColumn("_before", F.col("_single") + F.col("_upto") - F.col("_ok").cast("long"))
        taken = F.when(F.col("_ok"), F.col("_before"))
        ranked = earlier_max(ranked, identity, order, taken, slot, "_last")
        ok = F.col("_last").isNull() | (F.col("_before") - F.col("_last") > window)
        refined = written(ranked.select(*columns, "_single", "_ok", ok.alias("_new")), "dedup")
        if refined.filter("_ok <> _new").isEmpty():
            return single.unionByName(repeated.filter("_ok").select(*columns))
        repeated = refined.select(*columns, "_single", F.col("_new").alias("_ok"))
    return single.unionByName(_folded(repeated, window, identity, table, order).select(*columns))


def _folded(repeated: DataFrame, window: int, identity: Sequence[str], table: str, order: str) -> DataFrame:
    """The accepted ones of the repeated attempts, in one ordered pass per table."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, accepted = None, 0
        last: OrderedDict[tuple, int] = OrderedDict()  # block -> number accepted before it; the window only
        for batch in batches:
            kept = []
            blocks = zip(*(batch.column(c).to_pylist() for c in identity), strict=True)
            for block, single in zip(blocks, batch.column("_single").to_pylist(), strict=True):
                if block[0] != current:
                    current, accepted = block[0], 0
                    last.clear()
                before = single + accepted
                while last and before - next(iter(last.values())) > window:
                    last.popitem(last=False)
                kept.append(block not in last)
                if kept[-1]:
                    last[block] = before
                    accepted += 1
            yield batch.filter(pa.array(kept, pa.bool_()))

    rows = repeated.drop("_ok").repartition(table).sortWithinPartitions(table, order)
    return rows.mapInArrow(fold, rows.schema)


def dedup_blocks(
    records: DataFrame,
    attempt: Sequence[str],
    content: Sequence[str],
    window: int,
    table: str = "table",
    order: str = "seq",
) -> DataFrame:
    """Records of accepted attempts. ``attempt`` names the columns that identify one attempt."""
    accepted = accepted_blocks(block_ids(records, attempt, content), window, table, order)
    keys = [*attempt, "topic", "partition"]
    return join_control(records, accepted.select(*keys), keys, "left_semi")
