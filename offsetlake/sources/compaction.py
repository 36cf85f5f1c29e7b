"""Maintenance of append tables: ledger checkpoints, segments of small batches, and removal of what they replace.

Nothing here changes what a reader sees. Each step writes beside what it replaces and becomes valid by its marker
file; what it replaced is removed by a later call of ``vacuum`` only, one generation behind, so that a reader that
has listed the older state still finds its files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offsetlake.operators.audit import ViolationError
from offsetlake.operators.ledger import FINISHED, block_ranges
from offsetlake.operators.skew import join_control
from offsetlake.schemas import BLOCK_ID
from offsetlake.sources import storage
from offsetlake.sources import table as tables

CHECKPOINT_ROWS = 1_000_000  # block rows of one file
SMALL_BATCH = 1_000_000  # rows
SEGMENT_ROWS = 4_000_000  # rows of one file
LISTED = 100_000


def checkpoint_ledger(spark: SparkSession, table: str) -> int | None:
    """Fold all commits into one table ``checkpoints/n=<n>``; returns n, or None if there is nothing new.

    The commits stay as they are. A checkpoint that was not finished is overwritten by the next.
    """
    done = tables.complete(spark, f"{table}/checkpoints")
    commits = tables.read_commits(spark, table)
    rows = commits.count()
    if done and rows == spark.read.parquet(f"{table}/checkpoints/n={done[-1]}").count() or not rows:
        return None
    number = done[-1] + 1 if done else 0
    folded = commits.repartition(-(-rows // CHECKPOINT_ROWS)).sortWithinPartitions("commit")
    storage.overwriting(folded).parquet(f"{table}/checkpoints/n={number}")
    return number


def small_batches(spark: SparkSession, table: str, most_rows: int = SMALL_BATCH) -> DataFrame:
    """``batch_id, rows`` of the committed batches of few rows that no segment holds yet."""
    blocks = tables.read_ledger(spark, table).filter(F.col("state") == FINISHED).filter("rows > 0")
    held = tables.segment_batches(spark, table, tables.complete(spark, f"{table}/segments", "batches/_SUCCESS"))
    sizes = blocks.groupBy("batch_id").agg(F.sum("rows").alias("rows")).filter(F.col("rows") <= most_rows)
    return join_control(sizes, held, ["batch_id"], "left_anti")


def compact(spark: SparkSession, table: str, user: T.StructType, most_rows: int = SMALL_BATCH, segment_rows: int = SEGMENT_ROWS) -> int | None:
    """Merge the rows and dead letters of small batches into one new segment; returns its number, or None.

    Rows keep their batch, so blocks, ledgers and backups stay as they are, and a merged batch is never merged
    again. Rows are dealt out by ranges of batches and offsets, a large batch to several tasks, and sorted by them, so
    that readers of few batches skip the rest by statistics. Before the segment becomes valid, its blocks are compared
    with those of the ledger.
    """
    chosen = storage.settled(small_batches(spark, table, most_rows), "small")
    sums = chosen.agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows")).first()
    if sums.n < 2:
        return None
    done = tables.complete(spark, f"{table}/segments", "batches/_SUCCESS")
    root = f"{table}/segments/n={done[-1] + 1 if done else 0}"
    schema = T.StructType([*tables.table_schema(user).fields, tables.LETTER, tables.BATCH, tables.DEAD])
    loose = spark.read.schema(schema).parquet(f"{table}/data")
    rows = tables.only_batches(loose, chosen)
    files = -(-sums["rows"] // segment_rows)
    order = ["batch_id", "topic", "partition", "offset"]
    rows = rows.repartitionByRange(files, *order).sortWithinPartitions("dead", *order)
    storage.overwriting(rows).partitionBy("dead").parquet(f"{root}/rows")
    merged = block_ranges(spark.read.schema(schema).parquet(f"{root}/rows"), BLOCK_ID)
    fields = [*BLOCK_ID, "min_offset", "max_offset", "rows"]
    ledger = join_control(tables.read_ledger(spark, table).filter("rows > 0"), chosen.select("batch_id"), ["batch_id"], "left_semi")
    odd = merged.select(fields).exceptAll(ledger.select(fields)).unionByName(ledger.select(fields).exceptAll(merged.select(fields))).take(1)
    if odd:
        raise ViolationError([Row(rule="segment-differs-from-ledger", subject=odd[0].batch_id, detail=root)])
    storage.overwriting(chosen.select("batch_id")).parquet(f"{root}/batches")
    return int(root.rsplit("=", 1)[1])


def replaced(spark: SparkSession, table: str) -> list[str]:
    """Paths that the state before the newest one replaced already; at most ``LISTED`` a call.

    Commits that the checkpoint before the newest names, older checkpoints, and batch directories of
    segments before the newest. A single checkpoint or segment frees nothing yet.
    """
    out = []
    done = tables.complete(spark, f"{table}/checkpoints")
    if len(done) > 1:
        out += [f"{table}/checkpoints/n={n}" for n in done[:-2]]
        there = {n.removeprefix("commit=") for n in storage.children(spark, f"{table}/ledger") if n.startswith("commit=")}
        named = spark.read.schema(tables.COMMITTED).parquet(f"{table}/checkpoints/n={done[-2]}").select("commit").distinct()
        out += [f"{table}/ledger/commit={r.commit}" for r in named.limit(LISTED).toLocalIterator() if r.commit in there]
    merged = tables.complete(spark, f"{table}/segments", "batches/_SUCCESS")[:-1]
    if merged:
        there = {n.removeprefix("batch_id=") for n in storage.children(spark, f"{table}/data") if n.startswith("batch_id=")}
        batches = tables.segment_batches(spark, table, merged).limit(LISTED).toLocalIterator()
        out += [f"{table}/data/batch_id={r.batch_id}" for r in batches if r.batch_id in there]
    return out


def vacuum(spark: SparkSession, table: str) -> int:
    """Remove what ``replaced`` lists; returns how many paths. A call that died is made good by the next."""
    paths = replaced(spark, table)
    for path in paths:
        storage.remove(spark, path)
    return len(paths)
