"""Exactly-once append tables.

Layout of a table directory::

    data/batch_id=<epoch>-<n>/dead=0/*.parquet   user columns, topic, partition, offset
    data/batch_id=<epoch>-<n>/dead=1/*.parquet   dead letters: the position and the raw record
    ledger/commit=<epoch>-<n>/*.parquet          one file: block ranges of the batch
    checkpoints/n=<n>/*.parquet                  all commits so far in one table, with their names
    segments/n=<n>/rows/dead=0/*.parquet         rows of many small batches, sorted by batch
    segments/n=<n>/batches/*.parquet             the batches that the segment holds

Rows and dead letters come out of one pass over the source. A batch is visible once its ledger
file exists. Its data directory is overwritten until then and
never touched afterwards, so a failed attempt leaves nothing that a reader can see.

Checkpoints and segments are made by ``compaction``. A reader takes the newest complete checkpoint and the commits
that it does not name, and each batch from the complete segment that holds it, else from its directory.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offsetlake import schemas
from offsetlake.operators.audit import ViolationError
from offsetlake.operators.ledger import FINISHED, block_ranges, fold_ledger
from offsetlake.operators.skew import join_control
from offsetlake.sources import storage

POSITION_FIELDS = schemas.OFFSETS.fields
BATCH = T.StructField("batch_id", T.StringType())
DEAD = T.StructField("dead", T.IntegerType())
LETTER = T.StructField("letter", schemas.struct(**{f.name: f.dataType for f in schemas.LOG.fields[3:]}))
LISTED_BATCHES = 1_000
LOAD_BUCKET = 1_000_000


def table_schema(user: T.StructType) -> T.StructType:
    reserved = {"topic", "partition", "offset", "batch_id", "dead", "letter"} & {f.name.lower() for f in user.fields}
    if reserved:
        raise ValueError(f"column names are reserved for delivery: {sorted(reserved)}")
    return T.StructType([*user.fields, *POSITION_FIELDS])


def write_ledger(spark: SparkSession, table: str, batch_id: str, rows: Iterable[Row]) -> None:
    """Commit one batch: its block ranges as a single file, which appears whole or not at all."""
    rows = spark.createDataFrame(list(rows), schemas.LEDGER).coalesce(1)
    storage.overwriting(rows).parquet(f"{table}/ledger/commit={batch_id}")


def complete(spark: SparkSession, path: str, marker: str = "_SUCCESS") -> list[int]:
    """Numbers of the finished entries ``n=<n>`` of a directory, ascending."""
    names = [n for n in storage.children(spark, path) if n.startswith("n=")]
    return sorted(int(n[2:]) for n in names if storage.exists(spark, f"{path}/{n}/{marker}"))


COMMITTED = T.StructType([*schemas.LEDGER.fields, T.StructField("commit", T.StringType())])


def read_commits(spark: SparkSession, table: str) -> DataFrame:
    """All committed blocks with the commit each belongs to: the newest checkpoint and the commits after it."""
    done = complete(spark, f"{table}/checkpoints")
    base = spark.read.schema(COMMITTED).parquet(f"{table}/checkpoints/n={done[-1]}") if done else None
    if not storage.has_children(spark, f"{table}/ledger"):
        return spark.createDataFrame([], COMMITTED) if base is None else base
    tail = spark.read.schema(COMMITTED).parquet(f"{table}/ledger")
    if base is None:
        return tail
    return base.unionByName(join_control(tail, base.select("commit").distinct(), ["commit"], "left_anti"))


def read_ledger(spark: SparkSession, table: str) -> DataFrame:
    """All committed blocks, one row per topic, partition and batch."""
    return read_commits(spark, table).drop("commit")


def is_committed(spark: SparkSession, table: str, batch_id: str) -> bool:
    if storage.has_files(spark, f"{table}/ledger/commit={batch_id}"):
        return True
    done = complete(spark, f"{table}/checkpoints")
    if not done:
        return False
    named = spark.read.schema(COMMITTED).parquet(f"{table}/checkpoints/n={done[-1]}").filter(F.col("commit") == batch_id)
    return not named.isEmpty()


def has_commits(spark: SparkSession, table: str) -> bool:
    return storage.has_children(spark, f"{table}/ledger") or bool(complete(spark, f"{table}/checkpoints"))


def read_table(spark: SparkSession, table: str, user: T.StructType) -> DataFrame:
    """Delivered rows of committed batches."""
    if not has_commits(spark, table):
        return spark.createDataFrame([], T.StructType([*table_schema(user).fields, BATCH]))
    committed = read_ledger(spark, table).filter(F.col("state") == FINISHED)
    return only_batches(read_data(spark, table, user), committed)


def read_data(spark: SparkSession, table: str, user: T.StructType) -> DataFrame:
    """All rows under the data directory, committed or not."""
    schema = T.StructType([*table_schema(user).fields, BATCH])
    return _scan(spark, table, schema).filter("dead = 0").select(*schema.names)


def read_dead_letters(spark: SparkSession, table: str) -> DataFrame:
    """The raw records that committed batches could not decode."""
    schema = T.StructType([*POSITION_FIELDS, LETTER, BATCH])
    rows = _scan(spark, table, schema).filter("dead = 1")
    rows = only_batches(rows, read_ledger(spark, table))
    return rows.select(*schemas.POSITION, "letter.*", "batch_id")


def _scan(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    schema = T.StructType([*schema.fields, DEAD])
    path = f"{table}/data"
    loose = spark.read.schema(schema).parquet(path) if storage.has_children(spark, path) else spark.createDataFrame([], schema)
    done = complete(spark, f"{table}/segments", "batches/_SUCCESS")
    if not done:
        return loose
    roots = [f"{table}/segments/n={n}" for n in done]
    held = segment_batches(spark, table, done)
    merged = None
    for root in roots:
        part = spark.read.schema(schema).parquet(f"{root}/rows")
        merged = part if merged is None else merged.unionByName(part)
    return merged.unionByName(join_control(loose, held.select("batch_id"), ["batch_id"], "left_anti"))


def segment_batches(spark: SparkSession, table: str, segments: Sequence[int]) -> DataFrame:
    """The batches that segments hold, each in one of them."""
    schema = T.StructType([BATCH])
    if not segments:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{table}/segments/n={n}/batches" for n in segments])


def only_batches(data: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows of the batches that occur in ``blocks``.

    A short list of batches becomes a partition filter, which prunes directories and costs
    nothing per row. A long one is a semi join.
    """
    batches = blocks.select("batch_id").distinct()
    some = batches.limit(LISTED_BATCHES + 1).toArrow()
    if some.num_rows <= LISTED_BATCHES:
        return data.filter(F.col("batch_id").isin(some["batch_id"].to_pylist()))
    return join_control(data, batches, ["batch_id"], "left_semi")


def folded_ends(spark: SparkSession, table: str) -> dict[tuple[str, int], int]:
    """Highest processed offset of every topic-partition; bounded by the partition count."""
    folded = fold_ledger(read_ledger(spark, table).select("topic", "partition", "max_offset"))
    return {(r.topic, r.partition): r.max_offset for r in folded.collect()}


def row_count(spark: SparkSession, table: str) -> int:
    """Committed rows and dead letters, from the ledger alone."""
    total = read_ledger(spark, table).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"))
    return total.collect()[0].n


def set_vector(spark: SparkSession, table: str, offsets: DataFrame, commit: str) -> None:
    """Ledger rows that move a table to an offset vector without any data.

    For what a vector covers but no row stands for: aborted tails and dead letters.
    """
    if is_committed(spark, table, commit):
        return
    rows = offsets.filter("offset > 0").collect()
    write_ledger(
        spark,
        table,
        commit,
        [Row(r.topic, r.partition, r.offset - 1, r.offset - 1, 0, FINISHED, commit) for r in rows],
    )


def append_batch(
    rows: DataFrame,
    table: str,
    batch_id: str,
    order_by: Sequence[str] = (),
    ends: dict[tuple[str, int], int] | None = None,
    allow_dead: bool = True,
) -> bool:
    """Append one batch exactly once. Returns False if there is nothing to do.

    ``rows`` have the user's columns and a position, and for dead letters ``dead`` = 1 and the raw
    ``letter``. The source is read once; block ranges come from the position columns of what was
    written. They cover dead letters too, so a later replay will not meet them again.

    ``ends`` holds the highest processed offset of every topic-partition. A batch that reaches back
    behind one is refused before it becomes visible, as is one with dead letters unless they are
    allowed. ``order_by`` is the storage order: rows are sorted inside each file, with no shuffle.
    """
    spark = rows.sparkSession
    if is_committed(spark, table, batch_id):
        return False
    path = f"{table}/data/batch_id={batch_id}"
    if order_by:
        rows = rows.sortWithinPartitions("dead", *order_by)
    storage.overwriting(rows).partitionBy("dead").parquet(path)
    positions = T.StructType([*POSITION_FIELDS, DEAD])
    blocks = block_ranges(spark.read.schema(positions).parquet(path), ("topic", "partition", "dead"))
    # One or two rows per topic-partition of the batch reach the driver.
    found = blocks.collect()
    dead = [r for r in found if r.dead]
    if dead and not allow_dead:
        raise ViolationError(
            [
                Row(rule="delivery-bad-record", subject=f"{r.topic}-{r.partition}", detail=str(r.min_offset))
                for r in dead
            ]
        )
    ranges: dict[tuple[str, int], tuple[int, int, int]] = {}
    for r in found:
        low, high, count = ranges.get((r.topic, r.partition), (r.min_offset, r.max_offset, 0))
        ranges[r.topic, r.partition] = (
            min(low, r.min_offset),
            max(high, r.max_offset),
            count + r.rows,
        )
    if ends is not None:
        behind = [
            Row(rule="delivery-moved-back", subject=f"{t}-{p}", detail=str(low))
            for (t, p), (low, _, _) in ranges.items()
            if low <= ends.get((t, p), -1)
        ]
        if behind:
            raise ViolationError(behind)
    if not ranges:
        return False
    committed = [
        Row(t, p, low, high, count, FINISHED, batch_id)
        for (t, p), (low, high, count) in ranges.items()
    ]
    write_ledger(spark, table, batch_id, committed)
    if ends is not None:
        ends.update({tp: high for tp, (_, high, _) in ranges.items()})
    return True


def bulk_load(
    rows: DataFrame,
    table: str,
    order_by: Sequence[str] = (),
    commit: str | None = None,
    cluster: bool = True,
    batches: DataFrame | None = None,
) -> None:
    """Load rows that carry their ``batch_id`` into an empty table, many batches in one job.

    With ``cluster`` rows are shuffled by batch and offset bucket, so that each batch is written by
    few tasks and a large one by several. Rows that are already stored by batch need no shuffle.
    All blocks are committed by one ledger file at the end; ``batches``, rows with a ``batch_id``, says
    which batches may be in it.
    """
    spark = rows.sparkSession
    if has_commits(spark, table):
        raise ViolationError([Row(rule="load-not-empty", subject=table, detail=None)])
    if cluster:
        rows = rows.repartition("batch_id", F.expr(f"offset div {LOAD_BUCKET}"))
    if order_by:
        rows = rows.sortWithinPartitions("batch_id", *order_by)
    rows = rows.withColumn("dead", F.lit(0))
    storage.overwriting(rows).partitionBy("batch_id", "dead").parquet(f"{table}/data")
    positions = T.StructType([*POSITION_FIELDS, BATCH])
    data = spark.read.schema(positions).parquet(f"{table}/data")
    if batches is not None:
        data = only_batches(data, batches)
    ledger = block_ranges(data, schemas.BLOCK_ID).withColumn("state", F.lit(FINISHED))
    ledger = ledger.select(*schemas.LEDGER.names).repartition(1)
    storage.overwriting(ledger).parquet(f"{table}/ledger/commit={commit or uuid.uuid4().hex}")
