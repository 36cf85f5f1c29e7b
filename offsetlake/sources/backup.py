"""Backup archives: immutable copies of the blocks of a cut, full or incremental.

Layout of an archive::

    data/backup=<id>/table=<t>/batch_id=<b>/*.parquet   rows of the blocks this backup holds
    blocks/backup=<id>/table=<t>/*.parquet              every block of the cut, inherited ones too
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offsetlake import schemas
from offsetlake.functions import content_hash
from offsetlake.functions.hashing import plain
from offsetlake.operators.audit import ViolationError, broken_rules, diff_rows
from offsetlake.operators.bounds import TP, position_name
from offsetlake.operators.skew import join_control
from offsetlake.operators.snapshot import blocks_below, read_range, snapshot_at
from offsetlake.sources import storage
from offsetlake.sources import table as tables

BLOCKS = T.StructType([schemas.LEDGER[c] for c in [*schemas.BLOCK_ID, "min_offset", "max_offset", "rows"]])
RECONCILE_BUCKET = 1_000_000
BACKUP, TABLE = (T.StructField(name, T.StringType()) for name in ("backup", "table"))


def cut_blocks(spark: SparkSession, table: str, offsets: DataFrame) -> DataFrame:
    """The committed blocks of a table that hold rows below the vector; see ``blocks_below``."""
    return blocks_below(tables.read_ledger(spark, table), offsets).select(*BLOCKS.names, "whole")


def _blocks_path(archive: str, backup_id: str, name: str) -> str:
    return f"{archive}/blocks/backup={backup_id}/table={name}"


def read_blocks(spark: SparkSession, archive: str, backup_id: str, name: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(_blocks_path(archive, backup_id, name))


def missing_blocks(blocks: DataFrame, parent: DataFrame | None) -> DataFrame:
    """Blocks that are not in the parent backup; all of them for a full backup.

    A block that the parent's cut split has another range there, and counts as missing.
    """
    if parent is None:
        return blocks
    return blocks.join(parent.select(*BLOCKS.names), BLOCKS.names, "left_anti")


def write_backup(
    spark: SparkSession,
    table: str,
    name: str,
    user: T.StructType,
    offsets: DataFrame,
    archive: str,
    backup_id: str,
    parent_id: str | None = None,
    order_by: Sequence[str] = (),
) -> None:
    """Copy the blocks of the cut into the archive, without those that the parent holds.

    Delivery is append-only and blocks are immutable, so no pause is needed while this runs. Only
    directories of the missing blocks' batches are read, and nothing is shuffled. A batch may hold
    several partitions, of which the parent has some; delivery goes forward in each partition, so
    the rows to copy are those from the end of the parent's blocks to the cut. The block list is
    written last: a backup without it was not finished.
    """
    listed = _blocks_path(archive, backup_id, name)
    if storage.exists(spark, f"{listed}/_SUCCESS"):
        raise ViolationError([Row(rule="backup-exists", subject=listed, detail=None)])
    offsets = storage.settled(offsets.select(*schemas.POSITION))
    blocks = storage.settled(cut_blocks(spark, table, offsets), "cut")
    if not blocks.filter("NOT whole").isEmpty():
        raise ViolationError([Row(rule="backup-splits-block", subject=name, detail=None)])
    blocks = blocks.drop("whole")
    parent = read_blocks(spark, archive, parent_id, name) if parent_id else None
    data = tables.read_data(spark, table, user)
    rows = tables.only_batches(data, missing_blocks(blocks, parent))
    if parent is None:
        rows = snapshot_at(rows, offsets)
    else:
        ends = parent.groupBy(*TP).agg((F.max("max_offset") + 1).alias("end"))
        starts = offsets.select(*TP).join(ends, TP, "left").fillna(0, ["end"])
        rows = read_range(rows, starts.withColumnRenamed("end", "offset"), offsets)
    if order_by:
        rows = rows.sortWithinPartitions("batch_id", *order_by)
    path = f"{archive}/data/backup={backup_id}/table={name}"
    storage.overwriting(rows).partitionBy("batch_id").parquet(path)
    storage.overwriting(blocks).parquet(listed)


def read_chain(
    spark: SparkSession, archive: str, backup_ids: Sequence[str], name: str, user: T.StructType
) -> DataFrame:
    """Rows of one table from a chain of backups, as one scan over their directories.

    The list is bounded by the chain length. A backup that was not finished is refused. Only batches
    that the last backup lists are read, whatever else lies in the directories.
    """
    schema = T.StructType([*tables.table_schema(user).fields, tables.BATCH])
    for backup_id in backup_ids:
        if not storage.exists(spark, f"{_blocks_path(archive, backup_id, name)}/_SUCCESS"):
            raise ViolationError([Row(rule="backup-unfinished", subject=backup_id, detail=name)])
    base = f"{archive}/data"
    paths = [f"{base}/backup={backup_id}/table={name}" for backup_id in backup_ids]
    reader = spark.read.schema(T.StructType([*schema.fields, BACKUP, TABLE]))
    rows = reader.option("basePath", base).parquet(*paths).select(*schema.names)
    return tables.only_batches(rows, read_blocks(spark, archive, backup_ids[-1], name))


def project(rows: DataFrame, schema: T.StructType, drop_missing: bool = False) -> DataFrame:
    """Rows in another user schema: new columns are null, and values are converted if they fit.

    A source column that the destination lacks is an error unless ``drop_missing`` is set.
    ``audit_projection`` lists the values that a conversion loses.
    """
    positions = {*schemas.OFFSETS.names, "batch_id"}
    lost = [c for c in rows.columns if c not in positions and c not in schema.names]
    if lost and not drop_missing:
        raise ViolationError([Row(rule="restore-column-dropped", subject=c, detail=None) for c in lost])
    users = [
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).try_cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]
    return rows.select(*users, *[c for c in rows.columns if c in positions])


def audit_projection(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Values that do not survive the conversion to the destination types."""
    rules = {
        f"restore-value-lost:{f.name}": F.col(f.name).isNotNull()
        & F.col(f.name).try_cast(f.dataType).isNull()
        for f in schema.fields
        if f.name in rows.columns and rows.schema[f.name].dataType != f.dataType
    }
    if not rules:
        return rows.sparkSession.createDataFrame([], schemas.VIOLATION)
    place = [F.col(c).cast("string") for c in schemas.POSITION]
    return broken_rules(rows, F.concat_ws("-", *place), rules)


def backup_metrics(spark: SparkSession, archive: str) -> DataFrame:
    """Files, bytes and rows of every backup and table, from file metadata of the scan."""
    fields = T.StructType([*schemas.OFFSETS.fields, BACKUP, TABLE, tables.BATCH])
    rows = spark.read.schema(fields).parquet(f"{archive}/data")
    per_file = rows.groupBy("backup", "table", "_metadata.file_path").agg(
        F.max("_metadata.file_size").alias("bytes"), F.count(F.lit(1)).alias("rows")
    )
    return per_file.groupBy("backup", "table").agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")
    )


def fingerprint(rows: DataFrame, keys: Sequence[str] = ("topic", "partition")) -> DataFrame:
    """Count, offset range and order-free row hash per key: fixed-width, so a hash aggregation."""
    content = [
        plain(F.col(c), rows.schema[c].dataType) for c in rows.columns if c not in ("batch_id", "table", *keys)
    ]
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("offset").alias("min_offset"),
        F.max("offset").alias("max_offset"),
        content_hash(*content).alias("content"),
    )


def verify_backup(backup: DataFrame, cut: DataFrame) -> DataFrame:
    """Compare what was written with the cut it should hold, per topic-partition."""
    fields = ["rows", "min_offset", "max_offset", "content"]
    left = fingerprint(backup).select(*TP, *[F.col(c).alias(f"b_{c}") for c in fields])
    right = fingerprint(cut).select(*TP, *[F.col(c).alias(f"c_{c}") for c in fields])
    both = left.join(right, TP, "full_outer")

    def differs(field):
        return ~F.col(f"b_{field}").eqNullSafe(F.col(f"c_{field}"))

    return broken_rules(
        both,
        position_name(),
        {
            "backup-row-count": differs("rows"),
            "backup-offset-range": differs("min_offset") | differs("max_offset"),
            "backup-content": differs("content"),
        },
    )


def reconcile(left: DataFrame, right: DataFrame, bucket: int = RECONCILE_BUCKET) -> DataFrame:
    """Row differences of two tables that should be equal.

    Fingerprints per offset bucket of a topic-partition come first; they combine before the
    shuffle. Only rows of buckets that differ are compared one by one, so one lost row does not
    shuffle a whole hot partition.
    """
    columns = [c for c in left.columns if c != "batch_id"]
    slot = F.expr(f"offset div {bucket}")
    left, right = (side.select(*columns).withColumn("_slot", slot) for side in (left, right))
    keys = [*TP, "_slot"]
    off = (
        fingerprint(left, keys)
        .unionByName(fingerprint(right, keys))
        .groupBy(*keys, "rows", "min_offset", "max_offset", "content")
        .agg(F.count(F.lit(1)).alias("_sides"))
        .filter("_sides = 1")
        .select(*keys)
        .distinct()
    )
    off = storage.settled(off)
    left, right = (
        join_control(side, off, keys, "left_semi").select(*columns) for side in (left, right)
    )
    return diff_rows(left, right)
