"""A stored fingerprint tree: comparing two tables reads only what differs.

Leaves are additive hashes per batch, topic-partition and bucket of offsets. They lie beside the table,
``prints/n=<n>/*.parquet``; batches never change, so each entry only adds the batches that came since. Leaves add up
to buckets, spans of buckets, partitions and the table. A comparison goes down from the table and opens only the nodes
that differ; then it reads the batches that have rows in a differing bucket, and of those the differing buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offsetlake import schemas
from offsetlake.operators.audit import ViolationError, diff_rows
from offsetlake.operators.bounds import TP
from offsetlake.operators.ledger import FINISHED
from offsetlake.operators.skew import join_control, pin
from offsetlake.sources import storage
from offsetlake.sources import table as tables
from offsetlake.sources.backup import fingerprint

BUCKET = 1_000_000  # offsets of a leaf
SPAN = 1_000  # buckets of a span
SLOT, CONTENT = T.StructField("slot", T.LongType()), T.StructField("content", T.DecimalType(38, 0))
PRINTS = T.StructType([*(schemas.LEDGER[c] for c in ("batch_id", *TP)), SLOT, schemas.LEDGER["rows"], CONTENT])
# What a level groups by; the slot of a span is the number of its first bucket.
LEVELS = ([], TP, [*TP, "span"], [*TP, "slot"])


def _path(table: str, user: T.StructType, bucket: int) -> str:
    """Leaves of other columns or buckets cannot be compared, and lie apart."""
    kind = hashlib.sha256(f"{bucket}:{user.json()}".encode()).hexdigest()[:16]
    return f"{table}/prints/kind={kind}"


def leaves_of(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Leaves of delivered rows; they combine before the shuffle."""
    slotted = rows.withColumn("slot", F.expr(f"offset div {bucket}"))
    found = fingerprint(slotted, ["batch_id", *TP, "slot"])
    return found.select(*[F.col(f.name).cast(f.dataType) for f in PRINTS.fields])


def _stored(spark: SparkSession, root: str) -> DataFrame:
    entries = tables.complete(spark, root)
    if not entries:
        return spark.createDataFrame([], PRINTS)
    return spark.read.schema(PRINTS).parquet(*[f"{root}/n={n}" for n in entries])


def _unprinted(spark: SparkSession, table: str, stored: DataFrame) -> DataFrame:
    """Committed blocks with rows whose batch has no leaves yet."""
    blocks = tables.read_ledger(spark, table).filter((F.col("state") == FINISHED) & (F.col("rows") > 0))
    return blocks.select("batch_id").distinct().join(stored.select("batch_id").distinct(), "batch_id", "left_anti")


def _fresh(spark: SparkSession, table: str, user: T.StructType, stored: DataFrame, bucket: int) -> DataFrame | None:
    missing = _unprinted(spark, table, stored)
    if missing.isEmpty():
        return None
    return leaves_of(tables.only_batches(tables.read_data(spark, table, user), missing), bucket)


def update_prints(spark: SparkSession, table: str, user: T.StructType, bucket: int = BUCKET) -> int | None:
    """Store the leaves of the batches committed since the last entry; returns its number, or None without any.

    An entry counts once it is complete, and an unfinished one is overwritten. Batches that hold nothing but dead letters
    have no leaves, and are looked at again.
    """
    root = _path(table, user, bucket)
    fresh = _fresh(spark, table, user, _stored(spark, root), bucket)
    if fresh is None:
        return None
    entries = tables.complete(spark, root)
    number = entries[-1] + 1 if entries else 0
    storage.overwriting(fresh).parquet(f"{root}/n={number}")
    return number


def leaves(spark: SparkSession, table: str, user: T.StructType, bucket: int = BUCKET) -> DataFrame:
    """The leaves of all committed rows: stored ones, and those of later batches computed now."""
    stored = _stored(spark, _path(table, user, bucket))
    fresh = _fresh(spark, table, user, stored, bucket)
    return stored if fresh is None else stored.unionByName(fresh)


def fold(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nodes of a level of the tree, as sums of what lies below them."""
    return nodes.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.sum("content").alias("content"))


def _unequal(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nodes of a level whose two sides differ, with the rows of either."""
    of = lambda side, what: F.coalesce(F.sum(F.when(F.col("side") == side, F.col(what))), F.lit(0))
    sums = [of(side, what).alias(f"{name}_{what}") for side, name in ((0, "left"), (1, "right")) for what in ("rows", "content")]
    unequal = "left_rows <> right_rows OR left_content <> right_content"
    return nodes.groupBy(*keys).agg(*sums).filter(unequal).select(*keys, "left_rows", "right_rows")


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Buckets whose sums differ: ``topic, partition, slot, left_rows, right_rows``; a side without the bucket has 0 rows.

    Level by level, only the children of nodes that differ are compared. Nodes are narrow and one per bucket, so
    they are folded once a side and level; equal tables end at the first.
    """
    spans = F.expr(f"slot div {SPAN}").alias("span")
    sides = [storage.written(fold(side, [*TP, "slot"]).select("*", spans), "prints") for side in (left, right)]
    off = None
    for keys in LEVELS:
        parents = [c for c in off.columns if c in (*TP, "span")] if off is not None else []
        if parents:
            sides = [join_control(side, off.select(*parents), parents, "left_semi") for side in sides]
        tagged = sides[0].withColumn("side", F.lit(0)).unionByName(sides[1].withColumn("side", F.lit(1)))
        off = storage.settled(_unequal(tagged, keys), "differing")
        if off.isEmpty():
            break
    return off if "slot" in off.columns else _unequal(tagged, LEVELS[-1]).limit(0)


def _touched(rows: DataFrame, own: DataFrame, slots: DataFrame, bucket: int) -> DataFrame:
    """Rows of the differing buckets, from the batches that have some."""
    batches = join_control(own, slots, [*TP, "slot"], "left_semi")
    held = pin(slots.groupBy("topic").agg(F.min("slot").alias("low"), F.max("slot").alias("high")))
    rows = tables.only_batches(rows, batches)
    if held is not None:
        # Literals that reach the scan.
        hulls = held.collect()
        low, high = min(r.low for r in hulls), max(r.high for r in hulls)
        rows = rows.filter(
            F.col("topic").isin([r.topic for r in hulls]) & (F.col("offset") >= low * bucket) & (F.col("offset") < (high + 1) * bucket)
        )
    slotted = rows.withColumn("slot", F.expr(f"offset div {bucket}"))
    return join_control(slotted, slots, [*TP, "slot"], "left_semi").select(*[c for c in rows.columns if c != "batch_id"])


def diff_tables(spark: SparkSession, left: str, right: str, user: T.StructType, bucket: int = BUCKET) -> DataFrame:
    """Row differences of two delivered tables, as ``reconcile`` gives them, from their stored trees."""
    empty = [table for table in (left, right) if not tables.has_commits(spark, table)]
    if empty:
        raise ViolationError([Row(rule="prints-no-table", subject=table, detail=None) for table in empty])
    own = [leaves(spark, table, user, bucket) for table in (left, right)]
    slots = differing(*own).select(*TP, "slot")
    if slots.isEmpty():
        nothing = spark.createDataFrame([], tables.table_schema(user))
        return diff_rows(nothing, nothing)
    rows = [tables.read_table(spark, table, user) for table in (left, right)]
    return diff_rows(*(_touched(r, o, slots, bucket) for r, o in zip(rows, own, strict=True)))
