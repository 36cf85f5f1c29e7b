"""Joins against control tables and ordered operations that do not depend on key balance.

A log has few partitions, and one of them may hold a third of all rows. A window over
(topic, partition) would then put a third of the data in one task. The helpers below split
every key into buckets of its ordering column, work inside the buckets, and carry only one
row per bucket between them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

NESTED = (T.ArrayType, T.MapType, T.StructType)
CONTROL_ROWS = 100_000
CONTROL_BYTES = 64 * 1024 * 1024
SPREAD = 64


def pin(control: DataFrame, max_rows: int = CONTROL_ROWS) -> DataFrame | None:
    """Evaluate a control table once and hold it as a local relation.

    Returns None when it has more than ``max_rows`` rows or ``CONTROL_BYTES`` bytes; the
    caller must then take a plan that does not broadcast it. At most ``max_rows + 1`` rows
    reach the driver. Meant for narrow rows, such as offset vectors, block lists and key sets;
    nested rows, such as manifests, may be large each and are never held.
    """
    if any(isinstance(f.dataType, NESTED) for f in control.schema.fields):
        return None
    table = control.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows or table.nbytes > CONTROL_BYTES:
        return None
    return control.sparkSession.createDataFrame(table, control.schema)


def _salt_columns(records: DataFrame) -> list[Column]:
    """What tells records apart without their payloads: the position, else numbers and times, else the place."""
    names = [c for c in ("topic", "partition", "offset") if c in records.columns]
    if "offset" not in names:
        fixed = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)
        names = [f.name for f in records.schema.fields if isinstance(f.dataType, fixed)]
    return [F.col(c) for c in names] or [F.spark_partition_id()]


def join_control(
    records: DataFrame,
    control: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    max_rows: int = CONTROL_ROWS,
    spread: int = SPREAD,
) -> DataFrame:
    """Join records with a table that is small but not known to be.

    The control table is measured first. Within the bound it is broadcast and the records stay
    where they are. Beyond it both sides are shuffled on the keys plus a salt, with the control
    rows repeated once per salt, so that a hot key is still shared by ``spread`` tasks. That is a merge join by name:
    Spark's estimate does not know the repetition, and would broadcast all of it.
    """
    side = pin(control, max_rows)
    if side is not None:
        return records.join(F.broadcast(side), list(on), how)
    salt = F.pmod(F.xxhash64(*_salt_columns(records)), F.lit(spread)).cast("int")
    repeated = control.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    return (
        records.withColumn("_salt", salt).join(repeated.hint("merge"), [*on, "_salt"], how).drop("_salt")
    )


def _between_buckets(rows: DataFrame, keys: Sequence[str], total: Column, fold) -> DataFrame:
    """Per key and bucket, ``fold`` of ``total`` over all earlier buckets: one row per bucket."""
    parts = [*keys, "_bucket"]
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(*parts).agg(total.alias("_total"))
    return totals.select(*parts, fold("_total").over(earlier).alias("_base"))


def running_sum(
    rows: DataFrame, keys: Sequence[str], order: str, value: Column, bucket: Column, name: str
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over this and all earlier rows of the key.

    ``order`` must be unique in the key, and ``bucket`` must never decrease with it. Rows are
    shuffled once, by key and bucket; between buckets only their totals are summed up.
    """
    parts = [*keys, "_bucket"]
    rows = rows.withColumn("_value", value).withColumn("_bucket", bucket)
    bases = _between_buckets(rows, keys, F.sum("_value"), F.sum)
    inside = W.partitionBy(*parts).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return (
        rows.withColumn("_inside", F.sum("_value").over(inside))
        .join(bases, parts)
        .withColumn(name, F.coalesce("_base", F.lit(0)) + F.col("_inside"))
        .drop("_value", "_bucket", "_inside", "_base")
    )


def earlier_max(
    rows: DataFrame, keys: Sequence[str], order: str, value: Column, bucket: Column, name: str
) -> DataFrame:
    """Add ``name``: the largest ``value`` of all earlier rows of the key; null if there is none."""
    parts = [*keys, "_bucket"]
    rows = rows.withColumn("_value", value).withColumn("_bucket", bucket)
    bases = _between_buckets(rows, keys, F.max("_value"), F.max)
    inside = W.partitionBy(*parts).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return (
        rows.withColumn("_inside", F.max("_value").over(inside))
        .join(bases, parts)
        .withColumn(name, F.greatest("_base", "_inside"))
        .drop("_value", "_bucket", "_inside", "_base")
    )


def dense_index(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str
) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... in ``order`` within the key, with the same plan shape."""
    parts = [*keys, "_bucket"]
    rows = rows.withColumn("_bucket", bucket)
    bases = _between_buckets(rows, keys, F.count(F.lit(1)), F.sum)
    inside = W.partitionBy(*parts).orderBy(*order)
    return (
        rows.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(bases, parts)
        .withColumn(name, F.coalesce("_base", F.lit(0)) + F.col("_inside"))
        .drop("_bucket", "_inside", "_base")
    )


def following(
    rows: DataFrame, keys: Sequence[str], order: str, bucket: Column, name: str
) -> DataFrame:
    """Add ``name``: the next value of ``order`` within the key, null on the last row."""
    parts = [*keys, "_bucket"]
    rows = rows.withColumn("_bucket", bucket)
    firsts = rows.groupBy(*parts).agg(F.min(order).alias("_first"))
    across = W.partitionBy(*keys).orderBy("_bucket")
    nexts = firsts.select(*parts, F.lead("_first").over(across).alias("_across"))
    inside = W.partitionBy(*parts).orderBy(order)
    return (
        rows.withColumn("_inside", F.lead(order).over(inside))
        .join(nexts, parts)
        .withColumn(name, F.coalesce("_inside", "_across"))
        .drop("_bucket", "_inside", "_across")
    )
