"""Reports that operators are told to watch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offsetlake.operators.bounds import TP
from offsetlake.operators.catalog import flatten_offsets


def delivery_lag(bounds: DataFrame, exact: DataFrame) -> DataFrame:
    """Records in the log that are not in the table yet, per topic-partition."""
    return bounds.join(exact, TP, "left").select(
        *TP, (F.col("high") - F.coalesce("offset", F.lit(0))).alias("lag")
    )


def retention_headroom(manifests: DataFrame, bounds: DataFrame) -> DataFrame:
    """How far each checkpoint is from being lost to retention; negative means it is lost.

    Null means that the log has no such topic-partition any more.
    """
    return flatten_offsets(manifests).join(bounds, TP, "left").select(
        "backup_id", *TP, (F.col("offset") - F.col("low")).alias("headroom")
    )


def backup_report(manifests: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Expected runs by status, with the age of the newest backup of each kind of outcome.

    ``runs`` has ``run_id`` and ``status``. A run that is ``BACKUP_CREATED`` without a manifest
    counts as ``MISSING``.
    """
    known = manifests.select(F.col("backup_id").alias("run_id"), "created_at")
    rows = runs.join(known, "run_id", "left")
    status = F.when(
        (F.col("status") == "BACKUP_CREATED") & F.col("created_at").isNull(), "MISSING"
    ).otherwise(F.col("status"))
    newest = F.to_timestamp(F.max("created_at"), "yyyy-MM-dd'T'HH:mm:ssX")
    return rows.groupBy(status.alias("status")).agg(
        F.count(F.lit(1)).alias("runs"),
        F.timestamp_diff("SECOND", newest, now).alias("age_seconds"),
    )
