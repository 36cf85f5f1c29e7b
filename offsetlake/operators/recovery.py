"""Recovery requests: source, start vector and target vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offsetlake.functions import is_identifier
from offsetlake.operators.audit import broken_rules, duplicates, union, violation
from offsetlake.operators.bounds import TP, position_name


def audit_targets(starts: DataFrame, targets: DataFrame, keys=()) -> DataFrame:
    """A target vector names every start partition exactly once, and none below its start.

    ``keys`` are columns in front of the position that separate several vectors.
    """
    on = [*keys, *TP]
    joined = starts.select(*on, F.col("offset").alias("start")).join(
        targets.select(*on, F.col("offset").alias("target")), on, "full_outer"
    )
    owner = F.concat_ws(",", *[F.col(k).cast("string") for k in keys]) if keys else F.lit(None)
    has_start, has_target = F.col("start").isNotNull(), F.col("target").isNotNull()
    return union(
        [
            broken_rules(
                joined,
                position_name(),
                {
                    "target-missing": has_start & ~has_target,
                    "target-unknown": has_target & ~has_start,
                    "target-before-start": has_start & has_target & (F.col("target") < F.col("start")),
                },
                owner,
            ),
            violation(duplicates(targets, on), "target-duplicate", position_name(), owner),
            violation(duplicates(starts, on), "start-duplicate", position_name(), owner),
        ]
    )


def _source_rows(recoveries: DataFrame, manifests: DataFrame) -> DataFrame:
    """Requests joined to the connectors of their manifest that wrote the source table."""
    held = manifests.select("backup_id", F.explode("connectors").alias("c"))
    requests = recoveries.select("id", "backup_id", "source_database", "source_table", "targets")
    joined = requests.join(held, "backup_id")
    return joined.filter(
        (F.col("c.database") == F.col("source_database")) & (F.col("c.table") == F.col("source_table"))
    )


def recovery_plan(recoveries: DataFrame, manifests: DataFrame) -> DataFrame:
    """The plan of every request: one row per connector and topic-partition.

    ``mode`` is ``point-in-time`` with a target vector and ``follow`` without; ``target`` is null
    then. Run ``audit_recoveries`` first: a request that breaks its rules has no plan.
    """
    starts = (
        _source_rows(recoveries, manifests)
        .select(
            "id",
            F.col("c.name").alias("connector"),
            F.col("targets").isNotNull().alias("bounded"),
            F.explode("c.offsets").alias("o"),
        )
        .select(
            "id",
            "connector",
            "bounded",
            F.col("o.topic").alias("topic"),
            F.col("o.partition").alias("partition"),
            F.col("o.offset").cast("long").alias("start"),
        )
    )
    targets = _targets(recoveries).withColumnRenamed("offset", "target")
    return starts.join(targets, ["id", *TP], "left").select(
        "id",
        "connector",
        F.when(F.col("bounded"), "point-in-time").otherwise("follow").alias("mode"),
        *TP,
        "start",
        "target",
    )


def _targets(recoveries: DataFrame) -> DataFrame:
    return recoveries.select("id", F.explode("targets").alias("t")).select(
        "id",
        F.col("t.topic").alias("topic"),
        F.col("t.partition").alias("partition"),
        F.col("t.offset").cast("long").alias("offset"),
    )


def audit_recoveries(recoveries: DataFrame, manifests: DataFrame) -> DataFrame:
    """Rules over all requests: names, known backup, source table in it, and target vectors."""
    known = manifests.select("backup_id").distinct().withColumn("_known", F.lit(True))
    rows = recoveries.join(known, "backup_id", "left")
    sources = _source_rows(recoveries, manifests)
    missing = rows.filter("_known").join(sources.select("id").distinct(), "id", "left_anti")
    names = ["source_database", "source_table", "dest_database", "dest_table"]
    bad_name = ~is_identifier(F.col(names[0]))
    for name in names[1:]:
        bad_name = bad_name | ~is_identifier(F.col(name))
    starts = (
        sources.filter("targets IS NOT NULL")
        .select("id", F.explode("c.offsets").alias("o"))
        .select(
            "id",
            F.col("o.topic").alias("topic"),
            F.col("o.partition").alias("partition"),
            F.col("o.offset").cast("long").alias("offset"),
        )
    )
    targets = _targets(recoveries).join(missing.select("id"), "id", "left_anti")
    return union(
        [
            broken_rules(
                rows,
                F.col("id"),
                {
                    "recovery-name": bad_name,
                    "recovery-same-table": (F.col("source_database") == F.col("dest_database"))
                    & (F.col("source_table") == F.col("dest_table")),
                    "recovery-unknown-backup": F.col("_known").isNull(),
                },
            ),
            violation(missing, "recovery-no-source-table", F.col("id")),
            audit_targets(starts, targets, ["id"]),
        ]
    )
