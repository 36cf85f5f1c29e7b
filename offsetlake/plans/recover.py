"""Point-in-time recovery: restore a chain, replay a range, and stand exactly at the vector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offsetlake import schemas
from offsetlake.operators.audit import ViolationError, require
from offsetlake.operators.bounds import audit_ranges
from offsetlake.operators.catalog import (
    audit_catalog,
    audit_manifests,
    audit_walk,
    latest_by_key,
    parse_manifests,
    walk_chain,
)
from offsetlake.operators.recovery import audit_recoveries, audit_targets, recovery_plan
from offsetlake.operators.snapshot import read_range
from offsetlake.sources import table as tables
from offsetlake.sources.backup import audit_projection, project, read_blocks, read_chain
from offsetlake.sources.catalog import read_catalog
from offsetlake.sources.log import decode_json, only_good
from offsetlake.sources.storage import settled, written
from offsetlake.streaming.deliver import Target
from offsetlake.streaming.follow import Bounds, current, replay_until, require_at


def point_in_time(
    restored: DataFrame, log: DataFrame, starts: DataFrame, targets: DataFrame, schema: T.StructType
) -> DataFrame:
    """The table at a vector: restored snapshot plus the decoded range, no overlap, no gap."""
    require(audit_targets(starts, targets))
    replayed = only_good(decode_json(read_range(log, starts, targets), schema))
    columns = [*schema.names, *schemas.POSITION]
    return restored.select(columns).unionByName(replayed.select("row.*", *schemas.POSITION))


def restore(
    spark: SparkSession,
    archive: str,
    backup_ids: Sequence[str],
    name: str,
    source_schema: T.StructType,
    target: Target,
    run_id: str,
    drop_missing: bool = False,
) -> bool:
    """Restore one table of a chain into an empty table; ``backup_ids`` are full backup first.

    The ledger commit is the proof that a run finished: the same run returns False, and any other
    run finds the destination non-empty and is refused. A run that died before its commit left
    nothing visible and starts again.
    """
    commit = f"{run_id}-restore"
    if tables.is_committed(spark, target.path, commit):
        return False
    if tables.row_count(spark, target.path):
        raise ViolationError([Row(rule="restore-not-empty", subject=target.path, detail=None)])
    rows = read_chain(spark, archive, backup_ids, name, source_schema)
    if target.schema != source_schema:
        require(audit_projection(rows, target.schema))
        rows = project(rows, target.schema, drop_missing)
    listed = read_blocks(spark, archive, backup_ids[-1], name)
    tables.bulk_load(rows, target.path, target.order_by, commit, cluster=False, batches=listed)
    return True


def chain_of(spark: SparkSession, catalog: str, backup_id: str) -> tuple[DataFrame, list[str]]:
    """The audited manifest of a backup, and the ids of its chain up to it, full backup first."""
    latest = written(latest_by_key(read_catalog(spark, catalog)), "catalog")
    require(audit_catalog(latest))
    manifests = parse_manifests(latest)
    tip = spark.createDataFrame([(backup_id,)], "backup_id STRING")
    walked = settled(walk_chain(manifests, tip))
    require(audit_walk(walked))
    ids = [r.backup_id for r in walked.select("backup_id", "step").orderBy(F.desc("step")).collect()]
    manifest = manifests.filter(F.col("backup_id") == backup_id)
    manifest = written(manifest.select(*schemas.MANIFESTS.names), "manifest")
    require(audit_manifests(manifest))
    return manifest, ids


def recover(
    spark: SparkSession,
    request: DataFrame,
    catalog: str,
    archive: str,
    log: DataFrame,
    bounds: Bounds,
    source_schema: T.StructType,
    target: Target,
    tolerance: str = "all",
) -> str:
    """Run one recovery request; returns ``Complete``, or ``Streaming`` when ``follow`` is next.

    ``request`` holds exactly one request; anything else is refused, so that vectors of several never
    mix. It, its vectors and the log range are all checked before the first row is written.
    Every step is safe to run again with the same request id.
    """
    rows = request.limit(2).collect()
    if len(rows) != 1:
        raise ViolationError([Row(rule="recovery-not-one-request", subject=None, detail=None)])
    row = rows[0]
    manifest, ids = chain_of(spark, catalog, row.backup_id)
    require(audit_recoveries(request, manifest))
    plan = recovery_plan(request, manifest)
    starts = plan.select("topic", "partition", F.col("start").alias("offset"))
    bounded = row.targets is not None
    targets = plan.select("topic", "partition", F.col("target").alias("offset")) if bounded else starts
    require(audit_ranges(starts, targets, current(bounds)))
    restore(spark, archive, ids, row.source_table, source_schema, target, row.id)
    if not bounded:
        tables.set_vector(spark, target.path, starts, f"{row.id}-vector")
        return "Streaming"
    replay_until(log, starts, targets, bounds, target, row.id, tolerance)
    require_at(target, targets)
    return "Complete"
