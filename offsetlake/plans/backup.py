"""One backup run: consistent cut, archive, audits and catalog commit."""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offsetlake import schemas
from offsetlake.functions import ledger_key
from offsetlake.operators.audit import require
from offsetlake.operators.bounds import audit_replayable
from offsetlake.operators.catalog import (
    audit_catalog,
    audit_chain,
    audit_manifests,
    audit_pipelines,
    audit_walk,
    latest_by_key,
    next_backup,
    parse_manifests,
    parse_state,
    walk_chain,
)
from offsetlake.operators.ledger import fold_ledger
from offsetlake.operators.snapshot import barrier_cut, snapshot_at
from offsetlake.sources import table as tables
from offsetlake.sources.backup import read_chain, verify_backup, write_backup
from offsetlake.sources.catalog import commit_catalog, read_catalog
from offsetlake.sources.storage import settled, written


def load_chain(spark: SparkSession, catalog: str, pipelines: DataFrame):
    """The current chain: its state and audited manifests, or (None, None) for an empty catalog."""
    latest = written(latest_by_key(read_catalog(spark, catalog)), "catalog")
    require(audit_catalog(latest))
    states = parse_state(latest)
    state = next(iter(states.collect()), None)
    if state is None:
        return None, None
    manifests = parse_manifests(latest)
    tip = spark.createDataFrame([(state.tip.id,)], "backup_id STRING")
    walked = settled(walk_chain(manifests, tip))
    require(audit_walk(walked))
    chain = manifests.join(walked.select("backup_id"), "backup_id", "left_semi")
    chain = written(chain.select(*schemas.MANIFESTS.names), "chain")
    require(audit_manifests(chain).unionByName(audit_chain(chain, states, pipelines)))
    return state, chain


def _connector(pipeline, vector, ledger) -> dict:
    own = [
        {"topic": r.topic, "partition": r.partition, "offset": r.offset}
        for r in sorted(vector, key=lambda r: r.partition)
        if r.connector == pipeline.connector
    ]
    return {
        "name": pipeline.connector,
        "topic": pipeline.topic,
        "partitions": pipeline.partitions,
        "database": pipeline.database,
        "table": pipeline.table,
        "state_database": pipeline.database,
        "state_table": pipeline.state_table,
        "state_path": pipeline.state_path,
        "offsets": own,
        "observed": [],
        "ledger": [
            {"key": r.key, "min_offset": r.min_offset, "max_offset": r.max_offset, "state": r.state}
            for r in ledger
            if r.topic == pipeline.topic
        ],
    }


def _state(manifest: dict, plan: dict, state, configured) -> dict:
    """The chain state that becomes visible with the manifest."""
    tip = {"id": manifest["backup_id"]}
    tip |= {k: manifest[k] for k in ("name", "kind", "chain_id", "position", "parent_id", "parent_name")}
    fields = ("connector", "topic", "partitions", "database", "table", "state_table", "state_path")
    return {
        "generation": plan["generation"],
        "chain_id": plan["chain_id"],
        "root": tip if plan["position"] == 0 else state.root.asDict(),
        "tip": tip,
        "incremental_count": plan["position"],
        "pipelines": [{f: p[f] for f in fields} for p in configured],
    }


def run_backup(
    spark: SparkSession,
    roots: Mapping[str, str],
    user_schemas: Mapping[str, T.StructType],
    pipelines: DataFrame,
    bounds: DataFrame,
    archive: str,
    catalog: str,
    run_id: str,
    max_incrementals: int,
    store: str = "archive",
    verify: bool = False,
) -> dict:
    """Back up every table of the pipelines and commit the manifest; returns the manifest.

    ``roots`` and ``user_schemas`` are by table name. The commit is the only success point:
    whatever fails before it leaves an archive that no manifest names, and the chain unchanged.
    Vectors and ledger rows reach the driver, bounded by the partition count; table rows do not.
    """
    require(audit_pipelines(pipelines))
    configured = pipelines.collect()
    state, chain = load_chain(spark, catalog, pipelines)
    plan = next_backup(state, max_incrementals, run_id)
    earlier = []
    if plan["parent_id"]:
        earlier = [r.backup_id for r in chain.select("backup_id", "position").orderBy("position").collect()]
    vector, ledger = [], []
    for name in sorted({p.table for p in configured}):
        feeding = pipelines.filter(F.col("table") == name)
        blocks = tables.read_ledger(spark, roots[name])
        folded = fold_ledger(blocks).withColumn(
            "key", ledger_key(F.col("topic"), F.col("partition"))
        )
        ledger += folded.collect()
        vector += barrier_cut(blocks, feeding).collect()
    offsets = spark.createDataFrame(
        [(r.topic, r.partition, r.offset) for r in vector], schemas.OFFSETS
    )
    require(audit_replayable(offsets, bounds))
    for name in sorted({p.table for p in configured}):
        feeding = [p.topic for p in configured if p.table == name]
        own = offsets.filter(F.col("topic").isin(feeding))
        write_backup(
            spark,
            roots[name],
            name,
            user_schemas[name],
            own,
            archive,
            run_id,
            plan["parent_id"],
        )
        if verify:
            copied = read_chain(spark, archive, [*earlier, run_id], name, user_schemas[name])
            cut = snapshot_at(tables.read_table(spark, roots[name], user_schemas[name]), own)
            require(verify_backup(copied, cut))
    manifest = {
        "backup_id": run_id,
        "name": f"{store}:{plan['chain_id']}/{plan['position']:04d}-{run_id}",
        **{k: plan[k] for k in ("kind", "chain_id", "position", "parent_id", "parent_name")},
        "created_at": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"),
        "connectors": [_connector(p, vector, ledger) for p in configured],
    }
    record = spark.createDataFrame([(run_id, json.dumps(manifest))], "key STRING, value STRING")
    require(audit_manifests(parse_manifests(record)))
    require(audit_replayable(offsets, bounds))
    commit_catalog(
        spark, catalog, manifest, _state(manifest, plan, state, configured), plan["generation"] - 1
    )
    return manifest
