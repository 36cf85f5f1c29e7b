"""The backup catalog: latest record per key, manifests, chains and their audits."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offsetlake import schemas
from offsetlake.functions import MAX_I64, names
from offsetlake.functions.numbers import MAX_U64
from offsetlake.operators.audit import broken_rules, duplicates, union, violation
from offsetlake.operators.ledger import FINISHED
from offsetlake.operators.skew import dense_index
from offsetlake.sources.storage import settled

# Fixed values.
STATE_KEY = "chain-state"
NIL_ID = "00000000-0000-0000-0000-000000000000"
FULL, INCREMENTAL = "full", "incremental"


def latest_by_key(catalog: DataFrame) -> DataFrame:
    """The last value of every key in log order; a last value of null means the key is gone.

    An aggregate rather than a window: records fold on the map side, so a key that is rewritten
    all the time sends one row per task to the shuffle.
    """
    last = F.max(F.struct("log_offset", "value"))
    return (
        catalog.groupBy("key")
        .agg(last.alias("_last"))
        .select("key", "_last.value", "_last.log_offset")
        .filter("value IS NOT NULL")
    )


def fold_segment(records: DataFrame) -> DataFrame:
    """The last record of every key of a piece of the catalog log; a null value, which deletes the key, stays."""
    last = F.max(F.struct("log_offset", "value"))
    return records.groupBy("key").agg(last.alias("_last")).select("_last.log_offset", "key", "_last.value")


def merge_segments(base: DataFrame | None, deltas: Sequence[DataFrame]) -> DataFrame:
    """A new base from the old one and the segments after it, in any order.

    Records merge by log offset. With a base that covers the log from its start, a deletion has nothing left to
    delete and goes; a delta merged without a base keeps it.
    """
    parts = [base, *deltas] if base is not None else list(deltas)
    merged = fold_segment(reduce(DataFrame.unionByName, parts))
    return merged if base is None else merged.filter("value IS NOT NULL")


def lookup(catalog: DataFrame, key: str) -> DataFrame:
    """The live value of one key: the filter comes first, so nothing else is folded."""
    return latest_by_key(catalog.filter(F.col("key") == key))


def parse_manifests(latest: DataFrame) -> DataFrame:
    """Manifest rows of a compacted catalog; ``key`` stays for the identity audit."""
    rows = latest.filter(F.col("key") != STATE_KEY)
    parsed = rows.select("key", "value", F.from_json("value", schemas.MANIFESTS).alias("m"))
    return parsed.select("key", "value", "m.*")


def parse_state(latest: DataFrame) -> DataFrame:
    rows = latest.filter(F.col("key") == STATE_KEY)
    return rows.select(F.from_json("value", schemas.CHAIN_STATE).alias("s")).select("s.*")


def audit_catalog(latest: DataFrame) -> DataFrame:
    """Values must parse, name their own key, and hold no unknown fields; chain states too, but for the name."""
    manifests = parse_manifests(latest)
    known = F.array(*[F.lit(name) for name in schemas.MANIFESTS.names])
    extra = F.size(F.array_except(F.json_object_keys("value"), known)) > 0
    broken = broken_rules(
        manifests,
        F.col("key"),
        {
            "catalog-invalid-json": F.col("backup_id").isNull(),
            "catalog-key-mismatch": F.col("backup_id").isNotNull()
            & (F.col("backup_id") != F.col("key")),
            "catalog-unknown-field": F.coalesce(extra, F.lit(False)),
        },
    )
    fields = F.array(*[F.lit(name) for name in schemas.CHAIN_STATE.names])
    unknown = F.size(F.array_except(F.json_object_keys("value"), fields)) > 0
    states = latest.filter(F.col("key") == STATE_KEY)
    broken_states = broken_rules(
        states.withColumn("_tip", F.from_json("value", schemas.CHAIN_STATE)["tip"]),
        F.col("key"),
        {
            "catalog-invalid-json": F.col("_tip").isNull(),
            "catalog-unknown-field": F.coalesce(unknown, F.lit(False)),
        },
    )
    return broken.unionByName(broken_states)


def audit_pipelines(pipelines: DataFrame) -> DataFrame:
    """The configuration of all pipelines: valid names, one partition at least, and no topic or connector twice."""
    once = {
        rule: duplicates(pipelines.filter(F.col(c).isNotNull()), [c]).select(F.col(c).alias("name"))
        for rule, c in (("pipeline-connector-repeated", "connector"), ("pipeline-topic-repeated", "topic"))
    }
    single = broken_rules(
        pipelines,
        F.coalesce("connector", "topic"),
        {
            "pipeline-connector": ~names.is_log_name(F.col("connector")),
            "pipeline-topic": ~names.is_log_name(F.col("topic")),
            "pipeline-table": ~names.is_identifier(F.col("table")),
            "pipeline-partitions": F.coalesce(F.col("partitions") < 1, F.lit(True)),
        },
    )
    return union([single, *(violation(rows, rule, F.col("name")) for rule, rows in once.items())])


def flatten_offsets(manifests: DataFrame) -> DataFrame:
    """One row per manifest, connector and topic-partition, in checkpoint order."""
    return (
        manifests.select("backup_id", F.explode("connectors").alias("c"))
        .select("backup_id", F.col("c.name").alias("connector"), F.posexplode("c.offsets").alias("index", "o"))
        .select(
            "backup_id",
            "connector",
            "index",
            F.col("o.topic").alias("topic"),
            F.col("o.partition").alias("partition"),
            F.col("o.offset").cast("long").alias("offset"),
        )
    )


def recovery_connectors(manifests: DataFrame, database: str, table: str) -> DataFrame:
    """Connectors of each manifest that wrote the source table."""
    return (
        manifests.select("backup_id", F.explode("connectors").alias("c"))
        .filter((F.col("c.database") == database) & (F.col("c.table") == table))
        .select("backup_id", F.col("c.name").alias("connector"), F.col("c.topic").alias("topic"))
    )


def audit_recovery_source(manifests: DataFrame, database: str, table: str) -> DataFrame:
    """Manifests that do not hold the source table at all."""
    without = manifests.filter(
        ~F.exists(
            "connectors", lambda c: (c["database"] == database) & (c["table"] == table)
        )
    )
    return violation(without, "recovery-no-source-table", F.col("backup_id"))


def latest_backups(manifests: DataFrame, k: int) -> DataFrame:
    """The newest k backups; a bounded heap per task, not a full sort."""
    return manifests.orderBy(F.desc("created_at"), F.desc("backup_id")).limit(k)


# --- manifest audit ------------------------------------------------------------------------------


def _valid(field: str, pattern: str) -> str:
    return f"coalesce({field} rlike r'{pattern}', false)"


# Pieces of SQL over one connector ``c``, offset ``o`` or ledger row ``r`` of a manifest.
_KEY = "concat_ws('-', o.topic, cast(o.partition as string))"
_EXPECTED = f"coalesce(try_element_at(filter(c.ledger, r -> r.key = {_KEY}), 1).max_offset + 1, 0)"
_REPEATED = "size(array_distinct({0})) <> size({0})"
_NAMES = " AND ".join(
    [
        _valid("c.name", names.LOG_NAME),
        _valid("c.topic", names.LOG_NAME),
        _valid("c.database", names.IDENTIFIER),
        _valid("c.`table`", names.IDENTIFIER),
        _valid("c.state_database", names.IDENTIFIER),
        _valid("c.state_table", names.IDENTIFIER),
        _valid("c.state_path", names.STATE_PATH),
    ]
)
_SLOTS = "transform({0}, o -> struct(o.topic, o.partition))"
_BAD_ROW = (
    f"NOT (r.state <=> '{FINISHED}') OR r.min_offset > r.max_offset OR r.max_offset > {MAX_I64}"
)
_OUTSIDE = "o.topic <> c.topic OR o.partition < 0 OR o.partition >= c.partitions"

# Rules that some connector of the manifest breaks.
CONNECTOR_RULES = {
    "manifest-duplicate-offset": " OR ".join(
        _REPEATED.format(_SLOTS.format(vector)) for vector in ("c.offsets", "c.observed")
    ),
    "manifest-names": f"NOT ({_NAMES})",
    "manifest-partitions": "c.partitions <= 0 OR size(c.offsets) <> c.partitions",
    "manifest-ledger": f"exists(c.ledger, r -> {_BAD_ROW}) OR "
    + _REPEATED.format("transform(c.ledger, r -> r.key)"),
    "manifest-observed-range": f"exists(c.observed, o -> {_OUTSIDE})",
    "manifest-offset-order": "NOT forall("
    "transform(c.offsets, (o, i) -> o.topic = c.topic AND o.partition = i), fits -> fits)",
    "manifest-offset-value": f"exists(c.offsets, o -> o.offset <> {_EXPECTED}) "
    f"OR exists(c.observed, o -> o.offset > {_EXPECTED})",
    "manifest-stray-ledger": "exists(c.ledger, "
    f"r -> NOT array_contains(transform(c.offsets, o -> {_KEY}), r.key))",
}


def audit_manifests(manifests: DataFrame) -> DataFrame:
    """The fourteen rules of a single manifest.

    All rules are expressions over the nested columns of one row, so any number of manifests is
    audited in one pass without a shuffle.
    """
    connectors = F.coalesce("connectors", F.array().cast(schemas.CONNECTORS))
    has_parent = F.col("parent_id").isNotNull()
    whole = F.col("kind").eqNullSafe(FULL) & (F.col("position") == 0) & ~has_parent
    part = F.col("kind").eqNullSafe(INCREMENTAL) & (F.col("position") > 0) & has_parent
    listed = "transform(_connectors, c -> c.name)"
    return broken_rules(
        manifests.withColumn("_connectors", connectors),
        F.col("backup_id"),
        {
            "manifest-no-connectors": F.expr("size(_connectors) = 0"),
            "manifest-chain-id": ~names.is_chain_id(F.col("chain_id")),
            "manifest-destination": ~names.is_destination(F.col("name")),
            "manifest-parent-destination": has_parent
            & ~names.is_destination(F.col("parent_name")),
            "manifest-kind": ~(whole | part),
            "manifest-duplicate-connector": F.expr(_REPEATED.format(listed)),
            **{
                rule: F.expr(f"exists(_connectors, c -> coalesce({broken}, true))")
                for rule, broken in CONNECTOR_RULES.items()
            },
        },
    )


# --- chains --------------------------------------------------------------------------------------


def walk_chain(manifests: DataFrame, tips: DataFrame) -> DataFrame:
    """All manifests from each tip back to its full backup: (tip, step, backup_id, parent_id).

    Pointer jumping: round k knows the 2^k-th ancestor of every manifest, so a chain of n
    backups takes log2(n) joins, and all chains are walked together. An id without a manifest
    ends its walk with ``found`` false. An id that a walk meets again has ``repeated`` set; it is
    kept once, so a cycle adds no more rows than it has manifests.
    """
    nodes = settled(manifests.select("backup_id", "parent_id").distinct(), "nodes")
    count = nodes.count()
    jumps = settled(
        nodes.filter("parent_id IS NOT NULL").select(
            "backup_id", F.col("parent_id").alias("ancestor")
        ),
        "jumps",
    )
    walked = tips.select(
        F.col("backup_id").alias("tip"),
        F.lit(0).cast("long").alias("step"),
        "backup_id",
        F.lit(False).alias("repeated"),
    )
    reach = 1
    while reach <= count and not jumps.isEmpty():
        further = walked.join(jumps, "backup_id").select(
            "tip",
            (F.col("step") + reach).alias("step"),
            F.col("ancestor").alias("backup_id"),
            "repeated",
        )
        met = walked.unionByName(further).groupBy("tip", "backup_id").agg(
            F.min("step").alias("step"),
            (F.max("repeated") | (F.count(F.lit(1)) > 1)).alias("repeated"),
        )
        walked = settled(met, "walked")
        second = jumps.select(F.col("backup_id").alias("ancestor"), F.col("ancestor").alias("next"))
        jumps = settled(
            jumps.join(second, "ancestor").select("backup_id", F.col("next").alias("ancestor")),
            "jumps",
        )
        reach *= 2
    return walked.join(nodes.withColumn("_found", F.lit(True)), "backup_id", "left").select(
        "tip",
        "step",
        "backup_id",
        "parent_id",
        F.coalesce("_found", F.lit(False)).alias("found"),
        "repeated",
    )


def audit_walk(walked: DataFrame) -> DataFrame:
    """A walk must end at a full backup: no missing manifest and no repeated id."""
    return broken_rules(
        walked,
        F.col("backup_id"),
        {"chain-missing-manifest": ~F.col("found"), "chain-cycle": F.col("repeated")},
        F.col("tip"),
    )


def chain_ranges(manifests: DataFrame) -> DataFrame:
    """What each backup adds: ``[parent checkpoint, checkpoint)`` per topic-partition.

    A join on the parent link, not a window over the chain: it spreads over all backups and
    partitions however long one chain is.
    """
    offsets = flatten_offsets(manifests)
    links = manifests.select("backup_id", "parent_id", "chain_id", "position")
    current = offsets.join(links, "backup_id")
    previous = offsets.select(
        F.col("backup_id").alias("parent_id"),
        "connector",
        "topic",
        "partition",
        F.col("offset").alias("start"),
    )
    keys = ["parent_id", "connector", "topic", "partition"]
    return current.join(previous, keys, "left").select(
        "chain_id",
        "position",
        "backup_id",
        "topic",
        "partition",
        F.coalesce("start", F.lit(0)).cast("long").alias("start"),
        F.col("offset").alias("target"),
    )


def backup_struct() -> Column:
    """The stored identity of a manifest row."""
    return F.struct(
        F.col("backup_id").alias("id"),
        "name",
        "kind",
        "chain_id",
        F.col("position").cast("long").alias("position"),
        "parent_id",
        "parent_name",
    )


PIPELINE_FIELDS = (
    "connector", "topic", "partitions", "database", "table", "state_table", "state_path"
)


def configured_pipelines(pipelines: DataFrame) -> Column:
    """The configured pipelines as one constant array; configuration, so read on the driver."""
    rows = [{f: r[f] for f in PIPELINE_FIELDS} for r in pipelines.collect()]
    return F.from_json(F.lit(json.dumps(rows)), schemas.CHAIN_STATE["pipelines"].dataType)


def audit_states(states: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Rules of a chain state on its own, and against the configured pipelines."""
    configured = configured_pipelines(pipelines)
    root, tip, count = F.col("root"), F.col("tip"), F.col("incremental_count")
    has_parent = tip["parent_id"].isNotNull()
    whole_tip = (tip["kind"] == FULL) & ~has_parent & tip.eqNullSafe(root)
    part_tip = (
        (tip["kind"] == INCREMENTAL)
        & has_parent
        & (tip["parent_id"] != tip["id"])
        & (tip["parent_name"] != tip["name"])
    )
    return broken_rules(
        states,
        F.col("chain_id"),
        {
            "state-generation": (F.col("generation") == 0)
            | (F.col("generation") == F.lit(str(MAX_U64)).cast("decimal(20,0)")),
            "state-pipelines": ~F.sort_array("pipelines").eqNullSafe(F.sort_array(configured)),
            "state-chain-id": ~names.is_chain_id(F.col("chain_id")),
            "state-root": (root["kind"] != FULL)
            | ~names.is_destination(root["name"])
            | (root["chain_id"] != F.col("chain_id"))
            | (root["position"] != 0)
            | root["parent_id"].isNotNull(),
            "state-tip": ~names.is_destination(tip["name"])
            | (tip["chain_id"] != F.col("chain_id"))
            | (tip["position"] != count)
            | has_parent & ~names.is_destination(tip["parent_name"])
            | ~F.when(count == 0, whole_tip).otherwise(F.coalesce(part_tip, F.lit(False))),
        },
    )


def audit_chain(manifests: DataFrame, states: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Chain rules over every chain of a catalog at once.

    Parents are joined by their id. Only counts are grouped by chain.
    """
    state = states.select(
        "chain_id", "generation", "root", "tip", "incremental_count"
    )
    rows = manifests.withColumn("self", backup_struct())
    counts = rows.groupBy("chain_id").agg(
        F.count(F.lit(1)).alias("manifests"),
        F.count_if(F.col("position") == 0).alias("roots"),
        F.max(F.struct("position", "self"))["self"].alias("last"),
        F.min(F.struct("position", "self"))["self"].alias("first"),
    )
    of_state = state.join(counts, "chain_id", "left")
    chain = broken_rules(
        of_state,
        F.col("chain_id"),
        {
            "chain-count": F.coalesce("manifests", F.lit(0)) != F.col("incremental_count") + 1,
            "chain-generation": F.col("generation") <= F.col("incremental_count"),
            "chain-tip": ~F.col("last").eqNullSafe(F.col("tip")),
            "chain-root": ~F.col("first").eqNullSafe(F.col("root")),
        },
    )
    unknown = rows.join(state.select("chain_id"), "chain_id", "left_anti")
    previous = rows.select(
        F.col("backup_id").alias("parent_id"),
        F.col("name").alias("p_name"),
        F.col("position").alias("p_position"),
        F.col("chain_id").alias("p_chain"),
        F.col("connectors").alias("p_connectors"),
    )
    configured = configured_pipelines(pipelines)
    linked = rows.join(previous, "parent_id", "left").withColumn("_configured", configured)
    unmatched = F.expr(
        "exists(_configured, p -> NOT exists(connectors, c -> coalesce("
        "c.name = p.connector AND c.topic = p.topic AND c.partitions = p.partitions AND "
        "c.state_database = p.database AND c.state_table = p.state_table AND "
        "c.state_path = p.state_path, false)))"
    )
    # Offsets are compared with those of the parent's connector by array position.
    before = "try_element_at(filter(p_connectors, p -> p.name = c.name), 1).offsets"
    backwards = F.expr(
        "exists(connectors, c -> coalesce(exists("
        f"zip_with(c.offsets, {before}, (now, then) -> now.offset < then.offset), "
        "fell -> fell), false))"
    )
    lost = F.expr(
        "exists(connectors, c -> NOT exists(p_connectors, p -> coalesce(p.name = c.name, false)))"
    )
    has_parent = F.col("parent_id").isNotNull()
    found = F.col("p_name").isNotNull()
    single = broken_rules(
        linked,
        F.col("backup_id"),
        {
            "chain-nil-id": F.col("backup_id") == NIL_ID,
            "chain-missing-parent": has_parent & ~found,
            "chain-parent-link": has_parent
            & found
            & (
                (F.col("p_name") != F.col("parent_name"))
                | (F.col("p_chain") != F.col("chain_id"))
                | (F.col("p_position") + 1 != F.col("position"))
            ),
            "chain-connector-count": F.expr("size(connectors) <> size(_configured)"),
            "chain-pipeline-mismatch": unmatched,
            "chain-parent-connector": found & lost,
            "chain-offsets-backwards": found & backwards,
        },
        F.col("chain_id"),
    )
    twice = duplicates(rows, ["chain_id", "position"])
    ids = duplicates(rows, ["chain_id", "backup_id"])
    names = duplicates(rows, ["chain_id", "name"])
    return union(
        [
            chain,
            violation(unknown, "chain-unknown", F.col("backup_id"), F.col("chain_id")),
            single,
            violation(twice, "chain-duplicate-position", F.col("chain_id"), F.col("position")),
            violation(ids, "chain-duplicate-id", F.col("backup_id"), F.col("chain_id")),
            violation(names, "chain-duplicate-name", F.col("name"), F.col("chain_id")),
            audit_states(states, pipelines),
        ]
    )


def plan_backups(
    runs: DataFrame, max_incrementals: int, order: str = "started_at", bucket: str = "1 day"
) -> DataFrame:
    """Kind, chain, position, parent and generation of every run of a history.

    Run n of a history (all committed, ``max_incrementals`` fixed) has position
    ``n % (max_incrementals + 1)`` and belongs to the chain opened by run ``n - position``. The
    running number comes from time buckets, so no single task sorts the history; the chain's
    opening run and the parent are found by joins on that number.
    """
    length = max_incrementals + 1
    slot = F.window(order, bucket)["start"]
    numbered = dense_index(runs.withColumn("_all", F.lit(0)), ["_all"], [order, "run_id"], slot, "n")
    numbered = numbered.drop("_all").withColumn("position", F.expr(f"n % {length}"))
    ids = numbered.select("n", "run_id")
    opening = ids.select(F.col("n").alias("_open"), F.col("run_id").alias("chain_id"))
    parents = ids.select((F.col("n") + 1).alias("n"), F.col("run_id").alias("_previous"))
    return (
        numbered.withColumn("_open", F.col("n") - F.col("position"))
        .join(opening, "_open")
        .join(parents, "n", "left")
        .select(
            "run_id",
            F.when(F.col("position") == 0, FULL).otherwise(INCREMENTAL).alias("kind"),
            "chain_id",
            "position",
            F.when(F.col("position") > 0, F.col("_previous")).alias("parent_id"),
            (F.col("n") + 1).alias("generation"),
        )
    )


def next_backup(state, max_incrementals: int, run_id: str) -> dict:
    """Plan of one run from the current chain state (a row, or None for an empty catalog)."""
    if state is not None and state["incremental_count"] < max_incrementals:
        return {
            "kind": INCREMENTAL,
            "chain_id": state["chain_id"],
            "position": state["incremental_count"] + 1,
            "parent_id": state["tip"]["id"],
            "parent_name": state["tip"]["name"],
            "generation": int(state["generation"]) + 1,
        }
    return {
        "kind": FULL,
        "chain_id": run_id,
        "position": 0,
        "parent_id": None,
        "parent_name": None,
        "generation": 1 if state is None else int(state["generation"]) + 1,
    }


def closed_chains(manifests: DataFrame, states: DataFrame, keep: DataFrame) -> DataFrame:
    """Chains that may be deleted: not the open one, and no retained manifest depends on them.

    ``keep`` holds the ``backup_id`` of manifests to retain. Every backup of a chain depends on
    all earlier ones, so one retained backup keeps its whole chain.
    """
    open_chains = states.select("chain_id").distinct()
    kept = manifests.join(keep.select("backup_id"), "backup_id", "left_semi").select("chain_id").distinct()
    return (
        manifests.groupBy("chain_id")
        .agg(F.count(F.lit(1)).alias("backups"))
        .join(open_chains, "chain_id", "left_anti")
        .join(kept, "chain_id", "left_anti")
    )
