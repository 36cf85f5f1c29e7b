"""Audits: a valid object passes, and each broken field is reported by its own rule."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from offsetlake import schemas
from offsetlake.operators import audit, bounds, catalog, ledger, recovery
from tests.conftest import rules

MAX = 2**63 - 1


def pipelines(spark, partitions=3):
    row = ("c", "main", "state", "/ledger/c", "t", "a-b", partitions)
    return spark.createDataFrame([row], schemas.PIPELINES)


def raw(spark, *rows):
    full = [("c", k, Decimal(lo), Decimal(hi), s) for k, lo, hi, s in rows]
    return spark.createDataFrame(full, schemas.RAW_LEDGER)


def vector(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.OFFSETS)


def limits(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.LOG_BOUNDS)


DONE = ledger.FINISHED


@pytest.mark.parametrize(
    ("row", "rule"),
    [
        (("a-b-0", 0, MAX, DONE), None),
        (("other-0", 0, 1, DONE), "ledger-unexpected-topic"),
        (("a-b", 0, 1, DONE), "ledger-unexpected-topic"),
        (("a-b-0", 2, 1, DONE), "ledger-invalid-range"),
        (("a-b-0", 0, MAX + 1, DONE), "ledger-offset-too-large"),
        (("a-b-x", 0, 1, DONE), "ledger-invalid-partition"),
        (("a-b--1", 0, 1, DONE), "ledger-invalid-partition"),
        (("a-b-3", 0, 1, DONE), "ledger-partition-out-of-range"),
        (("a-b-0", 0, 1, "BEFORE_PROCESSING"), "ledger-unfinished"),
        (("a-b-01", 0, 1, DONE), "ledger-duplicate-partition"),
    ],
)
def test_ledger_rules(spark, row, rule):
    rows = [row, ("a-b-1", 0, 9, DONE)]
    found = rules(ledger.audit_ledger(raw(spark, *rows), pipelines(spark)))
    assert [r for r, _ in found] == ([rule] if rule else [])


def test_exact_offsets_fill_missing_partitions(spark):
    parsed = ledger.parse_ledger(raw(spark, ("a-b-1", 4, 9, DONE)), pipelines(spark))
    exact = ledger.exact_offsets(pipelines(spark), parsed)
    assert sorted((r.partition, r.offset) for r in exact.collect()) == [(0, 0), (1, 10), (2, 0)]


@pytest.mark.parametrize("observed", [0, 9, 10, 11])
def test_observed_may_lag_but_not_lead(spark, observed):
    exact = vector(spark, ("t", 0, 10), ("t", 1, 0))
    found = rules(ledger.audit_observed(exact, vector(spark, ("t", 0, observed))))
    assert found == ([("observed-ahead", "t-0")] if observed > 10 else [])


def test_observed_unknown_and_repeated(spark):
    exact = vector(spark, ("t", 0, 10))
    seen = vector(spark, ("t", 0, 1), ("t", 0, 2), ("t", 1, 0), ("u", 0, 0))
    assert rules(ledger.audit_observed(exact, seen)) == [
        ("observed-duplicate", "t-0"),
        ("observed-unexpected", "t-1"),
        ("observed-unexpected", "u-0"),
    ]


@pytest.mark.parametrize(
    ("start", "target", "low", "high", "rule"),
    [
        (5, 10, 5, 10, None),
        (5, 5, 5, 5, None),
        (4, 10, 5, 10, "range-start-expired"),
        (5, 11, 5, 10, "range-target-beyond-end"),
        (5, 9, -1, 10, "range-invalid-bounds"),
    ],
)
def test_ranges(spark, start, target, low, high, rule):
    found = bounds.audit_ranges(
        vector(spark, ("t", 0, start)), vector(spark, ("t", 0, target)), limits(spark, ("t", 0, low, high))
    )
    assert [r for r, _ in rules(found)] == ([rule] if rule else [])


def test_range_without_start_or_bounds(spark):
    found = bounds.audit_ranges(
        vector(spark, ("t", 0, 1)), vector(spark, ("t", 0, 2), ("t", 1, 2)), limits(spark, ("t", 1, 0, 9))
    )
    assert rules(found) == [("range-no-bounds", "t-0"), ("range-no-start", "t-1")]


def test_replayable(spark):
    low_high = limits(spark, ("t", 0, 5, 10), ("t", 1, 0, 3))
    assert rules(bounds.audit_replayable(vector(spark, ("t", 0, 5), ("t", 1, 3)), low_high)) == []
    assert rules(bounds.audit_replayable(vector(spark, ("t", 0, 4), ("t", 1, 4)), low_high)) == [
        ("replay-beyond-end", "t-1"),
        ("replay-expired", "t-0"),
    ]
    assert rules(bounds.audit_replayable(vector(spark, ("t", 0, 5)), low_high, complete=True)) == [
        ("replay-incomplete-log", "t-0"),
        ("replay-partition-count", "t"),
    ]


def test_targets(spark):
    starts = vector(spark, ("t", 0, 5), ("t", 1, 5))
    ok = vector(spark, ("t", 1, 5), ("t", 0, 9))
    assert rules(recovery.audit_targets(starts, ok)) == []
    bad = vector(spark, ("t", 0, 4), ("t", 0, 9), ("u", 0, 1))
    assert rules(recovery.audit_targets(starts, bad)) == [
        ("target-before-start", "t-0"),
        ("target-duplicate", "t-0"),
        ("target-missing", "t-1"),
        ("target-unknown", "u-0"),
    ]


def test_require_raises_with_the_rows(spark):
    audit.require(spark.createDataFrame([], schemas.VIOLATION))
    with pytest.raises(audit.ViolationError, match="r: s d"):
        audit.require(spark.createDataFrame([("r", "s", "d")], schemas.VIOLATION))


def test_diff_rows_counts_copies(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (3,)], "a INT")
    right = spark.createDataFrame([(1,), (2,), (4,), (4,)], "a INT")
    found = sorted((r.side, r.a, r.copies) for r in audit.diff_rows(left, right).collect())
    assert found == [("left", 1, 1), ("left", 3, 1), ("right", 4, 2)]
    assert audit.diff_rows(left, left).isEmpty()


def test_rehydrate_and_progress(spark):
    expected = ledger.vector_to_ledger(vector(spark, ("t", 0, 5), ("t", 1, 7), ("t", 2, 0)))
    assert sorted((r.key, r.max_offset) for r in expected.collect()) == [("t-0", 4), ("t-1", 6)]
    actual = expected.filter("key = 't-0'")
    assert [(r.action, r.key) for r in ledger.rehydrate(expected, actual).collect()] == [("insert", "t-1")]
    assert ledger.rehydrate(expected, expected).isEmpty()
    initial, offsets = expected, vector(spark, ("t", 0, 5), ("t", 1, 7), ("t", 2, 0))
    moved = expected.withColumn("max_offset", F.col("max_offset") + 3)
    assert rules(ledger.audit_progress(moved, initial, offsets)) == []
    back = expected.withColumn("max_offset", F.col("max_offset") - 1)
    assert [r for r, _ in rules(ledger.audit_progress(back, initial, offsets))] == ["progress-moved-back"] * 2


# --- manifests and chains, in the style: build a valid chain, break one field -------------------


def manifest(position, /, **changes):
    offset = 10 + position
    full = position == 0
    fields = {
        "backup_id": f"id-{position}",
        "name": f"store:chain/{position}",
        "kind": "full" if full else "incremental",
        "chain_id": "chain",
        "position": position,
        "parent_id": None if full else f"id-{position - 1}",
        "parent_name": None if full else f"store:chain/{position - 1}",
        "created_at": f"2024-01-0{position + 1}T00:00:00Z",
        "connectors": [
            {
                "name": "c",
                "topic": "a-b",
                "partitions": 3,
                "database": "main",
                "table": "t",
                "state_database": "main",
                "state_table": "state",
                "state_path": "/ledger/c",
                "offsets": [
                    {"topic": "a-b", "partition": p, "offset": Decimal(offset if p == 0 else 0)}
                    for p in range(3)
                ],
                "observed": [{"topic": "a-b", "partition": 0, "offset": Decimal(offset - 1)}],
                "ledger": [
                    {
                        "key": "a-b-0",
                        "min_offset": Decimal(offset - 1),
                        "max_offset": Decimal(offset - 1),
                        "state": DONE,
                    }
                ],
            }
        ],
    }
    connector = changes.pop("connector", None)
    fields.update(changes)
    if connector:
        fields["connectors"] = [{**fields["connectors"][0], **connector}]
    return fields


def at(partition, offset, topic="a-b"):
    return {"topic": topic, "partition": partition, "offset": Decimal(offset)}


def row(key="a-b-0", low=9, high=9, state=DONE):
    return {"key": key, "min_offset": Decimal(low), "max_offset": Decimal(high), "state": state}


@pytest.mark.parametrize(
    ("changes", "found"),
    [
        ({}, []),
        ({"connectors": []}, ["manifest-no-connectors"]),
        ({"connectors": None}, ["manifest-no-connectors"]),
        ({"chain_id": "a b"}, ["manifest-chain-id"]),
        ({"name": "nowhere"}, ["manifest-destination"]),
        ({"kind": "other"}, ["manifest-kind"]),
        ({"position": 1}, ["manifest-kind"]),
        ({"parent_id": "x", "parent_name": "store:x"}, ["manifest-kind"]),
        (
            {"kind": "incremental", "position": 2, "parent_id": "x", "parent_name": "bad"},
            ["manifest-parent-destination"],
        ),
        ({"connectors": [manifest(0)["connectors"][0]] * 2}, ["manifest-duplicate-connector"]),
        ({"connector": {"table": "no-name"}}, ["manifest-names"]),
        ({"connector": {"state_path": "no/slash"}}, ["manifest-names"]),
        ({"connector": {"partitions": 4}}, ["manifest-partitions"]),
        ({"connector": {"observed": [at(0, 1), at(0, 2)]}}, ["manifest-duplicate-offset"]),
        ({"connector": {"observed": [at(3, 0)]}}, ["manifest-observed-range"]),
        ({"connector": {"observed": [at(0, 11)]}}, ["manifest-offset-value"]),
        ({"connector": {"offsets": [at(0, 11), at(1, 0), at(2, 0)]}}, ["manifest-offset-value"]),
        ({"connector": {"offsets": [at(0, 10), at(2, 0), at(1, 0)]}}, ["manifest-offset-order"]),
        ({"connector": {"ledger": [row(state="OPEN")]}}, ["manifest-ledger"]),
        ({"connector": {"ledger": [row(low=10)]}}, ["manifest-ledger"]),
        ({"connector": {"ledger": [row(), row()]}}, ["manifest-ledger"]),
        ({"connector": {"ledger": [row(), row("a-b-7")]}}, ["manifest-stray-ledger"]),
        ({"connector": {"ledger": []}}, ["manifest-offset-value"]),
    ],
)
def test_manifest_rules(spark, changes, found):
    rows = spark.createDataFrame([manifest(0, **changes)], schemas.MANIFESTS)
    assert [r for r, _ in rules(catalog.audit_manifests(rows))] == found


def ref(fields):
    return {
        "id": fields["backup_id"],
        **{k: fields[k] for k in ("name", "kind", "chain_id", "position", "parent_id", "parent_name")},
    }


def chain(spark, change=None, state_change=None, drop=None, add=None):
    points = [manifest(p) for p in range(4)]
    state = {
        "generation": Decimal(7),
        "chain_id": "chain",
        "root": ref(points[0]),
        "tip": ref(points[3]),
        "incremental_count": 3,
        "pipelines": [
            {
                "connector": "c",
                "topic": "a-b",
                "partitions": 3,
                "database": "main",
                "table": "t",
                "state_table": "state",
                "state_path": "/ledger/c",
            }
        ],
    }
    state.update(state_change or {})
    if change:
        points[change[0]].update(change[1])
    if drop is not None:
        del points[drop]
    points += add or []
    manifests = spark.createDataFrame(points, schemas.MANIFESTS)
    states = spark.createDataFrame([state], schemas.CHAIN_STATE)
    found = catalog.audit_chain(manifests, states, pipelines(spark))
    return sorted({r for r, _ in rules(found)})


def test_valid_chain(spark):
    assert chain(spark) == []


@pytest.mark.parametrize(
    ("kwargs", "expected"),
    [
        ({"drop": 1}, {"chain-count", "chain-missing-parent"}),
        ({"drop": 3}, {"chain-count", "chain-tip"}),
        ({"drop": 0}, {"chain-count", "chain-root", "chain-missing-parent"}),
        ({"add": [manifest(2)]}, {"chain-count", "chain-duplicate-id", "chain-duplicate-name", "chain-duplicate-position"}),
        ({"change": (1, {"chain_id": "other"})}, {"chain-count", "chain-unknown", "chain-parent-link"}),
        ({"change": (2, {"parent_id": "nobody"})}, {"chain-missing-parent"}),
        ({"change": (2, {"parent_name": "store:x"})}, {"chain-parent-link"}),
        ({"change": (2, {"connectors": manifest(0)["connectors"]})}, {"chain-offsets-backwards"}),
        ({"change": (2, {"connectors": []})}, {"chain-connector-count", "chain-pipeline-mismatch", "chain-parent-connector"}),
        ({"change": (2, manifest(2, connector={"state_path": "/else"}))}, {"chain-pipeline-mismatch"}),
        ({"state_change": {"generation": Decimal(3)}}, {"chain-generation"}),
        ({"state_change": {"generation": Decimal(0)}}, {"chain-generation", "state-generation"}),
        ({"state_change": {"generation": Decimal(2**64 - 1)}}, {"state-generation"}),
        ({"state_change": {"pipelines": []}}, {"state-pipelines"}),
        ({"state_change": {"incremental_count": 2}}, {"chain-count", "state-tip"}),
        ({"state_change": {"tip": ref(manifest(2))}}, {"chain-tip", "state-tip"}),
        ({"state_change": {"root": ref(manifest(1))}}, {"chain-root", "state-root"}),
    ],
)
def test_broken_chains(spark, kwargs, expected):
    assert set(chain(spark, **kwargs)) == expected


def links(spark, *pairs):
    return spark.createDataFrame(list(pairs), "backup_id STRING, parent_id STRING")


def test_walk_long_forked_missing_and_cyclic(spark):
    long = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(37)]
    rows = links(spark, *long, ("fork", "n5"), ("lost", "gone"), ("x", "y"), ("y", "z"), ("z", "x"))
    tips = rows.filter("backup_id IN ('n36', 'fork', 'lost', 'x')").select("backup_id")
    walked = catalog.walk_chain(rows, tips)
    steps = {}
    for r in walked.collect():
        steps.setdefault(r.tip, []).append((r.step, r.backup_id))
    assert sorted(steps["n36"]) == [(36 - i, f"n{i}") for i in range(36, -1, -1)]
    assert sorted(steps["fork"]) == [(0, "fork")] + [(6 - i, f"n{i}") for i in range(5, -1, -1)]
    assert sorted(steps["lost"]) == [(0, "lost"), (1, "gone")]
    found = rules(catalog.audit_walk(walked))
    assert ("chain-missing-manifest", "gone") in found
    assert {r for r, s in found if s in "xyz"} == {"chain-cycle"}
    assert len(found) == 1 + len({s for _, s in found if s in "xyz"})


def test_latest_by_key_drops_deleted(spark):
    rows = spark.createDataFrame(
        [(1, "a", "1"), (2, "b", "1"), (3, "a", "2"), (4, "b", None), (5, "c", None), (6, "c", "3")],
        schemas.CATALOG,
    )
    assert sorted((r.key, r.value) for r in catalog.latest_by_key(rows).collect()) == [("a", "2"), ("c", "3")]


def test_catalog_values_are_strict(spark):
    rows = [
        (1, "a", '{"backup_id": "a"}'),
        (2, "b", '{"backup_id": "x"}'),
        (3, "c", '{"backup_id": "c", "surprise": 1}'),
        (4, "d", "no json"),
    ]
    latest = catalog.latest_by_key(spark.createDataFrame(rows, schemas.CATALOG))
    assert rules(catalog.audit_catalog(latest)) == [
        ("catalog-invalid-json", "d"),
        ("catalog-key-mismatch", "b"),
        ("catalog-unknown-field", "c"),
    ]


@pytest.mark.parametrize("limit", [0, 1, 3])
def test_plan_equals_run_by_run_planning(spark, limit):
    rows = [(f"r{i:02d}", f"2024-01-0{1 + i // 3} 0{i % 3}:00:00") for i in range(11)]
    runs = spark.createDataFrame(rows, "run_id STRING, at STRING").selectExpr(
        "run_id", "CAST(at AS TIMESTAMP) AS started_at"
    )
    got = sorted(map(tuple, catalog.plan_backups(runs, limit).collect()))
    want, state = [], None
    for run, _ in rows:
        plan = catalog.next_backup(state, limit, run)
        want.append((run, plan["kind"], plan["chain_id"], plan["position"], plan["parent_id"], plan["generation"]))
        state = {
            "incremental_count": plan["position"],
            "chain_id": plan["chain_id"],
            "tip": {"id": run, "name": run},
            "generation": plan["generation"],
        }
    assert got == want
