"""Stale rows, mixed requests, foreign catalog values, maps, and both sides of former bounds."""

import shutil

import pytest
from pyspark.sql import functions as F

from offsetlake import schemas
from offsetlake.operators import bounds, catalog, health, skew, snapshot
from offsetlake.operators.audit import ViolationError, diff_rows, require, violation
from offsetlake.operators.dedup import accepted_blocks
from offsetlake.plans import recover as recovery
from offsetlake.sources import backup as backups
from offsetlake.sources import catalog as catalogs
from offsetlake.sources import storage
from offsetlake.sources import table as tables
from tests.conftest import rules
from tests.test_delivery import USER, counts, target
from tests.test_recovery import Site, pipelines

OFFSETS = "topic string, partition int, offset long"


@pytest.fixture
def dynamic(spark):
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    yield
    spark.conf.unset("spark.sql.sources.partitionOverwriteMode")


def test_rows_of_a_crashed_restore_stay_invisible(spark, path, dynamic):
    site = Site(spark, path)
    site.produce(90)
    site.backup("run-0")
    restored = target(path)
    stale = site.table.path + "/data"
    crashed = f"{restored.path}/data/batch_id=stale"
    shutil.copytree(f"{stale}/batch_id=e-0", crashed)
    recovery.restore(spark, site.archive, ["run-0"], "records", USER, restored, "r-1")
    assert counts(spark, restored) == (90, 90)


def test_batches_that_a_backup_does_not_list_are_not_read(spark, path):
    site = Site(spark, path)
    site.produce(60)
    site.backup("run-0")
    data = f"{site.archive}/data/backup=run-0/table=records"
    shutil.copytree(f"{data}/batch_id=e-0", f"{data}/batch_id=stray")
    rows = backups.read_chain(spark, site.archive, ["run-0"], "records", USER)
    assert rows.count() == 60


def test_a_recovery_is_one_request(spark, path):
    site = Site(spark, path)
    site.produce(30)
    site.backup("run-0")
    one = site.request("run-0")
    for requests in (one.unionByName(site.request("run-0", name="req-2")), one.limit(0)):
        with pytest.raises(ViolationError, match="recovery-not-one-request"):
            site.recover(requests, target(path))


def test_foreign_catalog_values_stop_backups_and_recoveries(spark, path, monkeypatch):
    site = Site(spark, path)
    site.produce(30)
    site.backup("run-0")
    read = catalogs.read_catalog
    extra = F.concat(F.expr("substr(value, 1, length(value) - 1)"), F.lit(',"extra":1}'))
    changes = {
        "catalog-key-mismatch": {"key": F.when(F.col("key") == "run-0", "run-9").otherwise(F.col("key"))},
        "catalog-unknown-field": {"value": extra},
    }
    for rule, change in changes.items():
        for module in ("offsetlake.plans.backup", "offsetlake.plans.recover"):
            monkeypatch.setattr(f"{module}.read_catalog", lambda s, p, c=change: read(s, p).withColumns(c))
        with pytest.raises(ViolationError, match=rule):
            site.backup("run-1")
        with pytest.raises(ViolationError, match=rule):
            site.recover(site.request("run-0"), target(path))


def test_pipelines_are_audited(spark):
    good = pipelines(spark)
    assert rules(catalog.audit_pipelines(good)) == []
    assert rules(catalog.audit_pipelines(pipelines(spark, 0))) == [("pipeline-partitions", "records-input")]
    assert rules(catalog.audit_pipelines(good.unionByName(good))) == [
        ("pipeline-connector-repeated", "records-input"),
        ("pipeline-topic-repeated", "records.input"),
    ]
    assert bounds.all_partitions(pipelines(spark, 0)).collect() == []
    assert bounds.all_partitions(good).count() == 3


def test_lost_partitions_stay_in_the_report(spark, path):
    site = Site(spark, path)
    site.produce(30)
    site.backup("run-0")
    manifest, _ = recovery.chain_of(spark, site.catalog, "run-0")
    seen = site.bounds().filter("partition <> 1")
    found = {r.partition: r.headroom for r in health.retention_headroom(manifest, seen).collect()}
    assert set(found) == {0, 1, 2} and found[1] is None and found[0] is not None


def test_maps_compare_by_their_entries(spark):
    schema = "topic string, partition int, offset long, m map<string, struct<a: map<int, string>>>, n array<map<string, int>>"
    left = spark.createDataFrame(
        [("t", 0, 0, {"a": ({1: "x", 2: "y"},), "b": None}, [{"p": 1, "q": 2}]), ("t", 0, 1, None, [None])], schema
    )
    same = spark.createDataFrame(
        [("t", 0, 0, {"b": None, "a": ({2: "y", 1: "x"},)}, [{"q": 2, "p": 1}]), ("t", 0, 1, None, [None])], schema
    )
    other = spark.createDataFrame([("t", 0, 0, {"a": ({1: "x"},)}, []), ("t", 0, 1, None, [None])], schema)
    assert backups.verify_backup(left, same).collect() == []
    assert rules(backups.verify_backup(left, other)) == [("backup-content", "t-0")]
    assert backups.reconcile(left, same).collect() == []
    assert sorted(r.side for r in backups.reconcile(left, other).collect()) == ["left", "right"]
    assert diff_rows(left, same).collect() == []


def test_large_control_tables_join_records_with_maps(spark):
    records = spark.range(200).select(
        F.lit("t").alias("topic"), (F.col("id") % 3).cast("int").alias("partition"), F.col("id").alias("offset"),
        F.create_map(F.lit("k"), F.col("id")).alias("m"),
    )
    control = spark.createDataFrame([("t", p, p * 10) for p in range(3)], "topic string, partition int, low long")
    for limit in (2, 3):
        got = skew.join_control(records, control, ["topic", "partition"], max_rows=limit)
        assert got.count() == 200 and got.filter("low = partition * 10").count() == 200
    plain = skew.join_control(records.drop("offset", "topic"), control.drop("topic"), ["partition"], max_rows=2)
    assert plain.count() == 200


@pytest.mark.parametrize("topics", [64, 65, 130])
def test_any_number_of_topics_is_pushed(spark, topics):
    rows = spark.range(1000).select(
        F.concat(F.lit("t"), (F.col("id") % 200).cast("string")).alias("topic"),
        F.lit(0).alias("partition"),
        F.expr("id div 200").alias("offset"),
    )
    vector = spark.createDataFrame([(f"t{i}", 0, 1 + i % 5) for i in range(topics)], OFFSETS)
    found = snapshot.snapshot_at(rows, vector)
    assert found.count() == sum(1 + i % 5 for i in range(topics))


def test_errors_say_that_there_are_more(spark):
    rows = violation(spark.range(30), "rule", F.col("id"))
    with pytest.raises(ViolationError, match="and more") as error:
        require(rows)
    assert len(error.value.rows) == 20 and error.value.more
    with pytest.raises(ViolationError) as error:
        require(rows.limit(20))
    assert not error.value.more


def test_windows_hold_a_block_at_least(spark):
    from offsetlake.streaming.dedup import stream_accepted_blocks

    schema = "table string, seq long, topic string, partition int, min_offset long, max_offset long, rows long, content string"
    blocks = spark.createDataFrame([], schema)
    for window in (0, -1):
        with pytest.raises(ValueError):
            accepted_blocks(blocks, window)
        with pytest.raises(ValueError):
            stream_accepted_blocks(blocks, window)


def test_emptiness_looks_at_one_entry(spark, path):
    place = path()
    assert not storage.has_children(spark, place)
    spark.range(1).write.parquet(place)
    assert storage.has_children(spark, place)
    assert tables.read_ledger(spark, path()).schema == schemas.LEDGER
