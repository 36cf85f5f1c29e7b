"""Zone maps, catalog segments, and mark and sweep."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from offsetlake import schemas
from offsetlake.operators import catalog
from offsetlake.operators.audit import ViolationError
from offsetlake.sources import backup as backups
from offsetlake.sources import catalog as catalogs
from offsetlake.sources import compaction, storage, sweep, zones
from offsetlake.sources import log as logs
from offsetlake.sources import table as tables
from offsetlake.streaming import deliver as delivery
from tests.test_delivery import USER, records, target

TOPIC = "records.input"


def vector(spark, *offsets):
    return spark.createDataFrame([(TOPIC, p, o) for p, o in enumerate(offsets) if o is not None], schemas.OFFSETS)


def places(rows):
    return sorted((r.partition, r.offset) for r in rows.select("partition", "offset").collect())


def opened(rows):
    return sorted(tuple(int(x.split("=")[1]) for x in f.split("/") if x.startswith(("partition=", "segment="))) for f in rows.inputFiles())


def test_only_overlapping_files_are_opened(spark, path):
    """One hull over all partitions would read nearly everything."""
    journal = path("journal")
    logs.write_segments(records(spark, 0, 300), journal, 10)
    assert zones.update_zones(spark, journal) == 0 and zones.update_zones(spark, journal) is None
    starts, targets = vector(spark, 85, 0, 50), vector(spark, 100, 12, 50)
    found = zones.read_pruned(spark, journal, starts, targets)
    assert places(found) == [(0, o) for o in range(85, 100)] + [(1, o) for o in range(12)]
    assert opened(found) == [(0, 8), (0, 9), (1, 0), (1, 1)]
    assert {r["rows"] for r in zones.read_zones(spark, journal).collect()} == {10}


def test_files_that_are_not_in_the_map_are_read(spark, path):
    journal = path("journal")
    logs.write_segments(records(spark, 0, 90), journal, 10)
    zones.update_zones(spark, journal)
    logs.write_segments(records(spark, 90, 150), journal, 10)
    starts, targets = vector(spark, 25, 25, 25), vector(spark, 45, 45, 45)
    found = zones.read_pruned(spark, journal, starts, targets)
    assert places(found) == [(p, o) for p in range(3) for o in range(25, 45)]
    assert zones.update_zones(spark, journal) == 1
    again = zones.read_pruned(spark, journal, starts, targets)
    assert places(again) == places(found) and len(again.inputFiles()) == 9
    # Readers of the journal do not see the map.
    assert logs.read_log(spark, journal).count() == 150


def test_many_files_fall_back_to_the_whole_scan(spark, path, monkeypatch):
    journal = path("journal")
    logs.write_segments(records(spark, 0, 90), journal, 5)
    monkeypatch.setattr(zones, "LISTED", 3)
    assert zones.update_zones(spark, journal) == 0
    assert zones.read_zones(spark, journal).count() == 18
    found = zones.read_pruned(spark, journal, vector(spark, 0, 0, 0), vector(spark, 30, 30, 7))
    assert len(places(found)) == 67


def test_many_files_are_mapped_and_read_by_tasks_that_open_no_others(spark, path, monkeypatch):
    """The same map and records as from a scan that names its files; the driver gets no names beyond ``LISTED``."""
    journal = path("journal")
    logs.write_segments(records(spark, 0, 300), journal, 10)
    starts, targets = vector(spark, 85, 3, 50), vector(spark, 100, 12, 50)
    zones.update_zones(spark, journal)
    mapped = sorted(map(tuple, zones.read_zones(spark, journal).collect()))
    named = zones.read_pruned(spark, journal, starts, targets)
    wanted, files = sorted(map(str, named.collect())), sorted(r.file for r in zones.opened_files(named).collect())
    assert len(wanted) == 15 + 9 and len(files) == len(named.inputFiles()) == 4
    storage.remove(spark, f"{journal}/_zones")
    monkeypatch.setattr(zones, "LISTED", 3)
    assert zones.update_zones(spark, journal) == 0
    assert sorted(map(tuple, zones.read_zones(spark, journal).collect())) == mapped
    for file in {r[0] for r in mapped} - set(files):
        with open(file.removeprefix("file:"), "wb") as out:
            out.write(b"no one reads this")
    many = zones.read_pruned(spark, journal, starts, targets)
    assert sorted(map(str, many.collect())) == wanted
    assert sorted(r.file for r in zones.opened_files(many).collect()) == files
    assert not [f for f in many.inputFiles() if f.startswith("file://" + journal)]


def test_files_of_several_partitions_are_mapped_and_read_alike(spark, path, monkeypatch):
    """A table's files have positions as columns, gaps and more records than a task's range of offsets."""
    place = path("table")
    rows = records(spark, 0, 300).filter("offset % 7 <> 3")
    rows.coalesce(2).sortWithinPartitions("offset").write.parquet(place)
    ranges = vector(spark, 20, 0, 50), vector(spark, 55, 12, 50)
    zones.update_zones(spark, place)
    mapped = sorted(map(tuple, zones.read_zones(spark, place).collect()))
    wanted = sorted(map(str, zones.read_pruned(spark, place, *ranges).collect()))
    storage.remove(spark, f"{place}/_zones")
    monkeypatch.setattr(zones, "LISTED", 0)
    monkeypatch.setattr(zones.many_files, "TASK_OFFSETS", 9)
    fresh = zones.read_pruned(spark, place, *ranges)
    assert len(wanted) > 30 and sorted(map(str, fresh.collect())) == wanted
    assert zones.update_zones(spark, place) == 0 and zones.update_zones(spark, place) is None
    assert sorted(map(tuple, zones.read_zones(spark, place).collect())) == mapped
    assert sorted(map(str, zones.read_pruned(spark, place, *ranges).collect())) == wanted


def test_listing_takes_a_few_tasks_a_core(spark, path, monkeypatch):
    monkeypatch.setattr(zones, "LISTING", 1, raising=False)
    journal, context = path("journal"), spark.sparkContext
    logs.write_segments(records(spark, 0, 400), journal, 2)
    most = max(32, context.defaultParallelism)
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    context.setJobGroup("listing", "listing")
    found = zones.list_files(spark, journal)
    tracker = context.statusTracker()
    stages = [s for job in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(job).stageIds]
    assert stages and max(tracker.getStageInfo(s).numTasks for s in stages) <= most
    context.setLocalProperty("spark.jobGroup.id", None)
    assert found.count() > most and spark.conf.get(name) == before


def test_empty_journals_and_ranges(spark, path):
    journal = path("journal")
    assert zones.update_zones(spark, journal) is None
    assert zones.read_pruned(spark, journal, vector(spark, 0), vector(spark, 9)).collect() == []
    logs.write_segments(records(spark, 0, 30), journal, 10)
    zones.update_zones(spark, journal)
    assert zones.read_pruned(spark, journal, vector(spark, 5), vector(spark, 5)).collect() == []


def history(spark, path, first, last):
    for n in range(first, last):
        manifest = {"backup_id": f"run-{n % 4}", "created_at": f"at-{n}"}
        catalogs.commit_catalog(spark, path, manifest, {"generation": n + 1, "chain_id": f"c-{n}"}, n)


def latest(spark, path):
    return sorted(map(tuple, catalog.latest_by_key(catalogs.read_catalog(spark, path)).collect()))


def test_segments_change_nothing_that_is_read(spark, path):
    place = path("catalog")
    assert catalogs.write_delta(spark, place) is None and catalogs.write_base(spark, place) is None
    history(spark, place, 0, 6)
    whole = latest(spark, place)
    assert catalogs.write_delta(spark, place) == 6 and catalogs.write_delta(spark, place) is None
    assert latest(spark, place) == whole
    history(spark, place, 6, 9)
    whole = latest(spark, place)
    assert catalogs.write_base(spark, place) == 6 and catalogs.vacuum_catalog(spark, place) == 0
    assert latest(spark, place) == whole
    catalogs.write_delta(spark, place)
    assert catalogs.write_base(spark, place) == 9 and latest(spark, place) == whole
    # Commits and deltas that the base before covers go; the chain goes on.
    assert catalogs.vacuum_catalog(spark, place) == 7 and latest(spark, place) == whole
    history(spark, place, 9, 11)
    assert catalogs.current_generation(spark, place) == 11
    assert catalogs.read_state(spark, place)["generation"] == 11
    assert len(catalogs.read_catalog(spark, place).inputFiles()) == 3
    with pytest.raises(ViolationError, match="catalog-stale-generation"):
        catalogs.commit_catalog(spark, place, {"backup_id": "x"}, {"generation": 11}, 10)


def test_a_long_tail_of_commits_is_listed_and_not_named(spark, path, monkeypatch):
    place = path("catalog")
    history(spark, place, 0, 4)
    catalogs.write_delta(spark, place)
    history(spark, place, 4, 9)
    whole = latest(spark, place)
    monkeypatch.setattr(catalogs, "NAMED", 2)
    assert latest(spark, place) == whole
    tail = catalogs.read_catalog(spark, place).filter("log_offset > 9").select("log_offset").collect()
    assert sorted(r.log_offset for r in tail) == list(range(10, 20))
    assert catalogs.write_delta(spark, place) == 9 and latest(spark, place) == whole


def test_commits_on_a_mounted_folder_start_no_shells(spark, path, monkeypatch):
    place = path("catalog")
    monkeypatch.setattr(storage, "_fs", lambda *_: pytest.fail("went through Hadoop's local file system"))
    history(spark, place, 0, 3)
    with pytest.raises(ViolationError, match="catalog-stale-generation"):
        history(spark, place, 2, 3)
    assert sorted(os.listdir(f"{place}/commits")) == [f"{n:020d}.json" for n in (1, 2, 3)]


def test_a_folder_without_links_is_published_to_by_renames(spark, path, monkeypatch):
    def refused(*_):
        raise PermissionError("no links here")

    monkeypatch.setattr(os, "link", refused)
    where = f"{path('dir')}/file"
    assert storage.publish_text(spark, where, "first") and not storage.publish_text(spark, where, "second")
    assert storage.read_text(spark, where) == "first" and storage.children(spark, where.rsplit("/", 1)[0]) == ["file"]


def test_unfinished_segments_are_not_read(spark, path):
    place = path("catalog")
    history(spark, place, 0, 5)
    whole = latest(spark, place)
    catalogs.write_delta(spark, place)
    catalogs.write_base(spark, place)
    for kind in ("base", "deltas"):
        os.remove(f"{place}/{kind}/n=5/_SUCCESS")
        assert latest(spark, place) == whole


@pytest.mark.parametrize("seed", range(3))
def test_any_cut_into_segments_gives_the_latest(spark, seed):
    draw = random.Random(seed)
    rows = [(i, draw.choice("abcdef"), None if draw.random() < 0.3 else json.dumps(i)) for i in range(60)]
    records_ = spark.createDataFrame(rows, schemas.CATALOG)
    cuts = sorted(draw.sample(range(60), 4))
    pieces = [catalog.fold_segment(records_.filter((F.col("log_offset") >= a) & (F.col("log_offset") < b))) for a, b in zip([0, *cuts], [*cuts, 60], strict=True)]
    wanted = sorted(map(tuple, catalog.latest_by_key(records_).select("log_offset", "key", "value").collect()))
    empty = records_.limit(0)
    middle = catalog.merge_segments(None, [pieces[2], pieces[1]])
    base = catalog.merge_segments(catalog.merge_segments(empty, pieces[:1]), [middle])
    rest = pieces[3:]
    draw.shuffle(rest)
    got = catalog.merge_segments(base, rest)
    assert sorted(map(tuple, got.collect())) == wanted
    # A delta keeps deletions: without them an older base would show the key again.
    assert pieces[0].count() <= 6 and any(r.value is None for p in pieces for r in p.collect())


@pytest.fixture
def site(spark, path):
    to, archive = target(path), path("archive")
    for n in range(3):
        delivery.append_decoded(records(spark, n * 30, n * 30 + 30), to, f"e-{n}")
    return to, archive


def backup(spark, site, name, offset, parent=None):
    backups.write_backup(spark, site[0].path, "records", USER, vector(spark, offset, offset, offset), site[1], name, parent)


def chain(spark, *rows):
    return spark.createDataFrame(rows, "backup_id STRING, parent_id STRING")


def units(orphans):
    return {(r.reason, r.unit) for r in orphans.collect()}


def test_nothing_reachable_is_an_orphan(spark, site):
    backup(spark, site, "full", 10)
    backup(spark, site, "next", 20, "full")
    manifests = chain(spark, ("full", None), ("next", "full"))
    assert sweep.table_orphans(spark, site[0].path).collect() == []
    assert sweep.archive_orphans(spark, site[1], manifests, manifests.filter("backup_id = 'next'")).collect() == []
    # Of a chain whose root is its first backup only, the later one is closed.
    found = sweep.archive_orphans(spark, site[1], manifests, manifests.filter("backup_id = 'full'"))
    assert units(found) == {("closed-chain", "next")}


def test_leftovers_of_a_table(spark, site, monkeypatch):
    path = site[0].path
    storage.remove(spark, f"{path}/ledger/commit=e-1")
    assert units(sweep.table_orphans(spark, path)) == {("uncommitted-batch", "e-1")}
    compaction.checkpoint_ledger(spark, path)
    compaction.compact(spark, path, USER)
    os.remove(f"{path}/checkpoints/n=0/_SUCCESS")
    os.remove(f"{path}/segments/n=0/batches/_SUCCESS")
    found = sweep.table_orphans(spark, path)
    assert units(found) == {("uncommitted-batch", "e-1"), ("unfinished-checkpoint", "0"), ("unfinished-segment", "0")}
    before = sorted(map(tuple, tables.read_table(spark, path, USER).collect()))
    # Marking removes nothing, and a path outside the roots is left alone.
    assert sweep.sweep(spark, found, [site[1]]) == 0 and len(units(found)) == 3
    assert sweep.sweep(spark, found, [path]) == 3
    assert sweep.table_orphans(spark, path).collect() == []
    assert sorted(map(tuple, tables.read_table(spark, path, USER).collect())) == before and len(before) == 60


def test_grace_period(spark, site):
    path = site[0].path
    storage.remove(spark, f"{path}/ledger/commit=e-1")
    found = sweep.table_orphans(spark, path)
    hour = lambda n: spark.sql(f"SELECT current_timestamp() + INTERVAL '{n}' HOUR AS t").first().t
    assert sweep.settled_since(found, hour(-1)).collect() == []
    time.sleep(0.1)
    assert units(sweep.settled_since(found, hour(1))) == {("uncommitted-batch", "e-1")}


def test_leftovers_of_an_archive(spark, site):
    backup(spark, site, "old", 10)
    backup(spark, site, "open", 20)
    backup(spark, site, "lost", 20)
    backup(spark, site, "dead", 30)
    storage.remove(spark, f"{site[1]}/blocks/backup=dead")
    manifests = chain(spark, ("old", None), ("open", None), ("gone", "old"))
    roots = manifests.filter("backup_id = 'open'")
    found = sweep.archive_orphans(spark, site[1], manifests, roots)
    assert units(found) == {("closed-chain", "old"), ("uncommitted-backup", "lost"), ("unfinished-backup", "dead")}
    assert all(r.files and r.bytes for r in found.collect())
    sweep.sweep(spark, found, [site[1]])
    assert sweep.archive_orphans(spark, site[1], manifests, roots).collect() == []
    assert backups.read_chain(spark, site[1], ["open"], "records", USER).count() == 60
