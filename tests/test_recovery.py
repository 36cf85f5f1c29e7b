"""Backups, chains, restores, replays and follow, end to end."""

import pytest
from pyspark.sql import functions as F

from offsetlake import schemas
from offsetlake.operators import bounds, ledger
from offsetlake.operators.audit import ViolationError
from offsetlake.plans import backup as backup_plan
from offsetlake.plans import copy as copying
from offsetlake.plans import recover as recovery
from offsetlake.sources import backup as backups
from offsetlake.sources import catalog as catalogs
from offsetlake.sources import log as logs
from offsetlake.sources import storage
from offsetlake.sources import table as tables
from offsetlake.streaming import deliver as delivery
from offsetlake.streaming import follow as following
from tests.test_delivery import USER, counts, records, target

TOPIC = "records.input"


def pipelines(spark, partitions=3):
    row = ("records-input", "main", "state", "/ledger/records", "records", TOPIC, partitions)
    return spark.createDataFrame([row], schemas.PIPELINES)


class Site:
    """A table with its log, archive and catalog."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, path
        self.table = target(path)
        self.archive, self.catalog = path("archive"), path("catalog")
        self.high = 0

    def log(self):
        return records(self.spark, 0, self.high)

    def bounds(self):
        return bounds.log_bounds(self.log())

    def produce(self, count, deliver=True):
        start, self.high = self.high, self.high + count
        if deliver:
            delivery.append_decoded(
                records(self.spark, start, self.high), self.table, f"e-{start}"
            )

    def backup(self, run_id, limit=2, **kwargs):
        return backup_plan.run_backup(
            self.spark,
            {"records": self.table.path},
            {"records": USER},
            kwargs.pop("pipelines", pipelines(self.spark)),
            kwargs.pop("bounds", self.bounds()),
            self.archive,
            self.catalog,
            run_id,
            limit,
            verify=kwargs.pop("verify", False),
        )

    def generation(self):
        return catalogs.current_generation(self.spark, self.catalog)

    def request(self, backup_id, targets=None, dest="pitr_records", name="req-1"):
        if targets is not None:
            targets = [(TOPIC, p, o) for p, o in targets]
        row = (name, backup_id, "main", "records", "main", dest, targets)
        fields = {f.name: f.dataType for f in schemas.RECOVERIES.fields}
        fields["targets"] = schemas.T.ArrayType(schemas.OFFSETS)
        rows = self.spark.createDataFrame([row], schemas.struct(**fields))
        return rows.withColumn("targets", F.col("targets").cast(schemas.CHECKPOINT_OFFSETS))

    def recover(self, request, to):
        return recovery.recover(
            self.spark, request, self.catalog, self.archive, self.log(), self.bounds(), USER, to
        )


@pytest.fixture
def site(spark, path):
    return Site(spark, path)


def after(spark, rows, last):
    number = F.substring("record_key", 8, 20).cast("long")
    return rows.filter(number >= last).count()


def test_backup_is_a_cut_while_delivery_goes_on(spark, site, path):
    site.produce(1100)
    site.backup("run-0")
    site.produce(50)
    restored = target(path)
    recovery.restore(spark, site.archive, ["run-0"], "records", USER, restored, "r-1")
    assert counts(spark, restored) == (1100, 1100)
    assert after(spark, tables.read_table(spark, restored.path, USER), 1100) == 0
    assert counts(spark, site.table) == (1150, 1150)


def test_incrementals_roll_over_to_a_new_chain(spark, site, path):
    for i in range(4):
        site.produce(50)
        site.backup(f"run-{i}", verify=i == 2)
    state = catalogs.read_state(spark, site.catalog)
    assert state["chain_id"] == "run-3"
    assert state["incremental_count"] == 0
    assert state["generation"] == 4
    metrics = backups.backup_metrics(spark, site.archive).collect()
    assert {m.backup: m.rows for m in metrics} == {"run-0": 50, "run-1": 50, "run-2": 50, "run-3": 200}
    assert all(m.bytes > 0 and m.files > 0 for m in metrics)
    _, ids = recovery.chain_of(spark, site.catalog, "run-2")
    assert ids == ["run-0", "run-1", "run-2"]
    restored = target(path)
    recovery.restore(spark, site.archive, ids, "records", USER, restored, "r-1")
    assert counts(spark, restored) == (150, 150)
    # The blocks of an increment are exactly the offset range since its parent.
    rows = backups.read_chain(spark, site.archive, ["run-1"], "records", USER)
    low_high = {r.partition: (r.low, r.high) for r in bounds.log_bounds(rows).collect()}
    assert low_high == {0: (17, 34), 1: (17, 33), 2: (16, 33)}


def test_missing_parent_is_refused_and_nothing_changes(spark, site):
    site.produce(30)
    site.backup("run-0")
    state = catalogs.read_state(spark, site.catalog)
    bad = {**state, "generation": 2, "tip": {**state["tip"], "id": "lost"}}
    catalogs.commit_catalog(spark, site.catalog, {"backup_id": "x", "connectors": []}, bad, 1)
    with pytest.raises(ViolationError, match="chain-missing-manifest"):
        site.backup("run-1")
    assert site.generation() == 2
    assert storage.children(spark, f"{site.archive}/data") == ["backup=run-0"]


def test_other_topology_or_lost_log_is_refused(spark, site):
    site.produce(30)
    site.backup("run-0")
    with pytest.raises(ViolationError, match="state-pipelines"):
        site.backup("run-1", pipelines=pipelines(spark, 4))
    gone = spark.createDataFrame([(TOPIC, p, 11, 20) for p in range(3)], schemas.LOG_BOUNDS)
    with pytest.raises(ViolationError, match="replay-expired"):
        site.backup("run-1", bounds=gone)
    assert site.generation() == 1


def test_stale_generation_is_refused(spark, path):
    where = path("catalog")
    commit = lambda run, generation, expected: catalogs.commit_catalog(
        spark, where, {"backup_id": run}, {"generation": generation}, expected
    )
    commit("a", 1, 0)
    with pytest.raises(ViolationError, match="catalog-stale-generation"):
        commit("b", 1, 0)
    with pytest.raises(ViolationError, match="catalog-stale-generation"):
        commit("b", 3, 1)
    commit("b", 2, 1)
    rows = catalogs.read_catalog(spark, where).orderBy("log_offset").collect()
    assert [(r.log_offset, r.key) for r in rows] == [
        (2, "a"), (3, "chain-state"), (4, "b"), (5, "chain-state"),
    ]


def test_publish_does_not_overwrite(spark, path):
    where = f"{path('dir')}/file"
    assert storage.publish_text(spark, where, "first")
    assert not storage.publish_text(spark, where, "second")
    assert storage.read_text(spark, where) == "first"
    assert storage.children(spark, where.rsplit("/", 1)[0]) == ["file"]


def test_point_in_time_and_bad_vectors(spark, site, path):
    site.produce(1100)
    site.backup("run-0")
    site.produce(200)
    full = [(0, 417), (1, 417), (2, 416)]
    to = target(path)
    for bad, rule in [
        (full[:2], "target-missing"),
        ([(0, 434), (1, 434), (2, 433)], "range-target-beyond-end"),
    ]:
        with pytest.raises(ViolationError, match=rule):
            site.recover(site.request("run-0", bad), to)
        assert counts(spark, to) == (0, 0)
    with pytest.raises(ViolationError, match="recovery-same-table"):
        site.recover(site.request("run-0", full, dest="records"), to)
    assert site.recover(site.request("run-0", full), to) == "Complete"
    assert counts(spark, to) == (1250, 1250)
    # The same request again changes nothing; another one is refused.
    assert site.recover(site.request("run-0", full), to) == "Complete"
    assert counts(spark, to) == (1250, 1250)
    with pytest.raises(ViolationError, match="restore-not-empty"):
        site.recover(site.request("run-0", full, name="req-2"), to)
    rows = recovery.point_in_time(
        backups.read_chain(spark, site.archive, ["run-0"], "records", USER),
        site.log(),
        spark.createDataFrame([(TOPIC, 0, 367), (TOPIC, 1, 367), (TOPIC, 2, 366)], schemas.OFFSETS),
        spark.createDataFrame([(TOPIC, p, o) for p, o in full], schemas.OFFSETS),
        USER,
    )
    assert backups.reconcile(tables.read_table(spark, to.path, USER).select(rows.columns), rows).isEmpty()


def test_crashed_restore_starts_again(spark, site, path, monkeypatch):
    site.produce(60)
    site.backup("run-0")
    to = target(path)
    args = (spark, site.archive, ["run-0"], "records", USER, to, "r-1")
    with monkeypatch.context() as patch:
        patch.setattr(tables, "block_ranges", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            recovery.restore(*args)
    assert counts(spark, to) == (0, 0)
    assert recovery.restore(*args)
    assert not recovery.restore(*args)
    assert counts(spark, to) == (60, 60)


def test_unfinished_backup_is_not_restored(spark, site, path):
    with pytest.raises(ViolationError, match="backup-unfinished"):
        recovery.restore(spark, site.archive, ["run-9"], "records", USER, target(path), "r-1")


def test_restore_into_another_schema(spark, site, path):
    site.produce(30)
    site.backup("run-0")
    to = target(path)
    to.schema = schemas.struct(record_key=schemas.STRING, note=schemas.STRING)
    with pytest.raises(ViolationError, match="restore-column-dropped"):
        recovery.restore(spark, site.archive, ["run-0"], "records", USER, to, "r-1")
    recovery.restore(spark, site.archive, ["run-0"], "records", USER, to, "r-1", drop_missing=True)
    rows = tables.read_table(spark, to.path, to.schema)
    assert (rows.count(), rows.filter("note IS NULL").count()) == (30, 30)
    lossy = target(path)
    lossy.schema = schemas.struct(record_key=schemas.LONG, payload=schemas.STRING)
    with pytest.raises(ViolationError, match="restore-value-lost:record_key"):
        recovery.restore(spark, site.archive, ["run-0"], "records", USER, lossy, "r-2")


def test_follow_reaches_the_end_and_keeps_going(spark, site, path):
    site.produce(1200)
    site.backup("run-0")
    to = target(path)
    assert site.recover(site.request("run-0"), to) == "Streaming"
    assert counts(spark, to) == (1200, 1200)
    journal, checkpoint = path("journal"), path("checkpoint")
    logs.write_journal(site.log(), journal, segment=True)
    starts = spark.createDataFrame([(TOPIC, p, 400) for p in range(3)], schemas.OFFSETS)

    def follow():
        stream = logs.read_log(spark, journal, streaming=True)
        query = following.follow(stream, starts, site.bounds(), to, checkpoint)
        query.awaitTermination()

    follow()
    assert counts(spark, to) == (1200, 1200)
    site.produce(60, deliver=False)
    logs.write_journal(records(spark, 1200, 1260), journal, segment=True)
    follow()
    assert counts(spark, to) == (1260, 1260)
    lost = spark.createDataFrame([(TOPIC, p, 421, 430) for p in range(3)], schemas.LOG_BOUNDS)
    with pytest.raises(ViolationError, match="range-start-expired"):
        following.follow(logs.read_log(spark, journal, streaming=True), starts, lost, to, checkpoint)
    behind = spark.createDataFrame([(TOPIC, p, 500) for p in range(3)], schemas.OFFSETS)
    with pytest.raises(ViolationError, match="progress-moved-back"):
        following.follow(
            logs.read_log(spark, journal, streaming=True), behind, site.bounds(), to, checkpoint
        )


def test_bounded_recovery_that_moved_on_is_refused(spark, site):
    site.produce(30)
    at = spark.createDataFrame([(TOPIC, p, 10) for p in range(3)], schemas.OFFSETS)
    following.require_at(site.table, at)
    site.produce(3)
    with pytest.raises(ViolationError, match="recovery-moved-beyond"):
        following.require_at(site.table, at)


def test_replay_with_aborted_tail_stands_at_the_vector(spark, site, path):
    """The last records of the range are aborted: no row, but the vector is reached."""
    site.produce(60)
    site.backup("run-0")
    site.high += 30
    committed = site.log().filter("offset < 25")
    to = target(path)
    recovery.restore(spark, site.archive, ["run-0"], "records", USER, to, "r-1")
    starts = spark.createDataFrame([(TOPIC, p, 20) for p in range(3)], schemas.OFFSETS)
    targets = spark.createDataFrame([(TOPIC, p, 30) for p in range(3)], schemas.OFFSETS)
    following.replay_until(committed, starts, targets, site.bounds(), to, "r-1")
    following.require_at(to, targets)
    assert counts(spark, to) == (75, 75)


def test_backup_never_splits_a_block(spark, site):
    site.produce(60)
    cut = spark.createDataFrame([(TOPIC, p, 10) for p in range(3)], schemas.OFFSETS)
    with pytest.raises(ViolationError, match="backup-splits-block"):
        backups.write_backup(
            spark, site.table.path, "records", USER, cut, site.archive, "run-0"
        )


def test_verify_backup_reports_each_difference(spark, site):
    site.produce(60)
    rows = tables.read_table(spark, site.table.path, USER)
    assert backups.verify_backup(rows, rows).isEmpty()
    changed = rows.withColumn("payload", F.when(F.col("partition") == 1, "y").otherwise(F.col("payload")))
    found = backups.verify_backup(rows, changed.filter("partition <> 2")).collect()
    assert sorted((r.rule, r.subject) for r in found) == [
        ("backup-content", f"{TOPIC}-1"),
        ("backup-content", f"{TOPIC}-2"),
        ("backup-offset-range", f"{TOPIC}-2"),
        ("backup-row-count", f"{TOPIC}-2"),
    ]


def vector(spark, *offsets):
    return spark.createDataFrame([(TOPIC, p, o) for p, o in enumerate(offsets)], schemas.OFFSETS)


def test_copy_resumes_after_a_crash(spark, path, monkeypatch):
    log = records(spark, 0, 300).filter("offset % 7 <> 3")
    limits, dest = bounds.log_bounds(records(spark, 0, 300)), path("copy")
    args = (log, vector(spark, 5, 6, 7), vector(spark, 100, 90, 7), limits, dest, 10, 40)
    saves = []

    def save(*a, original=copying._save):
        if len(saves) == 1:
            raise RuntimeError("lost the driver")
        saves.append(a)
        return original(*a)

    with monkeypatch.context() as patch:
        patch.setattr(copying, "_save", save)
        with pytest.raises(RuntimeError):
            copying.copy_range(*args)
    partial = copying.read_copy(spark, dest)
    assert partial.agg(F.max("source_offset")).collect()[0][0] == 45 - 1
    copying.copy_range(*args)
    copying.copy_range(*args)
    got = {}
    for r in copying.read_copy(spark, dest).collect():
        got.setdefault(r.partition, []).append((r.offset, r.source_offset, r.batch, bytes(r.key)))
    for p, (low, high) in enumerate([(5, 100), (6, 90)]):
        kept = [o for o in range(low, high) if o % 7 != 3]
        assert sorted(got[p]) == [
            (i, o, i // 10, f"record-{o * 3 + p}".encode()) for i, o in enumerate(kept)
        ]
    assert 2 not in got


@pytest.mark.parametrize("most", [100_000, 40, 3])
def test_renumbering_equals_resequencing_without_a_shuffle(spark, path, monkeypatch, most):
    """Few runs are broadcast and records stay in place; beyond the bound they are shuffled."""
    monkeypatch.setattr(bounds, "RUN_SLOT", 16)
    log = records(spark, 0, 300).filter("offset % 23 <> 3 AND NOT (partition = 1 AND offset BETWEEN 20 AND 70)")
    got = bounds.renumber(log, 10, 300, max_rows=most)
    wanted = bounds.resequence(log, 10)
    assert sorted(map(tuple, got.select(*wanted.columns).collect())) == sorted(map(tuple, wanted.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("hashpartitioning" in plan) == (most == 3)


def test_copy_refuses_expired_progress_and_ranges(spark, path):
    log = records(spark, 0, 90)
    limits, dest = bounds.log_bounds(log), path("copy")
    low, high = vector(spark, 0, 0, 0), vector(spark, 20, 20, 20)
    copying.copy_range(log, low, high, limits, dest, 10, 10)
    with pytest.raises(ViolationError, match="copy-outside-range"):
        copying.copy_range(log, low, vector(spark, 15, 20, 20), limits, dest, 10)
    gone = spark.createDataFrame([(TOPIC, p, 5, 30) for p in range(3)], schemas.LOG_BOUNDS)
    with pytest.raises(ViolationError, match="range-start-expired"):
        copying.copy_range(log, low, high, gone, path("copy"), 10)
    for name in storage.children(spark, f"{dest}/progress"):
        fs, where = storage._fs(spark, f"{dest}/progress/{name}")
        fs.delete(where, False)
    with pytest.raises(ViolationError, match="copy-progress-expired"):
        copying.copy_range(log, low, high, limits, dest, 10)


def test_cut_of_two_pipelines_on_one_table(spark, path):
    to = target(path, "a", "b")
    delivery.append_decoded(records(spark, 0, 9, "a").unionByName(records(spark, 0, 4, "b", 1)), to, "e-0")
    feeds = spark.createDataFrame(
        [
            ("one", "main", "s", "/l/a", "t", "a", 3),
            ("two", "main", "s", "/l/b", "t", "b", 2),
        ],
        schemas.PIPELINES,
    )
    from offsetlake.operators.snapshot import barrier_cut

    cut = barrier_cut(tables.read_ledger(spark, to.path), feeds)
    assert sorted((r.connector, r.partition, r.offset) for r in cut.collect()) == [
        ("one", 0, 3), ("one", 1, 3), ("one", 2, 3), ("two", 0, 4), ("two", 1, 0),
    ]
    assert ledger.fold_ledger(tables.read_ledger(spark, to.path)).count() == 4


def test_empty_increment_and_empty_table(spark, site, path):
    """A run with nothing new, over two tables of which one never had a row."""
    site.produce(30)
    idle = target(path, "idle.input")
    both = pipelines(spark).unionByName(
        spark.createDataFrame(
            [("idle", "main", "state", "/ledger/idle", "idle", "idle.input", 1)], schemas.PIPELINES
        )
    )
    limits = site.bounds().unionByName(
        spark.createDataFrame([("idle.input", 0, 0, 0)], schemas.LOG_BOUNDS)
    )
    for run in ("run-0", "run-1"):
        manifest = backup_plan.run_backup(
            spark,
            {"records": site.table.path, "idle": idle.path},
            {"records": USER, "idle": USER},
            both,
            limits,
            site.archive,
            site.catalog,
            run,
            2,
            verify=True,
        )
    assert [o["offset"] for c in manifest["connectors"] for o in c["offsets"]] == [10, 10, 10, 0]
    _, ids = recovery.chain_of(spark, site.catalog, "run-1")
    for name, rows in (("records", 30), ("idle", 0)):
        to = target(path)
        recovery.restore(spark, site.archive, ids, name, USER, to, "r-1")
        assert counts(spark, to) == (rows, rows)
