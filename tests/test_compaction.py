"""Ledger checkpoints, segments and vacuum: no step, and no crash between steps, changes what is read."""

import glob
import os

import pytest

from offsetlake.operators.audit import ViolationError
from offsetlake.sources import compaction, storage
from offsetlake.sources import table as tables
from offsetlake.streaming import deliver as delivery
from tests.test_delivery import USER, records, target


def append(spark, to, first, last, size=6):
    """Batches of few records, each with a bad one."""
    for n in range(first, last):
        delivery.append_decoded(records(spark, n * size, n * size + size, bad=[n * size + 1]), to, f"e-{n}")


def view(spark, to):
    rows = sorted(map(tuple, tables.read_table(spark, to.path, USER).collect()))
    letters = sorted((r.topic, r.partition, r.offset, bytes(r.value), r.batch_id) for r in tables.read_dead_letters(spark, to.path).collect())
    return rows, letters, sorted(map(tuple, tables.read_ledger(spark, to.path).collect()))


def names(to, kind):
    return sorted(os.path.basename(p) for p in glob.glob(f"{to.path}/{kind}/*") if not os.path.basename(p).startswith("_"))


def test_every_step_leaves_the_view(spark, path):
    to = target(path)
    append(spark, to, 0, 3)
    whole = view(spark, to)
    assert len(whole[0]) == 15 and len(whole[1]) == 3 and len(whole[2]) == 9
    assert compaction.checkpoint_ledger(spark, to.path) == 0 and view(spark, to) == whole
    assert compaction.checkpoint_ledger(spark, to.path) is None
    assert compaction.compact(spark, to.path, USER) == 0 and view(spark, to) == whole
    assert compaction.compact(spark, to.path, USER) is None
    # One generation is kept for readers that listed it.
    assert compaction.vacuum(spark, to.path) == 0 and len(names(to, "ledger")) == 3
    append(spark, to, 3, 5)
    whole = view(spark, to)
    assert len(whole[0]) == 25
    assert compaction.checkpoint_ledger(spark, to.path) == 1 and compaction.compact(spark, to.path, USER) == 1
    assert view(spark, to) == whole
    assert compaction.vacuum(spark, to.path) == 6
    assert view(spark, to) == whole
    assert names(to, "ledger") == ["commit=e-3", "commit=e-4"] and names(to, "data") == ["batch_id=e-3", "batch_id=e-4"]
    # What was folded is still committed, and is not written again.
    assert tables.is_committed(spark, to.path, "e-0") and not tables.is_committed(spark, to.path, "e-9")
    assert not delivery.append_decoded(records(spark, 0, 6), to, "e-0")
    assert tables.folded_ends(spark, to.path) == {("records.input", p): 9 for p in range(3)}
    assert view(spark, to) == whole


def test_crashes_leave_the_old_view(spark, path, monkeypatch):
    to = target(path)
    append(spark, to, 0, 3)
    whole = view(spark, to)
    real = storage.overwriting

    def dies(at):
        count = [0]

        def writer(rows):
            count[0] += 1
            if count[0] == at:
                raise RuntimeError("lost the driver")
            return real(rows)

        return writer

    for step, writes in ((lambda: compaction.checkpoint_ledger(spark, to.path), 1), (lambda: compaction.compact(spark, to.path, USER), 2)):
        for at in range(1, writes + 1):
            with monkeypatch.context() as patch:
                patch.setattr(storage, "overwriting", dies(at))
                with pytest.raises(RuntimeError):
                    step()
            assert view(spark, to) == whole
        assert step() == 0 and view(spark, to) == whole
    # A vacuum that dies half way leaves the rest for the next one.
    append(spark, to, 3, 5)
    compaction.checkpoint_ledger(spark, to.path)
    compaction.compact(spark, to.path, USER)
    whole, gone = view(spark, to), []
    with monkeypatch.context() as patch:
        delete = storage.remove
        patch.setattr(storage, "remove", lambda s, p: gone.append(p) or (delete(s, p) if len(gone) < 4 else 1 / 0))
        with pytest.raises(ZeroDivisionError):
            compaction.vacuum(spark, to.path)
    assert view(spark, to) == whole
    assert compaction.vacuum(spark, to.path) == 3 and view(spark, to) == whole


def test_files_of_an_unfinished_checkpoint_are_not_read(spark, path):
    to = target(path)
    append(spark, to, 0, 2)
    compaction.checkpoint_ledger(spark, to.path)
    whole = view(spark, to)
    append(spark, to, 2, 3)
    compaction.checkpoint_ledger(spark, to.path)
    os.remove(storage_path(f"{to.path}/checkpoints/n=1/_SUCCESS"))
    assert tables.complete(spark, f"{to.path}/checkpoints") == [0]
    assert len(view(spark, to)[2]) == len(whole[2]) + 3


def storage_path(path):
    return path.removeprefix("file:")


def test_uncommitted_batches_are_never_merged(spark, path):
    to = target(path)
    append(spark, to, 0, 3)
    storage.remove(spark, f"{to.path}/ledger/commit=e-1")
    whole = view(spark, to)
    assert compaction.compact(spark, to.path, USER) == 0 and view(spark, to) == whole
    assert {r.batch_id for r in tables.segment_batches(spark, to.path, [0]).collect()} == {"e-0", "e-2"}


def test_a_segment_that_differs_from_the_ledger_is_refused(spark, path):
    to = target(path)
    append(spark, to, 0, 2)
    for file in glob.glob(f"{storage_path(to.path)}/data/batch_id=e-0/dead=1/*"):
        os.remove(file)
    with pytest.raises(ViolationError, match="segment-differs-from-ledger"):
        compaction.compact(spark, to.path, USER)
    assert tables.complete(spark, f"{to.path}/segments", "batches/_SUCCESS") == []


def test_large_batches_stay_where_they_are(spark, path):
    to = target(path)
    append(spark, to, 0, 3)
    delivery.append_decoded(records(spark, 18, 60), to, "e-3")
    assert sorted(r.batch_id for r in compaction.small_batches(spark, to.path, 10).collect()) == ["e-0", "e-1", "e-2"]
    whole = view(spark, to)
    compaction.compact(spark, to.path, USER, most_rows=10, segment_rows=4)
    assert view(spark, to) == whole


def test_thousands_of_commits_become_one_listing(spark, path):
    """After two checkpoints a reader lists one of them and the tail."""
    table = path()
    rows = [("t", n % 3, n, n, 1, "AFTER_PROCESSING", f"e-{n}", f"e-{n}") for n in range(5000)]
    from offsetlake.sources.table import COMMITTED

    spark.createDataFrame(rows, COMMITTED).repartition(8).write.partitionBy("commit").parquet(f"{table}/ledger")
    assert compaction.checkpoint_ledger(spark, table) == 0
    tables.write_ledger(spark, table, "e-tail", [("t", 0, 5001, 5001, 1, "AFTER_PROCESSING", "e-tail")])
    assert compaction.checkpoint_ledger(spark, table) == 1
    assert compaction.vacuum(spark, table) == 5000
    assert [n for n in storage.children(spark, f"{table}/ledger") if n.startswith("commit")] == ["commit=e-tail"]
    assert tables.read_ledger(spark, table).count() == 5001
    files = tables.read_commits(spark, table).inputFiles()
    assert len(files) == 2
