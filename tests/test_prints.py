"""Stored fingerprint trees: only what differs is read, and entries survive crashes."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from offsetlake.operators.audit import ViolationError, diff_rows
from offsetlake.sources import prints, storage
from offsetlake.sources import table as tables
from offsetlake.streaming import deliver as delivery
from tests.test_delivery import USER, records, target


def pair(spark, path, change=lambda batch, rows: rows, batches=4):
    left, right = target(path), target(path)
    for n in range(batches):
        rows = records(spark, n * 60, n * 60 + 60)
        delivery.append_decoded(rows, left, f"e-{n}")
        delivery.append_decoded(change(n, rows), right, f"e-{n}")
    return left, right


def plain(rows):
    return sorted(map(str, rows.collect()))


def full(spark, left, right):
    return plain(diff_rows(*(tables.read_table(spark, to.path, USER).drop("batch_id") for to in (left, right))))


def test_equal_tables_read_no_rows(spark, path, monkeypatch):
    left, right = pair(spark, path)
    for to in (left, right):
        assert prints.update_prints(spark, to.path, USER, 5) == 0
        assert prints.update_prints(spark, to.path, USER, 5) is None
    monkeypatch.setattr(tables, "read_data", lambda *_: pytest.fail("rows were read"))
    assert prints.diff_tables(spark, left.path, right.path, USER, 5).collect() == []


def test_only_batches_with_differences_are_read(spark, path):
    left, right = pair(spark, path, lambda n, rows: rows.filter(~((F.col("offset") == 47) & (F.col("partition") == 1))) if n == 2 else rows)
    for to in (left, right):
        prints.update_prints(spark, to.path, USER, 5)
    slots = prints.differing(*(prints.leaves(spark, to.path, USER, 5) for to in (left, right)))
    assert [tuple(r) for r in slots.collect()] == [("records.input", 1, 9, 5, 4)]
    expected = full(spark, left, right)
    for to in (left, right):
        for other in Path(to.path, "data").glob("batch_id=e-[013]/dead=0/*.parquet"):
            other.write_bytes(b"unreadable")
    assert plain(prints.diff_tables(spark, left.path, right.path, USER, 5)) == expected != []


def test_changed_values_and_moved_rows_are_found(spark, path):
    """Same counts on both sides: a changed payload, and two records that swap their values."""
    swap = F.when(F.col("offset") == 3, F.lit(6)).when(F.col("offset") == 6, F.lit(3)).otherwise(F.col("offset")).cast("long")
    broken = F.when(F.col("offset") == 70, F.lit(b'{"record_key": "x", "payload": null}')).otherwise(F.col("value"))
    left, right = pair(spark, path, lambda n, rows: rows.withColumns({"offset": swap, "value": broken}))
    expected = full(spark, left, right)
    assert len(expected) == 18  # three partitions, three places, two sides
    for bucket in (1, 5, 1000):
        assert plain(prints.diff_tables(spark, left.path, right.path, USER, bucket)) == expected


def test_batches_may_be_cut_differently(spark, path):
    left, right = target(path), target(path)
    delivery.append_decoded(records(spark, 0, 90), left, "a")
    for n in range(3):
        delivery.append_decoded(records(spark, n * 30, n * 30 + 30), right, f"b-{n}")
        prints.update_prints(spark, right.path, USER, 4)
    assert prints.diff_tables(spark, left.path, right.path, USER, 4).collect() == []


def test_uncommitted_rows_and_unfinished_entries_do_not_count(spark, path):
    left, right = pair(spark, path, batches=2)
    assert prints.update_prints(spark, left.path, USER, 5) == 0
    entry = f"{prints._path(left.path, USER, 5)}/n=0"
    storage.remove(spark, f"{entry}/_SUCCESS")
    assert prints.diff_tables(spark, left.path, right.path, USER, 5).collect() == []
    assert prints.update_prints(spark, left.path, USER, 5) == 0
    delivery.append_decoded(records(spark, 120, 150), left, "e-lost")
    storage.remove(spark, f"{left.path}/ledger/commit=e-lost")
    assert prints.diff_tables(spark, left.path, right.path, USER, 5).collect() == []


def test_one_side_only_and_no_table(spark, path):
    left, right = pair(spark, path, lambda n, rows: rows.filter("partition = 0"), batches=1)
    assert plain(prints.diff_tables(spark, left.path, right.path, USER)) == full(spark, left, right)
    with pytest.raises(ViolationError, match="prints-no-table"):
        prints.diff_tables(spark, left.path, path(), USER)
