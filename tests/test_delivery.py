"""Exactly-once delivery under restarts, crashes, lost checkpoints and bad input."""

import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from offsetlake import schemas
from offsetlake.operators import ledger
from offsetlake.operators.audit import ViolationError
from offsetlake.sources import log as logs
from offsetlake.sources import table as tables
from offsetlake.streaming import deliver as delivery

USER = schemas.struct(record_key=schemas.STRING, payload=schemas.STRING)


def records(spark, start, stop, topic="records.input", partitions=3, bad=()):
    """Records ``start`` to ``stop`` spread over partitions, as key and JSON value."""
    rows = []
    for i in range(start, stop):
        text = json.dumps({"record_key": f"record-{i}", "payload": "x" * 64})
        rows.append((topic, i % partitions, i // partitions, f"record-{i}", text[:-1] if i in bad else text))
    return spark.createDataFrame(
        rows, "topic STRING, partition INT, offset LONG, key STRING, value STRING"
    ).select(
        "topic",
        "partition",
        "offset",
        F.col("key").cast("binary").alias("key"),
        F.col("value").cast("binary").alias("value"),
        F.lit("2024-01-01").cast("timestamp").alias("timestamp"),
        F.lit(None).cast(schemas.HEADERS).alias("headers"),
    )


def run(spark, journal, targets, checkpoint, **options):
    stream = logs.read_log(spark, journal, streaming=True, max_files=3)
    delivery.deliver(stream, targets, checkpoint, **options).awaitTermination()


def counts(spark, target):
    rows = tables.read_table(spark, target.path, USER)
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("record_key").alias("d")).collect()[0]
    return found.n, found.d


def target(path, *topics, **kwargs):
    return delivery.Target(path("table"), USER, topics or ("records.input",), **kwargs)


def test_thousand_records_three_restarts(spark, path):
    to, journal, checkpoint = target(path), path("journal"), path("checkpoint")
    for step in range(4):
        logs.write_journal(records(spark, step * 250, step * 250 + 250), journal, segment=True)
        run(spark, journal, [to], checkpoint)
    run(spark, journal, [to], checkpoint)
    assert counts(spark, to) == (1000, 1000)


def test_crash_between_data_and_ledger(spark, path, monkeypatch):
    to, journal, checkpoint = target(path), path("journal"), path("checkpoint")
    logs.write_journal(records(spark, 0, 90), journal, segment=True)
    run(spark, journal, [to], checkpoint)
    logs.write_journal(records(spark, 90, 150), journal, segment=True)

    def crash(*_):
        raise RuntimeError("lost the driver")

    with monkeypatch.context() as patch:
        patch.setattr(tables, "write_ledger", crash)
        with pytest.raises(StreamingQueryException):
            run(spark, journal, [to], checkpoint)
    # The data of the failed batch is there, but no reader sees it.
    assert tables.read_data(spark, to.path, USER).count() == 150
    assert counts(spark, to) == (90, 90)
    run(spark, journal, [to], checkpoint)
    assert counts(spark, to) == (150, 150)


def test_crash_after_ledger_before_checkpoint(spark, path):
    """Spark calls the batch again; its ledger row makes that a no-op."""
    to = target(path)
    assert delivery.append_decoded(records(spark, 0, 30), to, "e-0")
    assert not delivery.append_decoded(records(spark, 0, 30), to, "e-0")
    assert counts(spark, to) == (30, 30)


def test_lost_checkpoint_replays_nothing_twice(spark, path, monkeypatch):
    to, journal = target(path), path("journal")
    logs.write_journal(records(spark, 0, 60), journal, segment=True)
    run(spark, journal, [to], path("checkpoint"))
    logs.write_journal(records(spark, 60, 100), journal, segment=True)
    second = path("checkpoint")
    with monkeypatch.context() as patch:
        patch.setattr(tables, "write_ledger", lambda *_: 1 / 0)
        with pytest.raises(StreamingQueryException):
            run(spark, journal, [to], second)
    # The new checkpoint also crashed once; the floor must still hold on its retry.
    run(spark, journal, [to], second)
    assert counts(spark, to) == (100, 100)
    offsets = tables.read_table(spark, to.path, USER).select("partition", "offset")
    assert offsets.distinct().count() == 100


def test_moved_back_input_is_refused(spark, path):
    to = target(path)
    delivery.append_decoded(records(spark, 30, 60), to, "e-0")
    with pytest.raises(ViolationError, match="delivery-moved-back"):
        delivery.append_decoded(records(spark, 0, 30), to, "e-1")
    assert counts(spark, to) == (30, 30)


def test_dead_letters(spark, path):
    to = target(path)
    delivery.append_decoded(records(spark, 0, 30, bad={4, 29}), to, "e-0")
    assert counts(spark, to) == (28, 28)
    letters = {r.offset: r for r in tables.read_dead_letters(spark, to.path).collect()}
    assert set(letters) == {4 // 3, 29 // 3}
    context = {h.key: bytes(h.value).decode() for h in letters[9].headers}
    assert context == {
        "error.topic": "records.input",
        "error.partition": "2",
        "error.offset": "9",
        "error.message": "payload is not valid",
    }
    assert bytes(letters[9].key) == b"record-29"
    # The ledger covers dead letters, so a replay does not report them again.
    assert tables.folded_ends(spark, to.path)["records.input", 2] == 9


def test_dead_letters_without_context_or_disabled(spark, path):
    to = target(path)
    delivery.append_decoded(records(spark, 0, 9, bad={4}), to, "e-0", context=False)
    assert tables.read_dead_letters(spark, to.path).collect()[0].headers == []
    off = target(path)
    delivery.append_decoded(records(spark, 0, 9, bad={4}), off, "e-0", dead_letters=False)
    assert counts(spark, off) == (8, 8)
    assert tables.read_dead_letters(spark, off.path).count() == 0


def test_tolerance_none_fails_the_batch(spark, path):
    to = target(path)
    with pytest.raises(ViolationError, match="delivery-bad-record"):
        delivery.append_decoded(records(spark, 0, 9, bad={4}), to, "e-0", tolerance="none")
    assert counts(spark, to) == (0, 0)
    with pytest.raises(ValueError, match="tolerance"):
        delivery.append_decoded(records(spark, 0, 9), to, "e-0", tolerance="some")


def test_several_topics_and_tables(spark, path):
    both, other, journal = target(path, "a", "b"), target(path, "c"), path("journal")
    for topic in "abcd":
        logs.write_journal(records(spark, 0, 12, topic), journal, segment=True)
    run(spark, journal, [both, other], path("checkpoint"))
    assert counts(spark, both) == (24, 12)
    assert counts(spark, other) == (12, 12)


def test_reserved_columns_are_refused():
    with pytest.raises(ValueError, match="reserved"):
        tables.table_schema(schemas.struct(Offset=schemas.LONG))


@pytest.mark.parametrize(
    ("text", "bad"),
    [
        ('{"a": 1, "b": "x"}', False),
        ('{"b": "x"}', False),
        ('{"a": null}', False),
        ('{"a": 1, "extra": 2}', False),
        ('{"a": "one"}', True),
        ("[1]", True),
        ("text", True),
        ("", True),
        (None, True),
    ],
)
def test_decode(spark, text, bad):
    row = spark.createDataFrame([(text,)], "value STRING")
    user = schemas.struct(a=schemas.INT, b=schemas.STRING)
    found = logs.decode_json(row, user).collect()[0]
    assert (found._error is not None) == bad
    assert (found.row is None) == bad


def test_fold_does_not_trust_batch_ids(spark, path):
    to = target(path)
    delivery.append_decoded(records(spark, 0, 30), to, "z-9")
    delivery.append_decoded(records(spark, 30, 60), to, "a-0")
    folded = ledger.fold_ledger(tables.read_ledger(spark, to.path))
    assert {r.partition: (r.max_offset, r.batch_id) for r in folded.collect()} == {
        p: (19, "a-0") for p in range(3)
    }


def test_kafka_vector_json():
    text = logs.kafka_offsets([("b", 0, 3), ("a", 1, 2), ("a", 0, 1)])
    assert json.loads(text) == {"a": {"0": 1, "1": 2}, "b": {"0": 3}}
