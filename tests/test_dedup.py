"""Block deduplication against the serial rule."""

import random

import pytest

from offsetlake.operators import dedup

SCHEMA = "`table` STRING, seq LONG, topic STRING, partition INT, offset LONG, v STRING"


def serial(attempts, window):
    kept, recent = set(), {}
    for table, seq, block in sorted(attempts, key=lambda a: a[1]):
        seen = recent.setdefault(table, [])
        if block not in seen[-window:]:
            seen.append(block)
            kept.add((table, seq))
    return kept


@pytest.mark.parametrize(("window", "bucket", "seed"), [(1, 7, 0), (3, 1000, 1), (5, 10, 2), (40, 5, 3)])
def test_equals_serial_fold(spark, window, bucket, seed):
    rng = random.Random(seed)
    attempts = []
    for seq in range(70):
        block = 0 if rng.random() < 0.33 else rng.randrange(12)
        attempts.append((rng.choice("ab") if seed % 2 else "a", seq, block))
    rows = [
        (table, seq, "t", 0, block * 10 + i, f"v{block}")
        for table, seq, block in attempts
        for i in range(2)
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    blocks = dedup.block_ids(frame, ["table", "seq"], ["v"])
    accepted = dedup.accepted_blocks(blocks, window, bucket=bucket)
    assert {(r.table, r.seq) for r in accepted.collect()} == serial(attempts, window)


@pytest.mark.parametrize(("window", "blocks"), [(1, 2), (2, 3), (3, 3)])
def test_alternating_retries_take_a_bounded_number_of_rounds(spark, monkeypatch, window, blocks):
    """Retries at the edge of the window: each round of refinement would settle one of them."""
    rng = random.Random(window)
    attempts = [("ab"[i % 2], i, rng.randrange(100, 999) if rng.random() < 0.2 else (i // 2) % blocks) for i in range(160)]
    rows = [(t, s, "t", 0, b, f"v{b}") for t, s, b in attempts]
    frame = dedup.block_ids(spark.createDataFrame(rows, SCHEMA), ["table", "seq"], ["v"])
    steps = []
    monkeypatch.setattr(dedup, "written", lambda rows, name, original=dedup.written: steps.append(name) or original(rows, name))
    for rounds in (0, 2, dedup.ROUNDS):
        steps.clear()
        accepted = dedup.accepted_blocks(frame, window, bucket=9, rounds=rounds)
        assert {(r.table, r.seq) for r in accepted.collect()} == serial(attempts, window)
        assert len(steps) <= 1 + rounds


def test_equal_records_in_other_blocks_stay(spark):
    """Same position range but other content is another block; equal rows inside one both stay."""
    rows = [("a", 0, "t", 0, 5, "x"), ("a", 1, "t", 0, 5, "y"), ("a", 2, "t", 0, 5, "x")]
    rows += [("a", 3, "t", 0, 9, "x"), ("a", 3, "t", 0, 9, "x")]
    kept = dedup.dedup_blocks(spark.createDataFrame(rows, SCHEMA), ["table", "seq"], ["v"], 10)
    assert sorted((r.seq, r.v) for r in kept.collect()) == [(0, "x"), (1, "y"), (3, "x"), (3, "x")]


def test_stream_equals_serial_fold(spark, path):
    """Blocks arrive in four micro-batches; the window reaches over their borders."""
    from offsetlake.streaming.dedup import stream_accepted_blocks

    rng = random.Random(9)
    attempts = [(rng.choice("ab"), seq, rng.randrange(9)) for seq in range(80)]
    source, out = path("attempts"), path("accepted")
    for start in range(0, 80, 20):
        rows = [(t, s, "t", 0, b, f"v{b}") for t, s, b in attempts[start : start + 20]]
        blocks = dedup.block_ids(spark.createDataFrame(rows, SCHEMA), ["table", "seq"], ["v"])
        blocks.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(blocks.schema).parquet(source)
        query = (
            stream_accepted_blocks(stream, 4)
            .writeStream.option("checkpointLocation", f"{out}-checkpoint")
            .trigger(availableNow=True)
            .start(out)
        )
        query.awaitTermination()
    got = {(r.table, r.seq) for r in spark.read.parquet(out).collect()}
    assert got == serial(attempts, 4)


@pytest.mark.parametrize("cut", [0, 33])
def test_a_stream_that_begins_with_a_batch_equals_one_batch(spark, path, cut):
    """The batch hands its window over; the state of the stream is the window at the end."""
    from offsetlake.streaming import dedup as streams

    rng = random.Random(4)
    attempts = [(rng.choice("ab"), seq, rng.randrange(9)) for seq in range(70)]
    rows = [(t, s, "t", 0, b, f"v{b}") for t, s, b in attempts]
    blocks = dedup.block_ids(spark.createDataFrame(rows, SCHEMA), ["table", "seq"], ["v"])
    accepted = dedup.accepted_blocks(blocks.filter(f"seq < {cut}"), 4)
    source, out = path("attempts"), path("accepted")
    blocks.filter(f"seq >= {cut}").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(blocks.schema).parquet(source)
    query = (
        streams.stream_accepted_blocks(stream, 4, initial=streams.handed_over(accepted, 4))
        .writeStream.option("checkpointLocation", f"{out}-checkpoint")
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    got = {(r.table, r.seq) for r in accepted.collect()} | {(r.table, r.seq) for r in spark.read.parquet(out).collect()}
    wanted = serial(attempts, 4)
    assert got == wanted
    of = {seq: block for _, seq, block in attempts}
    state = streams.window_state(spark, f"{out}-checkpoint").collect()
    for table in "ab":
        held = [r.identity.split("/")[2] for r in sorted(state, key=lambda r: r.number) if r.table == table]
        assert held == [str(of[s]) for t, s in sorted(wanted, key=lambda x: x[1]) if t == table][-4:]
    assert streams.audit_window(spark, f"{out}-checkpoint", 4).collect() == []
    assert {r.rule for r in streams.audit_window(spark, f"{out}-checkpoint", 3).collect()} == {"window-too-large"}
