import random
import re

import pytest

from offsetlake.llm import mixing
from tests.llm.hard import documents, hard_rows


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes, cap=3):
    """Raise the excess of capped sources on the others until none is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        level = rest / sum(weight[s] for s in free) if free else 0
        over = {s: cap * sizes[s] for s in free if weight[s] * level > cap * sizes[s] + 1e-9}
        if not over:
            return {**capped, **{s: weight[s] * level for s in free}}
        capped.update(over)


def brute_seats(votes, seats):
    """Sainte-Laguë, one seat after the other."""
    got = [0] * len(votes)
    for _ in range(seats):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
        got[best] += 1
    return got


def test_apportion_equals_one_seat_after_the_other(spark):
    draw = random.Random(1)
    for case in range(6):
        groups = {g: [draw.choice([0, 1, 7, draw.randint(0, 10**6)]) for _ in range(draw.randint(1, 9))] for g in "xy"}
        seats = {g: draw.choice([0, 1, 5, 200]) for g in groups}
        if case == 0:
            groups, seats = {"x": [5, 5, 5, 5], "y": [1]}, {"x": 6, "y": 3}
        rows = [(g, i, v, seats[g]) for g, votes in groups.items() for i, v in enumerate(votes)]
        frame = spark.createDataFrame(rows, "g string, i int, v long, seats long")
        got = {(r.g, r.i): r.quota for r in mixing.apportion(frame, ["g"], "i", "v", "seats").collect()}
        for g, votes in groups.items():
            wanted = brute_seats(votes, seats[g]) if sum(votes) else [0] * len(votes)
            assert [got[g, i] for i in range(len(votes))] == wanted, (groups, seats)


def test_targets_equal_the_loop_over_all_sources(spark):
    sizes = {"a": 1000, "b": 3, "c": 40, "d": 0, None: 500}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_mix_meets_its_targets(spark):
    draw = random.Random(2)
    rows = [
        (i, "w " * draw.choice([1, 20, 300, 900]), "en", draw.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(400)
    ]
    frame = documents(spark, rows).repartition(3)
    got = mixing.mix(frame, shard_words=20_000).collect()
    sizes = {}
    for row in rows:
        sizes[row[3]] = sizes.get(row[3], 0) + words(row[1])
    target = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    assert sorted(r.doc_id for r in got) == list(range(400))
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r["size"] and r.copies <= 3
        taken[r.source] += r.taken
    for source, words_taken in taken.items():
        shards = -(-sizes[source] // 20_000)
        assert abs(words_taken - target[source]) <= 3 * mixing.BLOCK * (shards + 1)
    again = mixing.mix(frame.repartition(7), shard_words=20_000).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_hard_rows(spark):
    frame = documents(spark, hard_rows())
    got = mixing.mix(frame).collect()
    assert len(got) == len(hard_rows())
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
    mixed = mixing.mixed_documents(frame)
    assert mixed.columns == frame.columns
    copies = {}
    for r in got:
        copies[r.doc_id, r.source] = copies.get((r.doc_id, r.source), 0) + r.copies
    found = {}
    for r in mixed.collect():
        assert words(r.text) > 0
        found[r.doc_id, r.source] = found.get((r.doc_id, r.source), 0) + 1
    assert found == {k: n for k, n in copies.items() if n}


def test_empty(spark):
    frame = documents(spark, [])
    assert mixing.mix(frame).collect() == []
    assert mixing.mixed_documents(frame).collect() == []


def test_documents_without_words_are_in_no_window(spark):
    """A source that is nearly all empty texts: one row of its few shards' windows per text with words."""
    full = [(i, "some words of a text " * (1 + i % 5), "en", "abc"[i % 3]) for i in range(60)]
    bare = [(1000 + i, None if i % 2 else " \n", "en", "a") for i in range(3000)]
    want = {r.doc_id: r.asDict() for r in mixing.mix(documents(spark, full)).collect()}
    mixed = mixing.mix(documents(spark, full + bare))
    got = {r.doc_id: r.asDict() for r in mixed.collect()}
    assert {k: v for k, v in got.items() if k < 1000} == want
    assert all((v["taken"], v["copies"], v["size"]) == (0, 0, 0) for k, v in got.items() if k >= 1000) and len(got) == 3060
    assert all(v["source_size"] == want[0]["source_size"] for k, v in got.items() if k >= 1000)
    plan = mixed._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Window [sum(") :].split("Union")[0]
    assert "(_size" in below and "> 0)" in below
