"""Leases against a direct simulation of the token store."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from offsetlake import schemas
from offsetlake.operators import lease

T0 = datetime(2024, 1, 1)
TTL = 60


def events(spark, rows):
    full = [(t, c, e, (T0 + timedelta(seconds=s)).replace(tzinfo=UTC)) for t, c, e, s in rows]
    return spark.createDataFrame(full, schemas.LEASE_EVENTS)


def at(column):
    return (F.unix_micros(column) / 1e6 - T0.replace(tzinfo=UTC).timestamp()).alias(column)


def sessions(spark, rows):
    found = lease.lease_sessions(events(spark, rows), TTL)
    return sorted(
        (r.token, tuple(r.connectors), r.start, r.end, r.ended_by)
        for r in found.select("token", "connectors", at("start"), at("end"), "ended_by").collect()
    )


def simulate(rows):
    lives = {}
    for token, connectors, event, s in sorted(rows, key=lambda r: r[3]):
        if event == "pause" and token not in lives:
            lives[token] = [tuple(connectors), s, s + TTL, None]
        elif token in lives and lives[token][3] is None:
            life = lives[token]
            if s >= life[2]:
                life[3] = "expired"
            elif event == "renew":
                life[2] = s + TTL
            elif event == "resume":
                life[2], life[3] = s, "resumed"
    return sorted((t, c, s, e, how or "expired") for t, (c, s, e, how) in lives.items())


@pytest.mark.parametrize("gap", [TTL - 1, TTL, TTL + 1])
def test_renewal_at_expiry_is_refused(spark, gap):
    rows = [("a", ["c"], "pause", 7), ("a", ["c"], "renew", 7 + gap)]
    end = 7 + TTL if gap >= TTL else 7 + gap + TTL
    assert sessions(spark, rows) == [("a", ("c",), 7, end, "expired")]


def test_refused_renewals_do_not_revive(spark):
    rows = [("a", ["c"], "pause", 0), ("a", ["c"], "renew", 200), ("a", ["c"], "renew", 210)]
    assert sessions(spark, rows) == [("a", ("c",), 0, TTL, "expired")]


def test_unknown_tokens_have_no_lease(spark):
    assert sessions(spark, [("a", ["c"], "renew", 0), ("b", ["c"], "resume", 1)]) == []


@pytest.mark.parametrize("seed", range(3))
def test_sessions_intervals_and_holders_by_simulation(spark, seed):
    rng = random.Random(seed)
    rows = []
    for token in range(40):
        s = rng.randrange(1500)
        connectors = rng.sample("uvwxyz", rng.randrange(1, 4))
        rows.append((f"t{token}", connectors, "pause", s))
        for _ in range(rng.randrange(200 if token == 0 else 8)):
            s += rng.choice([1, 5, 30, TTL - 1, TTL, TTL + 30, 300])
            rows.append((f"t{token}", connectors, rng.choice(["renew"] * 6 + ["resume"]), s))
    want = simulate(rows)
    assert sessions(spark, rows) == want

    merged = []
    for connector in "uvwxyz":
        spans = sorted((s, e) for _, cs, s, e, _ in want if connector in cs and s < e)
        for s, e in spans:
            if merged and merged[-1][0] == connector and s <= merged[-1][2]:
                merged[-1][2] = max(merged[-1][2], e)
            else:
                merged.append([connector, s, e])
    lives = lease.lease_sessions(events(spark, rows), TTL)
    for bucket in (10, 3600):
        held = lease.held_intervals(lives, bucket).select("connector", at("start"), at("end"))
        assert sorted(map(list, held.collect())) == sorted(merged)

    now = 700
    present = [w for w in want if w[2] <= now and not (w[4] == "resumed" and w[3] <= now)]
    holders = sorted(
        (
            t,
            c,
            e > now,
            not any(o[0] != t and c in o[1] and o[3] > now for o in present),
        )
        for t, cs, _, e, _ in present
        for c in cs
    )
    instant = (T0 + timedelta(seconds=now)).strftime("%Y-%m-%d %H:%M:%S")
    assert sorted(map(tuple, lease.holders_at(lives, instant).collect())) == holders


def test_stream_equals_batch(spark, path):
    """Events arrive in four batches; the last, far later one lets every lease run out."""
    rng = random.Random(5)
    rows = []
    for token in range(12):
        s = rng.randrange(400)
        connectors = rng.sample("uvw", 2)
        rows.append((f"t{token}", connectors, "pause", s))
        for _ in range(rng.randrange(12)):
            s += rng.choice([1, 20, TTL - 1, TTL, 90])
            rows.append((f"t{token}", connectors, rng.choice(["renew"] * 5 + ["resume"]), s))
    parts = [[r for r in rows if low <= r[3] < low + 300] for low in range(0, 1500, 300)]
    assert streamed(spark, path, parts, "10 seconds") == simulate(rows)


def streamed(spark, path, parts, delay):
    """Sessions of events that arrive in these micro-batches, and a far later one."""
    from offsetlake.streaming.leases import stream_sessions

    source, out = path("events"), path("out")
    for part in [*parts, [("late", ["u"], "pause", 10_000)]]:
        if part:
            events(spark, part).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(schemas.LEASE_EVENTS).parquet(source)
            query = (
                stream_sessions(stream, TTL, delay)
                .writeStream.option("checkpointLocation", f"{out}-checkpoint")
                .trigger(availableNow=True)
                .start(out)
            )
            query.awaitTermination()
    found = spark.read.parquet(out).select("token", "connectors", at("start"), at("end"), "ended_by")
    return sorted((r.token, tuple(r.connectors), r.start, r.end, r.ended_by) for r in found.collect())


@pytest.mark.parametrize("seed", range(3))
def test_events_may_arrive_in_any_order_within_the_delay(spark, path, seed):
    rng = random.Random(seed)
    rows = []
    for token in range(15):
        s = rng.randrange(400)
        rows.append((f"t{token}", rng.sample("uvw", 2), "pause", s))
        for _ in range(rng.randrange(12)):
            s += rng.choice([1, 20, TTL - 1, TTL, 90])
            rows.append((f"t{token}", ["u"], rng.choice(["renew"] * 5 + ["resume"]), s))
    arrival = sorted(rows, key=lambda r: r[3] + rng.randrange(400))
    parts = [arrival[i : i + 25] for i in range(0, len(arrival), 25)]
    assert streamed(spark, path, parts, "500 seconds") == simulate(rows)


def test_a_renewal_in_time_is_not_beaten_by_a_later_event(spark, path):
    parts = [[("t", ["u"], "pause", 0), ("t", ["u"], "renew", TTL + 20)], [("t", ["u"], "renew", TTL - 5)]]
    assert streamed(spark, path, parts, "1 hour") == simulate([r for part in parts for r in part])


def test_calls_of_the_store_do_not_grow_with_events():
    """A token with 2 or 200 slots in a micro-batch costs the same calls."""
    import pandas as pd

    from offsetlake.streaming.leases import LeaseLives

    calls = []

    class Store:
        def __init__(self, *_):
            self.held = {}

        def __getattr__(self, name):
            def call(*given):
                calls.append(name)
                if name == "update":
                    self.held["value"] = given[0]
                return {"exists": "value" in self.held, "get": self.held.get("value"), "listTimers": []}.get(name)

            return call

    class Handle(Store):
        getValueState = getMapState = lambda self, *_: Store()

    class Timers:
        getCurrentWatermarkInMs = lambda self: 0

    def cost(slots):
        lives = LeaseLives(1_000_000)
        lives.init(Handle())
        calls.clear()
        rows = pd.DataFrame({"ts": pd.to_datetime(range(slots), unit="s"), "event": "renew", "connectors": [["u"]] * slots})
        assert list(lives.handleInputRows(("t",), iter([rows]), Timers())) == []
        return len(calls)

    assert cost(2) == cost(200) <= 6
