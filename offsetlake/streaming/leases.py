"""Leases over an unbounded event stream: each token's life is emitted when it ends.

A token's state is its life so far and its undecided slots of one TTL, a value each: one call of the store a
token and micro-batch, not one an event or slot, as the slots are few and calls cost more than they do. A timer in event time wakes the token up when a slot or the life may be decided.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from offsetlake import schemas
from offsetlake.operators.lease import MICROS
from offsetlake.streaming.dedup import typed_state

SESSIONS = schemas.struct(
    token=schemas.STRING,
    connectors=schemas.LEASE_EVENTS["connectors"].dataType,
    start=schemas.TIME,
    end=schemas.TIME,
    ended_by=schemas.STRING,
)
CONNECTORS = schemas.LEASE_EVENTS["connectors"].dataType
LIFE = schemas.struct(start=schemas.LONG, last=schemas.LONG, connectors=CONNECTORS)
SEEN = T.StructType([
    *schemas.struct(slot=schemas.LONG, first=schemas.LONG, last=schemas.LONG, pause=schemas.LONG, resume=schemas.LONG).fields,
    T.StructField("connectors", CONNECTORS),
])
SLOTS = T.StructType([T.StructField("slots", T.ArrayType(SEEN))])


def _fold(batches: Iterable[pd.DataFrame], ttl: int) -> list[dict]:
    """Events of one token as slots of one TTL, in order; bounded by time, not by events."""
    slots: dict[int, dict] = {}
    for events in batches:
        micros = events["ts"].astype("int64") // (1000 if "ns" in str(events["ts"].dtype) else 1)
        for us, event, connectors in zip(micros.tolist(), events["event"].tolist(), events["connectors"].tolist(), strict=True):
            slot = us // ttl
            seen = slots.get(slot)
            if seen is None:
                seen = slots[slot] = {"slot": slot, "first": us, "last": us, "pause": None, "resume": None, "connectors": None}
            elif us < seen["first"]:
                seen["first"] = us
            elif us > seen["last"]:
                seen["last"] = us
            if event in ("pause", "resume") and (seen[event] is None or us < seen[event]):
                seen[event] = us
                if event == "pause":
                    seen["connectors"] = list(connectors)
    return [slots[slot] for slot in sorted(slots)]


def _life(token: str, life: tuple, end: int, ended_by: str) -> pd.DataFrame:
    start, _, connectors = life
    stamp = lambda us: pd.Timestamp(us, unit="us")
    return pd.DataFrame(
        {
            "token": [token],
            "connectors": [list(connectors)],
            "start": [stamp(start)],
            "end": [stamp(end)],
            "ended_by": [ended_by],
        }
    )


def _merge(slots: list[dict], new: list[dict]) -> list[dict]:
    """Slots of one token with those of a later micro-batch."""
    merged = {s["slot"]: s for s in slots}
    for slot in new:
        old = merged.setdefault(slot["slot"], slot)
        if old is slot:
            continue
        old = merged[slot["slot"]] = dict(old)
        old["first"], old["last"] = min(old["first"], slot["first"]), max(old["last"], slot["last"])
        for event in ("pause", "resume"):
            if slot[event] is not None and (old[event] is None or slot[event] < old[event]):
                old[event] = slot[event]
                if event == "pause":
                    old["connectors"] = slot["connectors"]
    return [merged[slot] for slot in sorted(merged)]


def _decide(life: tuple | None, slots: list[dict], ttl: int, watermark: int):
    """The life after all slots below the watermark, the open slots, and the end if there is one.

    Every event before the watermark has arrived, so a slot that ends there will not change any more,
    and neither will a gap that reaches as far as the watermark.
    """
    while slots and (slots[0]["slot"] + 1) * ttl <= watermark:
        slot = slots[0]
        if life is None and slot["pause"] is not None:
            life = (slot["pause"], slot["pause"], slot["connectors"])
        if life is not None:
            if slot["first"] - life[1] >= ttl:
                return life, slots, (life[1] + ttl, "expired")
            if slot["resume"] is not None:
                return life, slots, (slot["resume"], "resumed")
            life = (life[0], max(life[1], slot["last"]), life[2])
        slots = slots[1:]
    if life is not None and life[1] + ttl <= watermark and (not slots or slots[0]["first"] - life[1] >= ttl):
        return life, slots, (life[1] + ttl, "expired")
    return life, slots, None


class LeaseLives(StatefulProcessor):
    """Decides lives of tokens on the watermark."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", LIFE)
        self.slots = handle.getValueState("open", SLOTS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        return self._advance(key, timerValues, held, _merge(held, _fold(rows, self.ttl)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        return self._advance(key, timerValues, held, held)

    def _held(self) -> list[dict]:
        """The undecided slots of the token, ascending: one call of the store, however many there are."""
        found = self.slots.get()[0] if self.slots.exists() else []
        return [dict(zip(SEEN.names, seen, strict=True)) for seen in found]

    def _advance(self, key, timerValues, held, slots) -> Iterator[pd.DataFrame]:
        life = self.life.get() if self.life.exists() else None
        before = life = (life[0], life[1], list(life[2])) if life is not None else None
        life, left, ended = _decide(life, slots, self.ttl, timerValues.getCurrentWatermarkInMs() * 1000)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if ended is not None:
            if before is not None:
                self.life.clear()
            if held:
                self.slots.clear()
            yield _life(key[0], life, *ended)
            return
        if left and left is not held:
            self.slots.update(([tuple(seen[name] for name in SEEN.names) for seen in left],))
        elif held and not left:
            self.slots.clear()
        if life is not None and life != before:
            self.life.update(life)
        wake = [(left[0]["slot"] + 1) * self.ttl] if left else []
        if life is not None and (not left or left[0]["first"] - life[1] >= self.ttl):
            wake.append(life[1] + self.ttl)
        if wake:
            self.handle.registerTimer(-(-min(wake) // 1000))

    def close(self) -> None:
        pass


def stream_sessions(events: DataFrame, ttl_seconds: float, delay: str) -> DataFrame:
    """``lease_sessions`` for a stream: (token, connectors, start, end, ended_by), in append mode.

    ``delay`` is how late an event may arrive. Nothing is decided before the watermark has passed it, so
    pauses, renewals and resumes may come in any order within the delay. The state of a token is its life
    so far and its undecided slots, at most delay / TTL and a few; it is dropped when the life ends.
    """
    typed_state(events.sparkSession)
    return (
        events.withWatermark("ts", delay)
        .groupBy("token")
        .transformWithStateInPandas(LeaseLives(int(ttl_seconds * MICROS)), SESSIONS, "Append", "EventTime")
    )


def live_tokens(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``token, connectors, start, last`` of the lives that a stopped stream has begun and not ended."""
    state = spark.read.format("statestore").option("stateVarName", "life").load(checkpoint)
    moment = lambda name: F.timestamp_micros(F.col("value")[name]).alias(name)
    return state.select(F.col("key")["token"].alias("token"), F.col("value")["connectors"].alias("connectors"), moment("start"), moment("last"))
