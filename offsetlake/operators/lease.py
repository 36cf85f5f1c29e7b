"""Lease analytics over events (token, connectors, event, ts); event is pause, renew or resume.

A token is minted by its pause, so the pause is its first event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offsetlake.operators.skew import following, join_control, running_sum

MICROS = 1_000_000


def lease_sessions(events: DataFrame, ttl_seconds: float) -> DataFrame:
    """The life of every token: (token, connectors, start, end, ended_by).

    A token expires ``ttl`` after its pause or last accepted renewal. A renewal at or after that
    moment is refused, and so is every later one; a resume before it ends the lease.

    Events are folded into slots of one TTL first. Events of one slot are less than a TTL apart,
    so only the first and last of each slot matter, and a gap that ends the lease always lies
    between two slots. A hot token is thus reduced before the shuffle to one row per task and
    slot, and the window runs over slots, not events. The fold keeps fixed-width values only, so
    it is a hash aggregation; the connectors are joined from the few pause events afterwards.
    """
    ttl = int(ttl_seconds * MICROS)
    rows = events.select("token", "event", F.unix_micros("ts").alias("_us"))
    slots = rows.groupBy("token", F.expr(f"(_us - pmod(_us, {ttl})) div {ttl}").alias("slot")).agg(
        F.min("_us").alias("first"),
        F.max("_us").alias("last"),
        F.min(F.when(F.col("event") == "pause", F.col("_us"))).alias("pause"),
        F.min(F.when(F.col("event") == "resume", F.col("_us"))).alias("resume"),
    )
    order = W.partitionBy("token").orderBy("slot")
    chain = slots.withColumn("before", F.lag("last").over(order)).withColumn(
        "gap", F.coalesce(F.col("first") - F.col("before") >= ttl, F.lit(False))
    )
    # The first slot that ends the lease, by a gap before it or by a resume in it.
    ending = F.when(F.col("gap"), F.col("before") + ttl).otherwise(F.col("resume"))
    ended = F.when(F.col("ending").isNotNull(), F.struct("slot", "ending", "gap"))
    lives = (
        chain.withColumn("ending", ending)
        .groupBy("token")
        .agg(
            F.min("pause").alias("_start"),
            F.min(ended).alias("_ended"),
            F.max("last").alias("_last"),
        )
        .filter("_start IS NOT NULL")
    )
    pauses = events.filter("event = 'pause'").groupBy("token").agg(
        F.min(F.struct("ts", "connectors"))["connectors"].alias("connectors")
    )
    expired = F.col("_ended").isNull() | F.col("_ended.gap")
    return lives.join(pauses, "token").select(
        "token",
        "connectors",
        F.timestamp_micros("_start").alias("start"),
        F.timestamp_micros(F.coalesce(F.col("_ended.ending"), F.col("_last") + ttl)).alias("end"),
        F.when(expired, "expired").otherwise("resumed").alias("ended_by"),
    )


def held_intervals(sessions: DataFrame, bucket_seconds: float = 3600) -> DataFrame:
    """When each connector was held: overlapping and touching leases merge.

    A sweep over starts (+1) and ends (-1): a connector is held while the running sum is above 0.
    The sums are bucketed by time, so a connector that all leases name is not one task.
    """
    size = int(bucket_seconds * MICROS)
    held = sessions.filter(F.col("start") < F.col("end")).select(
        F.explode(F.array_distinct("connectors")).alias("connector"),
        F.unix_micros("start").alias("start"),
        F.unix_micros("end").alias("end"),
    )
    edge = F.explode(
        F.array(
            F.struct(F.col("start").alias("at"), F.lit(1).alias("step")),
            F.struct(F.col("end").alias("at"), F.lit(-1).alias("step")),
        )
    )
    steps = (
        held.select("connector", edge.alias("e"))
        .groupBy("connector", F.col("e.at").alias("at"))
        .agg(F.sum("e.step").alias("step"))
        .filter("step <> 0")
    )
    slot = F.expr(f"at div {size}")
    levels = running_sum(steps, ["connector"], "at", F.col("step"), slot, "level")
    edges = levels.filter("level = 0 OR level = step")
    paired = following(edges, ["connector"], "at", slot, "until")
    return paired.filter("level > 0").select(
        "connector",
        F.timestamp_micros("at").alias("start"),
        F.timestamp_micros("until").alias("end"),
    )


def holders_at(sessions: DataFrame, now) -> DataFrame:
    """Every token and connector at one instant, as the lease store sees it.

    ``live`` is false for a token that has expired but was not swept; one that expires exactly
    now is expired. ``freed`` tells whether releasing this token would free the connector: no
    other live token holds it.
    """
    at = F.lit(now).cast("timestamp")
    present = (
        sessions.filter((F.col("start") <= at) & ~((F.col("ended_by") == "resumed") & (F.col("end") <= at)))
        .withColumn("live", F.col("end") > at)
        .select("token", F.explode(F.array_distinct("connectors")).alias("connector"), "live")
    )
    live = present.groupBy("connector").agg(F.count_if("live").alias("holders"))
    return join_control(present, live, ["connector"]).select(
        "token",
        "connector",
        "live",
        (F.col("holders") - F.col("live").cast("int") == 0).alias("freed"),
    )
