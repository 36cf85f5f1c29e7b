"""A log, ledgers, manifests and lease events derived from the given event and order tables.

Everything here is a linear transform of those tables, so it grows with them. Partition and
offset come from the dense ids by arithmetic, which gives a gapless log without a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offsetlake import schemas
from offsetlake.functions import ledger_key
from offsetlake.operators.catalog import backup_struct, configured_pipelines
from offsetlake.operators.ledger import FINISHED, block_ranges
from offsetlake.sources import storage

EVENTS, ORDERS = "events.input", "orders.input"
TOPICS = [EVENTS, ORDERS]
LEDGER_CUT = "2024-01-25"
TARGET_CUT = "2024-01-28"
RETENTION_CUT = "2024-01-03"
BLOCK = 100
BATCH = 1000
EVENTS_PER_RUN, ORDERS_PER_RUN = 500, 750
MAX_INCREMENTALS = 2
PAYLOAD = schemas.struct(k=schemas.INT)


def wide_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with its source columns, before they are packed into keys and payloads."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    broken = F.expr("substring(props, 1, length(props) - 1)")
    return events.select(
        F.lit(EVENTS).alias("topic"),
        F.expr("cast(event_id % 3 as int)").alias("partition"),
        F.expr("event_id div 3").alias("offset"),
        F.col("event_id").alias("id"),
        "ts",
        F.col("user_id").alias("owner"),
        F.col("event_type").alias("kind"),
        F.when(F.col("event_id") % 101 == 0, broken).otherwise(F.col("props")).alias("payload"),
    ).unionByName(
        orders.select(
            F.lit(ORDERS).alias("topic"),
            F.expr("cast(o_orderkey % 2 as int)").alias("partition"),
            F.expr("o_orderkey div 2").alias("offset"),
            F.col("o_orderkey").alias("id"),
            F.col("o_orderdate").alias("ts"),
            F.col("o_custkey").alias("owner"),
            F.col("o_orderstatus").alias("kind"),
            F.lit('{"k": 1}').alias("payload"),
        )
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records in log form."""
    return packed(wide_log(spark, sf_dir))


def packed(wide: DataFrame) -> DataFrame:
    return wide.select(
        "topic",
        "partition",
        "offset",
        F.col("id").cast("string").cast("binary").alias("key"),
        F.col("payload").cast("binary").alias("value"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.array(
            F.struct(F.lit("kind").alias("key"), F.col("kind").cast("binary").alias("value")),
            F.struct(
                F.lit("owner").alias("key"),
                F.col("owner").cast("string").cast("binary").alias("value"),
            ),
        ).alias("headers"),
    )


def pipelines(spark: SparkSession) -> DataFrame:
    """Three pipelines; two of them feed one table, one has an empty topic."""
    rows = [
        ("records", "main", "records_state", "/ledger/records", "records", EVENTS, 3),
        ("records-secondary", "main", "records_state", "/ledger/secondary", "records", ORDERS, 2),
        ("other", "main", "other_state", "/ledger/other", "other_records", "other.input", 1),
    ]
    return spark.createDataFrame(rows, schemas.PIPELINES)


def blocks(records: DataFrame, size: int = BLOCK) -> DataFrame:
    """Delivered blocks: ``size`` offsets of one partition each."""
    batch = F.concat(F.lit("b-"), F.expr(f"offset div {size}").cast("string"))
    return block_ranges(records.withColumn("batch_id", batch))


def delivered_cut(records: DataFrame) -> DataFrame:
    return records.filter(F.col("ts") < F.lit(LEDGER_CUT).cast("timestamp_ntz"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finished row per block delivered before the cut."""
    done = blocks(delivered_cut(wide_log(spark, sf_dir)))
    return done.withColumn("state", F.lit(FINISHED)).select(*schemas.LEDGER.names)


def raw_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folded ledger in its raw form: text keys and unsigned offsets, by pipeline."""
    ends = delivered_cut(wide_log(spark, sf_dir)).groupBy("topic", "partition").agg(
        F.min("offset").alias("min_offset"), F.max("offset").alias("max_offset")
    )
    names = pipelines(spark).select(F.col("connector").alias("pipeline"), "topic")
    return ends.join(F.broadcast(names), "topic").select(
        "pipeline",
        ledger_key(F.col("topic"), F.col("partition")).alias("key"),
        F.col("min_offset").cast("decimal(20,0)").alias("min_offset"),
        F.col("max_offset").cast("decimal(20,0)").alias("max_offset"),
        F.lit(FINISHED).alias("state"),
    )


def vector(records: DataFrame, cut: str | None = None) -> DataFrame:
    """Next offsets of the records, or of those before a day of January 2024.

    Events come in the order of their time. Orders do not, so they are cut by offset: after as many
    thirtieths of them as days.
    """
    high = F.max("offset") + 1
    if cut is None:
        return records.groupBy("topic", "partition").agg(high.alias("offset"))
    timed = F.max(F.when(F.col("ts") < F.lit(cut).cast("timestamp_ntz"), F.col("offset"))) + 1
    ends = records.groupBy("topic", "partition").agg(timed.alias("timed"), high.alias("high"))
    share = F.expr(f"high * {int(cut[-2:])} div 30")
    offset = F.when(F.col("topic") == EVENTS, F.coalesce("timed", F.lit(0))).otherwise(share)
    return ends.select("topic", "partition", offset.cast("long").alias("offset"))


def vectors(records: DataFrame, cuts: Sequence[str | None]) -> list[DataFrame]:
    """The vectors of several cuts, out of one pass over the records."""
    each = [F.max(F.when(F.col("ts") < F.lit(cut).cast("timestamp_ntz"), F.col("offset"))) + 1 for cut in cuts if cut]
    ends = records.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("high"), *[e.alias(f"timed{n}") for n, e in enumerate(each)])
    ends, found = storage.settled(ends, "vectors"), []
    for cut in cuts:
        offset = F.col("high")
        if cut:
            timed = F.coalesce(f"timed{sum(c is not None for c in cuts[: len(found)])}", F.lit(0))
            offset = F.when(F.col("topic") == EVENTS, timed).otherwise(F.expr(f"high * {int(cut[-2:])} div 30"))
        found.append(ends.select("topic", "partition", offset.cast("long").alias("offset")))
    return found


def retained_bounds(records: DataFrame) -> DataFrame:
    """Log bounds when records before the retention cut are gone."""
    low = vector(records, RETENTION_CUT).withColumnRenamed("offset", "low")
    high = vector(records).withColumnRenamed("offset", "high")
    return low.join(high, ["topic", "partition"])


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset rows of a backup history: run n covers the first n + 1 slices of the log.

    One run per 500 events (and 750 orders), so the history grows with the data.
    """
    records = wide_log(spark, sf_dir)
    run = F.when(F.col("topic") == EVENTS, F.expr(f"id div {EVENTS_PER_RUN}")).otherwise(
        F.expr(f"id div {ORDERS_PER_RUN}")
    )
    ends = records.groupBy("topic", "partition", run.alias("run")).agg(
        (F.max("offset") + 1).alias("offset")
    )
    names = pipelines(spark).select("connector", "topic")
    return ends.join(F.broadcast(names), "topic").select(
        "run", "connector", "topic", "partition", "offset"
    )


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The backup history as manifests: chains of one full and two incremental backups."""
    offset = F.struct(
        "topic", "partition", F.col("offset").cast("decimal(20,0)").alias("offset")
    )
    done = F.struct(
        ledger_key(F.col("topic"), F.col("partition")).alias("key"),
        F.lit(0).cast("decimal(20,0)").alias("min_offset"),
        (F.col("offset") - 1).cast("decimal(20,0)").alias("max_offset"),
        F.lit(FINISHED).alias("state"),
    )
    vectors = checkpoints(spark, sf_dir).groupBy("run", "connector").agg(
        F.sort_array(F.collect_list(offset)).alias("offsets"),
        F.sort_array(F.collect_list(done)).alias("ledger"),
    )
    none = F.array().cast(schemas.CHECKPOINT_OFFSETS)
    fed = pipelines(spark).filter(F.col("topic").isin(EVENTS, ORDERS))
    connector = F.struct(
        F.col("connector").alias("name"),
        "topic",
        F.col("partitions").cast("long").alias("partitions"),
        "database",
        "table",
        F.lit("main").alias("state_database"),
        "state_table",
        "state_path",
        "offsets",
        none.alias("observed"),
        "ledger",
    ).cast(schemas.CONNECTORS.elementType)
    runs = vectors.join(F.broadcast(fed), "connector").groupBy("run").agg(
        F.sort_array(F.collect_list(connector)).alias("connectors")
    )
    position = F.expr(f"run % {MAX_INCREMENTALS + 1}")

    def name(run):
        return F.format_string("store:chain/run-%d", run)

    child = position > 0
    parent = F.col("run") - 1
    return runs.select(
        F.format_string("run-%d", "run").alias("backup_id"),
        name(F.col("run")).alias("name"),
        F.when(child, "incremental").otherwise("full").alias("kind"),
        F.format_string("run-%d", F.col("run") - position).alias("chain_id"),
        position.alias("position"),
        F.when(child, F.format_string("run-%d", parent)).alias("parent_id"),
        F.when(child, name(parent)).alias("parent_name"),
        F.date_format(
            F.timestamp_seconds(F.lit(1704067200) + F.col("run") * 86400), "yyyy-MM-dd'T'HH:mm:ss'Z'"
        ).alias("created_at"),
        "connectors",
    )


def chain_states(manifests: DataFrame, pipelines: DataFrame) -> DataFrame:
    """The state each chain had after its last backup."""
    last = F.max(F.struct("position", backup_struct().alias("ref")))["ref"]
    first = F.min(F.struct("position", backup_struct().alias("ref")))["ref"]
    return (
        manifests.groupBy("chain_id")
        .agg(first.alias("root"), last.alias("tip"))
        .withColumn("incremental_count", F.col("tip.position"))
        .withColumn(
            "generation",
            (F.regexp_extract("tip.id", r"([0-9]+)\z", 1).cast("long") + 1).cast("decimal(20,0)"),
        )
        .withColumn("pipelines", configured_pipelines(pipelines))
        .select(*schemas.CHAIN_STATE.names)
    )


def fed_pipelines(spark: SparkSession) -> DataFrame:
    """The pipelines that the backup history covers."""
    return pipelines(spark).filter(F.col("topic").isin(EVENTS, ORDERS))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history as catalog records: each run writes its manifest, then its chain state.

    Every fifth manifest is written a second time later on, and every seventh is deleted by a
    null value.
    """
    rows = manifests(spark, sf_dir)
    run = F.regexp_extract("backup_id", r"([0-9]+)\z", 1).cast("long")
    value = F.to_json(F.struct(*schemas.MANIFESTS.names))
    first = rows.select((run * 2).alias("log_offset"), F.col("backup_id").alias("key"), value.alias("value"))
    state = rows.select(
        (run * 2 + 1).alias("log_offset"),
        F.lit("chain-state").alias("key"),
        F.to_json(
            F.struct(
                (run + 1).cast("decimal(20,0)").alias("generation"),
                "chain_id",
                backup_struct().alias("tip"),
                F.col("position").alias("incremental_count"),
            )
        ).alias("value"),
    )
    unchanged = [c for c in schemas.MANIFESTS.names if c != "created_at"]
    again = rows.filter(run % 5 == 0).select(
        (run * 2 + 1_000_000_000).alias("log_offset"),
        F.col("backup_id").alias("key"),
        F.to_json(F.struct(*unchanged, F.lit("again").alias("created_at"))).alias("value"),
    )
    gone = rows.filter(run % 7 == 3).select(
        (run * 2 + 2_000_000_000).alias("log_offset"),
        F.col("backup_id").alias("key"),
        F.lit(None).cast("string").alias("value"),
    )
    return first.unionByName(state).unionByName(again).unionByName(gone)


def lease_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are tokens. A token's first event is its pause, each 53rd event id a resume."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    firsts = events.groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    pauses = firsts.withColumn("first", F.lit(True))
    rows = events.join(pauses, ["user_id", "event_id"], "left")
    event = (
        F.when(F.col("first"), "pause").when(F.col("event_id") % 53 == 0, "resume").otherwise("renew")
    )
    return rows.select(
        F.col("user_id").cast("string").alias("token"),
        F.array("event_type").alias("connectors"),
        event.alias("event"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
