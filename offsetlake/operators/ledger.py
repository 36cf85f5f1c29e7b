"""The delivery ledger: block ranges, the folded state, exact next offsets, and its audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offsetlake.functions import MAX_I64, ledger_key, ledger_partition
from offsetlake.operators.audit import broken_rules, duplicates, union, violation
from offsetlake.operators.bounds import TP, all_partitions, position_name

# Fixed value: the state of a ledger row whose block is durably in the table.
FINISHED = "AFTER_PROCESSING"


def block_ranges(records: DataFrame, keys=("topic", "partition", "batch_id")) -> DataFrame:
    """First and last offset and row count of every delivered block."""
    return records.groupBy(*keys).agg(
        F.min("offset").alias("min_offset"),
        F.max("offset").alias("max_offset"),
        F.count(F.lit(1)).alias("rows"),
    )


def fold_ledger(ledger: DataFrame, keys=("topic", "partition")) -> DataFrame:
    """The row with the highest ``max_offset`` of every topic-partition.

    Not the highest batch id: those restart when a stream gets a new checkpoint. One struct
    maximum, so folding happens before the shuffle.
    """
    rest = [c for c in ledger.columns if c not in keys and c != "max_offset"]
    latest = F.max(F.struct("max_offset", *rest))
    return ledger.groupBy(*keys).agg(latest.alias("_latest")).select(
        *keys, *[F.col(f"_latest.{c}").alias(c) for c in ledger.columns if c not in keys]
    )


def exact_offsets(pipelines: DataFrame, folded: DataFrame) -> DataFrame:
    """Exclusive next offset of every configured partition: ledger maximum + 1, else 0."""
    return (
        all_partitions(pipelines)
        .join(folded.select(*TP, "max_offset"), TP, "left")
        .select(
            *TP, F.coalesce(F.col("max_offset") + 1, F.lit(0)).cast("long").alias("offset")
        )
    )


def audit_ledger(raw: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Seven rules over raw ledger rows, before anything is derived from them."""
    known = pipelines.select(F.col("connector").alias("pipeline"), "topic", "partitions")
    rows = raw.join(known, "pipeline", "left")
    prefix = F.concat("topic", F.lit("-"))
    foreign = ~F.coalesce(F.startswith("key", prefix), F.lit(False))
    suffix = F.expr("substring(key, length(topic) + 2)")
    rows = rows.withColumn("_foreign", foreign).withColumn("_part", ledger_partition(suffix))
    own = ~F.col("_foreign")
    single = broken_rules(
        rows,
        F.col("key"),
        {
            "ledger-unexpected-topic": F.col("_foreign"),
            "ledger-invalid-range": F.col("min_offset") > F.col("max_offset"),
            "ledger-offset-too-large": F.col("max_offset") > F.lit(MAX_I64),
            "ledger-invalid-partition": own & F.col("_part").isNull(),
            "ledger-partition-out-of-range": own
            & F.coalesce(F.col("_part") >= F.col("partitions"), F.lit(False)),
            "ledger-unfinished": ~F.col("state").eqNullSafe(FINISHED),
        },
        F.col("pipeline"),
    )
    twice = duplicates(rows.filter(own & F.col("_part").isNotNull()), ["pipeline", "topic", "_part"])
    subject = ledger_key(F.col("topic"), F.col("_part"))
    return union([single, violation(twice, "ledger-duplicate-partition", subject, F.col("pipeline"))])


def parse_ledger(raw: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Audited raw rows as (topic, partition, min_offset, max_offset, state)."""
    known = pipelines.select(F.col("connector").alias("pipeline"), "topic")
    suffix = F.expr("substring(key, length(topic) + 2)")
    return raw.join(known, "pipeline").select(
        "topic",
        ledger_partition(suffix).cast("int").alias("partition"),
        F.col("min_offset").cast("long").alias("min_offset"),
        F.col("max_offset").cast("long").alias("max_offset"),
        "state",
    )


def audit_observed(exact: DataFrame, observed: DataFrame) -> DataFrame:
    """A consumer's own committed offsets may lag the ledger but never lead it.

    Missing partitions are fine; repeated, unknown and leading ones are not.
    """
    joined = observed.withColumnRenamed("offset", "observed").join(exact, TP, "left")
    unknown = F.col("offset").isNull()
    return union(
        [
            broken_rules(
                joined,
                position_name(),
                {
                    "observed-unexpected": unknown,
                    "observed-ahead": ~unknown & (F.col("observed") > F.col("offset")),
                },
            ),
            violation(duplicates(observed, TP), "observed-duplicate", position_name()),
        ]
    )


def vector_to_ledger(offsets: DataFrame) -> DataFrame:
    """Ledger rows that stand for an offset vector; offset 0 has no row."""
    return offsets.filter("offset > 0").select(
        ledger_key(F.col("topic"), F.col("partition")).alias("key"),
        (F.col("offset") - 1).alias("min_offset"),
        (F.col("offset") - 1).alias("max_offset"),
        F.lit(FINISHED).alias("state"),
    )


def rehydrate(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """What it takes to make ``actual`` ledger rows equal ``expected`` ones.

    ``insert`` rows are missing; ``conflict`` rows exist but are not expected, and must stop the
    recovery.
    """
    columns = ["key", "min_offset", "max_offset", "state"]
    expected, actual = expected.select(columns), actual.select(columns)
    insert = expected.join(actual, columns, "left_anti").withColumn("action", F.lit("insert"))
    conflict = actual.join(expected, columns, "left_anti").withColumn("action", F.lit("conflict"))
    return insert.unionByName(conflict)


def audit_progress(actual: DataFrame, initial: DataFrame, offsets: DataFrame) -> DataFrame:
    """A live recovery may only move forward from its initial ledger rows."""
    allowed = offsets.select(ledger_key(F.col("topic"), F.col("partition")).alias("key"))
    extra = actual.join(allowed, "key", "left_anti")
    moved = initial.select("key", F.col("max_offset").alias("initial")).join(
        actual.select("key", F.col("max_offset").alias("current")), "key", "left"
    )
    lost = F.col("current").isNull()
    return union(
        [
            violation(extra, "progress-unexpected-partition", F.col("key")),
            broken_rules(
                moved,
                F.col("key"),
                {
                    "progress-lost-row": lost,
                    "progress-moved-back": ~lost & (F.col("current") < F.col("initial")),
                },
            ),
        ]
    )
