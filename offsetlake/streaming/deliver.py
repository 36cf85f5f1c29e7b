"""Exactly-once delivery of a log stream into tables.

The batch key is ``<epoch>-<batch id>``, and the epoch is the id that Spark stores with the
checkpoint. After a crash Spark repeats the same source range under the same batch id, so a batch
whose ledger row exists is skipped and any other is written again in full. A new checkpoint is a
new epoch; records at or below what other epochs committed are then dropped, so that replaying the
log from its start adds nothing.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from offsetlake import schemas
from offsetlake.operators.ledger import fold_ledger
from offsetlake.operators.skew import join_control
from offsetlake.sources import storage
from offsetlake.sources import table as tables
from offsetlake.sources.log import decode_json

TOLERANCES = ("all", "none")


@dataclass
class Target:
    """Where the records of some topics go."""

    path: str
    schema: T.StructType
    topics: Sequence[str]
    order_by: Sequence[str] = ()
    ends: dict[tuple[str, int], int] = field(default_factory=dict)


def dead_letter(decoded: DataFrame, context: bool = True) -> DataFrame:
    """Decoded records in table form: user columns, position, ``dead``, and the raw ``letter``.

    With ``context`` the headers of a dead letter also tell where it came from and why it failed.
    """
    bad = F.col("_error").isNotNull()
    headers = F.coalesce("headers", F.array().cast(schemas.HEADERS))
    if context:
        extra = {
            "error.topic": F.col("topic"),
            "error.partition": F.col("partition").cast("string"),
            "error.offset": F.col("offset").cast("string"),
            "error.message": F.col("_error"),
        }
        added = [
            F.struct(F.lit(name).alias("key"), text.cast("binary").alias("value"))
            for name, text in extra.items()
        ]
        headers = F.concat(headers, F.array(*added))
    letter = F.struct("key", "value", "timestamp", headers.alias("headers"))
    return decoded.select(
        "row.*",
        *schemas.POSITION,
        F.when(bad, letter).alias("letter"),
        bad.cast("int").alias("dead"),
    )


def epoch_of(spark: SparkSession, checkpoint: str) -> str | None:
    """The id of the checkpoint, or None before its first start."""
    text = storage.read_text(spark, f"{checkpoint}/metadata")
    return None if text is None else json.loads(text)["id"]


def _floors(spark: SparkSession, target: Target, epoch: str | None) -> DataFrame | None:
    """Highest offsets committed by other epochs, restores and copies; None if there are none."""
    ledger = tables.read_ledger(spark, target.path)
    if epoch is not None:
        ledger = ledger.filter(~F.col("batch_id").startswith(epoch))
    folded = fold_ledger(ledger.select("topic", "partition", "max_offset"))
    table = folded.withColumnRenamed("max_offset", "_floor").toArrow()
    return spark.createDataFrame(table) if table.num_rows else None


def above(records: DataFrame, floors: DataFrame | None) -> DataFrame:
    """Records above the floor of their topic-partition."""
    if floors is None:
        return records
    joined = join_control(records, floors, ["topic", "partition"], "left")
    return joined.filter("_floor IS NULL OR offset > _floor").drop("_floor")


def append_decoded(
    records: DataFrame,
    target: Target,
    key: str,
    tolerance: str = "all",
    context: bool = True,
    dead_letters: bool = True,
) -> bool:
    """Decode and append one batch of log records, bad ones as dead letters, in one pass.

    With tolerance ``none`` a bad record fails the batch. With ``dead_letters`` off, bad records
    that are tolerated are dropped.
    """
    if tolerance not in TOLERANCES:
        raise ValueError(f"tolerance must be one of {TOLERANCES}")
    rows = dead_letter(decode_json(records, target.schema), context)
    if tolerance == "all" and not dead_letters:
        rows = rows.filter("dead = 0")
    return tables.append_batch(
        rows, target.path, key, target.order_by, target.ends, allow_dead=tolerance == "all"
    )


def deliver(
    stream: DataFrame,
    targets: Sequence[Target],
    checkpoint: str,
    tolerance: str = "all",
    context: bool = True,
    dead_letters: bool = True,
    interval: str | None = None,
    exact: bool = False,
) -> StreamingQuery:
    """Start delivery of a log stream. Without ``interval`` it stops when the log is consumed.

    An ``exact`` stream begins where all targets stand, so nothing is looked up to drop what other checkpoints
    delivered; a batch that goes back is refused as ever.

    Records of topics that no target names are dropped. Each table is its own unit: a crash
    between two tables of one batch leaves the first committed and skips it on the retry. A
    batch that feeds several tables is kept while they are written.
    """
    spark = stream.sparkSession
    epoch = epoch_of(spark, checkpoint)
    floors = {}
    for target in targets:
        tables.table_schema(target.schema)
        target.ends = tables.folded_ends(spark, target.path)
        floors[target.path] = None if exact else _floors(spark, target, epoch)

    def handle(batch: DataFrame, batch_id: int) -> None:
        key = f"{epoch_of(batch.sparkSession, checkpoint)}-{batch_id}"
        if len(targets) > 1:
            batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for target in targets:
                routed = batch.filter(F.col("topic").isin(list(target.topics)))
                fresh = above(routed, floors[target.path])
                append_decoded(fresh, target, key, tolerance, context, dead_letters)
        finally:
            if len(targets) > 1:
                batch.unpersist()

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if interval is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()
