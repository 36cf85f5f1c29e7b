"""The log: a Parquet journal with the columns of Spark's Kafka source, or Kafka itself.

The journal directory is partitioned by topic and partition, so readers of one topic list and
open only its files. Kafka needs the ``spark-sql-kafka`` package on the cluster and has not been
exercised by the tests here.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offsetlake import schemas
from offsetlake.operators.skew import join_control


def write_journal(log: DataFrame, path: str, mode: str = "append", segment: bool = False) -> None:
    """Append records to a journal, ordered by offset inside each file.

    As a ``segment``, a bounded piece of the log's end, each topic-partition becomes one file, so a
    stream that takes few files at a time still meets its offsets in order. A bulk load keeps the
    many files of its tasks and is to be streamed without ``max_files``.
    """
    if segment:
        log = log.repartition("topic", "partition")
    (
        log.select(*schemas.LOG.names)
        .sortWithinPartitions("topic", "partition", "offset")
        .write.mode(mode)
        .partitionBy("topic", "partition")
        .parquet(path)
    )


def write_segments(log: DataFrame, path: str, segment_offsets: int, mode: str = "append") -> None:
    """Append records to a journal with one file for every ``segment_offsets`` offsets of a topic-partition.

    Rows are shuffled by segment, so a hot partition is written by as many tasks as it has segments.
    """
    log = log.select(*schemas.LOG.names).withColumn("segment", F.expr(f"offset div {segment_offsets}"))
    keys = ["topic", "partition", "segment"]
    log.repartition(*keys).sortWithinPartitions(*keys, "offset").write.mode(mode).partitionBy(*keys).parquet(path)


def read_log(
    spark: SparkSession,
    path: str,
    topics: Sequence[str] | None = None,
    streaming: bool = False,
    max_files: int | None = None,
) -> DataFrame:
    """Scan whole topics of a journal, as a batch or a stream.

    ``max_files`` bounds a micro-batch; it wants a journal written in segments. Delivery refuses
    input whose offsets go back.
    """
    reader = (spark.readStream if streaming else spark.read).schema(schemas.LOG)
    if streaming and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    log = reader.parquet(path)
    if topics is not None:
        log = log.filter(F.col("topic").isin(list(topics)))
    return log.select(*schemas.LOG.names)


def kafka_offsets(vector: Sequence[tuple[str, int, int]]) -> str:
    """An offset vector in the JSON form of ``startingOffsets`` and ``endingOffsets``."""
    nested: dict[str, dict[str, int]] = {}
    for topic, partition, offset in sorted(vector):
        nested.setdefault(topic, {})[str(partition)] = offset
    return json.dumps(nested)


def read_kafka(
    spark: SparkSession,
    options: Mapping[str, str],
    topics: Sequence[str],
    starts: Sequence[tuple[str, int, int]] | None = None,
    targets: Sequence[tuple[str, int, int]] | None = None,
    streaming: bool = False,
) -> DataFrame:
    """The same columns from Kafka: committed records only, and lost data is an error."""
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    reader = reader.options(**options).option("subscribe", ",".join(topics))
    reader = reader.option("includeHeaders", "true").option("failOnDataLoss", "true")
    reader = reader.option("kafka.isolation.level", "read_committed")
    if starts is not None:
        reader = reader.option("startingOffsets", kafka_offsets(starts))
    if targets is not None and not streaming:
        reader = reader.option("endingOffsets", kafka_offsets(targets))
    return reader.load().select(*schemas.LOG.names)


def read_committed(log: DataFrame, aborted: DataFrame, transaction: str) -> DataFrame:
    """Hide records of aborted transactions; their offsets stay as gaps.

    ``aborted`` has the one column named ``transaction``.
    """
    return join_control(log, aborted.select(transaction).distinct(), [transaction], "left_anti")


def route(log: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Add the target ``table`` of every record; topics without a pipeline are dropped.

    Several topics may feed one table. A topic feeds one table.
    """
    return join_control(log, pipelines.select("topic", "table").distinct(), ["topic"])


CORRUPT = "_corrupt"


def decode_json(log: DataFrame, schema: T.StructType, value: str | Column = "value") -> DataFrame:
    """Decode payloads: adds ``row``, a struct of the user's columns, and ``_error``.

    A struct, so user columns may be called ``key`` or ``timestamp`` like those of the log. A
    payload that is absent, not JSON, or does not fit the schema has a null ``row`` and an error.
    """
    value = F.col(value) if isinstance(value, str) else value
    parsing = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    text = value.cast("string")
    decoded = log.withColumn("_json", F.from_json(text, parsing, options))
    json = F.col("_json")
    error = F.when(text.isNull(), "payload is null").when(
        json.isNull() | json[CORRUPT].isNotNull(), "payload is not valid"
    )
    users = F.struct(*[json[field.name].alias(field.name) for field in schema.fields])
    return decoded.select(
        *log.columns, F.when(error.isNull(), users).alias("row"), error.alias("_error")
    )


def only_good(decoded: DataFrame) -> DataFrame:
    """Decoded records without the bad ones.

    Exploding a one-element array keeps the filter above the decoding; pushed below, it would
    parse every payload a second time.
    """
    rest = [c for c in decoded.columns if c not in ("row", "_error")]
    held = decoded.select(*rest, F.explode(F.array(F.struct("row", "_error"))).alias("_held"))
    return held.filter("_held._error IS NULL").select(*rest, "_held.row")
