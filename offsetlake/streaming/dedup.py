"""Block deduplication over an unbounded stream of attempted blocks.

The state of a table is its last ``window`` accepted blocks, as two maps in the state store: the number of
each identity, and the identity of each number. An attempt is one lookup and, if it is accepted, one
entry in and one out, however long the window is. A stream can begin where a batch ended, and
``window_state`` reads the state of a checkpoint back as a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from offsetlake import schemas
from offsetlake.operators.audit import broken_rules

IDENTITY = ["topic", "partition", "min_offset", "max_offset", "rows", "content"]
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NUMBERS = schemas.struct(identity=schemas.STRING), schemas.struct(number=schemas.LONG)
HANDED_OVER = schemas.struct(table=schemas.STRING, identity=schemas.STRING, number=schemas.LONG)


def typed_state(spark: SparkSession) -> None:
    """Map and value state with timers needs the RocksDB store; streams that run already keep theirs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def identity_of() -> Column:
    return F.concat_ws("/", *[F.col(c).cast("string") for c in IDENTITY])


class WindowedBlocks(StatefulProcessor):
    """Accepts attempts of one table unless their block is among the last ``window`` accepted ones."""

    def __init__(self, window: int, order: str, columns: list[str]):
        self.window, self.order, self.columns = window, order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        identity, number = NUMBERS
        self.numbers = handle.getMapState("numbers", identity, number)
        self.identities = handle.getMapState("identities", number, identity)
        self.accepted = handle.getValueState("accepted", number)

    def _take(self, identity: str, number: int) -> None:
        self.numbers.updateValue((identity,), (number,))
        self.identities.updateValue((number,), (identity,))
        gone = (number - self.window,)
        if self.identities.containsKey(gone):
            left = self.identities.getValue(gone)
            self.identities.removeKey(gone)
            # Unless the block was accepted again since, which a window of its own length forbids.
            if self.numbers.containsKey(left) and self.numbers.getValue(left)[0] == gone[0]:
                self.numbers.removeKey(left)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """The last accepted blocks of a batch, by number."""
        rows = initialState.sort_values("number")
        for identity, number in zip(rows["identity"], rows["number"], strict=True):
            self._take(identity, int(number))
        if len(rows):
            self.accepted.update((int(rows["number"].max()) + 1,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tried = pd.concat(list(rows))
        # The key comes first, and Spark renames columns that begin with an underscore.
        tried = tried.iloc[:, -len(self.columns) :].set_axis(self.columns, axis=1).sort_values(self.order, kind="stable")
        count = self.accepted.get()[0] if self.accepted.exists() else 0
        kept = []
        for identity in tried["_id"]:
            fresh = not self.numbers.containsKey((identity,))
            kept.append(fresh)
            if fresh:
                self._take(identity, count)
                count += 1
        self.accepted.update((count,))
        yield tried[kept].drop(columns="_id")

    def close(self) -> None:
        pass


def handed_over(accepted: DataFrame, window: int, table: str = "table", order: str = "seq") -> DataFrame:
    """``table, identity, number``: what a stream must know of the blocks that a batch accepted.

    The last ``window`` blocks of every table. Numbers count down from the end, so that only as many rows
    of a table leave a task; the stream goes on from the highest.
    """
    last = W.partitionBy(table).orderBy(F.desc(order))
    ranked = accepted.select(F.col(table).alias("table"), identity_of().alias("identity"), order)
    ranked = ranked.withColumn("_rank", F.row_number().over(last)).filter(F.col("_rank") <= window)
    return ranked.select("table", "identity", (F.lit(window) - F.col("_rank")).cast("long").alias("number"))


def stream_accepted_blocks(
    attempts: DataFrame, window: int, order: str = "seq", initial: DataFrame | None = None
) -> DataFrame:
    """``accepted_blocks`` for a stream of block rows, in append mode.

    Blocks of one micro-batch are taken in ``order``, micro-batches as they arrive. Only block rows pass
    through here, one per batch and topic-partition; records are joined to the accepted ones afterwards.
    ``initial`` is ``handed_over`` by a batch; it counts in the first micro-batch of a new checkpoint.
    """
    if window < 1:
        raise ValueError("a deduplication window holds one block at least")
    typed_state(attempts.sparkSession)
    given = None if initial is None else initial.select(*HANDED_OVER.names).groupBy("table")
    processor = WindowedBlocks(window, order, [*attempts.columns, "_id"])
    return (
        attempts.withColumn("_id", identity_of())
        .groupBy("table")
        .transformWithStateInPandas(processor, attempts.schema, "Append", "None", initialState=given)
    )


def window_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``table, number, identity`` of the blocks that the state of a stopped stream holds."""
    state = spark.read.format("statestore").option("stateVarName", "identities").load(checkpoint)
    return state.select(F.col("key")["table"].alias("table"), F.col("user_map_key")["number"].alias("number"), F.col("user_map_value")["identity"].alias("identity"))


def audit_window(spark: SparkSession, checkpoint: str, window: int) -> DataFrame:
    """Violations of a checkpoint: more blocks than the window, numbers with gaps, maps that disagree."""
    state = window_state(spark, checkpoint)
    other = spark.read.format("statestore").option("stateVarName", "numbers").load(checkpoint)
    other = other.select(F.col("key")["table"].alias("table"), F.col("user_map_key")["identity"].alias("identity"), F.col("user_map_value")["number"].alias("_other"))
    held = state.join(other, ["table", "identity"], "full_outer")
    sums = held.groupBy("table").agg(
        F.count("number").alias("n"), F.min("number").alias("low"), F.max("number").alias("high"),
        F.count_if(~F.col("number").eqNullSafe(F.col("_other"))).alias("odd"),
    )
    return broken_rules(
        sums,
        F.col("table"),
        {
            "window-too-large": F.col("n") > window,
            "window-number-gap": F.col("high") - F.col("low") + 1 != F.col("n"),
            "window-maps-differ": F.col("odd") > 0,
        },
    )
