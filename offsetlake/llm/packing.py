"""Best-fit packing of documents into sequences of several permitted lengths.

Pieces of documents are packed in shards of bounded size. In a shard pieces go by descending
length into the open bin that they leave the fullest. If none has room, a bin opens at the
permitted length of least cost per unit that it can still be filled with. In the end each bin
shrinks to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offsetlake.llm.common import Work

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 16
SHARD_PIECES = 16_384


def padded_cost(overhead: int = OVERHEAD) -> Callable[[int], float]:
    """Cost of one sequence: its length and a fixed share of its own."""
    return lambda capacity: capacity + overhead


def best_fit(
    lengths: Sequence[int], capacities: Sequence[int], cost: Callable[[int], float]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the final capacity of each bin.

    ``lengths`` descend, and none exceeds the largest capacity. Of equally full bins the
    one opened first takes the piece; of equally cheap capacities the smaller one opens.
    """
    capacities = sorted(capacities)
    rest = int(np.sum(lengths))
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used: list[int] = []
    size: list[int] = []
    room: list[tuple[int, int]] = []  # (room left, bin), ascending
    for i, length in enumerate(map(int, lengths)):
        at = bisect_left(room, (length, -1))
        if at < len(room):
            left, bin_no = room.pop(at)
        else:
            bin_no = len(used)
            left = min((c for c in capacities if c >= length), key=lambda c: (cost(c) / min(c, rest), c))
            used.append(0)
            size.append(left)
        bins[i], offsets[i] = bin_no, used[bin_no]
        used[bin_no] += length
        rest -= length
        if left > length:
            insort(room, (left - length, bin_no))
    final = np.asarray(capacities)[np.searchsorted(capacities, used)] if used else np.zeros(0, np.int64)
    return bins, offsets, final


def pack(
    documents: DataFrame,
    length: str,
    key: Sequence[str] = ("doc_id",),
    capacities: Sequence[int] = CAPACITIES,
    overhead: int = OVERHEAD,
    shard_pieces: int = SHARD_PIECES,
    seed: int = 0,
) -> DataFrame:
    """Pack all documents; one row per piece.

    Returns ``*key, doc_length, copy, piece, start, length, shard, bin, bin_offset, capacity``. A
    document longer than the largest capacity is cut into pieces of that capacity and a rest;
    ``start`` is the place of the piece in its document. Documents of no or null length have one
    piece of length 0 in no bin (shard, bin, offset and capacity null). Rows equal in key and length
    are told apart by ``copy``. Null keys are keys like others; an empty table gives an empty
    result. Shards are a seeded hash of a piece's columns, so the result depends on the rows alone.
    """
    key = list(key)
    work = Work(documents.sparkSession, "pack")
    largest = max(capacities)
    items = documents.select(*key, F.coalesce(F.col(length), F.lit(0)).cast("long").alias("doc_length"))
    items = items.groupBy(*key, "doc_length").agg(F.count(F.lit(1)).alias("_rows"))
    last = F.greatest(F.lit(0), F.ceil(F.col("doc_length") / largest) - 1)
    columns = [*key, "doc_length", "copy", "piece", "start", "length"]
    pieces = (
        items.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
        .withColumn("start", F.col("piece") * largest)
        .withColumn("length", F.least(F.col("doc_length") - F.col("start"), F.lit(largest).cast("long")))
        .select(*columns)
    )
    pieces = work.keep(pieces, "pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))
    draw = F.xxhash64(F.lit(seed), *key, "doc_length", "copy", "piece")
    full = (
        pieces.filter("length > 0")
        .withColumn("shard", F.pmod(draw, F.lit(shards)).cast("long"))
        .withColumn("_draw", F.xxhash64(F.lit(seed + 1), draw))
    )
    places = ["bin", "bin_offset", "capacity"]
    schema = T.StructType([*full.drop("_draw").schema.fields, *(T.StructField(c, T.LongType()) for c in places)])
    caps = sorted(capacities)

    def pack_shard(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("length", "descending"), ("_draw", "ascending"), ("copy", "ascending")])
        bins, offsets, final = best_fit(shard.column("length").to_numpy(), caps, padded_cost(overhead))
        for name, values in zip(places, (bins, offsets, final[bins]), strict=True):
            shard = shard.append_column(name, pa.array(values, pa.int64()))
        return shard.drop_columns(["_draw"])

    packed = full.groupBy("shard").applyInArrow(pack_shard, schema)
    unpacked = pieces.filter("length = 0").select(
        *columns, *(F.lit(None).cast("long").alias(c) for c in ("shard", *places))
    )
    return packed.select(*columns, "shard", *places).unionByName(unpacked)
