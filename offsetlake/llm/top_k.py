"""Exact top-k inner products of integer vectors, longest vectors first.

Candidates lie in blocks of descending length. A query first meets the block of the longest vectors;
its k-th best score there is a threshold from the start. By Cauchy-Schwarz no block whose longest
vector times the query's length is below the threshold can matter, so a query block travels only to a
prefix of the blocks. A task takes the blocks of its lane in order, each with the threshold that the ones
before it raised. Inside a block vectors are rotated by the singular vectors of all data, which
puts most of a product into its first coordinates: the partial sum plus the product of the residual
lengths bounds the score, and only candidates whose bound reaches the threshold are scored, in
integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offsetlake.llm.common import Work, record_batch

BLOCK_ROWS = 4096
QUERY_ROWS = 512
QUERY_GROUP = 16  # query blocks that meet a lane in one task
LANE_BLOCKS = 4  # full blocks that a lane holds the rows of
STRIP = 512
HEAD_SHARE = 4  # partial sums cover the first dimensions / HEAD_SHARE coordinates


def integers(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component; null if the vector is null or holds null, NaN or infinity."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows; shorter ones end with zeros."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(array.offsets.to_numpy())
    out = np.zeros((len(array), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = array.flatten().to_numpy()
    return out


def rotation(rows: DataFrame, dims: int) -> np.ndarray:
    """Right singular vectors of all rows, strongest first.

    They are the eigenvectors of the Gram matrix; tasks add up their parts of it, and the driver gets
    its dims * dims entries.
    """

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            x = _matrix(batch.column("vector"), dims).astype(np.float64)
            total += x.T @ x
        yield record_batch(pa.schema([("cell", pa.int64()), ("v", pa.float64())]), [np.arange(dims * dims), total.ravel()])

    cells = rows.select("vector").mapInArrow(gram, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros(dims * dims)
    total[cells.column("cell").to_numpy()] = cells.column("v").to_numpy()
    value, vector = np.linalg.eigh(total.reshape(dims, dims))
    return vector[:, np.argsort(-value)]


class Best:
    """The k best (score, id) of each query so far; equal scores in order of the id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = [np.zeros(0, np.int64)] * queries
        self.ids = [np.zeros(0, np.int64)] * queries

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[query], scores]), np.concatenate([self.ids[query], ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[query], self.ids[query] = scores[order], ids[order]

    def least(self, query: int) -> float:
        return float(self.scores[query][-1]) if len(self.scores[query]) == self.k else -np.inf


def search(
    queries: np.ndarray,
    query_rows: np.ndarray,
    thresholds: np.ndarray,
    block: np.ndarray,
    rows: np.ndarray,
    ids: np.ndarray,
    rotate: np.ndarray,
    k: int,
    best: Best | None = None,
) -> Best:
    """The best of a block, descending in length, for each query; ``best`` holds what earlier blocks gave.

    ``rows`` number the rows, and no query meets its own. Candidates that cannot reach a query's
    threshold may be missing.
    """
    best = best or Best(len(queries), k)
    thresholds = np.maximum(thresholds, [best.least(i) for i in range(len(queries))])
    head = max(1, rotate.shape[1] // HEAD_SHARE)
    q, c = queries.astype(np.float64), block.astype(np.float64)
    q_norm, c_norm = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    q_head, c_head = q @ rotate[:, :head], c @ rotate[:, :head]
    residual = lambda norm, part: np.sqrt(np.maximum(norm**2 - (part**2).sum(1), 0))
    q_rest, c_rest = residual(q_norm, q_head), residual(c_norm, c_head)
    # Sums of products below 2 ** 53 are exact in floating point, whatever their order.
    exact = q_norm.max(initial=0) * c_norm.max(initial=0) < 2**53
    for start in range(0, len(block), STRIP):
        strip = slice(start, start + STRIP)
        slack = 1e-6 * (1 + q_norm * c_norm[start])
        active = np.flatnonzero(q_norm * c_norm[start] + slack >= thresholds)
        if not len(active):
            break  # all later vectors are shorter
        bound = q_head[active] @ c_head[strip].T + np.outer(q_rest[active], c_rest[strip]) + slack[active, None]
        hopeful = bound >= thresholds[active, None]
        hopeful &= rows[strip] != query_rows[active, None]
        columns = np.flatnonzero(hopeful.any(0))
        if not len(columns):
            continue
        if exact:
            scores = (q[active] @ c[strip][columns].T).astype(np.int64)
        else:
            scores = queries[active] @ block[strip][columns].T
        hopeful = hopeful[:, columns] & (scores >= thresholds[active, None])
        found = ids[strip][columns]
        for row in np.flatnonzero(hopeful.any(1)):
            query = int(active[row])
            best.add(query, scores[row][hopeful[row]], found[hopeful[row]])
            thresholds[query] = max(thresholds[query], best.least(query))
    return best


def _packed_rows(*parts: np.ndarray) -> list[bytes]:
    return [part.astype("<i8").tobytes() for part in parts]


def _unpacked_rows(rows: bytes, ids: bytes, vectors: bytes, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(rows, "<i8"), np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<i8").reshape(-1, dims)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    key: str = "vec_id",
    vector: str = "vector",
    k: int = 20,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """The k best candidates of each query: ``query_id, rank, vec_id, score``.

    ``vector`` holds integers. Queries are the rows for which ``is_query`` holds, candidates all rows but
    the query's own row. Equal scores rank by key. Rows with a null key or vector take no part. Rows that repeat a
    key are rows like others: each is a candidate, and each that asks gets a ranking of its own.
    Shorter vectors count as filled up with zeros; scores must fit in 64 bits. Queries with fewer than k candidates get all
    of them; an empty table gives an empty result. Other columns, whatever their names, are ignored.

    The driver holds the block of the longest vectors (``block_rows`` rows), the rotation (dimensions
    squared), and one length per block.
    """
    spark = vectors.sparkSession
    work = Work(spark, "top-k")
    out = "query_row long, query_id long, vec_id long, score long"
    rows = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull())
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<long>").alias("vector"), is_query.alias("asks"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # fixed by the write that follows
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    rows = work.keep(rows.withColumn("norm", F.sqrt(square)), "rows")
    dims, total = rows.agg(F.coalesce(F.max(F.size("vector")), F.lit(0)), F.count(F.lit(1))).first()
    ranks = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rotate = rotation(rows, dims)

    packed_columns = ("rows", "ids", "vectors")

    def in_blocks(size: int, name: str):
        schema = pa.schema([(name, pa.int64()), ("longest", pa.float64()), ("n", pa.int64()), *((c, pa.binary()) for c in packed_columns)])

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            number, waiting = TaskContext.get().partitionId() << 24, []

            def block(table: pa.Table) -> pa.RecordBatch:
                numbers, ids = table.column("row").to_numpy(), table.column("id").to_numpy()
                data = _matrix(table.column("vector"), dims)
                longest = float(table.column("norm").to_numpy()[0])
                return record_batch(schema, [[number], [longest], [len(ids)], *([v] for v in _packed_rows(numbers, ids, data))])

            for batch in batches:
                waiting.append(batch)
                while sum(b.num_rows for b in waiting) >= size:
                    table = pa.Table.from_batches(waiting)
                    yield block(table.slice(0, size))
                    number += 1
                    waiting = table.slice(size).to_batches()
            if sum(b.num_rows for b in waiting):
                yield block(pa.Table.from_batches(waiting))

        return packed

    order = [F.desc("norm"), F.asc("id"), F.asc("row")]
    lane_rows = LANE_BLOCKS * block_rows
    sorted_rows = rows.drop("asks").repartitionByRange(-(-total // lane_rows), *order).sortWithinPartitions(*order)
    blocks = work.keep(
        sorted_rows.mapInArrow(in_blocks(block_rows, "block"), "block long, longest double, n long, rows binary, ids binary, vectors binary"),
        "blocks",
    )
    # A lane is consecutive blocks with lane_rows rows, whatever partitions they were made in.
    lengths, before = [], 0
    for r in blocks.select("block", "longest", "n").orderBy("block").collect():
        lengths.append((r.block, r.longest, before // lane_rows))
        before += r.n
    first = blocks.filter(F.col("block") == lengths[0][0]).first()
    shared = spark.sparkContext.broadcast((rotate, *(bytes(first[c]) for c in packed_columns), lengths))

    def with_reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotate, *head, lengths = shared.value
        head_rows, head_ids, head = _unpacked_rows(*head, dims)
        longest = np.array([length for _, length, _ in lengths])
        schema = pa.schema([*((c, pa.binary()) for c in packed_columns), ("least", pa.binary()), ("lanes", pa.list_(pa.int64()))])
        for batch in batches:
            for start in range(0, batch.num_rows, query_rows):
                piece = batch.slice(start, query_rows)
                own, asked = piece.column("row").to_numpy(), _matrix(piece.column("vector"), dims)
                best = search(asked, own, np.full(len(own), -np.inf), head, head_rows, head_ids, rotate, k)
                least = np.array([best.least(i) for i in range(len(own))])
                norms = np.linalg.norm(asked.astype(np.float64), axis=1)
                # The first block whose longest vector is too short for every query of the piece.
                reach = (np.outer(norms, longest) * (1 + 1e-6) + 1e-6 >= least[:, None]).any(0)
                wanted = sorted({lengths[i][2] for i in np.flatnonzero(reach)})
                packed = _packed_rows(own, piece.column("id").to_numpy(), asked)
                yield record_batch(
                    schema, [*([v] for v in packed), [least.tobytes()], pa.array([wanted], pa.list_(pa.int64()))]
                )

    asks = rows.filter("asks").select("row", "id", "vector").mapInArrow(
        with_reach, "rows binary, ids binary, vectors binary, least binary, lanes array<long>"
    )
    asks = work.keep(asks, "queries")
    groups = max(1, -(-asks.count() // QUERY_GROUP))
    asks = asks.withColumn("part", F.pmod(F.xxhash64("rows"), F.lit(groups))).withColumn("lane", F.explode("lanes")).drop("lanes")
    def with_lane(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes = {block: lane for block, _, lane in shared.value[-1]}
        for batch in batches:
            yield batch.append_column("lane", pa.array([lanes[b] for b in batch.column("block").to_pylist()], pa.int64()))

    wide = blocks.drop("longest", "n").mapInArrow(with_lane, "block long, rows binary, ids binary, vectors binary, lane long")
    wide = wide.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def meet(asked: pa.Table, lane: pa.Table) -> pa.Table:
        schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        blocks = [_unpacked_rows(*(r[c] for c in packed_columns), dims) for r in lane.sort_by("block").to_pylist()]
        parts = []
        for left in asked.to_pylist():
            own, own_ids, queries = _unpacked_rows(*(left[c] for c in packed_columns), dims)
            least, best = np.frombuffer(left["least"]), Best(len(own), k)
            for numbers, ids, data in blocks:
                search(queries, own, least, data, numbers, ids, shared.value[0], k, best)
            found = [len(s) for s in best.scores]
            parts.append((np.repeat(own, found), np.repeat(own_ids, found), np.concatenate(best.ids), np.concatenate(best.scores)))
        if not parts:
            return schema.empty_table()
        return pa.table([np.concatenate(p) for p in zip(*parts, strict=True)], schema=schema)

    found = asks.groupBy("part", "lane").cogroup(wide.groupBy("part", "lane")).applyInArrow(meet, out)
    return found.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
