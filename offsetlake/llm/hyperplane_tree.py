"""Exact searches in windows of inner products, in a multiway hyperplane tree.

All rows get one more coordinate that brings them to one length. Then the distance of a query to a row
depends on their inner product alone, and a window of products is an annulus around the query. A
node of the tree has several split points and deals rows out to the nearest one, so its children are
separated by hyperplanes. Each split point stores the range of its distances to the rows of every
sibling. A child whose range, seen from any split point, cannot meet the annulus is eliminated with all
below it; rows of leaves that are left are compared exactly, in integers.

The split points come from a bounded sample; every row is in the tree. Ranges are minima and maxima that
tasks take of their own rows. Leaves are stored in blocks, however large they are, and blocks in lanes
of bounded size: one task takes one lane and one group of queries, and carries thresholds from block to
block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offsetlake.llm.common import Work, record_batch
from offsetlake.llm.top_k import _matrix

SAMPLE_ROWS = 8192  # rows that split points and first thresholds are taken from
BRANCHES = 16
LEAF_SAMPLE = 48  # a node with fewer rows of the sample is a leaf
MAX_LEVELS = 4
BLOCK_ROWS = 4096
LANE_ROWS = 32_768
QUERY_ROWS = 512
QUERY_GROUP = 64  # query blocks that meet a lane in one task
NO_LOW, NO_HIGH = -(1 << 62), 1 << 62


@dataclass(frozen=True)
class Node:
    points: np.ndarray  # split points, one row each, with the added coordinate
    children: tuple[int, ...]  # another node, or -1 - leaf


def distances(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    square = (one**2).sum(1)[:, None] + (other**2).sum(1) - 2 * (one @ other.T)
    return np.sqrt(np.maximum(square, 0))


def lifted(vectors: np.ndarray, square: float) -> np.ndarray:
    """Rows with one more coordinate, all of the squared length ``square``."""
    x = vectors.astype(np.float64)
    rest = np.sqrt(np.maximum(square - (x**2).sum(1), 0))
    return np.hstack([x, rest[:, None]])


def far_points(rows: np.ndarray, count: int) -> np.ndarray:
    """Rows far from one another: each next one is farthest from those chosen before."""
    chosen = [int(((rows - rows.mean(0)) ** 2).sum(1).argmax())]
    nearest = distances(rows, rows[chosen])[:, 0]
    while len(chosen) < count and nearest.max() > 1e-6 * (1 + np.abs(rows).max()):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, distances(rows, rows[chosen[-1:]])[:, 0])
    return np.array(chosen)


class Tree:
    """Split points of all nodes, and the distance ranges once they are known."""

    def __init__(self, sample: np.ndarray, branches: int = BRANCHES, leaf_sample: int = LEAF_SAMPLE, levels: int = MAX_LEVELS):
        self.nodes: list[Node | None] = []
        self.leaves = 0
        self.branches = branches
        self._grow(sample, leaf_sample, levels)
        shape = (len(self.nodes), branches, branches)
        self.low, self.high = np.full(shape, np.inf), np.full(shape, -np.inf)

    def _grow(self, rows: np.ndarray, leaf_sample: int, levels: int) -> int:
        points = rows[far_points(rows, self.branches)] if levels and len(rows) >= leaf_sample else rows[:0]
        if len(points) < 2:
            self.leaves += 1
            return -self.leaves
        at = len(self.nodes)
        self.nodes.append(None)
        nearest = distances(rows, points).argmin(1)
        children = tuple(self._grow(rows[nearest == i], leaf_sample, levels - 1) for i in range(len(points)))
        self.nodes[at] = Node(points, children)
        return at

    def place(self, rows: np.ndarray, widen: bool = False) -> np.ndarray:
        """The leaf of every row; with ``widen`` the ranges on its way take it in."""
        leaf = np.zeros(len(rows), np.int64)
        waiting = [(0, np.arange(len(rows)))] if self.nodes else []
        while waiting:
            at, mine = waiting.pop()
            if not len(mine):
                continue
            node = self.nodes[at]
            away = distances(rows[mine], node.points)
            nearest = away.argmin(1)
            for j, child in enumerate(node.children):
                inside = nearest == j
                if not inside.any():
                    continue
                if widen:
                    size = len(node.points)
                    self.low[at, :size, j] = np.minimum(self.low[at, :size, j], away[inside].min(0))
                    self.high[at, :size, j] = np.maximum(self.high[at, :size, j], away[inside].max(0))
                if child < 0:
                    leaf[mine[inside]] = -1 - child
                else:
                    waiting.append((child, mine[inside]))
        return leaf

    def alive(self, queries: np.ndarray, inner: np.ndarray, outer: np.ndarray, slack: np.ndarray) -> np.ndarray:
        """Per query and leaf: can a row there lie in the query's annulus?

        A row of child j is between low and high away from split point i, so the triangle inequality
        bounds its distance to the query from both sides, for every i.
        """
        out = np.zeros((len(queries), self.leaves), bool)
        if not self.nodes:
            out[:] = True
            return out
        waiting = [(0, np.arange(len(queries)))]
        while waiting:
            at, mine = waiting.pop()
            node = self.nodes[at]
            size = len(node.points)
            away = distances(queries[mine], node.points)[:, :, None]
            low, high = self.low[at, :size, :size], self.high[at, :size, :size]
            least = np.maximum(away - high, low - away).max(1)
            most = (away + high).min(1)
            stays = (least <= (outer + slack)[mine, None]) & (most >= (inner - slack)[mine, None])
            for j, child in enumerate(node.children):
                kept = mine[stays[:, j]]
                if not len(kept):
                    continue
                if child < 0:
                    out[kept, -1 - child] = True
                else:
                    waiting.append((child, kept))
        return out


@dataclass
class Asks:
    """Queries of one block: own row, label, vector, window of scores."""

    ask: np.ndarray
    uid: np.ndarray
    label: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray


def best_in(asks: Asks, active: np.ndarray, uids: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, same: bool, k: int, best: dict) -> None:
    """Take the rows that lie in the windows of the active queries into ``best``; raises their lower ends."""
    q, c = asks.vectors[active], vectors
    size = np.sqrt((q.astype(np.float64) ** 2).sum(1).max(initial=0) * (c.astype(np.float64) ** 2).sum(1).max(initial=0))
    # Sums of products below 2 ** 53 are exact in floating point, whatever their order.
    scores = (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64) if size < 2**53 else q @ c.T
    fits = (scores >= asks.low[active, None]) & (scores <= asks.high[active, None])
    fits &= (asks.label[active, None] == labels) == same
    fits &= asks.uid[active, None] != uids
    for row in np.flatnonzero(fits.any(1)):
        at, hit = int(active[row]), fits[row]
        old_scores, old_ids = best.get(at, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        found, names = np.concatenate([old_scores, scores[row, hit]]), np.concatenate([old_ids, ids[hit]])
        order = np.lexsort((names, -found))[:k]
        best[at] = found[order], names[order]
        if len(order) == k:
            asks.low[at] = max(asks.low[at], int(found[order[-1]]))


@dataclass(frozen=True)
class Index:
    """A tree, where its rows are stored, and the sample."""

    tree: Tree
    square: float  # of the longest row
    dims: int
    blocks: DataFrame  # lane, leaf, uids, ids, labels, vectors
    lanes: tuple[np.ndarray, ...]  # the leaves of each lane
    sample: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # uids, ids, labels, vectors


def _ints(data: bytes, dims: int | None = None) -> np.ndarray:
    found = np.frombuffer(data, "<i8")
    return found if dims is None else found.reshape(-1, dims)


def numbered(rows: DataFrame, work: Work, key: str, label: str, vector: str) -> DataFrame:
    """``uid, id, label, vector, square`` of the rows that have a key, a label and a vector; written once.

    Rows that repeat a key, or everything, are rows of their own.
    """
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    found = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<long>").alias("vector"))
    found = found.filter("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").withColumn("square", square)
    return work.keep(found.withColumn("uid", F.monotonically_increasing_id()), "rows")


def build(rows: DataFrame, work: Work, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS, lane_rows: int = LANE_ROWS, **shape) -> Index | None:
    """Index all rows of ``numbered``; None if there is none.

    The driver holds the sample, the split points and ranges, and one number per block.
    """
    spark = rows.sparkSession
    top = rows.agg(F.max("square").alias("square"), F.max(F.size("vector")).alias("dims")).first()
    if top.dims is None:
        return None
    square, dims = float(top.square), max(1, int(top.dims))
    drawn = rows.orderBy(F.xxhash64("id", "label", "vector"), "id", "uid").limit(sample_rows).select("uid", "id", "label", "vector").toArrow().combine_chunks()
    sample = (*(drawn.column(n).to_numpy() for n in ("uid", "id", "label")), _matrix(drawn.column("vector"), dims))
    tree = Tree(lifted(sample[3], square), **shape)
    shared = spark.sparkContext.broadcast(tree)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        mine.low[:], mine.high[:] = np.inf, -np.inf
        for batch in batches:
            mine.place(lifted(_matrix(batch.column("vector"), dims), square), widen=True)
        cell = np.flatnonzero(np.isfinite(mine.low.ravel()))
        schema = pa.schema([("cell", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])
        yield record_batch(schema, [cell, mine.low.ravel()[cell], mine.high.ravel()[cell]])

    found = rows.select("vector").mapInArrow(ranges, "cell long, low double, high double").groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
    cells = found.column("cell").to_numpy()
    tree.low.ravel()[cells], tree.high.ravel()[cells] = found.column("low").to_numpy(), found.column("high").to_numpy()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            schema = schema or pa.schema([*batch.schema, ("leaf", pa.int64())])
            yield record_batch(schema, [*batch.columns, shared.value.place(lifted(_matrix(batch.column("vector"), dims), square))])

    narrow = rows.select("uid", "id", "label", "vector")
    leaves = narrow.mapInArrow(placed, T.StructType([*narrow.schema.fields, T.StructField("leaf", T.LongType())]))
    order = [F.asc("leaf"), F.asc("uid")]
    # By the row as well, so that a leaf with a third of all rows is dealt out to many tasks.
    ordered = work.keep(leaves, "leaves").repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = work.keep(ordered.mapInArrow(_in_blocks(block_rows, dims), "block long, leaf long, n long, uids binary, ids binary, labels binary, vectors binary"), "blocks")
    lane, filled, lanes, of_block = -1, lane_rows, [], []
    for r in sorted(blocks.select("leaf", "block", "n").collect()):
        if filled >= lane_rows:
            lane, filled = lane + 1, 0
            lanes.append(set())
        filled += r.n
        lanes[lane].add(r.leaf)
        of_block.append((r.block, lane))
    places = spark.createDataFrame(of_block, "block long, lane long")
    return Index(tree, square, dims, blocks.join(places, "block").drop("block", "n"), tuple(np.array(sorted(s)) for s in lanes), sample)


def _in_blocks(size: int, dims: int):
    """Consecutive rows of one leaf in one row, at most ``size`` of them."""
    names = ("uids", "ids", "labels", "vectors")
    schema = pa.schema([(n, pa.int64()) for n in ("block", "leaf", "n")] + [(n, pa.binary()) for n in names])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        leaf, waiting, held = None, [], 0

        def block():
            table = pa.Table.from_batches(waiting)
            plain = [table.column(n).to_numpy().astype("<i8").tobytes() for n in ("uid", "id", "label")]
            data = _matrix(table.column("vector"), dims).astype("<i8").tobytes()
            return record_batch(schema, [[number], [leaf], [held], *([v] for v in plain), [data]])

        for batch in batches:
            of = batch.column("leaf").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1), batch.num_rows]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                while start < end:
                    if waiting and (of[start] != leaf or held >= size):
                        yield block()
                        number, waiting, held = number + 1, [], 0
                    leaf = int(of[start])
                    take = min(end - start, size - held)
                    waiting.append(batch.slice(start, take))
                    held, start = held + take, start + take
        if waiting:
            yield block()

    return packed


def search(index: Index, asks: DataFrame, work: Work, same: bool, k: int, name: str, query_rows: int = QUERY_ROWS, query_group: int = QUERY_GROUP) -> DataFrame:
    """``ask, rank, id, score``: the first k rows of each window, higher scores first, then smaller ids.

    ``asks`` has ``ask`` (unique), ``uid`` (the own row, which is no answer), ``label``, ``vector`` and the window
    ``low, high``, both ends inside. Answers have the same label, or with ``same`` off another one. All are
    returned if there are fewer than k.
    """
    spark, dims, square = asks.sparkSession, index.dims, index.square
    shared = spark.sparkContext.broadcast((index.tree, index.sample, index.lanes))
    arrays = ("ask", "uid", "label", "low", "high", "vectors")

    def unpacked(row: dict) -> Asks:
        ask, uid, label, low, high = (_ints(row[n]) for n in arrays[:5])
        return Asks(ask, uid, label, _ints(row["vectors"], dims), low.copy(), high.copy())

    def with_lanes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, sample, lanes = shared.value
        schema = pa.schema([*((n, pa.binary()) for n in arrays), ("alive", pa.binary()), ("lanes", pa.list_(pa.int64()))])
        for batch in batches:
            for start in range(0, batch.num_rows, query_rows):
                part = batch.slice(start, query_rows)
                numbers = {n: part.column(n).to_numpy().astype(np.int64) for n in arrays[:5]}
                block = Asks(numbers["ask"], numbers["uid"], numbers["label"], _matrix(part.column("vector"), dims), numbers["low"], numbers["high"])
                best_in(block, np.arange(len(block.ask)), *sample, same, k, {})
                alive = reachable(square, tree, block)
                wanted = [i for i, leaves in enumerate(lanes) if alive[:, leaves].any()]
                bits = np.packbits(alive, axis=1).tobytes()
                columns = [[np.ascontiguousarray(getattr(block, n)).astype("<i8").tobytes()] for n in arrays]
                yield record_batch(schema, [*columns, [bits], pa.array([wanted], pa.list_(pa.int64()))])

    binary = ", ".join(f"{n} binary" for n in (*arrays, "alive"))
    packed = work.keep(asks.select(*arrays[:5], "vector").mapInArrow(with_lanes, f"{binary}, lanes array<long>"), f"{name}-asks")
    groups = max(1, -(-packed.count() // query_group))
    packed = packed.withColumn("part", F.pmod(F.xxhash64("ask", "uid"), F.lit(groups)).cast("long"))
    packed = packed.withColumn("lane", F.explode("lanes")).drop("lanes")
    wide = index.blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def meet(asked: pa.Table, lane: pa.Table) -> pa.Table:
        schema = pa.schema([("ask", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
        stored = sorted(lane.to_pylist(), key=lambda r: (r["leaf"], r["uids"]))
        stored = [(r["leaf"], _ints(r["uids"]), _ints(r["ids"]), _ints(r["labels"]), _ints(r["vectors"], dims)) for r in stored]
        leaves, parts = shared.value[0].leaves, []
        for row in asked.to_pylist():
            block, best = unpacked(row), {}
            alive = np.unpackbits(np.frombuffer(row["alive"], np.uint8).reshape(len(block.ask), -1), axis=1)[:, :leaves].astype(bool)
            for leaf, *rows in stored:
                active = np.flatnonzero(alive[:, leaf])
                if len(active):
                    best_in(block, active, *rows, same, k, best)
            for at, (scores, ids) in best.items():
                parts.append((np.full(len(ids), block.ask[at]), ids, scores))
        if not parts:
            return schema.empty_table()
        return pa.table([np.concatenate(p) for p in zip(*parts, strict=True)], schema=schema)

    found = packed.groupBy("part", "lane").cogroup(wide.groupBy("part", "lane")).applyInArrow(meet, "ask long, id long, score long")
    ranks = W.partitionBy("ask").orderBy(F.desc("score"), "id")
    return work.keep(found.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= k), name)


def reachable(square: float, tree: Tree, asks: Asks) -> np.ndarray:
    """Per query and leaf: may the leaf hold a row of the window?"""
    plain = asks.vectors.astype(np.float64)
    own = (plain**2).sum(1)
    away = lambda score: np.sqrt(np.maximum(own + square - 2.0 * score, 0))
    inner, outer = away(asks.high.astype(np.float64)), away(asks.low.astype(np.float64))
    slack = 1e-5 * (1 + np.sqrt(own) + np.sqrt(square))
    alive = tree.alive(np.hstack([plain, np.zeros((len(plain), 1))]), inner, outer, slack)
    alive[asks.low > asks.high] = False
    return alive
