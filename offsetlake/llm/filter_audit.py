"""What each of several filters removes, alone and in every order, and whom that hits.

Five conditions look at whole texts; the last of them, a repeated text, needs all documents. Tasks
insert their texts into compressed radix tries first: a terminal holds the smallest id of its text, so
every other row there is a repeat already, and a text leaves a task once however often the task
has it. What is left is dealt out by ranges of adaptive prefixes: beginnings that many bytes share
are lengthened until they are told apart, so a passage that a third of all texts begin with is no hot
range. There tries hold whole texts again, and their terminals decide the rest. Each document
is then a mask of five bits, and all orders are sums over the counts of masks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offsetlake.llm.common import Work, record_batch, slices
from offsetlake.llm.tries import Trie

FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")
MIN_WORDS = 100
DISTINCT_PERCENT = 80
UPPER_PERCENT = 10
SIGNS = b"#$%&*|"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TRIE_BYTES = 32_000_000  # text that a trie of one task holds at once
PREFIXES = (16, 64, 256, 1024, 4096, 16_384, 65_536)  # characters that a beginning is lengthened to


def text_mask(text: bytes, code_points: int) -> int:
    """The bits of the conditions A to D that a whole text fails."""
    words = text.split()
    mask = len(words) < MIN_WORDS
    mask |= (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
    mask |= (100 * (len(text) - len(text.translate(None, UPPER))) > UPPER_PERCENT * code_points) << 2
    return mask | (len(text.translate(None, SIGNS)) != len(text)) << 3


def _repeated(key: int | None, least: int | None) -> bool:
    return key is not None and least is not None and least < key


def candidates(documents: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """``key, part, mask, n, text, bytes``; rows that a task knows to be repeats carry no text.

    ``n`` counts equal rows. A task holds about ``TRIE_BYTES`` of text; a text that comes again after
    that leaves the task again.
    """
    rows = documents.select(
        F.col(key).cast("long").alias("key"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    out = pa.schema([("key", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64()), ("text", pa.string()), ("bytes", pa.int64())])

    def flushed(trie: Trie) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for whole, node in trie.terminals():
            firsts: dict[tuple, int] = {}
            for one, lang, mask in node.rows:
                if _repeated(one, node.least):
                    found.append((one, lang, mask | REPEATED, 1, None, 0))
                else:
                    firsts[one, lang, mask] = firsts.get((one, lang, mask), 0) + 1
            if firsts:
                decoded = whole.decode("utf-8", "surrogatepass")
                found += [(*row, n, decoded, len(whole)) for row, n in firsts.items()]
                size += len(whole) * len(firsts)
            if size > 4_000_000:
                yield record_batch(out, list(zip(*found, strict=True)))
                found, size = [], 0
        if found:
            yield record_batch(out, list(zip(*found, strict=True)))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held = Trie(), 0
        for batch in batches:
            lengths = pc.binary_length(batch.column("text")).to_numpy()
            for piece in slices(batch, lambda row, lengths=lengths: int(lengths[row]), 4_000_000):
                texts = piece.column("text").cast(pa.binary()).to_pylist()
                points = pc.utf8_length(piece.column("text")).to_pylist()
                keys, parts = piece.column("key").to_pylist(), piece.column("part").to_pylist()
                for one, lang, whole, count in zip(keys, parts, texts, points, strict=True):
                    trie.insert(whole, (one, lang, text_mask(whole, count)), one)
                    held += 100
                if trie.bytes + held > TRIE_BYTES:
                    yield from flushed(trie)
                    trie, held = Trie(), 0
        yield from flushed(trie)

    return rows.mapInArrow(local, "key long, part string, mask int, n long, text string, bytes long")


def heavy_prefixes(texts: DataFrame, most: int) -> DataFrame:
    """``level, hash`` of the beginnings that more than ``most`` bytes of text share.

    All lengths are counted in one pass, hashed, with partial sums before the shuffle. At most
    total / most beginnings of each length are heavy.
    """
    beginnings = F.array(
        *[
            F.when(F.length("text") >= length, F.struct(F.lit(length).alias("level"), F.xxhash64(F.substring("text", 1, length)).alias("hash")))
            for length in PREFIXES
        ]
    )
    each = texts.select("bytes", F.explode(F.filter(beginnings, lambda b: b.isNotNull())).alias("b"))
    return each.groupBy("b.level", "b.hash").agg(F.sum("bytes").alias("bytes")).filter(F.col("bytes") > most).select("level", "hash")


def adaptive_prefix(heavy: dict[int, list[int]]) -> Column:
    """The shortest of the beginnings that is not heavy; the whole text if all are."""
    prefix = F.col("text")
    for length in reversed(PREFIXES):
        begin = F.substring("text", 1, length)
        known = heavy.get(length, [])
        prefix = F.when(F.xxhash64(begin).isin(known), prefix).otherwise(begin) if known else begin
    return prefix


def decided(texts: DataFrame) -> DataFrame:
    """``key, part, mask, n`` of candidates that come sorted by ``prefix``, all of one prefix in one task."""
    out = pa.schema([("key", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64())])

    def flagged(trie: Trie) -> pa.RecordBatch:
        found = [
            (one, lang, mask | (REPEATED if _repeated(one, node.least) else 0), n)
            for _, node in trie.terminals()
            for one, lang, mask, n in node.rows
        ]
        return record_batch(out, list(zip(*found, strict=True)))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last, held = Trie(), None, 0
        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("key", "part", "mask", "n")]
            prefixes = batch.column("prefix").to_pylist()
            for *row, prefix, whole in zip(*columns, prefixes, batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                # Equal texts have equal prefixes, so a trie may end between two of them.
                if prefix != last and trie.bytes + held > TRIE_BYTES:
                    yield flagged(trie)
                    trie, held = Trie(), 0
                last = prefix
                trie.insert(whole, tuple(row), row[0])
                held += 100
        if trie.rows:
            yield flagged(trie)

    return texts.mapInArrow(merged, "key long, part string, mask int, n long")


def masks(documents: DataFrame, work: Work, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``key, part, mask, n``: the filters that every document fails, equal rows counted.

    Two passes over the texts: one inserts them per task, one per range of prefixes. The ranges hold about
    ``TRIE_BYTES`` each; the driver sees the hashes of heavy beginnings, at most seven times their number.
    """
    spark = documents.sparkSession
    found = work.keep(candidates(documents, key, text, part), "candidates")
    open_ones = found.filter("text is not null")
    total = open_ones.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first().n
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TRIE_BYTES))
    heavy: dict[int, list[int]] = {}
    for row in heavy_prefixes(open_ones, max(1, total // (4 * ranges))).collect():
        heavy.setdefault(row.level, []).append(row.hash)
    placed = open_ones.withColumn("prefix", adaptive_prefix(heavy)).drop("bytes")
    placed = placed.repartitionByRange(ranges, "prefix").sortWithinPartitions("prefix")
    whole = decided(placed).unionByName(found.filter("text is null").select("key", "part", "mask", "n"))
    return work.keep(whole, "masks")


def orders() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of the step's filter, bits of the filters before it) of all orders."""
    out = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            out.append((order, step, bit, before))
            before |= bit
    return out


def audit(
    documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang", good: str = "quality", toxic: str = "toxic"
) -> DataFrame:
    """``part, filter_order, step`` and the counts ``kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    One row per value of ``part`` (null: the empty string), order and step, zeros included. Null texts
    count as empty, and an empty text fails A only, or E as well. A document whose key is null is no repeat
    and makes none; of equal rows with one key none is smaller than the other. A document with several
    labels is good or toxic if one of them says so; labels without a key or document count nowhere. Very long
    texts are handled whole. Other columns of either table are ignored, whatever they are called. Without documents there is no row.
    """
    work = Work(documents.sparkSession, "filter-audit")
    one = masks(documents, work, key, text, part)
    rows = one.groupBy("key", "part", "mask").agg(F.sum("n").alias("n"))
    says = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("key")).agg(
        F.max((F.col(good) == 1).cast("long")).alias("good"), F.max((F.col(toxic) == 1).cast("long")).alias("toxic")
    )
    of = lambda name: F.sum(F.col("n") * F.coalesce(name, F.lit(0)))
    counts = rows.groupBy("part", "mask").agg(F.sum("n").alias("n"))
    # Rows without a key have no label; the join leaves them out.
    marked = rows.join(says, "key").groupBy("part", "mask").agg(of("good").alias("good"), of("toxic").alias("toxic"))
    cells = work.keep(counts.join(marked, ["part", "mask"], "left").fillna(0, ["good", "toxic"]), "cells")
    schema = T.StructType([T.StructField(n, t) for n, t in zip(("filter_order", "step", "bit", "before"), (T.StringType(), *[T.IntegerType()] * 3), strict=True)])
    steps = F.from_json(F.lit(_json(orders())), T.ArrayType(schema))
    each = cells.withColumn("o", F.explode(steps)).select("part", "mask", "n", "good", "toxic", "o.*")
    fails = F.col("mask").bitwiseAND(F.col("bit")) > 0
    fresh = F.col("mask").bitwiseAND(F.col("before")) == 0
    count = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    table = each.groupBy("part", "filter_order", "step", "bit").agg(
        count(fresh & ~fails).alias("kept"),
        count(fresh & fails).alias("removed"),
        count(~fresh & fails).alias("redundant"),
        count(F.col("mask") == F.col("bit")).alias("unique_fails"),
        count(fresh & fails, "good").alias("good_lost"),
        count(fresh & fails, "toxic").alias("toxic_lost"),
    )
    whole = table.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return table.join(whole, ["part", "bit"]).drop("bit")


def _json(rows: list[tuple[str, int, int, int]]) -> str:
    inner = (f'{{"filter_order":"{o}","step":{s},"bit":{b},"before":{a}}}' for o, s, b, a in rows)
    return f"[{','.join(inner)}]"
