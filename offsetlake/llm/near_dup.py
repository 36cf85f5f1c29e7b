"""Near-duplicate documents by improved consistent weighted sampling (ICWS).

A document is the weighted set of its five-word shingles, each weighing its count in the
document times its inverse document frequency. Two documents are near copies if their weighted
Jaccard similarity is at least 0.8. ICWS draws samples that two documents share with just that
probability; rows of samples form bands, and documents that agree in a band are candidates, which
are verified exactly. Classes are the connected components of the verified links.

Equal texts are one text from the start. A bucket of up to ``SMALL_BUCKET`` texts compares all pairs; in a larger
one each text meets the leader, the text with the most bucket mates. A bucket that this leaves in several
classes is compared in tiles: its largest class needs no comparison with itself, so blocks of the others meet one another
and blocks of that class. A tile holds each text once, multiplies sparse weights as dense columns, and returns
no pairs but a spanning forest of its links. Members of buckets beyond ``TILED`` texts get longer bands
first, which part texts that are merely alike.

Document frequencies count a large group of near copies once, by a sketch over all texts (``large_groups``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offsetlake.llm.common import Work, record_batch, text_slices
from offsetlake.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
SHORT = (12, 3)  # bands and rows: 0.9998 of the pairs at 0.8 share a band
LONG = (100, 12)  # 0.9992 of the pairs at 0.8, 0.07 of those at 0.55
# The inverse document frequency saturates below one text in 2 ** RARE_BITS, or SUPPORT texts in a smaller table (as few
# can be edits of one text that share no key with most of them). Where the texts count up to FEW,
# one in 2 ** IDF_BITS is the bound, and up to FEW texts count each: beyond it, the shingles that a large group of near
# copies shares would weigh so little against their few edits that the group would fall apart.
IDF_BITS, RARE_BITS = 2, 12
SUPPORT, FEW = 8, 256
# Keys and least hashes a key: 0.99 of the texts at 0.8 share a key, 0.02 of those at a third.
GROUP = (16, 6)
GROUP_BITS = RARE_BITS  # groups of up to one text in 2 ** GROUP_BITS count as they are: their shingles are rare
UNIT = 1 << 30  # one text, in counts that shares of a text add up to
# Cells a text that a frequent shingle is in at least; cells of a row, and bits of a count that its cell rounds up.
CELL_BITS, PLACE_BITS, ROUND_BITS = 10, 14, 24
SMALL_BUCKET = 16  # texts
TILED = 4096
BLOCK_TEXTS, BLOCK_WEIGHT = 512, 1_000_000.0  # of one side of a tile
COLUMNS = 4096

_U = np.uint64


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on all input bits."""
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


@cache
def _bytes_table() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


@cache
def _spaces() -> np.ndarray:
    spaces = np.zeros(256, bool)
    spaces[[9, 10, 11, 12, 13, 32]] = True
    return spaces


@cache
def _gamma() -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at the middles of 2 ** 16 equal steps."""
    x = np.geomspace(1e-6, 60, 400_000)
    return np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), 1 - (1 + x) * np.exp(-x), x).astype(np.float32)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words of all texts, and how many words each text has."""
    encoded = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    ends = np.cumsum([len(e) + 1 for e in encoded])
    inside = ~_spaces()[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, _U), np.zeros(len(texts), np.int64)
    firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    power = np.full(int(lengths.max()), 0x9E3779B97F4A7C15, _U)
    power[0] = 1
    values = _bytes_table()[data[inside]] * np.multiply.accumulate(power)[place]
    counts = np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(texts))
    return mixed(np.add.reduceat(values, firsts)), counts


def shingles(texts: list[str]) -> list[np.ndarray]:
    """Shingle hashes of each whole text, repeats included; fewer than five words are one shingle."""
    words, counts = word_hashes(texts)
    if not len(words):
        return [words] * len(texts)
    rolled = words.copy()
    for n in range(1, min(SHINGLE, len(words))):
        rolled[: len(words) - n] = rolled[: len(words) - n] * _U(0xA0761D6478BD642F) + words[n:]
    rolled = mixed(rolled)
    out, start = [], 0
    for count in map(int, counts):
        if count >= SHINGLE:
            out.append(rolled[start : start + count - SHINGLE + 1])
        elif count:
            short = _U(count)
            for word in words[start : start + count]:
                short = mixed(np.array([short ^ word], _U))[0]
            out.append(np.array([short], _U))
        else:
            out.append(words[:0])
        start += count
    return out


@dataclass(frozen=True)
class Weights:
    """Inverse document frequencies: of the frequent shingles one by one, and of all others."""

    frequent: np.ndarray  # sorted hashes
    idf: np.ndarray
    rest: float

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles of a document, ascending, and their weights."""
        distinct, counts = np.unique(hashes, return_counts=True)
        return distinct, counts.astype(np.float32) * self.each(distinct)

    def each(self, distinct: np.ndarray) -> np.ndarray:
        """The inverse document frequency of each shingle."""
        idf = np.full(len(distinct), self.rest, np.float32)
        if len(self.frequent):
            at = np.searchsorted(self.frequent, distinct).clip(max=len(self.frequent) - 1)
            found = self.frequent[at] == distinct
            idf[found] = self.idf[at[found]]
        return idf


def weighted_jaccard(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(one[0], other[0], assume_unique=True, return_indices=True)
    common = float(np.minimum(one[1][i], other[1][j]).sum(dtype=np.float64))
    total = float(one[1].sum(dtype=np.float64) + other[1].sum(dtype=np.float64)) - common
    return common / total if total else 0.0


def signature(distinct: np.ndarray, weights: np.ndarray, shape: tuple[int, int] = SHORT) -> np.ndarray:
    """One hash per band, of its rows of consistent weighted samples; a sample is a shingle and its level.

    For a shingle and a sample number one 64-bit hash gives r and c (Gamma(2, 1)) and b (uniform), in
    16 bits each. With t = floor(ln w / r + b), the sample is the shingle of least ln c - r (t - b + 1).
    """
    n_bands, n_rows = shape
    n = n_bands * n_rows
    # Bands of another shape draw other samples.
    seeds = np.arange(1, n + 1, dtype=_U) * _U(0xD1342543DE82EF95 + 2 * n_rows)
    best = np.full(n, np.inf, np.float32)
    sample = np.zeros(n, _U)
    column = np.arange(n)
    step = max(1, 80_000 // n)
    for start in range(0, len(distinct), step):
        h = mixed(distinct[start : start + step, None] ^ seeds)
        r = _gamma()[h & _U(0xFFFF)]
        c = np.log(_gamma())[(h >> _U(16)) & _U(0xFFFF)]
        b = ((h >> _U(32)) & _U(0xFFFF)).astype(np.float32) / np.float32(1 << 16)
        t = np.floor(np.log(weights[start : start + step, None]) / r + b)
        rank = c - r * (t - b + 1)
        at = rank.argmin(0)
        lower = rank[at, column] < best
        best[lower] = rank[at, column][lower]
        drawn = mixed(h[at, column] + t[at, column].astype(np.int64).astype(_U))
        sample[lower] = drawn[lower]
    rows = sample.reshape(n_bands, n_rows)
    band = np.arange(1, n_bands + 1, dtype=_U)
    for row in range(n_rows):
        band = mixed(band * _U(0x9E3779B97F4A7C15) + rows[:, row])
    return band


@cache
def _edges() -> np.ndarray:
    n = GROUP[0] * GROUP[1]
    return np.arange(n, dtype=_U) * _U((1 << 64) // n)


def group_keys(texts: list[np.ndarray]) -> np.ndarray:
    """Keys of each text, a row a text, of the least hashes in some of the equal ranges; an empty range takes that of the next.

    ``texts`` are distinct shingles, ascending.
    """
    least = np.zeros((len(texts), GROUP[1], GROUP[0]), _U)
    for i, distinct in enumerate(texts):
        least[i].flat = distinct.take(distinct.searchsorted(_edges()), mode="wrap")
    keys = np.arange(1, GROUP[0] + 1, dtype=_U)
    for n in range(GROUP[1]):
        keys = mixed(keys * _U(0x9E3779B97F4A7C15) + least[:, n])
    return keys


@dataclass(frozen=True)
class Groups:
    """Keys that many texts share, and how many each."""

    keys: np.ndarray  # sorted
    sizes: np.ndarray

    def shares(self, texts: list[np.ndarray]) -> np.ndarray:
        """What each text counts: ``UNIT``, or its share of that in the largest group which it has a key of."""
        if not len(self.keys) or not texts:
            return np.full(len(texts), UNIT)
        keys = group_keys(texts)
        at = np.searchsorted(self.keys, keys).clip(max=len(self.keys) - 1)
        return np.maximum(1, UNIT // np.where(self.keys[at] == keys, self.sizes[at], 1).max(1))


def large_groups(texts: DataFrame, rows: int) -> Groups:
    """The groups of near copies among all texts that are large enough to make their own shingles frequent.

    Copies agree in most ranges of hashes, so nearly all of a group share some key with its most. The result has at most
    ``GROUP[0] * 2 ** GROUP_BITS`` keys, whatever the size of the corpus.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])
        for _, part in text_slices(batches, "text", 1_000_000):
            found, n = np.unique(group_keys([np.unique(h) for h in shingles(part) if len(h)]), return_counts=True)
            yield record_batch(schema, [found.view(np.int64), n])

    counted = texts.mapInArrow(keyed, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = counted.filter(F.col("n") > max(1, rows / (1 << GROUP_BITS))).toArrow()
    keys, sizes = found.column("key").to_numpy().view(_U), found.column("n").to_numpy()
    order = np.argsort(keys)
    return Groups(keys[order], sizes[order])


def inverse_frequencies(texts: DataFrame, rows: int, bits: int = IDF_BITS, groups: Groups | None = None) -> Weights:
    """Exact document frequencies of all shingles that occur in more than ``rows / 2 ** bits`` texts.

    With ``groups`` a text counts its share in them, in the number of all texts too. First, the shingles of all texts are
    counted in 2 ** (bits + CELL_BITS) cells, rounded up, one row per task and range of cells. A cell below the bound holds
    no frequent shingle. Shingles of the others are then counted one by one. A text of n
    shingles has n of them, so at most 2 ** bits times the mean length of a text are frequent: the
    result is bounded whatever the size of the corpus.
    """
    held = groups or Groups(np.zeros(0, _U), np.zeros(0, np.int64))
    cell_bits = bits + CELL_BITS
    size = 1 << min(PLACE_BITS, cell_bits)

    def weighed(part: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
        """Distinct shingles of each text one after the other, what each counts, and what the texts count."""
        distinct = [np.unique(h) for h in shingles(part) if len(h)]
        shares = held.shares(distinct)
        each = np.repeat(shares, np.array([len(d) for d in distinct], np.int64))
        return np.concatenate([np.zeros(0, _U), *distinct]), each, int(shares.sum())

    def cell_of(found: np.ndarray) -> np.ndarray:
        return (found >> _U(64 - cell_bits)).astype(np.int64)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("at", pa.int64()), ("n", pa.int64()), ("places", pa.binary()), ("counts", pa.binary())])
        counts, total = np.zeros(1 << cell_bits, np.int64), 0
        for _, part in text_slices(batches, "text", 1_000_000):
            found, n, of = weighed(part)
            np.add.at(counts, cell_of(found), n)
            total += of
        yield record_batch(schema, [[-1], [total], [b""], [b""]])
        for start in range(0, len(counts), size):
            places = np.flatnonzero(counts[start : start + size])
            if len(places):
                some = -(-counts[start + places] >> ROUND_BITS)
                yield record_batch(schema, [[start], [0], [places.astype(np.uint16).tobytes()], [some.astype(np.uint32).tobytes()]])

    def summed(rows: pa.Table) -> pa.Table:
        """The sum of a range of cells, each as eight times its binary logarithm, rounded up."""
        sums = np.zeros(size, np.int64)
        for places, counts in zip(rows.column("places").to_pylist(), rows.column("counts").to_pylist(), strict=True):
            sums[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, np.uint32)
        levels = np.ceil(8 * np.log2(np.maximum(sums, 1))).clip(max=255).astype(np.uint8)
        return pa.table({"at": rows.column("at")[:1], "n": [sum(rows.column("n").to_pylist())], "levels": [levels.tobytes()]})

    full = texts.mapInArrow(cells, "at long, n long, places binary, counts binary").groupBy("at")
    full = full.applyInArrow(lambda rows: summed(rows), "at long, n long, levels binary").toArrow().to_pylist()
    total = rows * UNIT if groups is None else max(UNIT, sum(r["n"] for r in full))
    least = total / (1 << IDF_BITS) if total <= FEW * UNIT else max(total / (1 << bits), SUPPORT * UNIT)
    rest = float(np.log2(1 + total / least))
    wanted = np.zeros(1 << cell_bits, bool)
    for r in full:
        if r["at"] >= 0:
            level = np.frombuffer(r["levels"], np.uint8)
            # The highest level stands for all counts beyond it.
            wanted[r["at"] : r["at"] + size] = (level == 255) | (np.exp2(level / 8) * (1 + 1e-9) > least / (1 << ROUND_BITS))
    if not wanted.any():
        return Weights(np.zeros(0, _U), np.zeros(0, np.float32), rest)
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("at", pa.int64()), ("n", pa.int64())])
        wanted = np.unpackbits(shared.value).view(bool)
        for _, part in text_slices(batches, "text", 1_000_000):
            found, n, _ = weighed(part)
            some = wanted[cell_of(found)]
            one, place = np.unique(found[some], return_inverse=True)
            yield record_batch(schema, [one.view(np.int64), np.bincount(place, n[some], len(one)).astype(np.int64)])

    exact = texts.mapInArrow(frequencies, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).filter(F.col("n") > least).toArrow()
    hashes, counts = exact.column("at").to_numpy().view(_U), exact.column("n").to_numpy()
    order = np.argsort(hashes)
    return Weights(hashes[order], np.log2(1 + total / counts[order]).astype(np.float32), rest)


def corpus_weights(texts: DataFrame, rows: int) -> Weights:
    """Inverse document frequencies in which a large group of near copies counts once; see ``RARE_BITS`` and ``FEW``."""
    if rows <= FEW:
        return inverse_frequencies(texts, rows)
    return inverse_frequencies(texts, rows, RARE_BITS, large_groups(texts, rows))


def bands(texts: DataFrame, weights: Weights, shape: tuple[int, int] = SHORT) -> DataFrame:
    """``id, total`` (weight), ``band, bucket`` of every distinct text that has a word."""
    shared = texts.sparkSession.sparkContext.broadcast(weights)
    names = [f"b{n}" for n in range(shape[0])]

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, seen = shared.value, {}
        schema = pa.schema([("id", pa.string()), ("total", pa.float64()), *((n, pa.int64()) for n in names)])
        for batch, part in text_slices(batches, "text", 1_000_000):
            ids, found, totals = batch.column("id").to_pylist(), {}, []
            fresh = [i for i, one in enumerate(ids) if one not in seen]
            for i, h in zip(fresh, shingles([part[i] for i in fresh]), strict=True):
                if ids[i] not in found and len(h):
                    weighed = weights.of(h)
                    found[ids[i]] = signature(*weighed, shape).view(np.int64)
                    totals.append(float(weighed[1].sum(dtype=np.float64)))
            if len(seen) > 50_000:
                seen.clear()
            seen.update(dict.fromkeys(found))
            columns = np.array(list(found.values()), np.int64).reshape(len(found), shape[0])
            yield record_batch(schema, [list(found), totals, *columns.T])

    signs = texts.mapInArrow(signed, "id string, total double, " + ", ".join(f"{n} long" for n in names)).dropDuplicates(["id"])
    each = F.posexplode(F.array(*names)).alias("band", "bucket")
    return signs.select("id", "total", each)


def verified(pairs: DataFrame, texts: DataFrame, weights: Weights, similarity: float) -> DataFrame:
    """The pairs ``a, b`` whose texts are similar enough."""
    shared = pairs.sparkSession.sparkContext.broadcast(weights)
    schema = pa.schema([("a", pa.string()), ("b", pa.string())])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, last, left = shared.value, None, None
        for batch, ones in text_slices(batches, "text_a", 1_000_000):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            values = np.zeros(len(a))
            for i, h in enumerate(shingles(batch.column("text_b").to_pylist())):
                if a[i] != last:
                    last, left = a[i], weights.of(shingles([ones[i]])[0])
                values[i] = weighted_jaccard(left, weights.of(h))
            # Sums in another order may differ in the last bits from the bound itself.
            keep = np.flatnonzero(values >= similarity - 1e-9)
            yield record_batch(schema, [[a[i] for i in keep], [b[i] for i in keep]])

    one = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    other = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(one, "a").join(other, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(compared, "a string, b string")


def first_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a < b`` to compare first: all of small buckets, and everyone with the leader of a large one.

    The leader is the text that shares its buckets with the most others. In a group that was edited from one text, that
    text stands out by this and is similar to the most. Pairs whose total weights alone rule out the
    similarity are not compared.
    """
    other = lambda of: of.select("band", "bucket", F.col("id").alias("_id"), F.col("total").alias("_total"))
    small, large = members.filter(F.col("size") <= SMALL_BUCKET), members.filter(F.col("size") > SMALL_BUCKET)
    leaders = large.groupBy("band", "bucket").agg(F.max(F.struct("mates", "id", "total")).alias("m")).select("band", "bucket", "m.*")
    pairs = small.join(other(small), ["band", "bucket"]).filter("id < _id").unionByName(large.join(other(leaders), ["band", "bucket"]))
    near = F.least("total", "_total") >= (similarity - 1e-6) * F.greatest("total", "_total")
    both = pairs.filter((F.col("id") != F.col("_id")) & near)
    return both.select(F.least("id", "_id").alias("a"), F.greatest("id", "_id").alias("b")).distinct()


def tiles(members: DataFrame) -> DataFrame:
    """``tile, id, class``: the members of buckets with several classes, so that all pairs that matter share a tile.

    The members outside the largest class of their bucket are the rest. Blocks of the rest meet one another and
    the blocks of the largest class; a bucket that fits into one block is one tile.
    """
    shares = members.groupBy("band", "bucket", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("w"))
    sums = shares.groupBy("band", "bucket").agg(
        F.max(F.struct("n", "class", "w")).alias("m"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("classes")
    ).filter("classes > 1")
    blocks = lambda n, w: F.greatest(F.ceil(n / BLOCK_TEXTS), F.ceil(w / BLOCK_WEIGHT), F.lit(1)).cast("int")
    one = (F.col("n") <= BLOCK_TEXTS) & (F.col("w") <= BLOCK_WEIGHT)
    buckets = sums.select(
        "band", "bucket", F.col("m.class").alias("most"), one.alias("whole"),
        blocks(F.col("n") - F.col("m.n"), F.col("w") - F.col("m.w")).alias("rests"), blocks(F.col("m.n"), F.col("m.w")).alias("mains"),
    )
    placed = members.join(buckets, ["band", "bucket"])
    main = F.col("class") == F.col("most")
    block = F.pmod(F.xxhash64("id"), F.when(main, F.col("mains")).otherwise(F.col("rests"))).cast("int")
    # Of the rest: each pair of blocks i <= j; of both: each block of the rest with each of the largest class.
    steps = lambda n: F.sequence(F.lit(0), n - 1)
    among = F.transform(steps(F.col("rests")), lambda j: F.struct(F.lit(0).alias("kind"), F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    across = F.transform(steps(F.col("mains")), lambda j: F.struct(F.lit(1).alias("kind"), F.col("block").alias("i"), j.alias("j")))
    met = F.transform(steps(F.col("rests")), lambda i: F.struct(F.lit(1).alias("kind"), i.alias("i"), F.col("block").alias("j")))
    alone = F.array(F.struct(F.lit(0).alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("j")))
    wanted = F.when(F.col("whole"), alone).when(main, met).otherwise(F.concat(among, across))
    dealt = placed.withColumn("block", block).withColumn("t", F.explode(wanted))
    return dealt.select(F.struct("band", "bucket", "t.kind", "t.i", "t.j").alias("tile"), "id", "class")


def similar(texts: list[str], labels: np.ndarray, weights: Weights, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between texts of different classes.

    A shingle that occurs n times is n columns of its weight, which makes the sum of minima a product of two matrices.
    """
    sparse = [weights.of(h) for h in shingles(texts)]
    total = np.array([w.sum(dtype=np.float64) for _, w in sparse])
    row, key, value = [], [], []
    for i, (distinct, weight) in enumerate(sparse):
        counts = np.rint(weight / weights.each(distinct)).astype(np.int64)
        level = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        key.append(mixed(np.repeat(distinct, counts) + level.astype(_U) * _U(0x9E3779B97F4A7C15)))
        value.append(np.repeat(weights.each(distinct), counts))
        row.append(np.full(len(level), i, np.int32))
    row, key, value = np.concatenate(row), np.concatenate(key), np.concatenate(value)
    _, column, times = np.unique(key, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    row, value = row[shared], value[shared]
    _, column = np.unique(column[shared], return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column, value = row[order], column[order], value[order]
    common = np.zeros((len(texts), len(texts)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        low, high = np.searchsorted(column, [start, start + COLUMNS])
        dense = np.zeros((len(texts), COLUMNS), np.float32)
        dense[row[low:high], column[low:high] - start] = np.sqrt(value[low:high])
        common += dense @ dense.T
    union = np.maximum(total[:, None] + total - common, 1e-30)
    found = np.argwhere(np.triu((common / union >= similarity - 1e-3) & (labels[:, None] != labels), 1))
    root = list(range(len(texts)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    for i, j in found.tolist():
        if top(i) != top(j) and weighted_jaccard(sparse[i], sparse[j]) >= similarity - 1e-9:
            root[top(i)] = top(j)
            links.append((i, j))
    return links


def tiled_links(members: DataFrame, texts: DataFrame, weights: Weights, similarity: float) -> DataFrame:
    """Links ``a, b`` that join all classes which have similar texts in a common bucket."""
    shared = members.sparkSession.sparkContext.broadcast(weights)
    schema = pa.schema([("a", pa.string()), ("b", pa.string())])

    def compared(tile: pa.Table) -> pa.Table:
        ids, bodies = tile.column("id").to_pylist(), tile.column("text").to_pylist()
        _, labels = np.unique(np.array(tile.column("class").to_pylist()), return_inverse=True)
        links = similar(bodies, labels, shared.value, similarity)
        return pa.table([[ids[i] for i, _ in links], [ids[j] for _, j in links]], schema=schema)

    rows = tiles(members).join(texts, "id").select("tile", "id", "class", "text")
    return rows.groupBy("tile").applyInArrow(lambda tile: compared(tile), "a string, b string")


def link_texts(texts: DataFrame, work: Work, similarity: float = SIMILARITY) -> DataFrame:
    """Components ``id, component`` of the distinct texts that have a near copy.

    Three passes: small buckets and leaders; tiles of the buckets that still hold several classes; for those of more
    than ``TILED`` texts, tiles of the longer bands of their members, which tell 0.8 apart from smaller similarities more
    sharply.
    """
    weights = corpus_weights(texts, max(1, texts.count()))

    def bucketed(of: DataFrame, shape: tuple[int, int]) -> DataFrame:
        """Members of buckets of two and more: band, bucket, id, total weight and size."""
        every = work.keep(bands(of, weights, shape), f"bands{shape[1]}")
        sizes = every.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        kept = work.keep(every.join(sizes, ["band", "bucket"]), f"members{shape[1]}")
        work.drop(f"bands{shape[1]}")
        return kept

    def several(of: DataFrame, label: DataFrame) -> DataFrame:
        """Members with their classes, of the buckets that hold different ones."""
        classed = of.join(label, "id", "left").withColumn("class", F.coalesce("component", "id")).drop("component")
        ends = classed.groupBy("band", "bucket").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low <> high")
        return classed.join(ends.select("band", "bucket"), ["band", "bucket"], "left_semi")

    members = bucketed(texts, SHORT)
    copies = work.keep(texts.join(members.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]), "texts")
    mates = members.groupBy("id").agg(F.sum("size").alias("mates"))
    links = work.keep(verified(first_pairs(members.join(mates, "id"), similarity), copies, weights, similarity), "links")
    label = components(links, work, "first")
    left = work.keep(several(members.filter(F.col("size") > SMALL_BUCKET), label), "left")
    work.drop(f"members{SHORT[1]}")
    if left.isEmpty():
        return label
    more = work.keep(tiled_links(left.filter(F.col("size") <= TILED), copies, weights, similarity), "tiled")
    links = links.unionByName(more)
    wide = left.filter(F.col("size") > TILED).select("id").distinct()
    if not wide.isEmpty():
        label = components(links, work, "second")
        longer = several(bucketed(copies.join(wide, "id", "left_semi"), LONG), label)
        links = links.unionByName(work.keep(tiled_links(longer, copies, weights, similarity), "longer"))
    return components(links, work, "labels")


def classes(documents: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: ``key, class_id, text_id, component``.

    ``class_id`` is the smallest key of the documents whose texts are near copies of one
    another, directly or through others. Equal texts, repeated rows among them, are in one class, the
    empty text included. Texts of white space have no shingle and no other near copy; a
    document with a null text is a class of its own (``text_id`` and ``component`` null). Null keys are never
    a class id, unless the whole class has no key. Classes without a key, or with one smallest key, share their
    ``class_id``; ``component``, the smallest text id, tells them apart. An empty table gives an empty result.
    """
    work = Work(documents.sparkSession, "near-dup")
    rows = documents.select(F.col(key).alias("key"), F.md5(text).alias("id"))
    texts = documents.filter(F.col(text).isNotNull()).select(F.md5(text).alias("id"), F.col(text).alias("text"))
    label = link_texts(texts, work, similarity)
    named = work.keep(
        rows.groupBy("id").agg(F.min("key").alias("first")).join(label, "id", "left").withColumn("component", F.coalesce("component", "id")),
        "named",
    )
    least = named.groupBy("component").agg(F.min("first").alias("class_id"))
    found = named.filter("id is not null").join(least, "component").select("id", "class_id", "component")
    return rows.join(found, "id", "left").select(
        F.col("key").alias(key), F.when(F.col("id").isNull(), F.col("key")).otherwise(F.col("class_id")).alias("class_id"),
        F.col("id").alias("text_id"), "component",
    )


def distinct_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, that with the smallest key, null last; documents without a text all stay."""
    found = classes(documents, key, text, similarity).filter(F.col("text_id").isNotNull())
    # Other classes may have the same key, or none either.
    least = F.min(F.struct(F.col(key).isNull(), F.col(key).alias("key"), F.col("text_id").alias("id")))
    firsts = found.groupBy("component").agg(least.alias("m")).select(F.col("m.key").alias("__first_key"), F.col("m.id").alias("__first_id"))
    same = documents[key].eqNullSafe(F.col("__first_key")) & (F.md5(documents[text]) == F.col("__first_id"))
    stays = documents.join(firsts, same, "left_semi").dropDuplicates([key, text])
    return stays.unionByName(documents.filter(F.col(text).isNull()))
