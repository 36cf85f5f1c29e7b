"""Quality scores learned from trusted positives and unlabelled web text.

Nobody labels bad pages: the model sees documents that are known to be good, and a sample of all
others, good and bad. With the share of good ones among them, the class prior, the risk of a
classifier can be written without negatives: pi * R_p(+1) + R_u(-1) - pi * R_p(-1). Its last two terms
estimate a risk of negatives, which is never below zero; a flexible model that drives the estimate there is
stopped by taking max(0, .) and, below zero, a step back (non-negative risk estimation).

The prior is estimated first. A ranking by a model of positives against unlabelled text has a region
at its top where positives are purest; the share of unlabelled text there over that of positives, plus what
small samples allow, bounds the prior from above, and the least such bound is the estimate.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offsetlake.llm.common import record_batch, text_slices

POSITIVES = 3000  # labelled documents the model is fitted on, at most
UNLABELLED = 6000  # other documents of the corpus
GRAM_BITS = 10
SHAPES = 14
DIMS = (1 << GRAM_BITS) + SHAPES
EPOCHS = 60
BATCHES = 12
RATE = 0.02
RIDGE = 2e-4
STEP_BACK = 0.5
CONFIDENCE = 0.1
FOLDS = 2
PIECE = 1 << 20  # bytes of a text whose shapes are held at once
CLIP = 6.0  # standard deviations
SIGNS = b"#$%&*|<>{}[]\\~^=_@+"
MARKS = b".,;:!?'\"()-"
DIGITS = b"0123456789"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Quality does not depend on a language: n-grams are those of shapes, not of letters.
_SHAPE = np.zeros(256, np.uint64)
for _bytes, _code in (
    (range(ord("a"), ord("z") + 1), 1),
    (range(ord("A"), ord("Z") + 1), 2),
    (range(ord("0"), ord("9") + 1), 3),
    (range(128, 256), 4),
    (b" \t\x0b\x0c\r", 5),
    (b"\n", 6),
):
    for _one in _bytes:
        _SHAPE[_one] = _code
for _one in range(33, 127):
    if _SHAPE[_one] == 0:
        _SHAPE[_one] = 8 + _one


def _shape_grams(data: bytes) -> np.ndarray:
    """Logarithms of the shares of hashed shape n-grams; runs of one shape count as one.

    A long text goes through in pieces, each with the two shapes before it.
    """
    out = np.zeros(1 << GRAM_BITS, np.float32)
    before = np.zeros(0, np.uint64)
    for start in range(0, len(data), PIECE):
        shape = _SHAPE[np.frombuffer(data[start : start + PIECE], np.uint8)]
        shape = np.concatenate([before, shape])
        shape = shape[np.concatenate([[True], shape[1:] != shape[:-1]])]
        for n, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xD1342543DE82EF95), (3, 0xA0761D6478BD642F)):
            # Those that end before this piece are counted already.
            first = max(0, len(before) - n + 1)
            if len(shape) - first < n:
                continue
            key = np.zeros(len(shape) - n + 1 - first, np.uint64)
            for i in range(n):
                key = key * np.uint64(257) + shape[first + i : len(shape) - n + 1 + i]
            at = ((key + np.uint64(n)) * np.uint64(factor)) >> np.uint64(64 - GRAM_BITS)
            out += np.bincount(at.astype(np.int64), minlength=len(out)).astype(np.float32)
        before = shape[-2:]
    total = out.sum()
    return np.log1p(100 * out / total) if total else out


def features(texts: list[str]) -> np.ndarray:
    """One row per whole text: what its characters, words and lines look like, in rates.

    No feature grows with the length of a text, and none depends on single words.
    """
    out = np.zeros((len(texts), DIMS), np.float32)
    for row, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass")
        out[row, SHAPES:] = _shape_grams(data)
        words = data.split()
        n, chars, size = len(words), max(1, len(text)), len(data)
        counts = Counter(words)
        distinct = len(counts)
        pairs = len(set(zip(words, words[1:], strict=False)))
        lines = [line for line in data.split(b"\n") if line.strip()]
        out[row, :SHAPES] = [
            1.0,
            n < 20,
            n < 50,
            distinct / max(1, n),
            # Long texts repeat more words than short ones by chance; the root takes most of that out.
            min(1.0, distinct / max(1.0, 4 * n**0.5)),
            pairs / max(1, n - 1),
            np.log1p(100 * (size - len(data.translate(None, SIGNS))) / chars),
            np.log1p(100 * (size - len(data.translate(None, MARKS))) / chars),
            np.log1p(100 * (size - len(data.translate(None, DIGITS))) / chars),
            (size - len(data.translate(None, UPPER))) / chars,
            1 - len(set(lines)) / max(1, len(lines)),
            np.log1p(chars / max(1, n)) / 4,
            np.log1p(100 * (data.count(b"http") + data.count(b"www")) / max(1, n)),
            max(counts.values(), default=0) / max(1, n),
        ]
    return out


def scaled(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features as multiples of their spread; a single odd one cannot decide alone."""
    return np.clip((x - centre) / scale, -CLIP, CLIP)


@dataclass(frozen=True)
class Model:
    """A linear model of scaled features; its score estimates the probability of quality."""

    weights: np.ndarray
    bias: float
    centre: np.ndarray
    scale: np.ndarray
    prior: float
    history: list[float] = field(default_factory=list, compare=False)

    def margins(self, x: np.ndarray) -> np.ndarray:
        return scaled(x, self.centre, self.scale) @ self.weights + self.bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -40, 40)))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def non_negative_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """Risk of the positives, and the unbiased estimate of that of the negatives, by logistic loss."""
    of_positives = prior * float(_softplus(-positive).mean())
    of_negatives = float(_softplus(unlabelled).mean()) - prior * float(_softplus(positive).mean())
    return of_positives, of_negatives


def minimise(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int, epochs: int = EPOCHS) -> tuple[np.ndarray, float, list[float]]:
    """Weights and bias of least non-negative risk, by Adam over mini-batches of both samples.

    In a batch whose estimate of the negative risk is below zero, the step goes up that term, by
    ``STEP_BACK`` of the rate: the model has begun to fit single documents.
    """
    draw = np.random.default_rng(seed)
    theta, first, second = (np.zeros(positive.shape[1] + 1) for _ in range(3))
    history, step = [], 0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for epoch in range(epochs):
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        parts = zip(np.array_split(draw.permutation(len(positive)), BATCHES), np.array_split(draw.permutation(len(unlabelled)), BATCHES), strict=True)
        for p, u in parts:
            if not len(p) or not len(u):
                continue
            xp, xu = positive[p], unlabelled[u]
            zp, zu = xp @ theta[:-1] + theta[-1], xu @ theta[:-1] + theta[-1]
            gradient = lambda x, slope: np.append(x.T @ slope, slope.sum()) / len(x)
            of_negatives = gradient(xu, sigmoid(zu)) - prior * gradient(xp, sigmoid(zp))
            if non_negative_risk(zp, zu, prior)[1] >= 0:
                slope = -prior * gradient(xp, sigmoid(-zp)) + of_negatives
            else:
                slope = -STEP_BACK * of_negatives
            slope[:-1] += RIDGE * theta[:-1]
            step += 1
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
            theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        a, b = non_negative_risk(positive @ theta[:-1] + theta[-1], unlabelled @ theta[:-1] + theta[-1], prior)
        history.append(a + max(0.0, b))
    return theta[:-1], float(theta[-1]), history


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = CONFIDENCE) -> float:
    """The share of positives among the unlabelled, from held-out margins of both.

    For every threshold, share of unlabelled above / share of positives above is at least the prior, and
    equal to it where no negative lies. The threshold of the least upper confidence bound is taken.
    """
    if not len(positive) or not len(unlabelled):
        return 0.5
    cuts = np.unique(np.quantile(positive, np.linspace(0, 1, 201)))
    above = lambda z: 1 - np.searchsorted(np.sort(z), cuts, side="left") / len(z)
    slack = lambda n: np.sqrt(np.log(4 / confidence) / (2 * n))
    p, u = above(positive), above(unlabelled)
    usable = p > 0
    bound = (u[usable] + slack(len(unlabelled)) + slack(len(positive))) / p[usable]
    best = int(bound.argmin())
    return float(np.clip(u[usable][best] / p[usable][best], 0.01, 0.99))


def learn(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 0) -> Model:
    """A model from the features of both samples, rows in a fixed order.

    Without positives or unlabelled rows, every score is the prior of one half.
    """
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(DIMS), 0.0, np.zeros(DIMS), np.ones(DIMS), 0.5)
    everything = np.vstack([positive, unlabelled]).astype(np.float64)
    centre, scale = everything.mean(0), everything.std(0)
    # Rare n-grams would get weights from a handful of documents.
    scale = np.maximum(np.where(scale > 1e-6, scale, 1.0), 0.05)
    p, u = scaled(positive, centre, scale), scaled(unlabelled, centre, scale)
    held_p, held_u = [], []
    for fold in range(FOLDS):
        one, other = np.arange(len(p)) % FOLDS == fold, np.arange(len(u)) % FOLDS == fold
        if one.all() or other.all() or not one.any() or not other.any():
            continue
        weights, bias, _ = minimise(p[~one], u[~other], 0.5, seed, EPOCHS // 3)
        held_p.append(p[one] @ weights + bias)
        held_u.append(u[other] @ weights + bias)
    prior = estimated_prior(np.concatenate(held_p), np.concatenate(held_u)) if held_p else 0.5
    weights, bias, history = minimise(p, u, prior, seed)
    return Model(weights, bias, centre, scale, prior, history)


def fit(
    documents: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
    seed: int = 0,
) -> Model:
    """Learn from documents labelled 1 and from documents of any kind, at most so many of each.

    Both are drawn by seeded hashes of the key, over all of ``documents`` and ``labels``. Labels of 0 are not
    looked at; a document with several labels is positive if one says so. Rows without a key take no part; a
    null text counts as empty. Of rows that repeat a key all take part in the order of their texts, up to the bounds.
    Executors turn whole texts into features; the driver gets those of the two samples.
    """
    says = labels.filter(F.col(key).isNotNull() & (F.col(label) == 1)).select(F.col(key).alias("key")).distinct()
    ids = documents.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"))
    draws = F.xxhash64(F.lit(seed), "key", "hash")
    first = lambda rows, most, name: (
        rows.withColumn("draw", draws).orderBy("draw", "key", "hash").limit(most).select("key", "hash", "draw", F.lit(name).alias("kind"))
    )
    chosen = first(ids.join(says, "key", "left_semi"), positives, 1).unionByName(first(ids, unlabelled, 0))
    # Never more rows than the two bounds, so the broadcast is small.
    chosen = documents.sparkSession.createDataFrame(chosen.toArrow(), chosen.schema)
    rows = documents.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text")).join(F.broadcast(chosen.distinct()), ["key", "hash"])

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.int32()), ("draw", pa.int64()), ("x", pa.binary())])
        for batch, texts in text_slices(batches, "text", 1_000_000):
            found = [row.tobytes() for row in features(texts).astype("<f2")]
            yield record_batch(schema, [batch.column("kind"), batch.column("draw"), found])

    found = rows.select("kind", "draw", "text").mapInArrow(seen, "kind int, draw long, x binary").toArrow().to_pandas()
    found = found.sort_values(["kind", "draw", "x"], kind="stable")
    matrix = lambda kind, most: np.frombuffer(b"".join(found["x"][found["kind"] == kind][:most]), "<f2").reshape(-1, DIMS).astype(np.float32)
    return learn(matrix(1, positives), matrix(0, unlabelled), seed)


def score(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score`` of every whole text: the estimated probability of quality, 0 to 1.

    Null and empty texts are scored like any other, as a text without words. Equal texts have equal scores,
    and repeated rows stay. Very long texts are scored whole. Other columns are dropped, whatever they are
    called; an empty table gives an empty result. Nothing is shuffled; the model is a few kilobytes.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col(key).alias(key), F.col(text).alias("_text"))
    schema = rows.select(key).schema.add("score", "double")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "_text", 1_000_000):
            # As in training, where features travel in half precision.
            values = shared.value.scores(features(texts).astype("<f2").astype(np.float32)) if texts else np.zeros(0)
            out = pa.schema([batch.schema.field(0), ("score", pa.float64())])
            yield record_batch(out, [batch.column(0), values])

    return rows.mapInArrow(scored, schema)
