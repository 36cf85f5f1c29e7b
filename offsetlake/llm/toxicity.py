"""Toxicity scores from a weighted lexicon, matched by an Aho-Corasick automaton.

Texts are folded first: case, accents, look-alike letters of other scripts, digits and signs that
stand for letters. Terms are whole words or stems at the start of a word. Those that labelled
documents tie to toxicity get their log odds as weight; a short list of common insults backs them where
labels say nothing. A match inside an exception phrase does not count. Two sums, by length of the
text and in total, give a probability by logistic regression.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import cache
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offsetlake.llm.common import record_batch, text_slices

SAMPLE = {1: 2000, 0: 4000}  # labelled documents of each class that the model is fitted on
STEMS = range(4, 8)  # letters of a stem
LEAST_DOCUMENTS = 4
LEAST_SHARE = 0.01  # of the toxic documents of the sample
LEAST_WEIGHT = 2.5
COVERED = 0.9
MAX_TERMS = 5000
SEED_WEIGHT = 3.0
SMOOTH_WORDS = 10
# Common insults, and phrases in which such words are none.
SEEDS = (
    "idiot idiots moron morons stupid trash scum loser losers pathetic worthless disgusting clown clowns "
    "imbecile dumbass bastard bitch asshole retard fuck fucking shit bullshit cunt whore slut"
).split()
EXCEPTIONS = (
    "trash can",
    "trash bag",
    "trash bin",
    "trash collection",
    "clown fish",
    "class clown",
    "circus clown",
    "idiot proof",
    "pond scum",
    "soap scum",
    "sore loser",
    "slut walk",
)
# Letters of other scripts that look like Latin ones, and what stands for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "β": "b", "ε": "e",
    "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a",
    "ɡ": "g", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}
_INNER = re.compile(r"(?<=\w)[@$!|€](?=\w)")
# Possessive from the start of a word, so that words without signs cost one look and no call.
_TOKEN = re.compile(r"(?<![\w@$!|€])\w*+[@$!|€][\w@$!|€]*")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")


@cache
def _folds() -> dict[int, str]:
    """What a code point becomes: a letter stays or turns Latin, anything else a space.

    l falls together with i, since 1 stands for either; terms are folded alike.
    """
    table = {c: " " for c in range(0x3000) if not chr(c).isalpha()}
    for c in range(0x80, 0x3000):
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)).casefold()
        if chr(c).isalpha() and plain != chr(c):
            table[c] = plain
        elif unicodedata.combining(chr(c)):
            table[c] = ""
    table |= {ord(k): v for k, v in (LOOK_ALIKES | DIGITS).items()}
    return table | {ord("l"): "i"}


def folded(text: str, known: Callable[[str], bool] | None = None) -> list[str]:
    """The folded words of a text.

    A sign between two letters stands for a letter. Signs at the start of a word or several in a row may as
    well be prices, mentions or marks, so they only do if ``known`` holds for the word that they spell.
    """
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    text = text.casefold()
    if any(sign in text for sign in SIGNS):
        text = _TOKEN.sub(lambda m: _spelled(m.group(), known), text)
    return text.translate(_folds()).split()


def _spelled(token: str, known: Callable[[str], bool] | None) -> str:
    """A run of letters and signs, with the signs that stand for letters replaced."""
    if not token.strip("".join(SIGNS)):
        return token
    plain = _INNER.sub(lambda m: SIGNS[m.group()], token)
    if known is not None and any(sign in plain for sign in SIGNS):
        word = "".join(SIGNS.get(c, c) for c in token.rstrip("".join(SIGNS)))
        if known(word.translate(_folds())):
            return f" {word} "
    return plain


def terms_of(words: Sequence[str]) -> set[str]:
    """The terms that a text could be matched by: its words, and the stems of its words."""
    found = {f" {word} " for word in words}
    for word in set(words):
        found.update(f" {word[:n]}" for n in STEMS if len(word) > n)
    return found


class Lexicon:
    """Weighted terms and exception phrases in one automaton over folded texts."""

    def __init__(self, weights: Mapping[str, float], exceptions: Sequence[str] = EXCEPTIONS):
        import ahocorasick

        self.weights = weights
        self.automaton = ahocorasick.Automaton()
        for phrase in exceptions:
            self.automaton.add_word(f" {' '.join(folded(phrase))} ", (len(" ".join(folded(phrase))) + 2, None))
        for term, weight in weights.items():
            self.automaton.add_word(term, (len(term), weight))
        self.automaton.make_automaton()

    def known(self, word: str) -> bool:
        """Would this folded word match a term?"""
        return f" {word} " in self.weights or any(f" {word[:n]}" in self.weights for n in STEMS if len(word) > n)

    def words(self, text: str) -> list[str]:
        """The folded words of a text, with signs read as letters where they spell a term."""
        return folded(text, self.known)

    def match(self, words: Sequence[str]) -> float:
        """Sum of the weights of all matched words; of several terms at a word the heaviest counts.

        Matches and exception phrases are walked through once, both by their place.
        """
        text = f" {' '.join(words)} "
        hits: dict[int, float] = {}
        excepted: list[tuple[int, int]] = []
        for end, (length, weight) in self.automaton.iter(text):
            start = end - length + 1
            if weight is None:
                excepted.append((start, end))
            elif weight > hits.get(start, 0):
                hits[start] = weight
        if not excepted:
            return sum(hits.values())
        excepted.sort()
        total, reach, i = 0.0, -1, 0
        for at in sorted(hits):
            while i < len(excepted) and excepted[i][0] <= at:
                reach = max(reach, excepted[i][1])
                i += 1
            if at >= reach:
                total += hits[at]
        return total


def features(matched: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Weight per word, damped for short texts; weight in total; and 1."""
    density = np.log1p(100 * matched / (words + SMOOTH_WORDS))
    return np.stack([density, np.log1p(matched), np.ones(len(matched))], axis=1)


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    coefficients: np.ndarray
    exceptions: tuple[str, ...] = EXCEPTIONS

    def scores(self, matched: np.ndarray, words: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(matched, words) @ self.coefficients, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the constant is not penalised."""
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.diag([1.0] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(
            (x * (share * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + penalty, x.T @ (share * (y - p)) - penalty @ beta
        )
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def needed(learned: Mapping[str, tuple[float, int]]) -> dict[str, float]:
    """Weights of the terms, without stems that hardly match more documents than one longer term."""
    order, kept = sorted(learned), {}
    for i, term in enumerate(order):
        weight, documents = learned[term]
        longer = takewhile(lambda other, term=term: other.startswith(term), order[i + 1 :])
        if all(learned[other][1] < COVERED * documents for other in longer):
            kept[term] = weight
    return kept


def fit(
    documents: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample: Mapping[int, int] = SAMPLE,
    seed: int = 0,
) -> Model:
    """Learn from labelled documents, at most ``sample[c]`` of class c by a seeded hash of the key.

    Label rows without a key or label say nothing; a document with several labels is toxic if one
    says so. Executors fold the sampled whole texts and count documents by term; the
    driver gets at most ``MAX_TERMS`` terms and two numbers a document. Without toxic or without other
    labelled documents the seeds and fixed coefficients are the model.
    """
    spark = documents.sparkSession
    marks = (
        labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1))
        .groupBy(F.col(key).alias("key"))
        .agg(F.max(F.col(label).cast("int")).alias("label"))
        .withColumn("draw", F.xxhash64(F.lit(seed), "key"))
    )
    total = {r.label: r.n for r in marks.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    limit = F.when(F.col("label") == 1, sample[1]).otherwise(sample[0])
    ranked = marks.withColumn("rank", F.row_number().over(W.partitionBy("label").orderBy("draw", "key")))
    # Never more rows than the sample, so the broadcast is bounded.
    chosen = ranked.filter(F.col("rank") <= max(sample.values())).filter(F.col("rank") <= limit).select("key", "label")
    chosen = spark.createDataFrame(chosen.toArrow(), chosen.schema)
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter(), Counter()
        seen = [0, 0]
        for batch, texts in text_slices(batches, "text", 1_000_000):
            for one, mark in zip(texts, batch.column("label").to_pylist(), strict=True):
                counts[mark].update(terms_of(folded(one)))
                seen[mark] += 1
        terms = list(counts[0].keys() | counts[1].keys())
        schema = pa.schema([("term", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())])
        yield record_batch(schema, [["", *terms], [seen[0], *(counts[0][t] for t in terms)], [seen[1], *(counts[1][t] for t in terms)]])

    counts = rows.mapInArrow(counted, "term string, clean long, toxic long").groupBy("term").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )
    counts = counts.persist()
    whole = counts.filter("term = ''").first()
    n_clean, n_toxic = (whole.clean, whole.toxic) if whole else (0, 0)
    seeds = {f" {folded(word)[0]} ": SEED_WEIGHT for word in SEEDS}
    if not n_clean or not n_toxic:
        counts.unpersist()
        return Model(seeds, np.array([2.0, 0.5, -4.0]))
    weight = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    least = max(LEAST_DOCUMENTS, LEAST_SHARE * n_toxic)
    learned = (
        counts.withColumn("weight", weight)
        .filter((F.col("term") != "") & (F.col("toxic") >= least) & (F.col("weight") >= LEAST_WEIGHT))
        .orderBy(F.desc(F.col("weight") * F.col("toxic")), "term")
        .limit(MAX_TERMS)
        .collect()
    )
    counts.unpersist()
    weights = seeds | needed({r.term: (r.weight, r.toxic) for r in learned})
    shared = spark.sparkContext.broadcast(weights)

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value)
        schema = pa.schema([("label", pa.int32()), ("matched", pa.float64()), ("words", pa.int64())])
        for batch, texts in text_slices(batches, "text", 1_000_000):
            split = [lexicon.words(one) for one in texts]
            yield record_batch(schema, [batch.column("label"), [float(lexicon.match(w)) for w in split], [len(w) for w in split]])

    seen = rows.mapInArrow(matched, "label int, matched double, words long").toArrow().to_pandas()
    y = seen["label"].to_numpy(float)
    # The classes weigh as in all labels, not as in the sample.
    share = np.where(y == 1, total[1] / max(1, y.sum()), total[0] / max(1, (1 - y).sum()))
    x = features(seen["matched"].to_numpy(), seen["words"].to_numpy())
    return Model(weights, _logistic(x, y, share / share.sum() * len(y)))


def score(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, matched, n_words, score`` of every whole text; null and empty texts match nothing.

    Nothing is shuffled. Equal texts have equal scores; an empty table gives an empty result.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col(key).alias(key), F.col(text).alias("_text"))
    schema = rows.drop("_text").schema.add("matched", "double").add("n_words", "long").add("score", "double")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        lexicon = Lexicon(model.weights, model.exceptions)
        for batch, texts in text_slices(batches, "_text", 1_000_000):
            split = [lexicon.words(one) for one in texts]
            hits, words = np.array([lexicon.match(w) for w in split], float), np.array([len(w) for w in split], np.int64)
            out = pa.schema([batch.schema.field(0), ("matched", pa.float64()), ("n_words", pa.int64()), ("score", pa.float64())])
            yield record_batch(out, [batch.column(0), hits, words, model.scores(hits, words)])

    return rows.mapInArrow(scored, schema)
