"""Language identification by a string kernel with Nyström landmarks and kernel ridge regression.

The kernel of two texts is the cosine of their n-gram presence vectors, all lengths up to ``GRAMS``
blended: |common n-grams| / sqrt(|one| * |other|). N-grams are hashed to ``BUCKETS``
presence bits. A bounded sample of labelled documents gives the landmarks; kernel values against
them, whitened by the landmarks' own kernel matrix (Nyström), are the features of one ridge regression per
language against the rest. Scoring a batch of whole texts is two matrix products.
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

from offsetlake.llm.common import record_batch, text_slices

GRAMS = 3
BITS = 13
BUCKETS = 1 << BITS
LANDMARKS = 48  # of each language
SAMPLE = 400  # labelled documents of each language that the model is fitted on
MAX_LANGUAGES = 200
RIDGE = 1e-3
SHARPNESS = 6.0
UNKNOWN = "und"
_MULTIPLIERS = tuple((0x9E3779B97F4A7C15 * (2 * n + 1)) % (1 << 64) for n in range(8))


def presence(texts: list[str]) -> np.ndarray:
    """n-gram presence of whole texts as rows of 0 and 1; a text of white space only has none.

    Lower case; every run of characters that are no letters counts as one separator, and texts begin
    and end with one.
    """
    out = np.zeros((len(texts), BUCKETS), np.float32)
    codes, rows = [], []
    for row, text in enumerate(texts):
        code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = letters(code)
        keep = letter.copy()
        keep[0] = True
        keep[1:] |= letter[:-1]  # a separator after each word, and the first one
        codes.append(np.where(letter, code, 32)[keep])
        rows.append(np.full(len(codes[-1]), row, np.int32))
    code, row = np.concatenate(codes).astype(np.uint64), np.concatenate(rows)
    flat = out.reshape(-1)
    key = np.zeros(len(code), np.uint64)
    for n in range(GRAMS):
        # key of n + 1 characters from the key of the first n
        key = key[: len(code) - n] * np.uint64(0x100000001B3) + code[n:]
        hashed = (key * np.uint64(_MULTIPLIERS[n])) >> np.uint64(64 - BITS)
        inside = row[: len(row) - n] == row[n:]
        flat[row[: len(row) - n][inside].astype(np.int64) * BUCKETS + hashed[inside].astype(np.int64)] = 1
        key = key[:-1]
    return out


_LETTER: np.ndarray | None = None


def letters(code: np.ndarray) -> np.ndarray:
    """Which code points are letters (a table of one bool per code point, made once a process)."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _LETTER[code]


def kernel(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Blended-spectrum presence kernel, normalised; 0 against a text without n-grams."""
    norm = np.sqrt(np.outer(one.sum(1), other.sum(1)))
    return (one @ other.T) / np.maximum(norm, 1)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    landmarks: np.ndarray  # presence vectors
    weights: np.ndarray  # kernel values and 1 -> one value per language

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1) of each text; ``und`` and 0 without a letter."""
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        known = np.array([bool(letters(c).any()) for c in codes], bool)
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not known.any() or not self.languages:
            return names, scores
        at = np.flatnonzero(known)
        k = kernel(presence([texts[i] for i in at]), self.landmarks)
        values = np.hstack([k, np.ones((len(at), 1), np.float32)]) @ self.weights
        odds = np.exp(SHARPNESS * (values - values.max(1, keepdims=True)))
        best = values.argmax(1)
        scores[at] = odds[np.arange(len(at)), best] / odds.sum(1)
        for i, b in zip(at, best, strict=True):
            names[i] = self.languages[b]
        return names, scores


def labelled_sample(labelled: DataFrame, key: str, text: str, lang: str, per_language: int, seed: int) -> DataFrame:
    """``text, lang, draw`` of at most ``per_language`` rows of each language, by a seeded hash.

    Keys and hashes are ranked, no texts; equal rows count once. The few chosen keys are broadcast, at most
    ``per_language`` of at most ``MAX_LANGUAGES`` languages, and texts stay where they are. More languages are refused.
    """
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(text).alias("hash")
    )
    draw = F.xxhash64(F.lit(seed), "key", "hash")
    first = W.partitionBy("lang").orderBy("draw", "key", "hash")
    ranked = rows.select("key", "lang", "hash").distinct().withColumn("draw", draw).withColumn("rank", F.row_number().over(first))
    most = per_language * MAX_LANGUAGES
    chosen = ranked.filter(F.col("rank") <= per_language).drop("rank").limit(most + 1).toArrow()
    languages = len(set(chosen.column("lang").to_pylist()))
    if languages > MAX_LANGUAGES or chosen.num_rows > most:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    side = labelled.sparkSession.createDataFrame(chosen, ranked.drop("rank").schema)
    same = rows["key"].eqNullSafe(side["key"]) & (rows["lang"] == side["lang"]) & (rows["hash"] == side["hash"])
    return rows.join(F.broadcast(side), same).select(rows["text"], rows["lang"], "draw")


def fit(
    labelled: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample: int = SAMPLE,
    landmarks: int = LANDMARKS,
    ridge: float = RIDGE,
    seed: int = 0,
) -> Model:
    """Fit on at most ``sample`` documents of each language, texts and languages not null.

    Executors turn the sampled whole texts into presence bits; the driver gets at most
    ``sample * MAX_LANGUAGES`` rows of 1 KiB and solves a system of the size of the
    landmarks. More languages than ``MAX_LANGUAGES`` are refused. Without any labelled row the model
    knows no language and answers ``und``.
    """
    rows = labelled_sample(labelled, key, text, lang, sample, seed)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("draw", pa.int64()), ("bits", pa.binary())])
        for batch, texts in text_slices(batches, "text", 1_000_000):
            packed = [np.packbits(p.astype(bool)).tobytes() for p in presence(texts)]
            yield record_batch(schema, [batch.column("lang"), batch.column("draw"), packed])

    found = rows.mapInArrow(bits, "lang string, draw long, bits binary").distinct().toArrow().to_pandas()
    found = found.sort_values(["lang", "draw", "bits"], kind="stable").reset_index(drop=True)
    languages = tuple(sorted(found["lang"].unique()))
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; at most {MAX_LANGUAGES} are supported")
    if not languages:
        return Model((), np.zeros((0, BUCKETS), np.float32), np.zeros((1, 0), np.float32))
    x = np.unpackbits(np.frombuffer(b"".join(found["bits"]), np.uint8)).reshape(len(found), BUCKETS).astype(np.float32)
    rank = found.groupby("lang").cumcount().to_numpy()
    marks = x[rank < landmarks]
    # Nyström: features k(x, marks) K^(-1/2); directions without weight are left out.
    value, vector = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    use = value > 1e-6 * value.max()
    whiten = vector[:, use] / np.sqrt(value[use])
    features = np.hstack([kernel(x, marks) @ whiten, np.ones((len(x), 1))])
    aim = np.array([[1.0 if a == b else -1.0 for b in languages] for a in found["lang"]])
    # Each language weighs the same, however many documents it has.
    share = (1 / found.groupby("lang")["lang"].transform("size").to_numpy(float))[:, None] / len(languages)
    penalty = ridge * np.eye(features.shape[1])
    penalty[-1, -1] = 0
    solved = np.linalg.solve(features.T @ (share * features) + penalty + 1e-12 * np.eye(len(penalty)), features.T @ (share * aim))
    weights = np.vstack([whiten @ solved[:-1], solved[-1:]])
    return Model(languages, marks, weights.astype(np.float32))


def predict(documents: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Documents with two more columns: the language of the whole text, and a score from 0 to 1.

    ``und`` and 0 for a null text or one without a letter. Texts are read whole, however long; equal texts get equal
    answers (ties go to the first language), repeated rows stay, and an empty table gives an empty result. Documents
    that have a column of one of the new names already are refused. Nothing is shuffled; the model, a few
    hundred vectors of fixed size, travels as a broadcast variable.
    """
    taken = {c.lower() for c in documents.columns} & {lang_pred.lower(), score.lower()}
    if taken:
        raise ValueError(f"the documents have columns {sorted(taken)}; name the new ones otherwise")
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, texts in text_slices(batches, text, 1_000_000):
            for start in range(0, len(texts), 256):
                names, scores = model.decide(texts[start : start + 256])
                part = batch.slice(start, 256)
                out = pa.schema([*batch.schema, (lang_pred, pa.string()), (score, pa.float64())])
                yield record_batch(out, [*part.columns, pa.array(names), pa.array(scores)])

    fields = [*documents.schema.fields, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())]
    return documents.mapInArrow(decided, T.StructType(fields))


def known_documents(documents: DataFrame, model: Model, text: str = "text", least_score: float = 0.0, lang: str | None = None) -> DataFrame:
    """The documents whose text has a language: not ``und``, and a score of at least ``least_score``.

    They keep their columns, whatever these are called; null, empty and letterless texts go, repeated rows stay. A column
    named by ``lang`` holds the language of the text instead of what it held before.
    """
    columns = documents.columns
    if lang is not None and lang not in columns:
        raise ValueError(f"the documents have no column {lang}")
    free = lambda name: name if name not in {c.lower() for c in columns} else free(name + "_")
    lang_pred, score = free("_lang_pred"), free("_score")
    named = predict(documents, model, text, lang_pred, score)
    known = named.filter((F.col(lang_pred) != UNKNOWN) & (F.col(score) >= least_score))
    return known.select(*[F.col(lang_pred).alias(c) if c == lang else F.col(c) for c in columns])
