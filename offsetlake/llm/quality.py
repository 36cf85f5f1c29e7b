"""Quality rules with thresholds that adapt to each language and source.

Every document gets a few whole-text measures. Per language and source their distributions are kept
as quantile sketches: counts by bucket, where a bucket holds the integers that agree in
their seven leading bits. Such a sketch is exact below 128, within 1/64 above, has at most a few
hundred buckets, and is merged by adding counts, so Spark builds it as one partial aggregation.
The sketches are of documents that pass the base rules. A threshold is the upper quartile of the group
plus a multiple of the spread of its quartiles, or of the sketch's own resolution where they agree; a group of few
documents borrows from the merged sketch of its language. A document breaks a rule if its count is
beyond the threshold by more than counts of its size vary by chance, so a stray sign in a short text
is no outlier, and a few in every hundred words of a long one are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offsetlake.llm.common import SPACES, Work, record_batch, text_slices

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
LEADING_BITS = 7
SPREADS = 6
DEVIATIONS = 3  # of a count
FULL_GROUP = 30  # documents of a group that needs nothing from its language
# What each rule counts, per what, and how much one incident adds: a line that comes twice repeats many words.
RULES = {
    "symbol_rate": ("n_symbols", "n_words", 1),
    "dup_line_rate": ("n_dup_lines", "n_lines", 1),
    "repeat_rate": ("n_repeat_words", "n_words", 30),
    "word_length": ("word_chars", "n_words", 1),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _repeats(words: list[bytes], ends: np.ndarray) -> np.ndarray:
    """Per document, words in 3-word windows that the document has at least twice."""
    counts = np.diff(ends, prepend=0)
    repeated = np.zeros(len(ends), np.int64)
    if len(words) < 4:
        return repeated
    codes, _ = pd.factorize(np.array(words, dtype=object))
    doc = np.repeat(np.arange(len(ends)), counts)
    codes = codes.astype(np.int64)
    inside = np.flatnonzero(doc[:-2] == doc[2:])  # starts of windows within one document
    pairs, _ = pd.factorize(codes[:-1] * (int(codes.max()) + 1) + codes[1:])
    windows, _ = pd.factorize(pairs[inside].astype(np.int64) * (int(codes.max()) + 1) + codes[inside + 2])
    # The same window in another document is another window.
    keyed, uniques = pd.factorize(windows.astype(np.int64) * len(ends) + doc[inside])
    twice = inside[np.bincount(keyed, minlength=len(uniques))[keyed] > 1]
    covered = np.zeros(len(words), bool)
    for step in range(3):
        covered[twice + step] = True
    return np.bincount(doc[covered], minlength=len(ends)).astype(np.int64)


def text_measures(texts: list[str]) -> list[np.ndarray]:
    """MEASURES of whole texts."""
    words: list[bytes] = []
    ends = np.zeros(len(texts), np.int64)
    chars, symbols, lines, copies = (np.zeros(len(texts), np.int64) for _ in range(4))
    for i, text in enumerate(texts):
        words += text.encode("utf-8", "surrogatepass").split()
        ends[i] = len(words)
        chars[i] = len(text) - sum(map(text.count, SPACES))
        symbols[i] = sum(map(text.count, SYMBOLS))
        full = [line for line in text.split("\n") if line.strip(SPACES)]
        lines[i], copies[i] = len(full), len(full) - len(set(full))
    return [np.diff(ends, prepend=0), chars, symbols, lines, copies, _repeats(words, ends)]


def measure(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Key, language, source and MEASURES per document; a null text has no words.

    The columns are ``key, lang, source, text_hash`` and the measures, whatever the input calls them.
    """
    rows = documents.select(
        F.col(key).alias("key"),
        F.col(lang).alias("lang"),
        F.col(source).alias("source"),
        F.xxhash64(text).alias("text_hash"),
        F.col(text).alias("_text"),
    )
    schema = rows.drop("_text").schema
    for name in MEASURES:
        schema = schema.add(name, "long")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch, texts in text_slices(batches, "_text"):
            kept = [batch.column(i) for i in range(4)]
            values = [pa.array(v, pa.int64()) for v in text_measures(texts)]
            out = out or pa.schema([*list(batch.schema)[:4], *(pa.field(n, pa.int64()) for n in MEASURES)])
            yield record_batch(out, [*kept, *values])

    return rows.mapInArrow(measured, schema)


def bucket(value: Column) -> Column:
    """The smallest value of the sketch bucket of a non-negative integer."""
    shift = F.greatest(F.lit(0), F.length(F.bin(value)) - LEADING_BITS)
    width = F.pow(F.lit(2.0), shift).cast("long")
    return value - F.pmod(value, width)


def rates(measured: DataFrame) -> DataFrame:
    """Add the integer rates that the adaptive rules look at."""
    per = lambda part, whole: F.when(F.col(whole) > 0, F.expr(f"1000 * {part} div {whole}")).otherwise(0)
    return measured.withColumns(
        {
            "symbol_rate": per("n_symbols", "n_words"),
            "dup_line_rate": per("n_dup_lines", "n_lines"),
            "repeat_rate": per("n_repeat_words", "n_words"),
            "word_length": per("word_chars", "n_words"),
        }
    )


def sketches(rated: DataFrame, rules: Iterable[str] = RULES) -> DataFrame:
    """Quantile sketches ``lang, source, rule, bucket, rows``; sketches of parts add up.

    Counts are summed before the shuffle, so a source with a third of all rows costs no more
    than a few hundred rows a task.
    """
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), bucket(F.col(r)).alias("bucket")) for r in rules])
    return (
        rated.select("lang", "source", F.explode(pairs).alias("p"))
        .groupBy("lang", "source", F.col("p.rule").alias("rule"), F.col("p.bucket").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def limits(sketch: DataFrame, by: Sequence[str], spreads: int = SPREADS) -> DataFrame:
    """``by, rule, size, limit``: what the upper quartile and the spread of each sketch allow.

    The spread is at least the width of the sketch's bucket at the upper quartile.
    """
    group = W.partitionBy(*by, "rule")
    upto = group.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    ranked = sketch.withColumn("_upto", F.sum("rows").over(upto)).withColumn("_all", F.sum("rows").over(group))
    quartile = lambda q: F.min(F.when(4 * F.col("_upto") >= q * F.col("_all"), F.col("bucket")))
    found = ranked.groupBy(*by, "rule").agg(quartile(1).alias("low"), quartile(3).alias("high"), F.sum("rows").alias("size"))
    width = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.length(F.bin("high")) - LEADING_BITS)).cast("long")
    return found.select(*by, "rule", "size", (F.col("high") + spreads * F.greatest(F.col("high") - F.col("low"), width)).alias("limit"))


def thresholds(sketch: DataFrame, rules: Iterable[str] = RULES, spreads: int = SPREADS) -> DataFrame:
    """One row per language and source with the threshold of each rule, from their own sketch.

    A group of n < ``FULL_GROUP`` documents takes the rest of its weight from the sketch of its language, to which
    the sketches of all its sources add up.
    """
    own = limits(sketch, ["lang", "source"], spreads)
    whole = sketch.groupBy("lang", "rule", "bucket").agg(F.sum("rows").alias("rows"))
    whole = limits(whole, ["lang"], spreads).select(F.col("lang").alias("_lang"), F.col("rule").alias("_rule"), F.col("limit").alias("_limit"))
    both = own.join(whole, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("rule") == F.col("_rule")))
    weight = F.least("size", F.lit(FULL_GROUP))
    mixed = (weight * F.col("limit") + (FULL_GROUP - weight) * F.col("_limit")) / FULL_GROUP
    return both.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("rule") == r, F.floor(mixed))).alias(f"max_{r}") for r in rules], F.max("size").alias("group_size")
    )


def beyond(count: Column, size: Column, limit: Column, incident: int = 1) -> Column:
    """Is a count of things among ``size`` more than ``limit`` in a thousand, by more than chance?

    Things come in incidents of about so many, which vary like independent events, one more or less included.
    """
    size, limit = size.cast("double"), limit.cast("double")
    excess = F.lit(1000.0) * count.cast("double") - limit * size
    chance = F.lit(1000.0 * DEVIATIONS**2 * incident) * (limit * size + F.lit(1000.0 * incident))
    return (excess > 0) & (excess * excess > chance)


def judge(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    rules: Mapping[str, tuple[str, str, int]] = RULES,
    spreads: int = SPREADS,
) -> DataFrame:
    """Measures and verdict of every document: ``key, MEASURES, rates, limits, base_failed, kept``.

    ``base_failed`` marks too few words or too many repeated ones. ``kept`` is false for those and
    for documents beyond a threshold of their language and source; null languages and sources
    are groups like others. A null or empty text has no words and fails. Equal rows get equal
    verdicts, very long texts are measured whole, and other columns are left out, whatever they are called;
    an empty table gives an empty result.
    """
    work = Work(documents.sparkSession, "quality")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rated = rates(work.keep(measure(documents, key, text, lang, source), "measured")).withColumn("base_failed", failed)
    found = work.keep(thresholds(sketches(rated.filter("NOT base_failed"), rules), rules, spreads), "thresholds")
    found = found.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    over = reduce(lambda a, b: a | b, [beyond(F.col(count), F.col(size), F.col(f"max_{r}"), one) for r, (count, size, one) in rules.items()])
    return (
        rated.join(found, same, "left")
        .withColumn("kept", ~F.col("base_failed") & ~F.coalesce(over, F.lit(False)))
        .drop("_lang", "_source")
    )


def good_documents(
    documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", **options
) -> DataFrame:
    """The documents that ``judge`` keeps, with the columns of ``documents``."""
    kept = judge(documents, key, text, lang, source, **options).filter("kept")
    kept = kept.select(*(F.col(c).alias(f"__kept_{c}") for c in ("key", "lang", "source", "text_hash")))
    same = (
        documents[key].eqNullSafe(F.col("__kept_key"))
        & documents[lang].eqNullSafe(F.col("__kept_lang"))
        & documents[source].eqNullSafe(F.col("__kept_source"))
        & (F.xxhash64(documents[text]) == F.col("__kept_text_hash"))
    )
    return documents.join(kept, same, "left_semi")
