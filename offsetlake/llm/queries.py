"""One query per operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offsetlake.llm import filter_audit, hard_negatives, langid, mixing, near_dup, packing, pu_quality, quality, token_files, top_k, toxicity, warc
from offsetlake.llm.common import Work, remainder, table, word_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


@query
def op1_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives in the shared folder and read back from them."""
    path = f"{Work(spark, 'warc').path}/archives"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    found = warc.resolved(warc.read_archives(spark, path, payloads=False))
    return found.select(
        warc.page_key("record_id").try_cast("long").alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        warc.page_key("refers_to").try_cast("long").alias("refers_to"),
        "problem",
    )


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by their words, in sequences of the permitted lengths; one row per piece."""
    documents = table(spark, sf_dir, "documents").select("doc_id", word_count("text").alias("n_words"))
    return packing.pack(documents, "n_words")


@query
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op4_packed_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = token_files.packed_documents(documents, tokenizer_path(), end_id=1)
    return found.withColumnRenamed("key", "doc_id")


@query
def op5_norm_sorted_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    vectors = embeddings.select("vec_id", top_k.integers(F.col("embedding")).alias("vector"))
    return top_k.top_k(vectors, F.col("vec_id") % 20 == 0, k=20)


@query
def op6_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, from flat files whose documents end with <|endoftext|>."""
    documents = table(spark, sf_dir, "documents")
    found = token_files.scanned_documents(documents, tokenizer_path(), separator=49407)
    return found.withColumnRenamed("key", "doc_id")


@query
def op7_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality.judge(table(spark, sf_dir, "documents"))
    return verdicts.select(
        F.col("key").alias("doc_id"),
        *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"),
        *("symbol_rate", "dup_line_rate", "repeat_rate", "word_length", "base_failed", "kept"),
    )


@query
def op8_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = remainder("doc_id", 5) == 0
    model = toxicity.fit(documents, labels.filter(~held_out))
    found = toxicity.score(documents, model)
    return found.withColumn("held_out", held_out).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query
def op9_icws_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document, named after its smallest doc_id."""
    return near_dup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    model = langid.fit(documents.filter(~held_out))
    named = langid.predict(documents.select("doc_id", "text"), model)
    return named.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from all documents, in each of their orders."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op12_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = remainder("doc_id", 4) == 2
    model = pu_quality.fit(documents.filter(~held_out), labels.filter(~held_out))
    found = pu_quality.score(documents, model)
    return found.withColumn("held_out", held_out).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = rows.select("vec_id", label.alias("label"), top_k.integers(F.col("embedding"), 256.0).alias("vector"))
    return hard_negatives.mine(vectors, F.col("id") % 100 == 0)


oracle(
    "op1_warc_segments",
    """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to,
       CAST(NULL AS VARCHAR) AS problem
FROM f
""",
)

oracle(
    "op5_norm_sorted_top_k",
    """
WITH good AS (
  SELECT row_number() OVER () AS rid, vec_id,
         list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM good q JOIN good c ON c.rid <> q.rid WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
""",
)

QUALITY_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT rid, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols
  FROM docs),
word AS (SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM split),
windows AS (
  SELECT rid, i, w || ' ' || lead(w, 1) OVER s || ' ' || lead(w, 2) OVER s AS g
  FROM word WINDOW s AS (PARTITION BY rid ORDER BY i)),
twice AS (
  SELECT rid, i FROM windows WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
repeated AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid),
measured AS (
  SELECT d.rid, d.doc_id, d.lang, d.source, len(words) AS n_words, word_chars, n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM docs d JOIN split s USING (rid) LEFT JOIN repeated r USING (rid)),
rated AS (
  SELECT *, CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END AS symbol_rate,
         CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_line_rate,
         CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeat_rate,
         CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END AS word_length
  FROM measured),
failing AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM rated),
valued AS (
  SELECT f.rid, lang, source, base_failed, r.rule, CAST(r.c AS DOUBLE) AS c, CAST(r.n AS DOUBLE) AS n, r.v, r.one
  FROM failing f, LATERAL (VALUES
    ('symbol_rate', n_symbols, n_words, symbol_rate, 1), ('dup_line_rate', n_dup_lines, n_lines, dup_line_rate, 1),
    ('repeat_rate', n_repeat_words, n_words, repeat_rate, 30), ('word_length', word_chars, n_words, word_length, 1)) AS r(rule, c, n, v, one)),
buckets AS (
  SELECT lang, source, rule, v - v % CAST(pow(2, greatest(0, length(ltrim(bin(v), '0')) - {bits})) AS BIGINT) AS b
  FROM valued WHERE NOT base_failed),
ranked AS (
  SELECT *, count(*) OVER (PARTITION BY lang, source, rule ORDER BY b) AS upto, count(*) OVER (PARTITION BY lang, source, rule) AS total,
         count(*) OVER (PARTITION BY lang, rule ORDER BY b) AS l_upto, count(*) OVER (PARTITION BY lang, rule) AS l_total
  FROM buckets),
quartiles AS (
  SELECT lang, source, rule, count(*) AS size, min(b) FILTER (WHERE 4 * upto >= total) AS low, min(b) FILTER (WHERE 4 * upto >= 3 * total) AS high
  FROM ranked GROUP BY ALL),
l_quartiles AS (
  SELECT lang, rule, min(b) FILTER (WHERE 4 * l_upto >= l_total) AS l_low, min(b) FILTER (WHERE 4 * l_upto >= 3 * l_total) AS l_high
  FROM ranked GROUP BY ALL),
limits AS (
  SELECT q.lang, source, q.rule, floor((least(size, {full}) * (high + {spreads} * greatest(high - low,
           CAST(pow(2, greatest(0, length(ltrim(bin(high), '0')) - {bits})) AS BIGINT)))
         + ({full} - least(size, {full})) * (l_high + {spreads} * greatest(l_high - l_low,
           CAST(pow(2, greatest(0, length(ltrim(bin(l_high), '0')) - {bits})) AS BIGINT)))) / CAST({full} AS DOUBLE)) AS most
  FROM quartiles q JOIN l_quartiles l ON q.rule = l.rule AND q.lang IS NOT DISTINCT FROM l.lang),
outliers AS (
  SELECT DISTINCT v.rid FROM valued v JOIN limits l
  ON v.rule = l.rule AND v.lang IS NOT DISTINCT FROM l.lang AND v.source IS NOT DISTINCT FROM l.source
  WHERE CAST(1000 AS DOUBLE) * c - most * n > 0
    AND (CAST(1000 AS DOUBLE) * c - most * n) * (CAST(1000 AS DOUBLE) * c - most * n) > CAST({chance} * one AS DOUBLE) * (most * n + 1000 * one))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, symbol_rate, dup_line_rate,
       repeat_rate, word_length, base_failed, NOT base_failed AND o.rid IS NULL AS kept
FROM failing r LEFT JOIN outliers o USING (rid)
"""
oracle(
    "op7_adaptive_quality",
    QUALITY_SQL.replace("{bits}", str(quality.LEADING_BITS))
    .replace("{spreads}", str(quality.SPREADS))
    .replace("{full}", str(quality.FULL_GROUP))
    .replace("{chance}", str(1000 * quality.DEVIATIONS**2)),
)

oracle(
    "op11_filter_audit",
    r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS again FROM docs),
failed AS (
  SELECT doc_id, part,
         CASE WHEN len(words) < 100 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN again THEN 'E' ELSE '' END AS fails
  FROM split),
says AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
cells AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic
  FROM failed LEFT JOIN says USING (doc_id) GROUP BY ALL),
letters(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (
  SELECT filter_order, CAST(step AS INT) AS step, substr(filter_order, CAST(step AS INT), 1) AS f,
         '[' || substr(filter_order, 1, CAST(step AS INT) - 1) || '0]' AS before
  FROM orders, range(1, 6) AS r(step)),
counted AS (
  SELECT part, filter_order, step, f,
         sum(CASE WHEN NOT gone AND NOT bad THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND bad THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone AND bad THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND bad THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND bad THEN toxic ELSE 0 END) AS toxic_lost
  FROM (SELECT *, contains(fails, f) AS bad, regexp_matches(fails, before) AS gone FROM cells, steps) GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
""",
)

oracle(
    "op13_hard_negatives",
    """
WITH good AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         CAST(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, c.rid AS other, c.vec_id, a.label = c.label AS same,
         CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM good a JOIN good c ON a.rid <> c.rid WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor, anchor_id, other, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, other) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.vec_id, n.other) AS INT) AS rank,
       n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same
 AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY rank <= 10
""",
)
