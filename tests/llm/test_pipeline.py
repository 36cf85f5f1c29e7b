import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from offsetlake.llm import langid, mixing, near_dup, packing, quality
from tests.llm.test_mixing import words
from tests.llm.test_near_dup import brute_classes, edited
from tests.llm.test_packing import check
from tests.llm.test_quality import brute


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    draw = random.Random(11)
    rows = []
    stems = {"en": ["the", "ing", "tion", "er", "wh"], "fr": ["eau", "oux", "que", "é", "ment"]}
    for i in range(120):
        lang = draw.choice(list(stems))
        base = ["".join(draw.choices(stems[lang], k=draw.randint(1, 4))) for _ in range(draw.choice([20, 80, 200]))]
        rows.append((" ".join(base), lang, draw.choice(["a", "b", None])))
        if i % 10 == 0:
            rows += [(edited(draw, base, 1), lang, "b"), (" ".join(base), lang, "a")]
    rows += [(None, "en", "a"), ("", "en", "a"), ("123 456", "en", "b"), ("so so so " * 40, "en", "a")]
    place = str(tmp_path_factory.mktemp("sf"))
    data = [(i, t, la, s, len(t or "")) for i, (t, la, s) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(data, schema).write.parquet(f"{place}/documents.parquet")
    return place


def test_each_stage_on_what_the_one_before_it_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id",
        "quality_rules",
        "minhash_near_dedup",
        "source_mixing",
        "best_fit_packing",
    ]
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, spark.createDataFrame(before, docs.schema), sf_dir)
        after = frame.collect()
        if name == "best_fit_packing":
            check(after, [(r.doc_id, words(r.text)) for r in before], packing.CAPACITIES)
            break
        assert frame.columns == columns
        kept = {r.doc_id for r in after}
        if name == "language_id":
            assert kept == {r.doc_id for r in before if any(c.isalpha() for c in r.text or "")}
        if name == "quality_rules":
            failed = {r.doc_id for r in before if (m := brute(r.text))[0] < quality.MIN_WORDS or 2 * m[5] > m[0]}
            assert not kept & failed and len(kept) > 0.9 * len(before) - len(failed)
        if name == "minhash_near_dedup":
            classes = brute_classes([(r.doc_id, r.text) for r in before])
            assert sorted(r.doc_id for r in after) == sorted(set(classes.values()))
            assert len(kept) < len(before)
        if name == "source_mixing":
            copies = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(before, docs.schema)).collect()}
            assert sorted(r.doc_id for r in after) == sorted(k for k, n in copies.items() for _ in range(n))
        before = after


def test_language_stage_hands_on_the_language_that_it_found(spark, sf_dir):
    """Documents without a label, or with a wrong one, go on with the language of their text, by which the rules after it group them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    for label in (None, "en", "xx"):
        frame = corpus_pipeline.language_id(spark, docs.withColumn("lang", F.lit(label).cast("string")), sf_dir)
        found = {r.doc_id: r.lang for r in frame.collect()}
        assert frame.schema.names == docs.columns and found.keys() == truth.keys()
        assert np.mean([found[k] == truth[k] for k in truth]) > 0.95
    with pytest.raises(ValueError, match="no column"):
        langid.known_documents(docs.drop("lang"), langid.fit(docs), lang="lang")


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and all(r.length <= r.capacity for r in rows)


def test_near_dup_stage_weighs_common_passages_little(spark):
    """Two texts that differ in footers which a fifth of the texts have are one document; those with the footers alone stay."""
    named = lambda name, n: [f"{name}{i}" for i in range(n)]
    footers = [named("first", 14), named("second", 14)]
    texts = [" ".join(named(f"own{k}x", 20) + footers[k % 2] * (k % 5 < 2)) for k in range(1000)]
    texts += [" ".join(named("body", 100) + footer) for footer in footers]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.minhash_near_dedup(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(1001))


def test_near_dup_stage_weighs_passages_of_few_texts_by_their_frequency(spark):
    """Two texts that differ in footers which one text in 67 has are one document; each passage weighs by its own frequency."""
    named = lambda name, n: [f"{name}{i}" for i in range(n)]
    footers = [named("first", 13), named("second", 13)]
    texts = [" ".join(named(f"own{k}x", 20) + (footers[k % 2] if k % 67 < 2 else [])) for k in range(2010)]
    texts += [" ".join(named("body", 100) + footer) for footer in footers]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    weights = near_dup.corpus_weights(docs.selectExpr("md5(text) AS id", "text"), len(texts))
    assert weights.each(near_dup.shingles([" ".join(footers[0])])[0]) == pytest.approx(np.log2(1 + 2011 / 31), abs=0.1)
    kept = corpus_pipeline.minhash_near_dedup(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(2011))
