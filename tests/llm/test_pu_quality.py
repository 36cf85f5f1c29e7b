"""Learning from positives and unlabelled text: risk, prior, held-out labels, hard rows."""

import numpy as np
import pytest
from llm import hard

from offsetlake.llm import pu_quality
from offsetlake.llm.common import crc_remainder

SF = "/root/testdata/sf0.01"


def two_kinds(prior, n=4000, dims=6, seed=1):
    """Positives, and unlabelled rows of which a share ``prior`` are positive."""
    draw = np.random.default_rng(seed)
    good = lambda k: draw.normal(1.0, 1.0, (k, dims))
    bad = lambda k: draw.normal(-1.0, 1.0, (k, dims))
    k = int(prior * n)
    return good(n // 2), np.vstack([good(k), bad(n - k)]), np.arange(n) < k


def test_risk_is_that_of_labelled_negatives():
    """With many rows the estimate without negatives equals the risk of the true ones."""
    draw = np.random.default_rng(0)
    margins = draw.normal(0, 2, 200_000)
    good = draw.random(200_000) < 1 / (1 + np.exp(-margins))
    a, b = pu_quality.non_negative_risk(margins[good], margins, good.mean())
    loss = np.logaddexp(0, np.where(good, -margins, margins))
    assert a + b == pytest.approx(loss.mean(), rel=0.01)
    assert b == pytest.approx(np.logaddexp(0, margins[~good]).sum() / len(margins), rel=0.01)


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.85])
def test_prior_and_posterior(prior):
    positive, unlabelled, good = two_kinds(prior)
    weights, bias, _ = pu_quality.minimise(positive, unlabelled, 0.5, 0)
    assert pu_quality.estimated_prior(positive @ weights + bias, unlabelled @ weights + bias) == pytest.approx(prior, abs=0.05)
    weights, bias, history = pu_quality.minimise(positive, unlabelled, prior, 0)
    score = 1 / (1 + np.exp(-(unlabelled @ weights + bias)))
    assert ((score > 0.5) == good).mean() > 0.98 and history[-1] < history[0] and min(history) >= 0
    # Scores are probabilities: their mean is the prior.
    assert score.mean() == pytest.approx(prior, abs=0.05)


def test_negative_estimates_are_not_followed():
    """Few rows of many dimensions could drive the estimate of the negative risk far below zero."""
    draw = np.random.default_rng(2)
    positive, unlabelled = draw.normal(0, 1, (30, 400)), draw.normal(0, 1, (60, 400))
    weights, bias, _ = pu_quality.minimise(positive, unlabelled, 0.7, 0)
    assert pu_quality.non_negative_risk(positive @ weights + bias, unlabelled @ weights + bias, 0.7)[1] > -0.2
    free = pu_quality.STEP_BACK
    try:
        pu_quality.STEP_BACK = -1.0  # goes on downhill: the unbiased risk
        loose, other, _ = pu_quality.minimise(positive, unlabelled, 0.7, 0)
    finally:
        pu_quality.STEP_BACK = free
    assert pu_quality.non_negative_risk(positive @ loose + other, unlabelled @ loose + other, 0.7)[1] < -0.5


def test_shape_grams_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    draw = np.random.default_rng(3)
    texts = ["".join(draw.choice(list("aB1 .\n$é"), 5000)) for _ in range(3)] + ["", "a", "aaaa" * 30, "a1" * 40]
    whole = pu_quality.features(texts)
    for piece in (1, 2, 3, 64):
        monkeypatch.setattr(pu_quality, "PIECE", piece)
        assert np.allclose(pu_quality.features(texts), whole)


def test_held_out_labels(spark):
    documents, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    mine = [r.doc_id for r in documents.select("doc_id").collect() if crc_remainder(r.doc_id, 4) != 2]
    train = spark.createDataFrame([(i,) for i in mine], "doc_id long")
    model = pu_quality.fit(documents.join(train, "doc_id"), labels.join(train, "doc_id"))
    truth = {r.doc_id: r.quality for r in labels.collect() if crc_remainder(r.doc_id, 4) == 2}
    share = np.mean([r.quality for r in labels.collect()])
    assert model.prior == pytest.approx(share, abs=0.08)
    scores = {r.doc_id: r.score for r in pu_quality.score(documents, model).collect()}
    assert len(scores) == documents.count()
    good, bad = ([scores[i] for i, q in truth.items() if q == one] for one in (1, 0))
    assert np.mean([s >= 0.7 for s in good]) > 0.95 and np.mean([s < 0.7 for s in bad]) > 0.85


def test_labels_of_zero_are_never_used(spark):
    documents, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    one = pu_quality.fit(documents, labels)
    other = pu_quality.fit(documents, labels.filter("quality = 1"))
    assert np.array_equal(one.weights, other.weights) and one.prior == other.prior


def test_hard_rows(spark):
    rows = hard.hard_rows()
    documents = hard.documents(spark, rows)
    labels = spark.createDataFrame([(1, 1), (5, 1), (5, 0), (6, None), (None, 1), (77, 1)], "doc_id long, quality int")
    model = pu_quality.fit(documents, labels)
    again = pu_quality.fit(documents.repartition(7), labels.repartition(3))
    assert np.allclose(model.weights, again.weights)
    found = pu_quality.score(documents, model)
    assert found.columns == ["doc_id", "score"]
    got = found.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_text = {}
    for row, r in zip(sorted(rows, key=repr), sorted(((x.doc_id, x.score) for x in got), key=repr), strict=True):
        by_text.setdefault(row[0], set()).add(round(r[1], 9))
    assert len(by_text[5]) == 1 and len(by_text[1]) == 1


def test_without_positives_or_rows(spark):
    documents = hard.documents(spark, hard.hard_rows())
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = pu_quality.fit(documents, none)
    assert {r.score for r in pu_quality.score(documents, model).collect()} == {0.5}
    empty = documents.limit(0)
    assert pu_quality.score(empty, pu_quality.fit(empty, none)).collect() == []


def test_samples_are_bounded(spark):
    documents = spark.range(300).selectExpr("id AS doc_id", "concat('text number ', id) AS text")
    labels = documents.selectExpr("doc_id", "1 AS quality")
    seen = []
    real = pu_quality.learn
    try:
        pu_quality.learn = lambda p, u, seed: seen.append((len(p), len(u))) or real(p, u, seed)
        pu_quality.fit(documents, labels, positives=40, unlabelled=90)
    finally:
        pu_quality.learn = real
    assert seen == [(40, 90)]
