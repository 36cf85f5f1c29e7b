import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from offsetlake.llm import langid
from offsetlake.llm.common import crc_remainder, remainder
from tests.llm.hard import documents, hard_rows

STEMS = {"aa": ["the", "and", "ing", "tion", "er"], "bb": ["der", "und", "sch", "keit", "ein"], "cc": ["le", "eau", "oux", "que", "é"]}


def corpus(n=240):
    draw = random.Random(5)
    rows = []
    for i in range(n):
        lang = draw.choice(list(STEMS))
        text = " ".join("".join(draw.choices(STEMS[lang], k=draw.randint(1, 3))) for _ in range(draw.choice([4, 30, 200])))
        rows.append((i, text, lang, "s"))
    return rows


def grams(text):
    """The n-grams whose hashes presence() marks."""
    out, run = " ", False
    for c in text.lower() + " ":
        if c.isalpha():
            out, run = out + c, True
        elif run:
            out, run = out + " ", False
    return {out[i : i + n] for n in range(1, langid.GRAMS + 1) for i in range(len(out) - n + 1)}


def test_kernel_is_the_cosine_of_presence():
    texts = ["Der Hund, der bellt.", "der hund", "the dog", "", "1 2 3", "ÉÉ é"]
    exact = [grams(t) for t in texts]
    bits = langid.presence(texts)
    got = langid.kernel(bits, bits)
    for i, a in enumerate(exact):
        for j, b in enumerate(exact):
            want = len(a & b) / np.sqrt(len(a) * len(b))
            assert abs(got[i, j] - want) < 0.12  # n-grams may share a hash


def test_documents_do_not_touch_each_other():
    texts = [r[1] for r in corpus(30)] + ["", "x"]
    one_by_one = np.concatenate([langid.presence([t]) for t in texts])
    assert (langid.presence(texts) == one_by_one).all()


def test_held_out_accuracy(spark):
    frame = documents(spark, corpus())
    model = langid.fit(frame.filter(remainder("doc_id", 4) != 2))
    truth = {r[0]: r[2] for r in corpus()}
    got = langid.predict(frame.select("doc_id", "text"), model).collect()
    held = [r for r in got if crc_remainder(r.doc_id, 4) == 2]
    assert len(held) > 30 and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95


def test_hard_rows(spark):
    model = langid.fit(documents(spark, corpus()))
    frame = documents(spark, hard_rows())
    with pytest.raises(ValueError, match="score"):
        langid.predict(frame, model)
    plain = frame.drop("score", "lang_pred")
    got = langid.predict(plain, model).collect()
    assert len(got) == len(hard_rows())
    for r in got:
        known = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r.lang_pred != "und") == known and (known or r.score == 0)
    kept = langid.known_documents(frame, model)
    assert kept.columns == frame.columns and kept.count() == sum(r.lang_pred != "und" for r in got)
    assert langid.predict(plain.limit(0), model).collect() == []
    nothing = langid.fit(frame.limit(0))
    assert {r.lang_pred for r in langid.predict(plain, nothing).collect()} == {"und"}
    # Labels without language or text teach nothing, and one language is enough to fit.
    single = langid.fit(frame.filter("lang = 'en' or lang is null"))
    assert single.languages == ("en",)


def test_result_does_not_depend_on_partitions(spark):
    frame = documents(spark, corpus(60))
    model = langid.fit(frame)
    again = langid.fit(frame.repartition(5))
    assert model.languages == again.languages and np.allclose(model.weights, again.weights, atol=1e-3)


def test_sample_is_bounded_and_texts_are_not_ranked(spark, monkeypatch):
    """Equal rows count once, rows without a text teach nothing, and too many languages are refused."""
    rows = corpus(40) + [corpus(40)[0]] * 50 + [(None, "kein schluessel", "de", "s"), (900, None, "de", "s")]
    frame = documents(spark, rows)
    found = langid.labelled_sample(frame, "doc_id", "text", "lang", 5, 0)
    assert {r.lang: r.n for r in found.distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()} == {"aa": 5, "bb": 5, "cc": 5, "de": 1}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError, match="languages"):
        langid.labelled_sample(frame, "doc_id", "text", "lang", 5, 0)


def test_the_fit_is_the_minimum_of_the_ridge_loss(spark):
    """Against a plain solution of the same problem, language by language, on the same landmarks."""
    frame = documents(spark, corpus(60))
    model = langid.fit(frame, ridge=1e-2)
    texts = [(r[1], r[2]) for r in corpus(60)]
    k = langid.kernel(langid.presence([t for t, _ in texts]), model.landmarks).astype(float)
    marks = langid.kernel(model.landmarks, model.landmarks).astype(float)
    size = Counter(lang for _, lang in texts)
    share = np.array([1 / size[lang] / len(size) for _, lang in texts])
    loss = lambda w, y: (share * (k @ w[:-1] + w[-1] - y) ** 2).sum() + 1e-2 * w[:-1] @ marks @ w[:-1]
    draw = np.random.default_rng(0)
    for column, lang in enumerate(model.languages):
        y = np.array([1.0 if one == lang else -1.0 for _, one in texts])
        w = model.weights[:, column].astype(float)
        least = loss(w, y)
        for _ in range(200):
            step = draw.normal(0, 1, len(w))
            assert loss(w + 1e-2 * step / np.linalg.norm(step), y) > least - 1e-6
    assert [model.languages[i] for i in (np.hstack([k, np.ones((len(k), 1))]) @ model.weights).argmax(1)] == model.decide([t for t, _ in texts])[0]
