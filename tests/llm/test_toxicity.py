import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from offsetlake.llm import toxicity
from offsetlake.llm.common import crc_remainder, remainder
from tests.llm.hard import documents, hard_rows


def corpus(n=900):
    draw = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{draw.choice('abcdefgh')}{draw.choice('mnopq')}{draw.choice('uvxyz')}" for _ in range(draw.choice([8, 60, 300]))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(max(2, len(words) // 30)):
                words[draw.randrange(len(words))] = draw.choice(["idiot", "grumpf", "zorkan" + draw.choice("abcdef")])
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = corpus()
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").filter(remainder("doc_id", 5) != 0)
    return toxicity.fit(documents(spark, rows), marks)


@pytest.mark.parametrize("text", ["idiot", "IDIOT!!", "1d10t", "ídïot", "іdіоt", "i​diot", "id!ot", "ＩＤＩＯＴ"])
def test_disguises_fold_to_one_word(text):
    assert toxicity.folded(text) == toxicity.folded("idiot")


def test_signs_spell_terms_only():
    """At the start of a word or in a row signs are letters if the word is a term, else what they were."""
    weights = {f" {toxicity.folded(word)[0]} ": 3.0 for word in toxicity.SEEDS} | {" zork": 4.0}
    lexicon = toxicity.Lexicon(weights)
    for text in ("$tupid", "@sshole!!", "a$$hole", "($hit)", "so $tup!d, really", "!d!0t"):
        assert lexicon.match(lexicon.words(text)) == 3, text
    assert lexicon.match(lexicon.words("@zork zorkan$ idiot!!you")) == 4 + 4 + 3
    for text in ("$100", "@sam and @user", "wow!!great", "a|b", "!!!", "$", "me@idiotic.example", "pay $5, $tupendous"):
        assert lexicon.match(lexicon.words(text)) == 0 and lexicon.words(text) == toxicity.folded(text), text


def naive(lexicon_weights, words):
    """Every term and exception phrase at every word, one by one."""
    text = f" {' '.join(words)} "
    starts = [0, *(i for i in range(1, len(text) - 1) if text[i] == " ")]
    phrases = [f" {' '.join(toxicity.folded(phrase))} " for phrase in toxicity.EXCEPTIONS]
    spans = [(at, at + len(p) - 1) for at in starts for p in phrases if text.startswith(p, at)]
    total = 0
    for at in starts:
        weight = max((w for term, w in lexicon_weights.items() if text.startswith(term, at)), default=0)
        if not any(a <= at < b for a, b in spans):
            total += weight
    return total


def test_matching_equals_a_naive_scan():
    weights = {" trash ": 3.0, " idiot ": 2.0, " idio": 1.0, " ciown ": 2.5, " soap": 0.5, " scum ": 3.0}
    lexicon, draw = toxicity.Lexicon(weights), random.Random(5)
    pool = "trash can bag idiot idiots proof clown fish class circus soap scum pond sore loser a".split()
    for n in (0, 1, 2, 5, 40, 200):
        for _ in range(20):
            words = toxicity.folded(" ".join(draw.choice(pool) for _ in range(n)))
            assert lexicon.match(words) == pytest.approx(naive(weights, words))


def test_a_very_long_text_of_matches_takes_linear_time():
    lexicon = toxicity.Lexicon({" idiot ": 3.0, " trash ": 2.0})
    start = time.process_time()
    assert lexicon.match(lexicon.words("idiot trash can " * 100_000)) == 300_000
    assert time.process_time() - start < 20


def test_exception_phrases_and_word_ends():
    lexicon = toxicity.Lexicon({" trash ": 3.0, " ciown ": 2.0, " zork": 4.0})
    match = lambda text: lexicon.match(toxicity.folded(text))
    assert match("trash") == 3 and match("trashy") == 0 and match("the trash can") == 0
    assert match("trash can, trash!") == 3 and match("clown clown") == 4
    assert match("zorkans") == 4 and match("bazork") == 0 and match("") == 0


def test_stems_without_documents_of_their_own_go():
    learned = {" idio": (3.0, 10), " idiot ": (3.0, 10), " zork": (3.0, 30), " zorka ": (3.0, 9)}
    assert toxicity.needed(learned) == {" idiot ": 3.0, " zork": 3.0, " zorka ": 3.0}


def test_held_out_documents(spark, model):
    rows, labels = corpus()
    truth = {k: t for k, _, t in labels}
    got = toxicity.score(documents(spark, rows), model).collect()
    held = [r for r in got if crc_remainder(r.doc_id, 5) == 0]
    right = np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in held])
    assert len(held) > 100 and right > 0.97
    assert " idiot " in model.weights and any(t.startswith(" zork") for t in model.weights)


def test_length_matters(model):
    few, many = model.scores(np.array([7.0, 7.0]), np.array([10, 5000]))
    assert few > 0.5 > many


def test_hard_rows(spark, model):
    frame = documents(spark, hard_rows())
    got = toxicity.score(frame, model).collect()
    assert len(got) == len(hard_rows())
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.matched for r in got if r.doc_id in (1, 2, 3)} == {0.0}
    assert toxicity.score(frame.limit(0), model).collect() == []


def test_labels_that_teach_nothing(spark):
    rows, _ = corpus(20)
    frame = documents(spark, rows)
    marks = spark.createDataFrame([(None, 1), (1, None), (999, 1), (2, 0), (2, 0)], "doc_id long, toxic int")
    for labels in (marks, marks.limit(0), marks.filter(F.col("toxic") == 0)):
        model = toxicity.fit(frame, labels)
        assert " idiot " in model.weights
        low, high = model.scores(np.array([0.0, 9.0]), np.array([50, 50]))
        assert low < 0.5 < high
