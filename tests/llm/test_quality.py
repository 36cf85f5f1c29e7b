import random
import re
from collections import Counter

from offsetlake.llm import quality
from tests.llm.hard import documents, hard_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if twice[w] > 1 for k in range(3)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines),
        sum(line in lines[:i] for i, line in enumerate(lines)),
        len(covered),
    )


def test_measures_equal_brute_force():
    draw = random.Random(4)
    texts = ["", " ", "a", "a b", "a a a a", "a b c a b c", "x\ny\nx\n\n \nx", "é* # \x1c\xa0  b\x0bc"]
    for _ in range(60):
        texts.append("".join(draw.choice(["a ", "b ", "c\n", "dé ", "#", "\t", "a\n"]) for _ in range(draw.randint(0, 60))))
    got = list(zip(*(v.tolist() for v in quality.text_measures(texts)), strict=True))
    assert got == [brute(t) for t in texts]


def test_buckets_are_exact_below_128_and_within_a_64th_above(spark):
    values = [*range(300), 999, 1000, 12_345, 10**9, 2**40 + 12345]
    frame = spark.createDataFrame([(v,) for v in values], "v long")
    for r in frame.select("v", quality.bucket(frame["v"]).alias("b")).collect():
        assert r.b <= r.v < r.b + max(1, r.b / 64 + 1)
        assert r.v >= 128 or r.b == r.v


def test_sketches_of_parts_add_up(spark):
    rows = [(lang, s, i * 7 % 900, i, i, i) for i in range(200) for lang in ("en", None) for s in ("a", None)]
    schema = "lang string, source string, symbol_rate long, dup_line_rate long, repeat_rate long, word_length long"
    frame = spark.createDataFrame(rows, schema)
    parts = [quality.sketches(frame.filter(f"symbol_rate % 2 = {i}")) for i in (0, 1)]
    merged = parts[0].unionByName(parts[1]).groupBy("lang", "source", "rule", "bucket").agg({"rows": "sum"})
    whole = sorted(map(tuple, quality.sketches(frame).collect()), key=repr)
    assert sorted(map(tuple, merged.collect()), key=repr) == whole


def test_thresholds_adapt_to_language_and_source(spark):
    clean = "one two three four five six seven eight nine ten "
    unique = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    rows = [(i, unique(i, 80), "en", "plain") for i in range(40)]
    rows += [(100 + i, unique(i, 80).replace(" w", " # w"), "en", "code") for i in range(40)]
    rows += [(200, unique(200, 80).replace(" w", " # w"), "en", "plain"), (201, clean * 20, "en", "plain")]
    got = {r.key: r for r in quality.judge(documents(spark, rows)).collect()}
    assert all(got[i].kept for i in range(40)) and all(got[100 + i].kept for i in range(40))
    assert not got[200].kept and not got[200].base_failed
    assert got[201].base_failed and not got[201].kept


def words(i, n):
    return " ".join(f"w{i}x{k}" for k in range(n))


def test_a_group_decides_by_its_own_sketch(spark):
    """Far below any cutoff that suits all sources: 5 signs in 100 words, where no other text has one."""
    signs = lambda i, n, every: " ".join(w + "#" * (k % every == 0) for k, w in enumerate(words(i, n).split()))
    rows = [(i, words(i, 200), "en", "plain") for i in range(60)] + [(100 + i, signs(i, 200, 20 + i % 3), "en", "code") for i in range(60)]
    rows += [(300, signs(300, 400, 20), "en", "plain"), (301, signs(301, 60, 40), "en", "plain"), (302, signs(302, 400, 2), "en", "code")]
    got = {r.key: r for r in quality.judge(documents(spark, rows)).collect()}
    assert all(got[i].kept for i in range(60)) and all(got[100 + i].kept for i in range(60))
    assert got[300].symbol_rate == 50 and not got[300].kept
    # Two signs in a short text are chance; half of all words are an outlier anywhere.
    assert got[301].kept and not got[302].kept


def test_small_groups_borrow_from_their_language(spark):
    bulk = [(i, words(i, 100), "en", "bulk") for i in range(90)]
    few = [(200 + i, words(i, 100).replace(" w", " # w"), "en", "few") for i in range(3)]
    rated = quality.rates(quality.measure(documents(spark, bulk + few)))
    found = {r.source: r for r in quality.thresholds(quality.sketches(rated)).collect()}
    own = {r.source: r.limit for r in quality.limits(quality.sketches(rated), ["lang", "source"]).filter("rule = 'symbol_rate'").collect()}
    whole = quality.limits(quality.sketches(rated).groupBy("lang", "rule", "bucket").agg({"rows": "sum"}).withColumnRenamed("sum(rows)", "rows"), ["lang"])
    lang = whole.filter("rule = 'symbol_rate'").first().limit
    assert found["bulk"].max_symbol_rate == own["bulk"] == quality.SPREADS and found["bulk"].group_size == 90
    assert found["few"].max_symbol_rate == (3 * own["few"] + 27 * lang) // 30 < own["few"]


def test_documents_that_fail_the_base_rules_set_no_threshold(spark):
    rows = [(i, words(i, 100), "en", "s") for i in range(40)] + [(100 + i, "# " * 30, "en", "s") for i in range(200)]
    rows += [(500, words(500, 300).replace(" w", " #w"), "en", "s")]
    got = {r.key: r for r in quality.judge(documents(spark, rows)).collect()}
    assert got[500].max_symbol_rate == quality.SPREADS and not got[500].kept and got[0].kept


def test_chance_is_that_of_incidents(spark):
    rows = [(10, 1000, 6), (16, 1000, 6), (17, 1000, 6), (3, 100, 6), (6, 100, 6), (0, 0, 6), (5, 0, 0)]
    frame = spark.createDataFrame(rows, "c long, n long, l long")
    for one in (1, 5):
        for r in frame.select("c", "n", "l", quality.beyond(frame.c, frame.n, frame.l, one).alias("b")).collect():
            mean = r.l * r.n / 1000
            assert r.b == (r.c > mean and (r.c - mean) ** 2 > quality.DEVIATIONS**2 * one * (mean + one))


def test_hard_rows(spark):
    frame = documents(spark, hard_rows())
    got = quality.judge(frame).collect()
    assert len(got) == len(hard_rows())
    by_text = {(r.key, r.lang, r.source): brute(t) for r in got for k, t, la, s in hard_rows() if (k, la, s) == (r.key, r.lang, r.source)}
    for r in got:
        if r.key is not None:
            assert tuple(r[m] for m in quality.MEASURES) == by_text[r.key, r.lang, r.source]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    good = quality.good_documents(frame)
    assert good.columns == frame.columns
    assert good.count() == sum(r.kept for r in got)
    assert quality.judge(frame.limit(0)).collect() == []
    assert quality.good_documents(frame.limit(0)).collect() == []
