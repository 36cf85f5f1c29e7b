import random
from collections import Counter

import numpy as np
import pytest

from offsetlake.llm import near_dup
from offsetlake.llm.common import Work
from offsetlake.llm.components import components
from tests.llm.hard import documents, hard_rows


def brute_shingles(text):
    words = (text or "").lower().encode().split()
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_classes(rows, similarity=0.8):
    """Components of all pairs of texts with a weighted Jaccard similarity of at least 0.8."""
    sets = [brute_shingles(text) for _, text in rows]
    frequency = Counter(s for one in sets for s in one)
    n = len([text for _, text in rows if text is not None])
    bits = near_dup.IDF_BITS
    idf = {s: np.log2(1 + (n / f if f > n / 2**bits else 2**bits)) for s, f in frequency.items()}
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if a is None or b is None:
                continue
            weight = lambda s, one: one[s] * idf[s]
            both = sum(min(weight(s, sets[i]), weight(s, sets[j])) for s in sets[i].keys() & sets[j].keys())
            all_ = sum(weight(s, sets[i]) for s in sets[i]) + sum(weight(s, sets[j]) for s in sets[j]) - both
            if a == b or (all_ and both / all_ >= similarity - 1e-9):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {key: min(k for i2, (k, _) in enumerate(rows) if find(i2) == find(i)) for i, (key, _) in enumerate(rows)}


def edited(draw, words, edits):
    words = list(words)
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"new{draw.random()}"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(6)
    rows = []
    for group in range(12):
        base = [f"g{group}w{draw.randrange(400)}" for _ in range(draw.choice([40, 120, 300]))]
        for _ in range(draw.choice([1, 2, 3, 6])):
            rows.append(edited(draw, base, draw.choice([0, 0, 1, 2])))
        rows.append(edited(draw, base, len(base) // 2))
    base = [f"big{draw.randrange(400)}" for _ in range(200)]
    rows += [edited(draw, base, 1) for _ in range(45)] + [" ".join(base)] * 20
    passage = " ".join(f"shared{i}" for i in range(60))
    rows += [passage + " " + " ".join(f"own{n}x{i}" for i in range(150)) for n in range(25)]
    rows += ["a b c", "A  b\nc", "a b", ""]
    draw.shuffle(rows)
    return list(enumerate(rows))


def test_classes_equal_all_pairs(spark, corpus):
    frame = documents(spark, [(k, t, "en", "s") for k, t in corpus]).repartition(3)
    got = {r.doc_id: r.class_id for r in near_dup.classes(frame).collect()}
    assert got == brute_classes(corpus)
    kept = near_dup.distinct_documents(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


@pytest.mark.parametrize("tiled", [near_dup.TILED, 20])
def test_large_buckets_are_settled_in_tiles(spark, corpus, monkeypatch, tiled):
    monkeypatch.setattr(near_dup, "SMALL_BUCKET", 1)  # every bucket is large
    monkeypatch.setattr(near_dup, "BLOCK_TEXTS", 8)
    monkeypatch.setattr(near_dup, "TILED", tiled)  # those beyond get longer bands
    frame = documents(spark, [(k, t, "en", "s") for k, t in corpus])
    got = {r.doc_id: r.class_id for r in near_dup.classes(frame).collect()}
    assert got == brute_classes(corpus)


def test_samples_agree_as_often_as_texts_are_similar():
    draw = np.random.default_rng(7)
    weights, agreed, bands, similar = near_dup.Weights(np.zeros(0, np.uint64), np.zeros(0, np.float32), 2.0), 0, 0, []
    for _ in range(40):
        a = draw.integers(0, 1 << 62, 300).astype(np.uint64)
        b = np.concatenate([a[:270], draw.integers(0, 1 << 62, 30).astype(np.uint64)])
        one, other = weights.of(np.concatenate([a, a[:50]])), weights.of(b)
        similar.append(near_dup.weighted_jaccard(one, other) ** near_dup.SHORT[1])
        agreed += int((near_dup.signature(*one) == near_dup.signature(*other)).sum())
        bands += near_dup.SHORT[0]
    assert agreed / bands == pytest.approx(np.mean(similar), abs=0.07)


def test_frequencies_are_exact(spark):
    texts = [f"the very same boilerplate line here {i} and more words {i * 7}" for i in range(40)] + ["x y z"] * 3
    frame = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string").repartition(4)
    weights = near_dup.inverse_frequencies(frame, len(texts))
    frequency = Counter(h for t in texts for h in set(near_dup.shingles([t])[0].tolist()))
    wanted = {h: np.log2(1 + len(texts) / n) for h, n in frequency.items() if n > len(texts) / 2**near_dup.IDF_BITS}
    assert dict(zip(weights.frequent.tolist(), weights.idf.tolist(), strict=True)) == pytest.approx(wanted, rel=1e-5)


def test_words_of_one_text_do_not_depend_on_its_neighbours():
    texts = ["", "a  b\tc", "\n", "long " * 50, "ünï x", "a b c d e f"]
    alone = [near_dup.shingles([t])[0] for t in texts]
    together = near_dup.shingles(texts)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(alone, together, strict=True))
    assert [len(s) for s in together] == [sum(brute_shingles(t).values()) for t in texts]


def test_hard_rows(spark):
    frame = documents(spark, hard_rows())
    got = near_dup.classes(frame).collect()
    assert len(got) == len(hard_rows())
    by_key = {r.doc_id: r.class_id for r in got if r.doc_id is not None}
    assert by_key[5] == by_key[6] == 5 and by_key[1] == 1 and by_key[2] == 2 and by_key[3] == 3
    kept = near_dup.distinct_documents(frame)
    assert kept.columns == frame.columns
    keys = sorted(r.doc_id for r in kept.collect() if r.text is not None)
    assert keys == [2, 3, 4, 5, 7, 8]
    assert near_dup.classes(frame.limit(0)).collect() == []
    assert near_dup.distinct_documents(frame.limit(0)).collect() == []


def test_components_of_paths_and_stars(spark):
    links = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)] + [("s0", f"s{i}") for i in range(1, 80)] + [("z", "z")]
    links += [(b, a) for a, b in links[:5]]
    frame = spark.createDataFrame(links, "a string, b string")
    got = {r.id: r.component for r in components(frame, Work(spark, "test"), "c").collect()}
    assert set(got.values()) == {"p000", "s0"} and len(got) == 61 + 80
    assert components(frame.limit(0), Work(spark, "test"), "c").collect() == []


def edit_tree(draw, size, words, edits):
    """Texts each edited from any earlier one, so that many are near copies of texts other than the first."""
    made = [[f"tree{draw.random()}" for _ in range(words)]]
    while len(made) < size:
        made.append(edited(draw, draw.choice(made), edits).split())
    return [" ".join(text) for text in made]


@pytest.mark.parametrize("small", [None, 2])
def test_copies_of_copies_equal_all_pairs(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(near_dup, "SMALL_BUCKET", small)
        monkeypatch.setattr(near_dup, "BLOCK_WEIGHT", 2_000.0)
    draw = random.Random(21)
    rows = list(enumerate(edit_tree(draw, 120, 150, 3) + edit_tree(draw, 90, 150, 3)))
    draw.shuffle(rows)
    frame = documents(spark, [(k, t, "en", "s") for k, t in rows])
    got = {r.doc_id: r.class_id for r in near_dup.classes(frame).collect()}
    assert got == brute_classes(rows)


def test_lone_leftovers_meet_the_members_of_a_class(spark):
    """A leftover whose only near copy is a member, not the leader, of a large bucket."""
    draw = random.Random(8)
    base = [f"hub{i}" for i in range(200)]
    rows = [edited(draw, base, 1) for _ in range(90)]
    for start in range(12):  # one chain each: like a member, unlike all others
        member = [f"m{start}" if i % 67 == start else w for i, w in enumerate(base)]
        rows += [" ".join(member), " ".join(f"l{start}" if i % 67 in (start, start + 20) else w for i, w in enumerate(base))]
    rows = list(enumerate(rows))
    got = {r.doc_id: r.class_id for r in near_dup.classes(documents(spark, [(k, t, "en", "s") for k, t in rows])).collect()}
    assert got == brute_classes(rows)


def test_classes_without_a_key_or_with_the_same_key_all_keep_a_document(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("b")), (None, text("a")), (None, text("c")), (7, text("c"))]
    rows += [(5, text("d")), (5, text("e")), (5, text("e") + " more"), (6, text("d"))]
    frame = documents(spark, [(k, t, "en", "s") for k, t in rows])
    kept = [(r.doc_id, r.text[0]) for r in near_dup.distinct_documents(frame).collect()]
    assert sorted(kept, key=str) == sorted([(None, "a"), (None, "b"), (7, "c"), (5, "d"), (5, "e")], key=str)
    got = near_dup.classes(frame).collect()
    assert len({r.component for r in got}) == 5


def alike(n, shared, own):
    """Texts that share most of their words, and are no near copies."""
    passage = " ".join(f"shared{i}" for i in range(shared))
    return [passage + " " + " ".join(f"own{k}x{i}" for i in range(own)) for k in range(n)]


def test_many_alike_texts_make_no_pairs(spark, monkeypatch):
    """2,000 texts at a similarity of 0.6: one row a text and tile, and no class."""
    monkeypatch.setattr(near_dup, "SHORT", (2, 1))  # all of them in the same bucket, or nearly so
    dealt = []
    real = near_dup.tiles
    monkeypatch.setattr(near_dup, "tiles", lambda members: dealt.append(real(members)) or dealt[-1])
    rows = list(enumerate(alike(2000, 64, 20)))
    found = near_dup.classes(documents(spark, [(k, t, "en", "s") for k, t in rows])).collect()
    assert all(r.class_id == r.doc_id for r in found) and len(found) == 2000
    blocks = -(-2000 // near_dup.BLOCK_TEXTS)
    assert 1000 < dealt[0].count() <= 2 * 2000 * (blocks + 1)


def test_tiles_hold_every_pair_of_classes(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_TEXTS", 7)
    draw = random.Random(4)
    rows = [(b, 9, f"t{b}-{i}", "main" if draw.random() < 0.5 else f"c{draw.randrange(6)}", 30.0) for b, n in ((0, 5), (1, 60), (2, 33)) for i in range(n)]
    frame = spark.createDataFrame(rows, "band int, bucket long, id string, class string, total double")
    held = {}
    for r in near_dup.tiles(frame).collect():
        held.setdefault(tuple(r.tile), []).append((r.id, r["class"]))
    met = {(a, b) for one in held.values() for a, _ in one for b, _ in one}
    for b, _, i, label, _ in rows:
        assert all((i, j) in met for c, _, j, other, _ in rows if c == b and other != label)
    assert all(len(one) == len(set(one)) for one in held.values())
    assert max(map(len, held.values())) < 40


def test_forest_of_links_equals_all_pairs():
    draw = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    texts = [edited(draw, base + base[:20], draw.randrange(6)) for _ in range(40)] + ["", "a b"]
    weights = near_dup.Weights(np.sort(near_dup.shingles([" ".join(base)])[0][:10]), np.full(10, 0.5, np.float32), 2.0)
    links = near_dup.similar(texts, np.arange(len(texts)), weights, 0.8)
    wanted = [weights.of(h) for h in near_dup.shingles(texts)]
    root = list(range(len(texts)))
    for pairs, name in ((links, "got"), ([(i, j) for i in range(len(texts)) for j in range(i) if near_dup.weighted_jaccard(wanted[i], wanted[j]) >= 0.8], "all")):
        root = list(range(len(texts)))
        for i, j in pairs:
            old, new = root[i], root[j]
            root = [min(old, new) if r in (old, new) else r for r in root]
        if name == "got":
            found, count = root, len(pairs)
    assert found == root and count == len(texts) - len(set(root)) and len(set(root)) < 35


def test_copies_count_once_and_common_passages_little(spark):
    """A footer in a tenth of the texts weighs less than own text; the shingles of a large group of copies do not."""
    draw = random.Random(12)
    words = lambda name, n: [f"{name}{i}" for i in range(n)]
    footers = [words("first", 14), words("second", 14)]
    base = words("base", 120)
    texts = [" ".join(words(f"own{k}x", 80) + footers[k % 2] * (k % 5 < 2)) for k in range(1500)]
    texts += [" ".join(words("body", 100) + footer) for footer in footers]
    texts += [edited(draw, base, draw.choice([0, 1, 2])) for _ in range(300)]
    frame = documents(spark, [(k, t, "en", "s") for k, t in enumerate(texts)]).repartition(3)
    rows = frame.selectExpr("md5(text) AS id", "text")
    weights = near_dup.corpus_weights(rows, len(texts))
    of = lambda text: weights.each(near_dup.shingles([text])[0])
    assert of(" ".join(base)) == pytest.approx(weights.rest)
    common = of(" ".join(footers[0]))
    assert common == pytest.approx(np.log2(1 + 1503 / 301), abs=0.1) and common.max() < 0.6 * weights.rest
    got = {r.doc_id: r.class_id for r in near_dup.classes(frame).collect()}
    assert got == {k: k if k < 1500 else 1500 if k < 1502 else 1502 for k in range(len(texts))}
