import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardcast.llm import language, lm, toxicity
from tests.llm.conftest import row, words


# ---- toxicity -----------------------------------------------------------------------------------------------------------

def labelled(n=600):
    docs, labels = [], []
    r = random.Random(1)
    for d in range(n):
        text, toxic = words(d, 60), d % 5 == 0
        if toxic:
            for _ in range(4):
                text[r.randrange(60)] = r.choice(["idioto", "scumbag", "vilestem" + str(r.randrange(50))])
        docs.append(row(d, " ".join(text)))
        labels.append((d, int(toxic)))
    return docs, labels


def test_toxicity_on_rows_not_learned_from(spark, frame, folder):
    docs, labels = labelled()
    df, lab = frame(docs), spark.createDataFrame(labels + [(None, 1), (3, None), (9999, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(df, lab, toxicity.train_part())
    truth, hits = dict(labels), 0
    held = [r for r in toxicity.score(df, model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    hits = sum((r["score"] >= 0.5) == bool(truth[r["doc_id"]]) == bool(r["predicted"]) for r in held if r["doc_id"] % 5 == 0) + \
        sum(not r["predicted"] for r in held if r["doc_id"] % 5)
    assert len(held) > 80 and hits / len(held) > 0.95 and all(0 <= r["score"] <= 1 for r in held)
    kept = toxicity.without_toxic(df, model)
    assert kept.schema == df.schema
    gone = {d for d, _ in labels} - {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert sum(truth[d] for d in gone) / len(gone) > 0.95
    table = spark.read.parquet(f"{folder}/documents.parquet")
    both = toxicity.score(table, toxicity.fit(table, spark.read.parquet(f"{folder}/labels.parquet")))
    assert both.count() == table.count()


def test_toxicity_without_labels_or_with_one_kind(spark, awkward, empty):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.fit(awkward, none)
    found = toxicity.score(awkward, model).collect()
    assert len(found) == awkward.count() and all(r["score"] == 0 and r["predicted"] == 0 for r in found)
    assert toxicity.without_toxic(awkward, model).count() == awkward.count() and toxicity.score(empty, model).count() == 0
    one = toxicity.fit(awkward, spark.createDataFrame([(8, 1)], "doc_id bigint, toxic int"))
    assert one.prior == 1 and toxicity.without_toxic(awkward, one).count() == 0


def test_features_of_awkward_texts(awkward):
    tool = toxicity.Features({"idio": 1.0, "clown$": 0.5})
    for r in awkward.collect():
        found = tool.of((r["text"] or "").encode())
        assert len(found) == toxicity.N_FEATURES and all(math.isfinite(x) for x in found)
    assert tool.weight("idiotic") == 1.0 and tool.weight("clowns") == 0 and tool.weight("clown") == 0.5
    plain, hidden = tool.of(b"you clown there"), tool.of(b"an 1d10t here")
    assert plain[0] > 0 and plain[5] > 0 and hidden[11] > 0 and hidden[0] == 0


# ---- language ---------------------------------------------------------------------------------------------------------------

def test_language_of_rows_not_learned_from(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = language.identify(docs, language.prototypes(docs, language.train_part())).join(docs.select("doc_id", "lang"), "doc_id")
    held = [r for r in found.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 40 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95 and all(0 <= r["score"] <= 1 for r in held)


def test_language_dot_products_are_those_of_bundles():
    v = language.Vectors(256)
    codes, n = language.grams(language.letters("some letters, Some more".encode()))
    bundle = sum(k * v.gram(c).astype(int) for c, k in zip(codes.tolist(), n.tolist()))
    matrix = np.random.default_rng(1).normal(size=(3, 256))
    judge = language.Judge(["a", "b", "c"], matrix)
    assert np.allclose(n @ np.array([judge.product(c) for c in codes.tolist()]), matrix @ bundle)
    text = " ".join(words(3, 400)).encode()
    codes, n = language.grams(language.letters(text))
    full = np.zeros(language.DIMENSIONS)
    for c, k in zip(codes.tolist(), n.tolist()):
        full += k * language.Vectors().gram(c)
    assert abs(np.linalg.norm(full) / math.sqrt(language.DIMENSIONS * (n ** 2).sum()) - 1) < 0.2


def test_language_of_awkward_rows(awkward, empty):
    known = language.prototypes(awkward)
    assert list(known) == ["en"] and language.prototypes(empty) == {}
    by = {r["doc_id"]: r for r in language.identify(awkward, known).collect()}
    assert all(by[d]["lang_pred"] == "und" and by[d]["score"] == 0 for d in (1, 2, 3, 6)) and by[7]["lang_pred"] == "en"
    assert language.identify(awkward, {}).where("lang_pred = 'und'").count() == awkward.count() and language.identify(empty, known).count() == 0


# ---- language model -----------------------------------------------------------------------------------------------------------

def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


def test_lm_base_counts_and_gain(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    train = Counter(w for d, t in texts.items() if zlib.crc32(str(d).encode()) % 10 for w in tokens(t))
    n, v, gain = sum(train.values()), len(train), 0
    found = lm.scores(docs, lm.train_part()).collect()
    assert len(found) == len(texts)
    for r in found:
        w = tokens(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(train[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel=1e-9)
        assert r["score"] < 0
        gain += r["score"] - r["base_score"]
    assert gain > 0
    p = lm.perplexity(spark.createDataFrame(found)).first()
    assert p["perplexity"] < p["base_perplexity"]


def test_lm_awkward_rows(spark, awkward, empty):
    found = lm.scores(awkward).collect()
    assert len(found) == awkward.count() and lm.scores(empty).count() == 0
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in found)
    assert [r["n_tokens"] for r in found if r["doc_id"] in (1, 2, 3)] == [1, 1, 1]
    none = lm.scores(awkward, F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 and r["score"] < 0 for r in none)


def plain_scores(spark, texts, train):
    """Scores of texts by id from plain counts of pairs; word and class probabilities come from their own restaurants."""
    counts = Counter(w for d in train for w in tokens(texts[d])) + Counter()
    names = sorted({w for t in texts.values() for w in tokens(t)}, key=lambda w: (-counts[w], w))
    number = {w: i + 1 for i, w in enumerate(names[:lm.CLASSES - 1]) if counts[w]}
    restaurant = lm.word_restaurant(spark.createDataFrame([(w, counts[w]) for w in names], "word binary, n bigint"))
    chance = dict(zip(names, restaurant.chances(names, np.array([counts[w] for w in names]))))
    rest = 1 - sum(chance[w] for w in number)

    def steps(text):
        before, frame = b"\n", number.get(b"\n", 0)
        for w in tokens(text):
            yield frame, before, w
            before, frame = w, number.get(w, frame)

    follow, dishes = np.zeros((len(number) + 1, len(number) + 1), int), Counter()
    for d in train:
        for frame, before, w in steps(texts[d]):
            follow[frame, number.get(w, 0)] += 1
            if before not in number or w not in number:
                dishes[(frame, before), w] += 1
    follow = lm.class_chances(follow)
    one, two = (sum(n == k for n in dishes.values()) for k in (1, 2))
    discount, out = min(0.95, max(0.05, (one + 0.5) / (one + 2 * two + 1))), {}
    for d, text in texts.items():
        out[d] = 0
        for frame, before, w in steps(text):
            base = 1 if w in number else chance[w] / rest
            if before not in number:
                base *= follow[frame, number.get(w, 0)]
            if before not in number or w not in number:
                own = [n for (place, _), n in dishes.items() if place == (frame, before)]
                base = (max(dishes[(frame, before), w] - discount, 0) + (lm.STRENGTH + discount * len(own)) * base) / (lm.STRENGTH + sum(own))
            out[d] += math.log10(base * (follow[frame, number.get(w, 0)] if before in number else 1))
    return out


@pytest.mark.parametrize("classes, chunk", [(1, 12_000_000), (4, 1500), (40, 2500)])
def test_lm_all_words_are_contexts(spark, tmp_path, monkeypatch, classes, chunk):
    """Scores equal those of plain counts, also where pairs lie in several chunks; a pair of rare words that was seen is likelier than the same words turned round."""
    monkeypatch.setattr(lm, "CLASSES", classes)
    monkeypatch.setattr(lm, "CHUNK", chunk)
    some = words(7, 60)
    texts = {i: " ".join(some[(i * 7 + k * (1 + i % 3)) % 60] for k in range(12)) for i in range(40)}
    texts |= {i: f"the {w} of the {v}" for i, (w, v) in enumerate(zip(some, some[1:]), 40)}
    texts |= {200 + k: "zebra quartz" for k in range(3)} | {300: "zebra quartz", 301: "quartz zebra", 302: "", 303: "new words the new words"}
    train = [d for d in texts if d < 300]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(sorted(texts.items()), "doc_id bigint, text string").repartition(3, "doc_id").write.parquet(path)
    found = {r["doc_id"]: r["score"] for r in lm.scores(spark.read.parquet(path), F.col("doc_id") < 300).collect()}
    expected = plain_scores(spark, texts, train)
    assert found.keys() == expected.keys() and all(found[d] == pytest.approx(expected[d], rel=1e-4) for d in texts)
    assert found[300] > found[301] + 0.5


def test_spelling_probabilities_add_up():
    names = [b"ab", b"abc", b"b", b"ab"]
    codes, where, lengths = lm.spelled(names)
    counts = np.bincount(where)
    restaurants = lm.SpellingRestaurants()
    for k in range(3):
        s = restaurants.sweep(codes, counts, k)
        for context in (b"    ", b"  ab", b" abc", b"zzzz", b" zab"):
            whole = s.chance(np.arange(256) + (int.from_bytes(context, "big") << 8))
            assert whole.sum() == pytest.approx(1) and (whole > 0).all()
    assert lengths.tolist() == [3, 4, 2, 3]


def test_spelling_contexts_are_the_same_rule_in_every_corpus(spark, monkeypatch):
    """The most frequent contexts have restaurants; adding words with new, rarer ones takes no byte from the others."""
    monkeypatch.setattr(lm, "CONTEXTS", 40)
    common = [(b"banana" + bytes([97 + i]), 1) for i in range(20)]
    rare = [(w.encode() * 2, 1) for w in sorted(set(words(4, 10)))]
    kept = lm._contexts(spark.createDataFrame(common + rare, "word binary, n bigint"))
    assert len(kept) == 40
    held = {(int(c) >> 32, int(c) & (2**32 - 1)) for c in kept}
    assert all(k == 1 or (k - 1, c & ((1 << 8 * (k - 1)) - 1)) in held for k, c in held)
    assert (4, int.from_bytes(b"anan", "big")) in held  # where all contexts lost a byte at once, none of four was left
    codes, where, _ = lm.spelled([b"banana", b"zzz"])
    short = lm.shortened(codes, kept)
    assert all((lm.ORDER - (int(c) >> 40), int(c) >> 8 & (2**32 - 1)) in held | {(0, 0)} for c in short) and (short & 255 == codes & 255).all()
    restaurants = lm.SpellingRestaurants()
    for k in range(3):
        s = restaurants.sweep(*np.unique(short[where], return_counts=True), k)
        for context in (b"    ", b"anan", b" ban", b"zzzz"):
            assert s.chance(np.arange(256) + (int.from_bytes(context, "big") << 8)).sum() == pytest.approx(1)


def test_class_probabilities_add_up():
    counts = np.random.default_rng(2).poisson(0.7, (30, 30))
    counts[4] = 0
    found = lm.class_chances(counts)
    assert np.allclose(found.sum(1), 1) and (found > 0).all()


def test_seating_follows_the_process():
    """The mean number of tables of one dish's customers, against customers seated one by one."""
    r = np.random.default_rng(3)
    for customers, weight, discount in ((12, 0.8, 0.5), (200, 2.5, 0.3), (3000, 30.0, 0.6)):
        total = 0
        for _ in range(300):
            t = 1
            for n in range(1, customers):
                t += r.random() * (n - discount * t + weight) < weight
            total += t
        keys = np.arange(2000, dtype=np.uint64)
        found = lm.seat(np.full(2000, customers), np.full(2000, weight), discount, keys, 1)
        assert found.min() >= 1 and found.max() <= customers
        assert found.mean() == pytest.approx(total / 300, rel=0.08)
    assert lm.seat(np.array([0, 1, 2]), np.ones(3), 0.5, np.arange(3, dtype=np.uint64), 0)[:2].tolist() == [0, 1]


def test_discount_and_contexts():
    assert 0 < lm.discount_of(np.array([])) < 1
    assert lm.contexts_of(np.array([5, 0, 0, 7, 0, 5])).tolist() == [5, 5, 5, 7, 7]
