import random

import numpy as np
import pytest

from wardcast.llm import neardup
from wardcast.llm.components import components
from wardcast.llm.neardup import joint_estimate, merge, near_duplicates, sketch, without_copies
from wardcast.llm.text import shingle_set, word_hashes
from wardcast.session import via_table
from tests.llm.conftest import row, words


def sets(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(docs, size, percent):
    found = [(d, sets(t, size)) for d, t in docs]
    group = list(range(len(docs)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, (_, a) in enumerate(found):
        for j, (_, b) in enumerate(found[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                group[root(i)] = root(j)
    out = []
    for i, (d, s) in enumerate(found):
        ids = [found[j][0] for j in range(len(docs)) if root(j) == root(i) and found[j][0] is not None]
        out.append((d, len(s), min(ids, default=None) if s else d))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def family(seed, base, n, edits):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = "edit" + str(r.randrange(10_000))
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_groups_equal_brute_force(spark, size, percent):
    common = words(50, 60)  # a passage that makes many documents share buckets without being copies
    texts = family(1, words(10, 150), 30, 12) + family(2, words(11, 60), 25, 9) + family(3, words(12, 12), 10, 1)
    texts += [" ".join(common + words(100 + i, 40)) for i in range(40)] + ["", None, "one", "one", "One two", "one two three"]
    docs = list(enumerate(texts))
    random.Random(4).shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert rows_of(near_duplicates(df, size, percent)) == brute(docs, size, percent)


def test_chain_of_links_in_buckets_of_several_components(spark, monkeypatch):
    """Centers run out at two per round, so several rounds are needed."""
    monkeypatch.setattr(neardup, "CENTERS", 2)
    base, texts = words(20, 100), []
    for k in range(30):
        base = list(base)
        base[(7 * k) % 100] = f"step{k}"
        texts.append(" ".join(base))
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert rows_of(near_duplicates(df, 3, 85)) == brute(docs, 3, 85)


def test_awkward_rows(awkward, empty):
    found = near_duplicates(awkward).collect()
    assert len(found) == awkward.count() and near_duplicates(empty).count() == 0
    by = {r["doc_id"]: r for r in found}
    assert by[1]["n_shingles"] == 0 and by[1]["kept"] and by[3]["component_id"] == 3
    assert by[14]["kept"] and not by[15]["kept"] and by[15]["component_id"] == 14
    assert by[9]["component_id"] == 8 and by[17]["component_id"] == 8 and by[8]["kept"]
    assert sorted(r["component_id"] for r in found if r["doc_id"] is None and r["n_shingles"]) == [8]
    kept = without_copies(awkward)
    assert kept.schema == awkward.schema
    ids = [r["doc_id"] for r in kept.collect()]
    assert 9 not in ids and 15 not in ids and 17 not in ids and {1, 2, 3, 8, 12, 14} <= set(ids)


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(1)
    for common, only in ((400, 50), (400, 200), (30, 10)):
        a, b, c = (r.integers(0, 2**63, n).astype(np.uint64) for n in (common, only, only))
        x, y = np.union1d(a, b), np.union1d(a, c)
        s, t = sketch(x), sketch(y)
        assert (merge(sketch(a), sketch(b)) == s).all()
        est = joint_estimate(s[None], t[None], np.array([float(len(x))]), np.array([float(len(y))]))[0]
        assert abs(est - common / (common + 2 * only)) < 0.13
    assert (sketch(np.empty(0, np.uint64)) == 0).all() and (sketch(np.array([5], np.uint64)) == sketch(np.array([5], np.uint64))).all()


def test_hashes_depend_on_words_only():
    a = word_hashes(b"one  two\nthree")
    assert (a == word_hashes(b"  one two three ")).all() and len(set(a.tolist())) == 3
    long = b"w " * 700_000 + b"end"
    assert len(set(word_hashes(long).tolist())) == 2
    assert len(shingle_set(b"a b", 5)) == 1 and len(shingle_set(None, 5)) == 0


def test_components_of_paths_and_hubs(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 400)] + [(1, 1), (None, 3), (5, 3), (3, 5)]
    random.Random(1).shuffle(links)
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in [7, *range(200, 400)]}, 3: 3, 5: 3}


def test_rows_helper_matches_schema(frame):
    assert frame([row(1, "x")]).count() == 1


def test_one_row_of_each_group_stays_whatever_the_ids(frame):
    a, b, c = (" ".join(words(seed, 60)) for seed in (41, 42, 43))
    docs = [row(None, a), row(None, a + " more"), row(5, b), row(5, b), row(6, b), row(None, b), row(7, c), row(7, "other text of id seven"), row(3, c), row(None, ""), row(None, "")]
    for df in (frame(docs), via_table(frame(docs), "documents")):
        kept = without_copies(df)
        assert kept.schema == df.schema
        left = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
        first = [x for x in left if x[1].startswith(a)]
        assert len(first) == 1 and sorted([x for x in left if x not in first], key=str) == sorted([(5, b), (3, c), (7, "other text of id seven"), (None, ""), (None, "")], key=str)


def test_bitmaps_bound_what_two_sets_share(spark):
    """No pair at the threshold is left out, most others are."""
    from wardcast.llm import neardup
    from wardcast.llm.text import shingle_set

    r, rows = random.Random(6), []
    for k in range(40):
        text = words(9000 + k % 4, 100 + 20 * (k % 4))
        for i in r.sample(range(len(text)), k // 4):
            text[i] = f"other{k}x{i}"
        rows.append((k, " ".join(text).encode()))
    texts = spark.createDataFrame(rows, "node bigint, text binary")
    sets = {k: set(shingle_set(t, 3).tolist()) for k, t in rows}
    bits = neardup._bitmaps(texts, 3).collect()
    sizes = spark.createDataFrame([(r["node"], len(sets[r["node"]]), r["bits"]) for r in bits], "node bigint, n bigint, bits array<bigint>")
    pairs = sizes.crossJoin(sizes.toDF("center", "center_n", "center_bits")).where(neardup._bits_allow(0.85)).select("node", "center").collect()
    passed = {(r["node"], r["center"]) for r in pairs}
    linked = {(a, b) for a in sets for b in sets if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert linked <= passed and len(passed) < len(linked) + 0.2 * len(sets) ** 2 < len(sets) ** 2
