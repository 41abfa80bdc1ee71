import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wardcast.llm.packing import best_fit, bin_completion, completions, lower_bound, pack, pack_documents, sequences, token_pieces


def counts_of(lengths, capacity):
    return np.bincount(lengths, minlength=capacity + 1)


def optimum(lengths, capacity):
    """Fewest bins by trying every placement."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for free in set(bins):
            if free >= lengths[i]:
                rest = list(bins)
                rest.remove(free)
                place(i + 1, [*rest, free - lengths[i]])
        place(i + 1, [*bins, capacity - lengths[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_search_finds_the_optimum_of_small_cases(seed):
    r = random.Random(seed)
    lengths = [r.randint(3, 14) for _ in range(9)]
    counts = counts_of(lengths, 20)
    plan = bin_completion(counts, 20)
    used = Counter()
    for filling, n in plan:
        assert sum(filling) <= 20
        for x in filling:
            used[x] += n
    assert used == Counter(lengths)
    assert sum(n for _, n in plan) == optimum(lengths, 20) >= lower_bound(counts, 20)


def test_search_is_no_worse_than_best_fit_and_improves_some():
    better = 0
    for seed in range(6):
        counts = np.bincount(np.random.default_rng(seed).integers(30, 90, 120), minlength=201)
        a, b = (sum(n for _, n in f(counts, 200)) for f in (best_fit, bin_completion))
        assert lower_bound(counts, 200) <= b <= a
        better += b < a
    assert better


def undominated(items, room, most):
    """All fillings that waste at most ``most`` and in which no item left out fits in place of some of the items."""
    items, out = [x for x in items if x <= room], set()
    for n in range(len(items) + 1):
        for filling in itertools.combinations(sorted(items, reverse=True), n):
            waste = room - sum(filling)
            if not 0 <= waste <= most:
                continue
            left = Counter(items) - Counter(filling)
            swaps = ((k, sum(part), x) for k in range(n + 1) for part in itertools.combinations(filling, k) for x in left)
            if not any(s <= x <= s + waste and not (k == 1 and x == s) for k, s, x in swaps):
                out.add(filling)
    return out


def test_completions_are_all_undominated_ones_by_waste():
    r = random.Random(2)
    for _ in range(200):
        room, items = r.randint(1, 25), [r.randint(1, 14) for _ in range(r.randint(0, 8))]
        most = r.randint(0, room)
        found = list(completions(counts_of(items, 40), room, most))
        assert set(found) == undominated(items, room, most) and len(found) == len(set(found))
        assert [room - sum(f) for f in found] == sorted(room - sum(f) for f in found)


def test_pieces_are_the_tokenizers_ids(awkward):
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for r in awkward.select("doc_id", "text").collect():
        ids = [*slow.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        expected[r["doc_id"], np.array(ids, "<u4").tobytes()] += 1
    by = defaultdict(list)
    for r in token_pieces(awkward, 64).collect():
        by[r["doc_id"]].append(r)
        assert r["length"] == len(r["ids"]) // 4 and 1 <= r["length"] <= 64 and (r["piece"] == 0 or r["length"] == 64)
    for doc_id, rows in by.items():
        if doc_id not in (None, 9):
            rows.sort(key=lambda r: r["piece"])
            assert [r["start"] for r in rows] == [sum(x["length"] for x in rows[:i]) for i in range(len(rows))]
            assert expected[doc_id, b"".join(bytes(r["ids"]) for r in rows)] == 1
    assert sum(len(r) for r in by.values()) == sum(n * max(1, -(-len(ids) // 256)) for (_, ids), n in expected.items())


def test_sequences_are_gapless_and_complete(awkward):
    rows = pack_documents(awkward, 64).collect()
    assert len(rows) == token_pieces(awkward, 64).count()
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 64
    counts = np.bincount([r["length"] for r in rows], minlength=65)
    assert len(by) <= sum(n for _, n in best_fit(counts, 64))


def test_round_trip(frame):
    docs = frame([(i, f"text number {i} " * (i % 40 + 1), *["x"] * 2, 1, *["x"] * 2, 1, *["x"] * 3) for i in range(60)])
    pieces = token_pieces(docs, 64)
    packed = pack(pieces.drop("ids"), 64)
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in sequences(packed, pieces).collect()}
    ids = {(r["doc_id"], r["piece"]): bytes(r["ids"]) for r in pieces.collect()}
    for r in packed.collect():
        assert whole[r["sequence_id"]][4 * r["offset"]:4 * (r["offset"] + r["length"])] == ids[r["doc_id"], r["piece"]]


def test_empty_and_wrong_lengths(spark, empty):
    assert pack_documents(empty).count() == 0
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([(1, 65)], "doc_id bigint, length bigint"), 64)
