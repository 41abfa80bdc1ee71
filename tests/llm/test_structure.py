import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from wardcast.llm import structure as st

SCHEMA = "conv_id bigint, turn bigint, role string, text string, kind string, piece string, copies string, key string, id string, audit string"


def cheapest(codes):
    """The cheapest, then first, edits by a uniform-cost search that knows no bounds."""
    queue, seen = [(0, "", 0, st.NONE)], set()
    while True:
        cost, done, i, state = heapq.heappop(queue)
        if i == len(codes) and state in (st.NONE, st.ASSISTANT):
            return cost, done
        if (i, state) in seen:
            continue
        seen.add((i, state))
        heapq.heappush(queue, (cost + 2, done + "I", i, st.FITTING[state]))
        if i < len(codes):
            code = codes[i]
            heapq.heappush(queue, (cost + 3, done + "D", i + 1, state))
            if code != st.DROP:
                extra = int(code.isupper())
                if (state, code.lower()) in st.NEXT:
                    heapq.heappush(queue, (cost + extra, done + "K", i + 1, st.NEXT[state, code.lower()]))
                heapq.heappush(queue, (cost + extra + 2, done + "R", i + 1, st.FITTING[state]))


def all_edits(codes, most):
    """Every complete edit of at most ``most`` cost, as the contract words it: letters and roles."""
    found = []

    def go(i, roles, cost, done):
        if cost > most or len(done) > 2 * len(codes) + 4:
            return
        if i == len(codes) and re.fullmatch("(s?(ua)+)?", roles):
            found.append((cost, done))
        if i < len(codes):
            code = codes[i]
            go(i + 1, roles, cost + 3, done + "D")
            if code != st.DROP:
                go(i + 1, roles + code.lower(), cost + code.isupper(), done + "K")
                for role in "ua":
                    go(i + 1, roles + role, cost + 2 + code.isupper(), done + "R")
        for role in "ua":
            go(i, roles + role, cost + 2, done + "I")

    go(0, "", 0, "")
    return min(found)


def test_search_equals_enumeration_of_all_edits():
    for n in range(4):
        for codes in itertools.product("suaSx-", repeat=n):
            cost, done = st.search("".join(codes))
            assert (cost, done) == all_edits("".join(codes), cost), codes


def test_search_and_chunks_equal_uniform_cost():
    r = random.Random(1)
    for _ in range(150):
        codes = "".join(r.choice("uauauaua-SUAxs") for _ in range(r.randint(0, 40)))
        expected = cheapest(codes)
        assert st.search(codes) == expected
        partial, size = st.Partial(), r.randint(1, 9)
        for i in range(0, len(codes), size):
            partial.add([dict(zip(("entry", "exit", "cost", "letters"), x)) for x in st.matrix(codes[i:i + size])])
        assert partial.complete() == expected


def expected(conv, rows):
    out = []
    for turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out.sort(key=lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest()))
    seen, faults = set(), []
    for _, role, text in out:
        body = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = {x[0] for x in out} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(out, out[1:]))
    cost, audit = cheapest("".join(st._code(x[1][:1], f) for x, f in zip(out, faults)))
    rest, state, lines = iter(out), st.NONE, []
    for letter in audit:
        _, role, text = next(rest) if letter != "I" else (None, None, "")
        if letter != "D":
            state = st.NEXT[state, role[:1]] if letter == "K" else st.FITTING[state]
            lines.append(f"{role if letter == 'K' else st.ROLES[state]}:{text}")
    return (gaps, *(faults.count(c) for c in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations():
    r, rows = random.Random(4), []
    words = ["Yes.", "no", "", " \t", "Why?", "Go on!", "é. ", "long " * 4000, None, "x:y.", "same."]
    for conv in [None, -3, *range(40)]:
        for i in range(r.choice([1, 2, 5, 9, 30])):
            turn = None if r.random() < 0.05 else i if r.random() < 0.9 else r.randint(0, 40)
            role = r.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool", "unknown", "User"])
            text = r.choice(words) if r.random() < 0.5 else f"turn {i}."
            rows += [(conv, turn, role, text)] * r.choice([1, 1, 1, 1, 3])
    rows += [(77, 0, "user", "a."), (78, None, None, None)]
    rows += [(99, i, "user" if i % 2 == 0 else "assistant", f"t{i % 50}.") for i in range(700)]  # longer than a chunk
    # rows of which all are dropped
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return rows + [(gone, 0, "user", "gone.")], gone


@pytest.mark.parametrize("chunk,parts", [(st.CHUNK, None), (3, 7), (1, 30)])
def test_repair_equals_brute_force_whatever_the_chunks(spark, chunk, parts):
    rows, gone = conversations()
    table = spark.createDataFrame([(*r, "k", "p", "c", "y", "i", "a") for r in rows], SCHEMA).repartition(6)
    by = {}
    for conv, *rest in rows:
        by.setdefault(conv, []).append(rest)
    found = st.repaired(table, st.damaged(table), chunk, parts).collect()
    assert {r["conv_id"] for r in found} == set(by) and len(found) == len(by)
    for r in found:
        assert tuple(r)[1:] == expected(r["conv_id"], by[r["conv_id"]]), r["conv_id"]
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(next(r for r in found if r["conv_id"] == gone))[1:] == (0, 0, 0, 0, 0, 0, "", empty)


def test_the_tables_own_rows_and_an_empty_table(spark):
    table = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")], "conv_id int, turn int, role string, text string")
    assert st.repaired(table).select("cost", "audit").collect() == [(0, "KK")]
    assert st.repaired(table.limit(0)).isEmpty()
    texts = table.withColumn("conv_id", F.lit("c"))
    assert [r["conv_id"] for r in st.repaired(texts).collect()] == ["c"]
