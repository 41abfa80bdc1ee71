import hashlib
import math

import pytest
from pyspark.sql import functions as F

from wardcast.llm import fingerprint, urls
from wardcast.llm.chat import conversations, preference_pairs
from tests.llm.conftest import row, words


# ---- fingerprints ---------------------------------------------------------------------------------------------------------

def shingles(text, size=5):
    w = (text or "").lower().split()
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def test_edits_and_estimates(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    df = fingerprint.edited_fingerprints(docs)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan.replace("SinglePartition, ENSURE", "")
    a, b = F.col("sketch"), F.col("edited_sketch")
    rows = df.withColumn("near", fingerprint.resemblance(a, b)).withColumn("n", fingerprint.distinct_count(a)).withColumn("inside", fingerprint.containment(a, b)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        third = len(text) // 3
        edited = text[:len(text) - third] + texts[after[r["doc_id"]]][:third]
        assert r["n_chars"] == len(text) and r["edited"] == edited
        s, t = shingles(text), shingles(edited)
        assert abs(r["near"] - len(s & t) / len(s | t)) < 0.2 and abs(r["inside"] - len(s & t) / len(s)) < 0.25
        assert r["n"] == pytest.approx(len(s), rel=0 if len(s) < fingerprint.K else 0.4)


def test_parts_merge_to_the_whole(spark, frame):
    w = words(4, 900)
    df = frame([row(1, " ".join(w)), row(2, " ".join(w[:500])), row(3, " ".join(w[496:]))])
    s = {r["doc_id"]: r["s"] for r in fingerprint.with_sketch(df, "text", "s").collect()}
    merged = spark.createDataFrame([(s[2], s[3])], "a array<bigint>, b array<bigint>").select(fingerprint.merged(F.col("a"), F.col("b")).alias("m")).first()["m"]
    assert merged == s[1]


def test_fingerprints_of_awkward_rows(awkward, empty):
    rows = fingerprint.edited_fingerprints(awkward).withColumn("print", fingerprint.as_text(F.col("sketch"))).collect()
    assert len(rows) == awkward.count() and fingerprint.edited_fingerprints(empty).count() == 0
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["print"] == by[2]["print"] == "" and by[14]["print"] == by[15]["print"] != "" and len(by[4]["sketch"]) == 1
    assert by[1]["n_chars"] == 0 and by[1]["edited"] == ""
    assert by[-16]["edited"].endswith((awkward.where("doc_id = 17").first()["text"])[:by[-16]["n_chars"] // 3])  # the last is followed by the first


def test_a_single_row_follows_itself(frame):
    r = fingerprint.edited_fingerprints(frame([row(5, "abcdef")])).first()
    assert r["edited"] == "abcdab" and hashlib.sha256(r["edited"].encode()).hexdigest()


# ---- URL filters ------------------------------------------------------------------------------------------------------------

def test_hosts(spark):
    cases = {"http://A.Example.com:80/x?y#z": "a.example.com", "https://user:pw@h.net": "h.net", "h.org.": "h.org", "": None, None: None, "http:///x": None, "x.com?q=http://y": "x.com", "//a.b/x": "a.b", "ftp://b\\c": "b"}
    df = spark.createDataFrame([(k,) for k in cases], "url string").withColumn("h", urls.host_of(F.col("url")))
    assert {r["url"]: r["h"] for r in df.collect()} == cases


def brute(captures, entries):
    out = []
    for cid, host, day in captures:
        best = None
        for lst, pattern in {(e[0], e[1]) for e in entries if None not in e}:
            if not host or day is None or not (host == pattern or host.endswith("." + pattern)):
                continue
            past = [(e[2], e[3] == "remove") for e in entries if e[:2] == (lst, pattern) and e[2] is not None and e[2] <= day and e[3] in ("add", "remove")]
            if past and not max(past)[1]:
                best = max(best or (0,), (len(pattern), lst == "allow", lst, pattern, max(past)[0]))
        out.append((cid, "drop" if best and best[2] == "block" else "keep", best[3] if best else None, best[4] if best else None))
    return sorted(out, key=str)


def test_as_of_join_equals_brute_force(spark):
    import datetime as dt
    import random
    r, start = random.Random(6), dt.date(2024, 1, 1)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "d.org", "x.d.org", "z.net"]
    day = lambda: start + dt.timedelta(days=r.randrange(200))
    entries = [(r.choice(["block", "allow"]), r.choice(["a.com", "b.a.com", "d.org", "com", "z.net"]), day(), r.choice(["add", "remove"])) for _ in range(60)]
    entries += [entries[0], (None, "a.com", start, "add"), ("block", None, start, "add"), ("block", "a.com", None, "add"), ("block", "a.com", start, "other")]
    captures = [(i, r.choice(hosts), day()) for i in range(400)] + [(900, None, start), (901, "a.com", None), (902, "a.com", start), (902, "a.com", start)]
    c = spark.createDataFrame([(i, h and f"https://{h}/p", d, "n") for i, h, d in captures], "id bigint, url string, fetched date, list string")
    e = spark.createDataFrame(entries, "list string, pattern string, day date, action string")
    found = urls.judged(c, e)
    assert found.columns == ["id", "url", "fetched", "list", "decision"]
    got = [(r_["id"], r_["decision"]["verdict"], r_["decision"]["pattern"], r_["decision"]["first_day"]) for r_ in found.collect()]
    assert sorted(got, key=str) == brute(captures, entries)
    assert urls.judged(c.limit(0), e).count() == 0
    assert urls.judged(c, e.limit(0)).where("decision.verdict = 'drop'").count() == 0


# ---- chat --------------------------------------------------------------------------------------------------------------------

def test_common_prefix_masks_and_edges(spark):
    t = "array<struct<turn:bigint,role:string,text:string>>"
    u, a, b, c = (1, "user", "hi"), (2, "assistant", "hello"), (2, "assistant", "go away é"), (3, "user", "why")
    rows = [(1, [u, a], [u, b, c]), (2, [u, a], [u, a]), (3, [u], [u, a]), (4, [], [u]), (5, None, None), (6, [u, a, c], [u, a, (3, "user", "oh")]), (7, [a], [u])]
    df = spark.createDataFrame([(*r, "kept") for r in rows], f"id bigint, chosen {t}, rejected {t}, prompt_id string")
    by = {r["id"]: r for r in preference_pairs(df).collect()}
    assert [by[i]["n_common"] for i in range(1, 8)] == [1, 1, 0, 0, 0, 2, 0]
    assert [by[i]["same"] for i in range(1, 8)] == [False, True, False, False, True, False, False]
    assert by[1]["prompt"] == "<|user|>\nhi<|end|>\n" and by[1]["prompt_id"] == "kept"
    for r in by.values():
        for text, mask in ((r["chosen_text"], r["chosen_mask"]), (r["rejected_text"], r["rejected_mask"])):
            for span in mask:
                assert text[:span["first"]].endswith("<|assistant|>\n") and text[span["first"]:span["last"]].endswith("<|end|>\n")
            assert len(mask) == text.count("<|assistant|>")
    assert by[1]["rejected_text"][by[1]["rejected_mask"][0]["first"]:by[1]["rejected_mask"][0]["last"]] == "go away é<|end|>\n"


def test_conversations_of_awkward_turns(spark):
    turns = spark.createDataFrame([(1, 2, "assistant", "b", 0), (1, 1, "user", "a", 0), (1, 1, "user", "a", 0), (1, 1, None, None, 0), (None, 1, "user", "x", 0)], "conv_id bigint, turn bigint, role string, text string, turns int")
    found = conversations(turns).collect()
    assert len(found) == 1 and [(x["role"], x["text"]) for x in found[0]["turns"]] == [("user", ""), ("user", "a"), ("assistant", "b")]
    assert conversations(turns.limit(0)).count() == 0 and math.isfinite(1)
