import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wardcast.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
AWKWARD_TEXTS = [
    "a@b.c", "a@b", "a@b.c+d@e.f.g x", "@@x.y a@@b.c", "..@a-.-b", "write to bob.o%+-x@mail.example.com.", "é@b.c éa@b.cé", "a@b.c@d.e",
    "1.2.3.4.5.6.7.8", "256.1.1.1 255.0.00.1", "0001.2.3.4", "1.2.3", "9.9.9.9999", "10.0.0.1.", "4111 1111 1111 1111", "4111-1111-1111-1111x 4111111111111112",
    "4111  1111 1111 1111", "00000000000000000000", "000000000000", "0000 0000 0000 0000 000", "12 3", "+1 (722) 555-6978", "+12345678", "+123456789 +1234567890123456", "++1 234 567 890..",
    "+1 2 3 4 5 6 7 8 9 (", "😀 +44 20 7946 0958 😀 a@b.c", "1.2.3.4@5.6", "+4111 1111 1111 1111", "x" * 3000 + "@", "a" * 40_000, "1." * 20_000, "1 " * 20_000, "a@" * 10_000, "a@b" + ".c" * 20_000, "+" * 20_000, "+1" * 5_000, None, "",
]


def kept(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [int(c) if i % 2 == 0 else int(c) * 2 - (9 if c > "4" else 0) for i, c in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def base(text):
    return sorted((m.start(), i, m.end(), k, m[0]) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if kept(k, m[0]))


def test_base_spans_equal_the_plain_patterns(spark, frame, awkward, folder):
    texts = frame([(i, t, "en", "s", 0, "n", "s", 1, "l", "x", "f") for i, t in enumerate(AWKWARD_TEXTS)])
    docs = texts.unionByName(awkward).select("doc_id", "text").unionByName(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    for r in pii.with_base(docs, ["doc_id"]).collect():
        assert [tuple(s) for s in r["base"]] == base(r["text"]), r["text"][:80]


def brute(texts):
    """Spans of all texts by the method in plain steps."""
    words = re.compile(r"(?<![^\W_])[^\W\d_]{3,}(?![^\W_])")
    n_term = Counter(m[0].lower() for t in texts for m in words.finditer(t))
    places, mentions, both, contexts = defaultdict(set), Counter(), Counter(), defaultdict(set)
    for t in texts:
        for start, _, end, kind, value in base(t):
            entity = (kind, value.lower())
            mentions[entity] += 1
            near = [m for m in words.finditer(t) if start - pii.CONTEXT <= m.start() and m.end() <= start or end <= m.start() and m.end() <= end + pii.CONTEXT]
            # a word that touches the far edge may go on beyond it
            near = [m for m in near if (m.start() > start - pii.CONTEXT or start <= pii.CONTEXT) and (m.end() < end + pii.CONTEXT or len(t) <= end + pii.CONTEXT)]
            window = (t[max(0, start - pii.CONTEXT):start], t[end:end + pii.CONTEXT])
            for m in near:
                places[t].add((entity, m[0].lower(), m.start(), m.end()))
            for term in {m[0].lower() for m in near}:
                both[entity, term] += 1
                contexts[entity, term].add(window)
    out = {}
    for t in texts:
        own, found = base(t), {}
        for entity, term, start, end in places[t]:
            unknown = abs(math.log2(min(1, both[entity, term] / n_term[term])))
            if len(contexts[entity, term]) >= pii.LEAST_CONTEXTS and unknown <= pii.GENERALISE and not any(start < s[2] and s[0] < end for s in own):
                found[start, end] = min(unknown, found.get((start, end), 99))
        added = [(s, 4 if u <= pii.REMOVE else 5, e, "remove" if u <= pii.REMOVE else "general") for (s, e), u in found.items()]
        out[t] = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted([x[:4] for x in own] + added))
    return out


TEXTS = [f"Call Zebulon {w} in Atlantis at +1 (722) 555-6978 or {w} later, says the clerk" for w in ("now", "soon", "never", "today")]
TEXTS += [f"the clerk of Atlantis has {n} apples for the people here" for n in ("two", "few")] + ["say the word, clerk", "mail bob@x.org, " + "word " * 60 + "Zebulon"]
TEXTS += ["a clerk is here"] * 10 + [TEXTS[0]] * 5 + ["only in copies: Xanadu a@b.cc"] * 6 + ["pay 4111 1111 1111 1111 at 10.0.0.1 " + "y " * 90]


def test_terms_that_reveal_an_entity_equal_brute_force(frame):
    docs = frame([(i % 4 if i < 8 else None, t, "en", "s", 0, "n", "s", 1, "l", "x", "f") for i, t in enumerate(TEXTS)])
    expected = brute(TEXTS)
    rows = pii.personal_data(docs).select("doc_id", pii.as_text(F.col("spans")).alias("spans")).collect()
    want = sorted((i % 4 if i < 8 else -1, expected[t]) for i, t in enumerate(TEXTS))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["spans"]) for r in rows) == want
    assert "remove" in expected[TEXTS[0]] and "general" in expected[TEXTS[0]]
    assert "remove" not in expected["only in copies: Xanadu a@b.cc"]


def test_terms_far_from_the_mention_count_and_are_marked(frame):
    texts = [f"Write to bob@x.org {w} " + "lorem " * 300 + "Zebulon, 😀 Zebulon" for w in ("now", "soon", "never")] + ["lorem " * 3000]
    rows = pii.personal_data(frame([(i, t, "en", "s", 0, "n", "s", 1, "l", "x", "f") for i, t in enumerate(texts)])).collect()
    for r in [r for r in rows if r["doc_id"] < 3]:
        own = [tuple(s) for s in r["spans"] if s["value"] in ("zebulon", "lorem")]
        places = [m.span() for m in re.finditer("Zebulon", texts[r["doc_id"]])]
        assert own == [(s, 4, e, "remove", "zebulon") for s, e in places]


def test_sanitised_text_and_odd_tables(spark, frame, awkward, empty):
    docs = frame([(1, t, "en", "s", 0, "n", "s", 1, "l", "x", "f") for t in TEXTS])
    text = "Write to a@b.cc or 10.0.0.1 now"
    spans = pii.with_base(spark.createDataFrame([(text,)], "text string"), []).select(pii.sanitised(F.col("text"), F.col("base"))).first()[0]
    assert spans == "Write to [email] or [ip] now"
    clash = docs.select("doc_id", "text").withColumns({c: F.lit("x") for c in ("base", "spans", "contexts", "key", "salt", "added", "copies", "entity", "term")})
    assert pii.personal_data(clash).count() == len(TEXTS)
    assert pii.personal_data(empty).isEmpty() and pii.personal_data(awkward).count() == awkward.count()


def test_main_path_has_no_python_worker(frame):
    plan = pii.personal_data(frame([(1, "a@b.cc", "en", "s", 0, "n", "s", 1, "l", "x", "f")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("digits,good", [("4111111111111111", True), ("4111111111111112", False), ("000000000000", True)])
def test_luhn(spark, digits, good):
    assert spark.range(1).select(pii.luhn(F.lit(digits))).first()[0] == good
