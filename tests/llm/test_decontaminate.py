import re

from wardcast.llm.decontaminate import contamination, scan, without_contaminated
from tests.llm.conftest import words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items, size=13):
    windows = {}
    for item, text in items:
        w = WORD.findall(lowered(text))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        w = WORD.findall(lowered(text))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        out.append((doc_id, len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def cases():
    item = words(5, 30)
    items = [(1, " ".join(item)), (1, " ".join(item)), (2, "Short, item!"), (3, None), (4, ""), (5, "..."), (6, " ".join(item[5:25])), (None, "lost words"), (7, "straße größe")]
    docs = [(1, " ".join(words(6, 40) + item[3:20] + words(7, 40))), (2, "a SHORT item-here"), (3, "shortitem short"), (4, None), (5, ""),
            (6, "--".join(item).upper()), (7, " ".join(item[:12])), (8, " ".join(words(8, 500)) + " short item"), (9, "Straße Größe"), (9, "Straße Größe"), (None, "short item")]
    return docs, items


def rows_of(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in df.collect()), key=str)


def test_one_automaton_and_several_equal_brute_force(spark):
    docs, items = cases()
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    expected = sorted(brute(docs, [x for x in items if x[0] is not None]), key=str)
    assert rows_of(contamination(d, b)) == expected
    assert rows_of(contamination(d, b, max_block=700)) == expected


def test_spans_lead_back_to_the_original(spark):
    docs, items = cases()
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    texts = dict(docs)
    for r in scan(d, b).collect():
        for hit, span in zip(r["hits"], r["spans"]):
            cut = texts[r["doc_id"]].encode()[span["first"]:span["last"]].decode()
            assert WORD.findall(lowered(cut)) == WORD.findall(lowered(texts[r["doc_id"]]))[hit["first"]:hit["last"]]


def test_filter_keeps_columns_and_clean_rows(spark, awkward, empty):
    bench = spark.createDataFrame([(1, "one two"), (2, " ".join(words(2, 20)))], "item_id bigint, text string")
    for limit in (8_000_000, 60):
        kept = without_contaminated(awkward, bench, max_block=limit)
        assert kept.schema == awkward.schema
        ids = sorted(r["doc_id"] for r in kept.where("doc_id is not null").select("doc_id").collect())
        assert ids == sorted(r["doc_id"] for r in awkward.where("doc_id is not null").collect() if r["doc_id"] != 5)
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert without_contaminated(awkward, none).count() == awkward.count() and contamination(empty, bench).count() == 0
    assert contamination(awkward, none).where("contaminated or n_hit > 0").count() == 0


def test_each_row_is_judged_by_itself_with_several_blocks_too(spark):
    items = [(k, " ".join(words(60 + k, 15))) for k in range(6)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = [(None, items[0][1]), (None, "clean"), (4, items[5][1]), (4, "also clean"), (4, None), (8, " ".join(x for _, x in items))]
    # Each item alone stays below 5 % of the words, all of them together do not.
    docs.append((9, " ".join([x for _, x in items] + words(99, 700))))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    for limit in (8_000_000, 200):
        kept = without_contaminated(df, bench, max_block=limit)
        assert kept.schema == df.schema
        assert sorted(map(tuple, kept.collect()), key=str) == sorted([(None, "clean"), (4, "also clean"), (4, None)], key=str)
