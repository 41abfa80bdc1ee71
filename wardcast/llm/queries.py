"""The operators as registered queries, each over its whole table with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcast.llm import chat, decontaminate, fingerprint, language, lm, neardup, packing, pii, structure, substring, toxicity, urls, whitening
from wardcast.llm.text import held_out

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql.strip()
        return fn

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op2_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op10_benchmark_decontamination", rf"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({LOWER.format("text")}, '{WORDS}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({LOWER.format("text")}, '{WORDS}'), []) AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM win),
place AS (SELECT r, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM doc, sizes WHERE len(w) >= size),
found AS (SELECT DISTINCT r, i, size, item_id FROM (SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM place) AS place JOIN win USING (size, win)),
hits AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + size)) AS p FROM found) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hits USING (r) LEFT JOIN ids USING (r)""")
def benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    ids = F.array_join(F.sort_array("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(ids.cast("binary"), 256).alias("items_sha256"), "contaminated")


@query("op5_minhash_near_dedup", rf"""
WITH RECURSIVE doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({LOWER.format("text")}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sh AS (SELECT DISTINCT r, doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
n AS (SELECT r, doc_id, count(*) AS n FROM sh GROUP BY ALL),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh AS a JOIN sh AS b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM doc UNION SELECT reach.a, e.b FROM reach JOIN (SELECT a, b FROM link UNION ALL SELECT b, a FROM link) AS e ON e.a = reach.b),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM doc LEFT JOIN n USING (r, doc_id) LEFT JOIN comp USING (doc_id)""")
def minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"), size=3, percent=85)


@query("op6_toxicity")
def toxic(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"), toxicity.train_part())
    return toxicity.score(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


@query("op1_substring_dedup")
def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring.repeated_passages(table(spark, folder, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "start", "end", F.col("ref").alias("ref_doc_id"), "ref_start", "ref_end", "common", "passage_start", "passage_end")


@query("op3_document_fingerprints")
def document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    found = fingerprint.edited_fingerprints(table(spark, folder, "documents"))
    sketch, edited, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint.as_text(sketch).alias("fingerprint"), fingerprint.as_text(edited).alias("edited_fingerprint"),
        fingerprint.resemblance(sketch, edited).alias("near_edited"), fingerprint.resemblance(sketch, following).alias("near_next"))


@query("op7_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language.identify(docs, language.prototypes(docs, language.train_part()))
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


@query("op9_lm_scoring")
def lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    found = lm.scores(table(spark, folder, "documents"), lm.train_part())
    return found.select("doc_id", held_out("doc_id", 10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _edit(best: str, cost: str, letters: str) -> str:
    """SQL of a repair (six digits of cost, then letters) with more edits; null where there is none."""
    return f"lpad(CAST(CAST(substr({best}, 1, 6) AS BIGINT) + {cost} AS VARCHAR), 6, '0') || substr({best}, 7) || '{letters}'"


def _when(condition: str, *edits: str) -> list[str]:
    return [f"CASE WHEN {condition} THEN {e} END" for e in edits]


#: Per turn, the least (cost, letters) that ends in each state: none, system, user, assistant. At most one insert before a kept or changed turn can help.
_NONE = _edit("b0", "3", "D")
_SYSTEM = ", ".join([_edit("b1", "3", "D"), *_when("stays AND ini = 's'", _edit("b0", "t", "K"))])
_USER = ", ".join([
    _edit("b2", "3", "D"), *_when("stays AND ini = 'u'", *(_edit(b, "t", "K") for b in ("b0", "b1", "b3")), _edit("b2", "2 + t", "IK")),
    *_when("stays", *(_edit(b, "2 + t", "R") for b in ("b0", "b1", "b3")), _edit("b2", "4 + t", "IR"))])
_ASSISTANT = ", ".join([
    _edit("b3", "3", "D"), *_when("stays AND ini = 'a'", _edit("b2", "t", "K"), *(_edit(b, "2 + t", "IK") for b in ("b0", "b1", "b3"))),
    *_when("stays", _edit("b2", "2 + t", "R"), *(_edit(b, "4 + t", "IR") for b in ("b0", "b1", "b3")))])


@query("op11_conversation_repair", rf"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 20 AS kind FROM raw),
dam AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM kinds),
ord AS (SELECT *, substr(role, 1, 1) AS ini, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), copy) AS p,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM dam),
fault AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
  WHEN right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault, lag(ini) OVER (PARTITION BY conv_id ORDER BY p) || ini AS pair FROM ord),
turns AS (SELECT *, fault IN ('none', 'truncated') AS stays, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS t FROM fault),
ids AS (SELECT DISTINCT conv_id FROM conversations),
step AS (SELECT conv_id, 0::BIGINT AS i, '000000' AS b0, CAST(NULL AS VARCHAR) AS b1, CAST(NULL AS VARCHAR) AS b2, CAST(NULL AS VARCHAR) AS b3 FROM ids UNION ALL
  SELECT step.conv_id, i + 1, {_NONE}, least({_SYSTEM}), least({_USER}), least({_ASSISTANT}) FROM step JOIN turns ON turns.conv_id IS NOT DISTINCT FROM step.conv_id AND turns.p = step.i + 1),
best AS (SELECT conv_id, least(arg_max(b0, i), arg_max(b3, i), {_edit("arg_max(b2, i)", "2", "I")}, {_edit("arg_max(b1, i)", "4", "II")}) AS b FROM
  (SELECT step.conv_id, i, coalesce(b0, '999999') AS b0, coalesce(b1, '999990') AS b1, coalesce(b2, '999990') AS b2, coalesce(b3, '999999') AS b3 FROM step) GROUP BY conv_id),
spelled AS (SELECT conv_id, substr(b, 7) AS audit, CAST(substr(b, 1, 6) AS BIGINT) AS cost FROM best),
letter AS (SELECT conv_id, pos, audit[pos] AS l FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS pos FROM spelled)),
placed AS (SELECT *, sum(CASE WHEN l <> 'I' THEN 1 ELSE 0 END) OVER w AS src, sum(CASE WHEN l <> 'D' THEN 1 ELSE 0 END) OVER w AS e FROM letter WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
line AS (SELECT placed.*, ini, role, text, max(CASE WHEN e = 1 AND l = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY placed.conv_id) AS sys
  FROM placed LEFT JOIN turns ON l <> 'I' AND turns.conv_id IS NOT DISTINCT FROM placed.conv_id AND turns.p = src),
told AS (SELECT conv_id, sha256(string_agg(CASE WHEN l = 'K' THEN role WHEN (e - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN l = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos)) AS sha FROM line WHERE l <> 'D' GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit,
  coalesce(sha, sha256('')) AS repaired_sha256 FROM ids JOIN spelled ON spelled.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM ids.conv_id""")
def conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    return structure.repaired(conversations, structure.damaged(conversations))


@query("op12_embedding_whitening")
def embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"))


@query("op13_pii")
def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.personal_data(table(spark, folder, "documents"))
    counts = [pii.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS]
    digest = F.sha2(pii.as_text(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, pii.as_text(F.col("spans")).alias("spans"))


@query("op4_chat_formatting", r"""
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS p, count(*) OVER (PARTITION BY conv_id) AS n
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
size AS (SELECT DISTINCT conv_id, n, 1 + conv_id % 2 AS k FROM t),
side AS (SELECT 'c' AS side, conv_id, p, role, text FROM t
  UNION ALL SELECT 'r', conv_id, p, role, text FROM t JOIN size USING (conv_id, n) WHERE p <= greatest(size.n - k, 0)
  UNION ALL SELECT 'r', s.conv_id, greatest(s.n - s.k, 0) + t.p - greatest(t.n - s.k, 0), role, text FROM size AS s JOIN t ON t.conv_id = s.conv_id + 1 WHERE t.p > t.n - s.k),
len AS (SELECT conv_id, count(*) FILTER (WHERE side = 'c') AS nc, count(*) FILTER (WHERE side = 'r') AS nr FROM side GROUP BY conv_id),
diff AS (SELECT c.conv_id, min(c.p) FILTER (WHERE c.role <> r.role OR c.text <> r.text) AS d FROM side AS c JOIN side AS r USING (conv_id, p) WHERE c.side = 'c' AND r.side = 'r' GROUP BY c.conv_id),
common AS (SELECT conv_id, CASE WHEN d IS NOT NULL THEN d - 1 ELSE greatest(least(nc, nr) - 1, 0) END AS n_common FROM len LEFT JOIN diff USING (conv_id)),
cut AS (SELECT side.*, n_common, p > n_common AS tail, 13 + length(role) + length(text) AS size,
  sum(13 + length(role) + length(text)) OVER (PARTITION BY conv_id, side, p > n_common ORDER BY p) AS upto, concat('<|', role, '|>', chr(10), text, '<|end|>', chr(10)) AS turn FROM side JOIN common USING (conv_id)),
parts AS (SELECT conv_id, side, tail, string_agg(turn, '' ORDER BY p) AS txt, string_agg(concat(CAST(upto - length(text) - 8 AS BIGINT), '-', CAST(upto AS BIGINT)), ',' ORDER BY p) FILTER (WHERE role = 'assistant') AS mask FROM cut GROUP BY ALL)
SELECT conv_id, CAST(n_common AS BIGINT) AS n_common, coalesce(pr.txt, '') AS prompt, coalesce(c.txt, '') AS chosen_text, coalesce(r.txt, '') AS rejected_text,
  coalesce(c.mask, '') AS chosen_mask, coalesce(r.mask, '') AS rejected_mask, coalesce(c.txt, '') = coalesce(r.txt, '') AS same
FROM common LEFT JOIN (FROM parts WHERE side = 'c' AND NOT tail) AS pr USING (conv_id) LEFT JOIN (FROM parts WHERE side = 'c' AND tail) AS c USING (conv_id) LEFT JOIN (FROM parts WHERE side = 'r' AND tail) AS r USING (conv_id)""")
def chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Chosen is a conversation; rejected is the same with its last one or two turns replaced by the last ones of the next conversation."""
    all_ = chat.conversations(table(spark, folder, "conversations"))
    following = all_.select((F.col("conv_id") - 1).alias("conv_id"), F.col("turns").alias("other"))
    k = (1 + F.col("conv_id") % 2).cast("int")
    last = F.slice("other", F.greatest(F.size("other") - k, F.lit(0)) + 1, k)
    kept = F.slice("turns", F.lit(1), F.greatest(F.size("turns") - k, F.lit(0)))
    pairs = all_.join(following, "conv_id", "left").select("conv_id", F.col("turns").alias("chosen"), F.when(F.col("other").isNull(), kept).otherwise(F.concat(kept, last)).alias("rejected"))
    spans = {c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["first"], x["last"])), ",") for c in ("chosen_mask", "rejected_mask")}
    return chat.preference_pairs(pairs).withColumns(spans).withColumn("n_common", F.col("n_common").cast("bigint"))


@query("op8_url_filters", r"""
WITH page AS (SELECT page_id, DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS fetched,
    lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^([A-Za-z][A-Za-z0-9+.\-]*:)?//', ''), '[/?#\\].*$', ''), '^.*@', ''), '(:[0-9]*)?$', ''), '\.$', '')) AS h FROM pages),
cap AS (SELECT page_id, fetched, CASE WHEN length(h) > 0 THEN h END AS host FROM page),
seen AS (SELECT host AS pattern, min(page_id) AS m FROM cap WHERE host IS NOT NULL GROUP BY host),
up AS (SELECT regexp_replace(host, '^[^.]*\.', '') AS pattern, min(page_id) AS m FROM cap WHERE len(string_split(host, '.')) > 3 GROUP BY 1),
entry AS (SELECT 'block' AS list, pattern, m % 200 AS day, 'add' AS action FROM seen WHERE m % 3 = 0
  UNION ALL SELECT 'block', pattern, m % 200 + 60, 'remove' FROM seen WHERE m % 6 = 0
  UNION ALL SELECT 'block', pattern, m % 200 + 120, 'add' FROM seen WHERE m % 12 = 0
  UNION ALL SELECT 'allow', pattern, m % 300, 'add' FROM seen WHERE m % 5 = 0
  UNION ALL SELECT 'block', pattern, m % 100, 'add' FROM up WHERE m % 4 = 1),
span AS (SELECT list, pattern, day, action, lead(day) OVER (PARTITION BY list, pattern ORDER BY day) AS until FROM entry),
part AS (SELECT page_id, fetched, array_to_string(w[i:], '.') AS pattern FROM (SELECT page_id, fetched, string_split(host, '.') AS w, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM cap WHERE host IS NOT NULL)),
found AS (SELECT page_id, list, pattern, DATE '2024-01-01' + CAST(day AS INTEGER) AS first_day, row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, list, pattern DESC, day DESC) AS r
  FROM part JOIN span USING (pattern) WHERE action = 'add' AND fetched - DATE '2024-01-01' >= day AND (until IS NULL OR fetched - DATE '2024-01-01' < until))
SELECT page_id, CASE WHEN list = 'block' THEN 'drop' ELSE 'keep' END AS verdict, list, pattern, CAST(first_day AS VARCHAR) AS first_day FROM cap LEFT JOIN (FROM found WHERE r = 1) USING (page_id)""")
def url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Pages count as fetched on day page_id % 365 of 2024; the dated lists are derived from the hosts seen, by their first page's number."""
    captures = table(spark, folder, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 365).cast("int")).alias("fetched"))
    hosts = captures.select("page_id", urls.host_of(F.col("url")).alias("host")).where("host is not null")
    seen = hosts.groupBy(F.col("host").alias("pattern")).agg(F.min("page_id").alias("m"))
    up = hosts.where(F.size(F.split("host", r"\.")) > 3).groupBy(F.regexp_replace("host", r"^[^.]*\.", "").alias("pattern")).agg(F.min("page_id").alias("m"))

    def entries(rows: DataFrame, where: str, list_: str, day: str, action: str) -> DataFrame:
        return rows.where(where).select(F.lit(list_).alias("list"), "pattern", F.date_add(F.lit("2024-01-01").cast("date"), F.expr(day).cast("int")).alias("day"), F.lit(action).alias("action"))

    dated = [entries(seen, "m % 3 = 0", "block", "m % 200", "add"), entries(seen, "m % 6 = 0", "block", "m % 200 + 60", "remove"), entries(seen, "m % 12 = 0", "block", "m % 200 + 120", "add"),
             entries(seen, "m % 5 = 0", "allow", "m % 300", "add"), entries(up, "m % 4 = 1", "block", "m % 100", "add")]
    every = dated[0]
    for d in dated[1:]:
        every = every.unionByName(d)
    found = urls.judged(captures, every)
    return found.select("page_id", "decision.verdict", "decision.list", "decision.pattern", F.col("decision.first_day").cast("string").alias("first_day"))
