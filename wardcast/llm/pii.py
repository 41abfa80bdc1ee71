"""Personal data: patterns for what is always protected, and information-theoretic sanitisation of the terms beside it. Built-in functions only.

1. ``with_base`` finds e-mail addresses, IP addresses, card numbers and phone numbers. Their values are the protected entities.
2. A term is a word of at least three letters, A-Z and other letters in lower case. It co-occurs with an entity where it stands in a text that
   mentions it, however far away.
3. With n(e) mentions of an entity, n(t) occurrences of a term, n(e,t) of them in texts that mention the entity, and N words in all, the entity's
   information content is log2(N / n(e)) and what the term tells of it PMI = log2(N n(e,t) / (n(e) n(t))). The difference, -log2 of the
   share of the term's occurrences in texts with the entity, is what stays unknown of the entity to one who reads the term.
4. Terms that leave at most ``REMOVE`` bits unknown are removed wherever they stand in a text with the entity; up to ``GENERALISE`` bits they are
   generalised. Only terms seen with the entity in ``LEAST_CONTEXTS`` texts with different contexts count: a context is the text within ``CONTEXT`` characters
   of a mention, so copies and near copies are one. Entities without so many contexts, and terms of which too few occurrences lie in texts with any such
   entity, cannot count and leave before pairs are made; pairs of a text are its other entities times its other terms.

Nulls: a null text is empty; a null id is kept. Repeated rows each get the same spans. A row without personal data has empty spans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardcast.session import via_table

CONTEXT, LEAST_LETTERS, LEAST_CONTEXTS = 120, 3, 3
REMOVE, GENERALISE = 1.0, 2.0
#: Parts into which copies of one text are dealt.
SALTS = 16

# The contract's patterns, written so that Java's matcher neither recurses nor looks at a run of characters from each of its places:
# possessive repeats (nothing that follows could use what they took), and a start only where a run starts or the last match ended.
LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# A match is a whole run of digits with single separators; only runs of 12 to 19 digits pass, so others are not matched at all.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
KINDS = ("email", "ip", "card", "phone")
PATTERNS = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    n = F.length(digits)
    digit = lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int")
    weigh = lambda i: F.when(i % 2 == 1, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda total, i: total + weigh(i)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """Whether a match of the kind's pattern is kept."""
    if kind == "ip":
        return value.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")
    if kind == "card":
        return luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


SPANS = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def matches(text: str, pattern: str, kind: str, rank: int, keep=lambda value: F.lit(True)) -> Column:
    """Spans (start, rank, end, kind, value) of a pattern in the column ``text``, in code points, end exclusive.

    What lies between the matches (``split``) and the matches themselves add up to the places. Steps are linear but for the growing
    array: a text with very many matches costs their square in copied entries of 40 bytes.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    between = F.split(F.col(text), pattern, -1)
    pairs = F.filter(F.arrays_zip(between.alias("gap"), found.alias("value")), lambda x: x["value"].isNotNull())
    empty = F.array().cast(SPANS)
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + F.length(x["gap"])
        last = first + F.length(x["value"])
        span = F.struct(first.alias("start"), F.lit(rank).alias("rank"), last.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        return F.struct(last.alias("at"), F.when(keep(x["value"]), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.when(F.regexp_like(F.col(text), F.lit(pattern)), F.aggregate(pairs, start, step)["spans"]).otherwise(empty)


def with_base(docs: DataFrame, keep: Sequence[str], name: str = "base") -> DataFrame:
    """The named columns, the text (null as empty) and its base spans in order."""
    rows = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    hint = {"email": "@", "phone": "+", "ip": "."}
    parts = []
    for rank, kind in enumerate(KINDS):
        spans = matches("text", PATTERNS[kind], kind, rank, lambda value, kind=kind: valid(kind, value))
        parts.append(F.when(F.contains(F.col("text"), F.lit(hint[kind])), spans).otherwise(F.array().cast(SPANS)) if kind in hint else spans)
    return rows.withColumn(name, F.array_sort(F.concat(*parts)))


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


LETTERS = rf"(?<![\p{{L}}\p{{N}}])\p{{L}}{{{LEAST_LETTERS},}}+(?![\p{{L}}\p{{N}}])"


def _contexts(context: int) -> Column:
    """Per base span: its entity, and the text on either side with the place where it starts. A word cut by the far edge joins a letter and so is no term."""
    def around(s: Column) -> Column:
        low = F.greatest(s["start"] - context, F.lit(0))
        before = F.concat(F.when(low > 0, "x").otherwise(" "), F.substring(F.col("text"), low + 1, s["start"] - low), F.lit(" "))
        after = F.concat(F.lit(" "), F.substring(F.col("text"), s["end"] + 1, F.lit(context)), F.when(F.length("text") > s["end"] + context, "x").otherwise(" "))
        return F.struct(F.concat_ws(":", s["kind"], F.lower(s["value"])).alias("entity"), F.array(
            F.struct((low - 1).alias("from"), before.alias("words")), F.struct((s["end"] - 1).alias("from"), after.alias("words"))).alias("sides"))

    return F.transform("base", around)


def found(docs: DataFrame, context: int = CONTEXT) -> DataFrame:
    """doc_id, base spans, and for rows with personal data contexts, a key of the text and the text; stored in the shared folder."""
    rows = with_base(docs, ["doc_id"]).select(
        "doc_id", "base", F.when(F.size("base") > 0, _contexts(context)).alias("contexts"), F.when(F.size("base") > 0, F.sha2(F.col("text").cast("binary"), 256)).alias("key"),
        F.when(F.size("base") > 0, F.col("text")).alias("text"))
    return via_table(rows, "personal")


def _texts(rows: DataFrame) -> DataFrame:
    """One row per different text with personal data; copies are counted, not repeated."""
    return rows.where("key is not null").groupBy("key").agg(F.first("text").alias("text"), F.first("contexts").alias("contexts"), F.count("*").alias("copies"))


def _marked(texts: DataFrame) -> DataFrame:
    """key, entity and context (hash; one of the mentions') of each entity of each text."""
    mentions = texts.select("key", F.explode("contexts").alias("c")).select("key", "c.entity", F.xxhash64("c.sides.words").alias("context"))
    return mentions.groupBy("key", "entity").agg(F.min("context").alias("context"))


def _terms(texts: DataFrame) -> DataFrame:
    """key and term with its span, for every occurrence; places are running sums, so a long text costs no more per word than a short one."""
    found = F.regexp_extract_all(F.col("text"), F.lit(LETTERS), F.lit(0))
    pairs = texts.select("key", F.posexplode(F.arrays_zip(F.split(F.col("text"), LETTERS, -1).alias("gap"), found.alias("value"))).alias("i", "x")).where("x.value is not null")
    end = F.sum(F.length("x.gap") + F.length("x.value")).over(W.partitionBy("key").orderBy("i")).cast("int")
    return pairs.select("key", F.lower("x.value").alias("term"), end.alias("end"), F.length("x.value").alias("size")).select("key", "term", (F.col("end") - F.col("size")).alias("start"), "end")


def disclosures(docs: DataFrame, rows: DataFrame, generalise: float = GENERALISE, least: int = LEAST_CONTEXTS) -> DataFrame:
    """entity, term, n_entity, n_term, n_both, contexts, information, pmi, unknown (bits) of the terms that leave at most ``generalise`` bits unknown.

    Counts are over all documents, copies included; different contexts are counted once. Empty tables give an empty result.
    """
    texts = _texts(rows)
    marked = _marked(texts)
    # by context first, here and below, so that a hot entity or pair is spread and counted without a list of contexts
    often = marked.select("entity", "context").distinct().groupBy("entity").agg(F.count("*").alias("contexts")).where(F.col("contexts") >= least)
    marked = via_table(marked.join(often, "entity", "left_semi").select("key", "entity", "context"), "marked")
    words = docs.select(F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(LETTERS), F.lit(0))).alias("word")).groupBy(F.lower("word").alias("term")).agg(F.count("*").alias("n_term"))
    own = texts.join(marked.select("key").distinct(), "key", "left_semi").select("key", "copies", F.explode(F.regexp_extract_all(F.col("text"), F.lit(LETTERS), F.lit(0))).alias("word"))
    own = via_table(own.groupBy("key", F.lower("word").alias("term")).agg((F.count("*") * F.first("copies")).alias("n")), "terms")
    # a term with one entity has at most as many occurrences as with any
    near = own.groupBy("term").agg(F.sum("n").alias("n_near")).join(words, "term").where(F.col("n_near") >= F.col("n_term") * F.lit(0.999 * 2.0**-generalise)).select("term", "n_term")
    pairs = own.join(near, "term").join(marked, "key").groupBy("entity", "term", "n_term", "context").agg(F.sum("n").alias("n")).groupBy("entity", "term", "n_term").agg(
        F.sum("n").alias("n_both"), F.count("*").alias("contexts")).where(F.col("contexts") >= least)
    entities = rows.where("key is not null").select(F.explode("contexts.entity").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    total = words.agg(F.sum("n_term").alias("n"))
    both = pairs.join(entities, "entity").withColumn("total", total.scalar())
    share = F.col("n_both") / F.col("n_term")
    information = F.log2(F.col("total") / F.col("n_entity"))
    out = both.withColumns({"unknown": F.abs(F.log2(share)), "information": information}).withColumn("pmi", F.col("information") - F.col("unknown"))
    return out.where(F.col("unknown") <= generalise).select("entity", "term", "n_entity", "n_term", "n_both", "contexts", "information", "pmi", "unknown")


def personal_data(docs: DataFrame, remove: float = REMOVE, generalise: float = GENERALISE, least: int = LEAST_CONTEXTS, context: int = CONTEXT) -> DataFrame:
    """Per row of ``docs``: doc_id, base (spans) and spans: base and the terms to remove or generalise (kinds ``remove`` and ``general``).

    A span has start, rank, end, kind, value; places are code points. Other columns of ``docs`` are ignored, whatever their names. Terms never
    overlap base spans. Which terms of a text go depends on the text and the counts alone, so equal texts have equal spans.
    """
    rows = found(docs, context)
    revealing = via_table(disclosures(docs, rows, generalise, least), "disclosures")
    texts = _texts(rows)
    wanted = via_table(_marked(texts).join(revealing.select("entity", "term", "unknown"), "entity").groupBy("key", "term").agg(F.min("unknown").alias("unknown")), "wanted")
    spans = _terms(texts.join(wanted.select("key").distinct(), "key", "left_semi")).join(wanted, ["key", "term"])
    kind = F.when(F.col("unknown") <= remove, "remove").otherwise("general")
    rank = F.when(F.col("unknown") <= remove, len(KINDS)).otherwise(len(KINDS) + 1)
    added = spans.groupBy("key").agg(F.collect_list(F.struct("start", rank.cast("int").alias("rank"), "end", kind.alias("kind"), F.col("term").alias("value"))).alias("added"))
    clear = F.filter(F.coalesce("added", F.array().cast(SPANS)), lambda a: ~F.exists("base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    # Rows without personal data have nothing to look up. Copies of one text are dealt over tasks by salt.
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")
    salted = added.select("key", "added", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("salt"))
    some = rows.where("key is not null").select("*", salt).join(salted, ["key", "salt"], "left").select("doc_id", "base", F.array_sort(F.concat("base", clear)).alias("spans"))
    return rows.where("key is null").select("doc_id", "base", F.col("base").alias("spans")).unionByName(some)


MASKS = {"email": "[email]", "ip": "[ip]", "card": "[card]", "phone": "[phone]", "remove": "", "general": "[word]"}


def sanitised(text: Column, spans: Column) -> Column:
    """The text with protected values masked, revealing terms removed, and others made general. Of overlapping spans the first decides, and its mask stands for all."""
    mask = F.create_map(*[F.lit(x) for pair in MASKS.items() for x in pair])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), mask[s["kind"]])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, piece).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, start, step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
