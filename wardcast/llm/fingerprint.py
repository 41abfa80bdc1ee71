"""Document fingerprints: bottom-k sketches of word-shingle hashes, in built-in functions only.

A sketch is the sorted array of the ``K`` smallest distinct 48-bit shingle hashes. The sketch of a whole is the merge of the sketches of its
parts (parts of one text must overlap by ``SHINGLE`` - 1 words). Estimates from k values have a standard error of about
sqrt(s (1 - s) / k) for a resemblance s, and of 1 / sqrt(k) of the number of shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHINGLE, K, BITS = 5, 128, 48
SPACE = r"[\x20\x09-\x0D]+"
#: Bounds looked through one by one in each of two steps.
FAN = 32


def with_sketch(df: DataFrame, text: str, name: str, size: int = SHINGLE, k: int = K) -> DataFrame:
    """``df`` with the bottom-k sketch of a text column.

    Words are runs without ASCII white space, in lower case. Fewer than ``size`` words are one shingle; a null text and one without
    words have the empty sketch. A text of any length is one row's array, so cut texts of many millions of words into parts
    and merge their sketches.
    """
    # Words are hashed once each; a shingle hashes the hashes. The steps are columns of their own so that lambdas do not repeat them.
    words, hashes = f"{name}_words", f"{name}_hashes"
    out = df.withColumn(words, F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SPACE), lambda w: w != ""))
    out = out.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    h, n = F.col(hashes), F.size(hashes)
    full = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(size)]))
    found = F.when(n >= size, full).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
    kept = F.transform(found, lambda x: F.shiftrightunsigned(x, 64 - BITS))
    return out.withColumn(name, F.slice(F.sort_array(F.array_distinct(kept)), 1, k)).drop(words, hashes)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; two empty sketches are alike."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(2.0**BITS) / F.element_at(a, -1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b also has; 1 for an empty a."""
    s = resemblance(a, b, k)
    shared = s * distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    """A sketch as one string of fixed-width hexadecimal numbers."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), BITS // 4, "0")), "")


def _bucket(id_: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the id, in two steps of at most about sqrt(len) * 2 comparisons each."""
    if not bounds:
        return F.lit(0)
    fan = max(FAN, int(len(bounds) ** 0.5))
    coarse, fine = (F.array(*[F.lit(x).cast("bigint") for x in xs]) for xs in (bounds[::fan], bounds))
    block = F.greatest(F.size(F.filter(coarse, lambda x: x <= id_)) - 1, F.lit(0)) * fan
    return block + F.size(F.filter(F.slice(fine, block + 1, fan), lambda x: x <= id_))


def with_next(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` (with a bigint doc_id) and, as next_<column>, columns of the row after it by descending doc_id; the first follows the last.

    Rows are dealt by ranges of ids with bounds from approximate quantiles, several ranges per shuffle partition, so
    they move once. The row that starts a range also goes to the end of the range before it. Rows with equal ids
    follow each other in the order of their hash. Rows without an id follow themselves.
    """
    spark = df.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    found = df.agg(F.percentile_approx("doc_id", shares, F.lit(10 * ranges))).first()[0]
    bounds = sorted(set(found or []))
    numbered = df.withColumn("_range", _bucket(F.col("doc_id"), bounds)).withColumn("_extra", F.lit(0))
    numbered = numbered.withColumn("_tie", F.xxhash64(*columns))
    known = numbered.where("doc_id is not null")
    # One row per range: the largest id in each, in the order of the walk.
    tops = df.where("doc_id is not null").select(_bucket(F.col("doc_id"), bounds).alias("range"), "doc_id").groupBy("range").agg(F.max("doc_id").alias("top")).orderBy(F.desc("range")).collect()
    ends = [(tops[(i + 1) % len(tops)]["top"], r["range"]) for i, r in enumerate(tops)]
    starts = F.broadcast(spark.createDataFrame(ends, "_top bigint, _to int"))
    extra = known.join(starts, F.col("doc_id") == F.col("_top")).withColumn("_range", F.col("_to")).withColumn("_extra", F.lit(1)).drop("_top", "_to")
    walk = Window.partitionBy("_range").orderBy("_extra", F.desc("doc_id"), "_tie")
    out = known.unionByName(extra).select("*", *[F.lead(c).over(walk).alias(f"next_{c}") for c in columns]).where("_extra = 0")
    alone = numbered.where("doc_id is null").select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    return out.unionByName(alone).drop("_range", "_extra", "_tie")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Sketches of every text and of its edited text, with the likeness of both and of the next document.

    The edited text has the last third of its code points (rounded down) replaced by as many first ones of the next document, or all
    it has. Null is empty. Columns: doc_id, n_chars, edited (text), sketch, edited_sketch, next_sketch. Repeated rows each
    give a row; an empty table gives an empty table. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    both = with_next(with_sketch(rows, "text", "sketch"), ["text", "sketch"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.when(third == 0, F.col("text")).otherwise(F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)))
    out = both.select("doc_id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    return with_sketch(out, "edited", "edited_sketch")
