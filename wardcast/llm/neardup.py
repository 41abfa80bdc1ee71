"""Near-duplicate groups by SetSketch registers.

1. Each text becomes its set of word shingles and a SetSketch: ``REGISTERS`` truncated, exponentially spaced minima.
   Registers of two parts merge by their maxima. Texts with the same set form one class, which counts as one node.
2. Bands of ``ROWS`` register values are the buckets. Nodes of a bucket are compared with its smallest node only; the joint
   likelihood of both sketches discards what is far from the threshold, the full sets decide. Components of
   these links close most buckets.
3. Buckets that still hold several components go to an exact way: the nodes in them are joined on the rare shingles of
   which linked sets must share one (prefix filter), again star by star, until no bucket has two components
   with pairs not yet compared. Sizes, places in the order and a bitmap of each set bound what two sets can share; only pairs that pass go on.

No step emits all pairs of a bucket while components can still merge, and none brings a bucket into one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardcast.llm.components import components
from wardcast.llm.text import digest, mix, placed, shingle_set, text_bytes
from wardcast.session import drop_table, via_table

REGISTERS, ROWS = 252, 6
BASE, RATE, LIMIT = 1.001, 20.0, 2**16 - 2
#: Places of rows sent to all tasks to pick texts at the scan (a row carries node, size and place: 32 bytes); more ids take a shuffled join.
MAX_IDS = 1_000_000
#: Counters of the shingle frequencies that order the prefix filter: 4 bytes each.
COUNTERS = 1 << 20
#: Nodes of a bucket that the others are compared with in the first round; smaller buckets are done in that round.
CENTERS = 16
#: Shingles before a prefix shingle that its row carries, so that most pairs are met once.
BEFORE = 8
#: 64-bit words of the bitmap of a set that rows of open buckets carry.
BITMAP = 8


@cache
def _steps(registers: int) -> np.ndarray:
    """Step widths that visit every register."""
    return np.array([s for s in range(1, registers) if np.gcd(s, registers) == 1] or [1], np.uint64)


def sketch(elements: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """SetSketch of distinct 64-bit hashes, as unsigned 16-bit registers; all 0 for no elements.

    The exponential line is cut into ``registers`` intervals of equal mass. Every element has one point in each interval,
    and these go to the registers in an order of its own. Levels are added until every register has a
    point in a level reached, since later points are larger.
    """
    low = np.full(registers, np.inf)
    if not len(elements):
        return np.zeros(registers, np.uint16)
    m = np.uint64(registers)
    steps = _steps(registers)
    order = mix(elements ^ np.uint64(0xD1B54A32D192ED03))
    start, step = order % m, steps[(order >> np.uint64(32)) % np.uint64(len(steps))]
    level = 0
    while level < registers and not (low <= level).all():
        more = int(min(registers - level, max(1, np.ceil(registers * (np.log(registers) + 3) / len(elements)) - level)))
        if level:
            more = int(min(registers - level, max(1, level // 2)))
        j = np.arange(level, level + more, dtype=np.uint64)[:, None]
        at = (start + step * j) % m
        point = (mix(elements + (j + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) * 2.0**-53
        np.minimum.at(low, at.ravel().astype(np.int64), (point + j).ravel())
        level += more
    x = -np.log1p(-np.minimum(low, registers - 1e-9) / registers) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def joint_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs (rows of registers, set sizes known) with the greatest likelihood of the register comparison."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    top = np.minimum(u / v, v / u)

    def chance(x):
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)

    def likelihood(j):
        p, q = chance(u - v * j), chance(v - u * j)
        return more * np.log(p) + less * np.log(q) + same * np.log(np.clip(1 - p - q, 1e-12, 1))

    low, high = np.zeros(len(top)), top.copy()
    for _ in range(40):
        c, d = low + (high - low) / 3, high - (high - low) / 3
        left = likelihood(c) >= likelihood(d)
        low, high = np.where(left, low, c), np.where(left, d, high)
    return (low + high) / 2


def sketched(docs: DataFrame, size: int, *keep: str) -> DataFrame:
    """doc_id, n_shingles, key (128 bits of the set's content), registers and the bigint columns named; key and registers are null for empty sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, registers = [], [], []
            for text in batch.column(batch.num_columns - 1):
                found = shingle_set(text.as_py(), size)
                n.append(len(found))
                keys.append(digest(found) if len(found) else None)
                registers.append(sketch(found).astype(">u2").tobytes() if len(found) else None)
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(registers, pa.binary()), *batch.columns[1:-1]],
                                  names=["doc_id", "n_shingles", "key", "registers", *keep])

    kinds = ", ".join(["doc_id bigint, n_shingles bigint, key binary, registers binary", *[f"{c} bigint" for c in keep]])
    return text_bytes(docs, F.col("doc_id").cast("bigint").alias("doc_id"), *keep).mapInArrow(run, kinds)


def _pick(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n and text of the given nodes (node, n, file, row): each node's first row, found by its place."""
    wanted = nodes.select("node", "n", F.col("file").alias("_file"), F.col("row").alias("_row"))
    if wanted.count() <= MAX_IDS:
        wanted = F.broadcast(wanted)
    rows = text_bytes(docs, "file", "row").join(wanted, (F.col("file") == F.col("_file")) & (F.col("row") == F.col("_row")))
    return rows.select("node", "n", "text")


def _likely(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose joint likelihood allows the threshold; the margin is six standard deviations."""
    margin = 6 * (least * (1 - least) / REGISTERS) ** 0.5
    small = nodes.select("node", "n", "registers")
    both = pairs.join(small.toDF("a", "n_a", "r_a"), "a").join(small.toDF("b", "n_b", "r_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), ">u2").reshape(batch.num_rows, -1) for c in ("r_a", "r_b"))
            n_a, n_b = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            yield batch.filter(pa.array(joint_estimate(a, b, n_a, n_b) >= least - margin)).select(["a", "b"])

    return both.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold. Partners of a node with many pairs come by a join that skew handling splits."""
    t = texts.select("node", "text")
    both = pairs.join(t.toDF("a", "t_a"), "a").join(t.toDF("b", "t_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            keep = []
            for b, t_a, t_b in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if b != last:
                    last, held = b, shingle_set(t_b.as_py(), size)
                found = shingle_set(t_a.as_py(), size)
                common = len(np.intersect1d(found, held, assume_unique=True))
                keep.append(100 * common >= percent * (len(found) + len(held) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return both.select("a", "b", "t_a", "t_b").mapInArrow(run, "a bigint, b bigint")


def _shared(rows: DataFrame) -> DataFrame:
    """The rows (bucket, node, ..) of buckets with at least two nodes."""
    several = rows.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("bucket")
    return rows.join(several, "bucket").select(*rows.columns)


def _in_reach(rows: DataFrame, least: float) -> DataFrame:
    """The rows (bucket, node, n, place) that may still pair with the smallest set of their bucket, of buckets with at least two nodes.

    Two sets whose first common shingle has places p and q in their orders share at most min(n - p, m - q) shingles.
    """
    small = rows.groupBy("bucket").agg(F.min("n").alias("small"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("bucket", "small")
    near = rows.join(small, "bucket").where(F.col("n") - F.col("place") >= (F.col("n") + F.col("small")) * (least / (1 + least)) - 1e-6)
    return _shared(near.drop("small"))


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with their component, of buckets that hold more than one component."""
    found = members.join(labels.select("node", F.col("component").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
    return _still_open(found)


def _still_open(members: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component."""
    several = members.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
    return members.join(several, "bucket").select(*members.columns)


def _sizes_allow(least: float):
    """No pair of sets beyond this ratio of sizes reaches the threshold."""
    return F.least("n", "center_n") >= F.greatest("n", "center_n") * least - 1e-6


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b")).distinct()


def _first_stars(members: DataFrame, least: float) -> DataFrame:
    """Pairs of each bucket's nodes with its smallest node."""
    centers = members.groupBy("bucket").agg(F.min("node").alias("center"))
    centers = centers.join(members.select("bucket", F.col("node").alias("center"), F.col("n").alias("center_n")), ["bucket", "center"])
    return _pairs(members.join(centers, "bucket").where(F.col("node") != F.col("center")).where(_sizes_allow(least)))


def _bitmaps(texts: DataFrame, size: int) -> DataFrame:
    """node and bits: which of 64 * ``BITMAP`` places the shingles of its set fall on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                flags = np.zeros(64 * BITMAP, np.uint8)
                flags[(mix(shingle_set(text.as_py(), size)) % np.uint64(64 * BITMAP)).astype(np.int64)] = 1
                out.append(np.packbits(flags).view(">i8").astype(np.int64).tolist())
            yield pa.record_batch([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["node", "bits"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, bits array<bigint>")


def _bits_allow(least: float):
    """Whether two sets can share enough by their bitmaps: a place that only one of them has stands for a shingle that the other lacks."""
    def lacks(a: str, b: str):
        return sum((F.bit_count(F.col(a)[i].bitwiseAND(F.bitwise_not(F.col(b)[i]))) for i in range(1, BITMAP)), F.bit_count(F.col(a)[0].bitwiseAND(F.bitwise_not(F.col(b)[0]))))

    most = F.least(F.col("n") - lacks("bits", "center_bits"), F.col("center_n") - lacks("center_bits", "bits"))
    return most >= (F.col("n") + F.col("center_n")) * (least / (1 + least)) - 1e-6


def _stars(members: DataFrame, least: float, centers_each: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of each bucket's nodes with ``centers_each`` nodes of its smallest components, and what is left without these.

    The components' sizes are counted per bucket, so that a bucket of one large component and a few others is done
    after as many comparisons as it has rows for each of the others.
    """
    sizes = members.groupBy("bucket", "label").agg(F.count("*").alias("size"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("size", "node"))
    centers = members.join(sizes, ["bucket", "label"]).withColumn("rank", rank).where(F.col("rank") <= centers_each)  # limited before the shuffle
    centers = via_table(centers.select(
        "bucket", F.col("node").alias("center"), F.col("label").alias("center_label"), F.col("n").alias("center_n"), F.col("place").alias("center_place"), F.col("before").alias("center_before"), F.col("bits").alias("center_bits")), "centers")
    enough = F.least(F.col("n") - F.col("place"), F.col("center_n") - F.col("center_place")) >= (F.col("n") + F.col("center_n")) * (least / (1 + least)) - 1e-6
    # Two sets that also share one of the shingles just before this one in their orders meet in that one's bucket.
    earlier = F.arrays_overlap("before", "center_before")
    pairs = _pairs(members.join(centers, "bucket").where("label != center_label").where(_sizes_allow(least)).where(enough & _bits_allow(least) & ~earlier))
    left = members.join(centers.select("bucket", F.col("center").alias("node")), ["bucket", "node"], "left_anti")
    return pairs, _still_open(left.select(*members.columns))


def _prefixes(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(bucket, node, n, place, before): of every set the rarest shingles, of which two linked sets share at least one, with their places in the
    order and the ``BEFORE`` shingles before.

    The order is by a shared counter (2**20 counters over the given texts), then by hash, so it is the same for all sets.
    """
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(total, (shingle_set(text.as_py(), size) % np.uint64(COUNTERS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    counts = np.zeros(COUNTERS, np.uint32)
    rows = texts.select("text").mapInArrow(tally, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts[rows.column(0).to_numpy()] = np.minimum(rows.column(1).to_numpy(), 2**32 - 1)
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = shared.value
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = shingle_set(text.as_py(), size)
                length = len(found) - -(-len(found) * percent // 100) + 1
                order = np.lexsort((found, rare[(found % np.uint64(COUNTERS)).astype(np.int64)]))[:length]
                values = found[order].view(np.int64)
                yield pa.record_batch([pa.array(values), pa.array(np.full(length, node)), pa.array(np.full(length, len(found))), pa.array(np.arange(length)), pa.array([values[max(0, i - BEFORE):i] for i in range(length)], pa.list_(pa.int64()))],
                                      names=["bucket", "node", "n", "place", "before"])

    return texts.select("node", "text").mapInArrow(cut, "bucket bigint, node bigint, n bigint, place bigint, before array<bigint>")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text; other columns are ignored).

    Texts are linked when the Jaccard similarity of their sets of ``size``-word shingles is at least ``percent`` / 100.
    component_id is the smallest doc_id of the group. A text without words is null's equal: it has no shingles, is linked with
    nothing and kept. Rows that repeat a doc_id are judged by their own texts. A null doc_id is never
    kept, unless it has no words or its whole group has no id. Ties (equal sets) are one class. An empty table gives an empty table.
    """
    found = _grouped(_texts(placed(docs)), size, percent)
    component = F.coalesce("first", "rep", "doc_id")
    kept = F.col("key").isNull() | component.isNull() | F.coalesce(F.col("doc_id") == component, F.lit(False))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def _texts(rows: DataFrame) -> DataFrame:
    """doc_id, text, file and row of ``placed`` rows."""
    return rows.select("all.doc_id", "all.text", "place.file", "place.row")


def _grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Rows of ``sketched`` with their class (node, rep: its smallest doc_id) and of linked ones the component and its smallest doc_id (first)."""
    rows = via_table(sketched(docs, size, "file", "row"), "sketches")
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row")
    classes = rows.where("key is not null").groupBy("key").agg(F.min(at).alias("at"), F.any_value("n_shingles").alias("n"), F.any_value("registers").alias("registers"))
    classes = classes.select("key", F.col("at.doc_id").alias("rep"), "n", "registers", "at.file", "at.row")
    nodes = via_table(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    bands = nodes.select("node", "n", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1)), lambda i: F.substring("registers", i * (2 * ROWS) + 1, F.lit(2 * ROWS)))).alias("band", "value"))
    members = via_table(_shared(bands.select(F.xxhash64("band", "value").alias("bucket"), "node", "n")), "buckets")
    labels = None
    if not members.isEmpty():
        texts = via_table(_pick(docs, nodes.join(members.select("node").distinct(), "node", "left_semi")), "texts")
        links = via_table(_verified(_likely(_first_stars(members, percent / 100), nodes, percent / 100), texts, size, percent), "pairs")
        labels = via_table(components(links), "labels")
        rest = via_table(_labelled(members, labels).select("node").distinct(), "rest")
        drop_table(members)
        if not rest.isEmpty():
            labels = _exact_rest(via_table(texts.join(rest, "node", "left_semi"), "rest-texts"), labels, size, percent)
        drop_table(texts)
    result = rows.join(nodes.select("key", "node", "rep"), "key", "left")
    if labels is not None:
        first = nodes.select("node", "rep").join(labels, "node").groupBy("component").agg(F.min("rep").alias("first"))
        return result.join(labels.join(first, "component").select("node", "component", "first"), "node", "left")
    return result.withColumns({"component": F.lit(None).cast("bigint"), "first": F.lit(None).cast("bigint")})


def _exact_rest(texts: DataFrame, labels: DataFrame, size: int, percent: int) -> DataFrame:
    """Labels after all links among ``texts`` are found by the prefix filter, in rounds of stars.

    The components so far stay the same during the rounds, and the number of centers doubles: a bucket of n nodes is done after about
    log2(n / CENTERS) rounds.
    """
    least, centers = percent / 100, CENTERS
    members = via_table(_labelled(_in_reach(_shared(_prefixes(texts, size, percent)), least), labels).join(_bitmaps(texts, size), "node"), "open")
    links = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
    while not members.isEmpty():
        pairs, left = _stars(members, least, centers)
        links = links.unionByName(via_table(_verified(pairs, texts, size, percent), "links"))
        left = via_table(left, "open")
        drop_table(members)
        members = left
        centers *= 2
    return via_table(components(links), "labels")


def without_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group, all columns kept: the one of the smallest doc_id, a null id last, then of the first place in the files.

    Rows are judged one by one, whether or not they have an id or repeat one. Rows without words all stay.
    """
    rows = placed(docs)
    found = _grouped(_texts(rows), size, percent).where("key is not null")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row")
    members = via_table(found.select(F.coalesce("component", "node").alias("group"), order.alias("at")), "groups")
    stays = members.groupBy("group").agg(F.min("at").alias("stays"), F.max("at").alias("last")).where("stays < last").select("group", "stays")
    gone = via_table(members.join(stays, "group").where("at != stays").select("at.file", "at.row"), "gone")
    if gone.count() <= MAX_IDS:
        gone = F.broadcast(gone)
    same = (F.col("place.file") == F.col("file")) & (F.col("place.row") == F.col("row"))
    return rows.join(gone, same, "left_anti").select("all.*")
