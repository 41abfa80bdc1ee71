"""Best-fit packing of token pieces into sequences of fixed capacity, by bin completion.

Pieces of one length are interchangeable, so the search runs on the counts per length: at most ``capacity`` numbers, whatever
the size of the table. Its answer is a list of fillings (lengths in one sequence) with the number of sequences to
fill that way. Pieces then find their place by their rank among the pieces of their length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardcast.llm.text import text_bytes
from wardcast.session import via_table

CAPACITY = 2048
#: Branches of the search at most.
NODES = 4000
#: Fillings tried before the enumeration; steps of all enumerations at most, and what one test of dominance counts.
WIDTH, STEPS, DOMINANCE = 3, 2_000_000, 50
TOKENIZER = "byte_bpe_50k.json"
#: The same vocabulary as ranks, for the faster encoder; None always takes ``tokenizers``.
RANKS = "byte_bpe_50k.tiktoken"
END = 0


@lru_cache(maxsize=4)
def _encoder(tokenizer: str, ranks: str | None):
    """A function from text to ids.

    ``tiktoken`` with the same vocabulary is about four times as fast as ``tokenizers``. It takes texts whose
    code points all lie below U+0240, where both libraries class letters alike, and that hold no special token; all
    other texts go to ``tokenizers``.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path(tokenizer))
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    if ranks is None:
        return lambda data: slow.encode(data.decode(), add_special_tokens=False).ids
    import base64

    import tiktoken

    with open(public_tokenizers.path(ranks), "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(data: bytes):
        text = data.decode()
        if np.frombuffer(data, np.uint8).max(initial=0) > 0xC8 or any(s in text for s in special):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, ranks: str | None = RANKS) -> DataFrame:
    """Pieces of documents: doc_id, piece, start, length, ids (unsigned 32-bit, little-endian).

    A document is its ids followed by id 0; a null or empty text is that one id. Only documents longer than ``capacity``
    are cut; all pieces but the first are full. Rows with a null or repeated doc_id are cut like any other.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer, ranks)
        names = ["doc_id", "piece", "start", "length", "ids"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(np.asarray(encode(text.as_py()), dtype="<u4"), np.uint32(END)).astype("<u4")
                at, piece = 0, 0
                while at < len(ids):
                    size = (len(ids) - at) % capacity or capacity
                    rows.append((doc_id, piece, at, size, ids[at:at + size].tobytes()))
                    at, piece, held = at + size, piece + 1, held + size
                    if held > 1_000_000:
                        yield batch_of(rows)
                        rows, held = [], 0
            if rows:
                yield batch_of(rows)

    source = text_bytes(docs, F.col("doc_id").cast("bigint").alias("doc_id"))
    return source.mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids binary")


# ---- the search, on counts per length ------------------------------------------------------------------------------

Filling = tuple[int, ...]  # lengths in one sequence, longest first
Plan = list[tuple[Filling, int]]  # fillings and how many sequences get each


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: the total, or for some k the items over capacity - k alone, those over half, and the rest from k on."""
    sizes = np.arange(len(counts))
    n, mass = np.cumsum(counts), np.cumsum(counts * sizes)
    best = -(-int(mass[-1]) // capacity)
    half = capacity // 2
    for k in range(1, half + 1):
        large = int(n[-1] - n[capacity - k])
        middle = int(n[capacity - k] - n[half])
        middle_mass = int(mass[capacity - k] - mass[half])
        small = int(mass[half] - mass[k - 1])
        best = max(best, large + middle + max(0, -(-(small - (middle * capacity - middle_mass)) // capacity)))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Best-fit decreasing on counts: each length goes to the fullest bins that still take it."""
    free: dict[int, Counter] = {}  # free space -> fillings with their numbers
    for size in range(len(counts) - 1, 0, -1):
        left = int(counts[size])
        while left:
            room = min((r for r in free if r >= size), default=None)
            if room is None:
                per = capacity // size
                filling, take = (size,) * min(per, left), max(1, left // per)
                free.setdefault(capacity - len(filling) * size, Counter())[filling] += take
                left -= len(filling) * take
                continue
            filling, n = next(iter(free[room].items()))
            per = min(room // size, left)
            take = max(1, min(n, left // per))
            free[room][filling] -= take
            if not free[room][filling]:
                del free[room][filling]
                if not free[room]:
                    del free[room]
            free.setdefault(room - per * size, Counter())[filling + (size,) * per] += take
            left -= per * take
    return [(f, n) for fillings in free.values() for f, n in fillings.items()]


def _with_copies(sums: int, size: int, n: int, mask: int) -> int:
    """The bit set of sums after up to ``n`` items of a size may be added."""
    step = 1
    while n > 0:
        take = min(step, n)
        sums |= (sums << (take * size)) & mask
        n, step = n - take, step * 2
    return sums


def dominated(filling: Filling, waste: int, counts: np.ndarray, room: int) -> bool:
    """Whether an item left out fits in place of some items of the filling and leaves no more waste: it is as long as they are together, or up to ``waste`` longer."""
    mask, took = (1 << (room + 1)) - 1, Counter(filling)
    out = 0
    for size in np.flatnonzero(counts[:room + 1]).tolist():
        if counts[size] > took[size]:
            out |= 1 << size
    sums, several = 1, 0  # sums of any items, and of two and more
    for size in filling:
        several |= ((several | (sums & ~1)) << size) & mask
        sums |= (sums << size) & mask
    return bool(several & out) or any((sums << k) & out for k in range(1, waste + 1))


def greedy(counts: np.ndarray, room: int, width: int = WIDTH) -> list[Filling]:
    """Up to ``width`` fillings of ``room``, least waste first: for each first length the longest items that still fit. They are tried before all others."""
    found: dict[Filling, int] = {}
    sizes = np.flatnonzero(counts[:room + 1])[::-1]
    least = room + 1
    for first in sizes[:64 * width].tolist():
        left, took = room - first, Counter({first: 1})
        for size in sizes[np.searchsorted(-sizes, -min(first, left)):].tolist() if left else ():
            if size > left:
                continue
            n = min(left // size, int(counts[size]) - took[size])
            if n > 0:
                took[size] += n
                left -= n * size
            if not left:
                break
        if left < least or (left == least and len(found) < width):
            least = min(least, left)
            found[tuple(sorted(took.elements(), reverse=True))] = left
        if not least and len(found) >= width:
            break
    return sorted(found, key=lambda f: (found[f], len(f)))[:width]


def completions(counts: np.ndarray, room: int, most: int, budget: list[int] | None = None) -> Iterator[Filling]:
    """All undominated fillings of ``room`` from the items at hand that waste at most ``most``, least waste first, then longest items first.

    For each waste the fillings of that sum are enumerated in depth; sums that the shorter items cannot make are not entered. ``budget`` holds the
    steps that may still be taken; at 0 the enumeration ends.
    """
    budget = [1 << 60] if budget is None else budget
    sizes = np.flatnonzero(counts[:room + 1])[::-1].tolist()
    mask = (1 << (room + 1)) - 1
    reach = [1]  # sums of the items from the i-th size on, from the back
    for size in reversed(sizes):
        reach.append(_with_copies(reach[-1], size, min(int(counts[size]), room // size), mask))
    reach.reverse()
    for waste in range(min(most, room) + 1):
        if not reach[0] >> (room - waste) & 1:
            continue
        # place among the sizes, sum to make, items so far; the most items of the longest size come first
        stack: list[tuple[int, int, Filling]] = [(0, room - waste, ())]
        while stack:
            budget[0] -= 1
            if budget[0] < 0:
                return
            i, left, took = stack.pop()
            if not left:
                budget[0] -= DOMINANCE
                if not dominated(took, waste, counts, room):
                    yield took
                continue
            size = sizes[i]
            for n in range(0, min(int(counts[size]), left // size) + 1):
                if i + 1 < len(reach) and reach[i + 1] >> (left - n * size) & 1:
                    stack.append((i + 1, left - n * size, took + (size,) * n))


def _branches(counts: np.ndarray, room: int, most: int, budget: list[int]) -> Iterator[Filling]:
    first = [f for f in greedy(counts, room) or [()] if room - sum(f) <= most and not dominated(f, room - sum(f), counts, room)]
    yield from first
    yield from (f for f in completions(counts, room, most, budget) if f not in first)


def bin_completion(counts: np.ndarray, capacity: int, nodes: int = NODES) -> Plan:
    """Branch and bound over fillings around the longest item left.

    Best-fit decreasing is the first incumbent. A branch takes one completion of the longest item for as many bins as the counts
    allow; its completions are all undominated ones whose waste a better packing may still have, made as the search comes to them. It is cut when the bins so
    far plus the bound for the rest reach the incumbent. The search ends at the lower bound, when all is tried, or after ``nodes`` branches or ``STEPS`` steps
    of the enumeration.
    """
    counts = np.asarray(counts, np.int64)
    best = best_fit(counts, capacity)
    bins, floor = sum(n for _, n in best), lower_bound(counts, capacity)
    total = int((counts * np.arange(len(counts))).sum())
    budget = [STEPS]
    stack: list[list] = [[counts, [], 0, total, None]]  # items left, plan, bins, their total, completions to come
    while stack and bins > floor and nodes:
        left, plan, used, mass, more = stack[-1]
        if more is None:
            if not mass:
                if used < bins:
                    best, bins = plan, used
                stack.pop()
                continue
            if used - (-mass // capacity) >= bins or (used < 3 and used + lower_bound(left, capacity) >= bins):
                stack.pop()
                continue
            longest = int(np.flatnonzero(left)[-1])
            rest = left.copy()
            rest[longest] -= 1
            most = (bins - 1 - used) * capacity - mass
            more = stack[-1][4] = ((longest, *c) for c in _branches(rest, capacity - longest, most, budget))
        filling = next(more, None)
        waste = (bins - 1 - used) * capacity - mass  # less than when the completions were begun, if the incumbent is better now
        if filling is None or capacity - sum(filling) > waste:
            stack.pop()
            continue
        nodes -= 1
        need = Counter(filling)
        times = min(int(left[s]) // n for s, n in need.items())
        if capacity > sum(filling):
            times = min(times, waste // (capacity - sum(filling)))
        after = left.copy()
        for s, n in need.items():
            after[s] -= n * times
        stack.append([after, [*plan, (filling, times)], used + times, mass - sum(filling) * times, None])
    return best


# ---- places for the pieces -------------------------------------------------------------------------------------------

SEGMENT = "length bigint, first_rank bigint, end_rank bigint, per bigint, first_sequence bigint, base bigint"


def segments(plan: Plan) -> list[tuple[int, int, int, int, int, int]]:
    """For each filling and length: which ranks of that length it takes, how many per sequence, from which sequence and offset on."""
    out, taken, sequence = [], Counter(), 0
    for filling, times in plan:
        base = 0
        for size, per in sorted(Counter(filling).items(), reverse=True):
            out.append((size, taken[size], taken[size] + per * times, per, sequence, base))
            taken[size] += per * times
            base += per * size
        sequence += times
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """``pieces`` (any columns with length) plus sequence_id and offset, as few sequences as the search finds.

    Lengths must lie in 1..capacity; others raise. The pieces are written once to the shared folder, without binary ids: keep
    those out and join by doc_id and piece, as ``sequences`` does. Pieces of one length are ranked in lots, so a
    common length is never sorted in one task. An empty table gives an empty table. Columns stay whatever
    their names; those named sequence_id and offset are replaced.
    """
    spark = pieces.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = pieces.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("all"), "length")
    # A row's lot must not change between the passes below, so the numbered rows are stored.
    stored = via_table(pieces.withColumns({"_row": F.monotonically_increasing_id()}), "pieces").withColumn("_lot", F.pmod(F.xxhash64("_row"), F.lit(parts)))
    tally = stored.groupBy("length", "_lot").agg(F.count("*").alias("_n"))
    # At most one row per possible length reaches the driver.
    counts = np.zeros(capacity + 1, np.int64)
    for r in stored.groupBy("length").agg(F.count("*").alias("n")).limit(capacity + 2).collect():
        if r["length"] is None or not 1 <= r["length"] <= capacity:
            raise ValueError(f"a piece has length {r['length']}, which is not in 1..{capacity}")
        counts[r["length"]] = r["n"]
    plan = segments(bin_completion(counts, capacity, nodes))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1))
    lots = tally.select(F.col("length").alias("_length"), F.col("_lot").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = stored.withColumn("_in_lot", F.row_number().over(Window.partitionBy("length", "_lot").orderBy("_row")) - 1)
    ranked = ranked.join(lots, (F.col("length") == F.col("_length")) & (F.col("_lot") == F.col("_of"))).withColumn("_rank", F.col("_before") + F.col("_in_lot"))
    places = F.broadcast(spark.createDataFrame(plan, SEGMENT).withColumnRenamed("length", "_size"))  # bounded by the number of lengths
    inside = (F.col("length") == F.col("_size")) & (F.col("_rank") >= F.col("first_rank")) & (F.col("_rank") < F.col("end_rank"))
    return ranked.join(places, inside).select(
        "all.*", F.expr("first_sequence + (_rank - first_rank) div per").alias("sequence_id"),
        F.expr("base + (_rank - first_rank) % per * length").alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, ranks: str | None = RANKS) -> DataFrame:
    """Cut and pack documents: doc_id, piece, start, length, ids_crc32 (of the ids' bytes), sequence_id, offset."""
    pieces = token_pieces(docs, capacity, tokenizer, ranks)
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity)


def sequences(packed: DataFrame, pieces: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, length, ids (unsigned 32-bit, little-endian). (doc_id, piece) must be unique and not null."""
    ids = pieces.select("doc_id", "piece", "ids")
    rows = packed.join(ids, ["doc_id", "piece"]).groupBy("sequence_id").agg(  # at most ``capacity`` ids a group
        F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))).alias("parts"))
    return rows.select("sequence_id", "length", F.unhex(F.array_join(F.col("parts.ids"), "")).alias("ids"))

