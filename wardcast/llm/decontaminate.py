"""Benchmark decontamination by one Aho-Corasick automaton over the benchmark's word windows.

Texts are normalised byte by byte (A-Z lowered, every other ASCII character than letters and digits is a
separator), and each document is scanned once. Match offsets lead back to word numbers and to byte places of the original.

The automaton is built from benchmark rows of a checked size: ``MAX_BLOCK`` bytes of windows. A larger benchmark is dealt out
by window into as many blocks as that takes; the documents are scanned once per block and the hits are merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardcast.llm.text import bounded_batches, text_bytes
from wardcast.session import via_table

WINDOW = 13
#: Bytes of window texts in one automaton; a node takes about 50 bytes, so this is some 400 MB at most.
MAX_BLOCK = 8_000_000
#: Separators of words: all ASCII but digits and lower-case letters. Bytes from 0x80 on belong to words.
NORMAL = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in bytes(range(256)).lower())
IS_WORD = np.frombuffer(NORMAL, np.uint8) != 0x20


def normalised_words(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(NORMAL).split()


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Every window of ``size`` words of (item_id, text); an item of fewer words is one window, of none no window."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = normalised_words(data)
                n = max(1, len(words) - size + 1) if words else 0
                for at in range(0, n, 10_000):
                    found = {b" ".join(words[i:i + size]) for i in range(at, min(n, at + 10_000))}
                    yield pa.record_batch([pa.array([item] * len(found), pa.string()), pa.array(sorted(found), pa.binary())], names=["item_id", "window"])

    rows = text_bytes(items, F.col("item_id").cast("string").alias("item_id"))
    return rows.mapInArrow(cut, "item_id string, window binary").where("item_id is not null").distinct()


class Scanner:
    """Finds windows in texts; the automaton is built once per Python worker."""

    def __init__(self, entries: list[tuple[bytes, list[str]]], size: int):
        self.entries, self.size, self.automaton = entries, size, None

    def __getstate__(self) -> tuple:
        return self.entries, self.size

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def find(self, data: bytes | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """The number of words, hit word ranges [first, last) in order and without overlap, and item ids found."""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for k, (window, _) in enumerate(self.entries):
                # Words end with a space and windows also start with one, so that only whole words match.
                self.automaton.add_word(f" {window.decode('latin-1')} ", k)
            self.automaton.make_automaton()
        words = normalised_words(data)
        joined = b" " + b" ".join(words) + b" "
        if not words or not self.entries:
            return len(words), [], []
        found = [(end, k) for end, k in self.automaton.iter(joined.decode("latin-1"))]
        if not found:
            return len(words), [], []
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
        ends = np.searchsorted(gaps, [end for end, _ in found])
        hit = np.zeros(len(words) + 1, np.int64)
        for last, (_, k) in zip(ends, found):
            hit[last - self.entries[k][0].count(b" ") - 1] += 1
            hit[last] -= 1
        return len(words), runs(np.cumsum(hit[:-1]) > 0), sorted({item for _, k in found for item in self.entries[k][1]})


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Ranges [first, last) where flags hold."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def byte_spans(data: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte offsets in the original text of word ranges."""
    edge = np.diff(np.concatenate(([0], IS_WORD[np.frombuffer(data, np.uint8)].astype(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [(int(starts[a]), int(ends[b - 1])) for a, b in ranges]


def _dealt(benchmark: DataFrame, size: int, max_block: int) -> tuple[int, Callable[[int], Scanner]]:
    """The number of blocks of at most about ``max_block`` bytes that hold the benchmark's windows with their items, and what gives a block's scanner."""
    found = windows(benchmark, size).groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    weight = F.octet_length("window") + 2 + F.aggregate("items", F.lit(0), lambda n, x: n + F.octet_length(x))
    total = found.agg(F.sum(weight)).first()[0]
    n = -(-(total or 0) // max_block)
    if n > 1:
        found = via_table(found, "windows")

    def scanner(block: int) -> Scanner:
        rows = found.where(F.pmod(F.xxhash64("window"), F.lit(n)) == block) if n else found.limit(0)
        return Scanner([(bytes(r["window"]), list(r["items"])) for r in rows.toLocalIterator()], size)

    return n, scanner


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_block: int = MAX_BLOCK) -> DataFrame:
    """Per document row: doc_id, n_words, hit word ranges, their byte spans in the original text, and item ids found.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other columns are ignored. A null or empty
    text has no words. Items without id or words are left out. Repeated items count once, repeated
    documents each give a row. Without benchmark rows nothing is hit.
    """
    schema = "doc_id bigint, n_words bigint, hits array<struct<first:bigint,last:bigint>>, spans array<struct<first:bigint,last:bigint>>, items array<string>"
    source = text_bytes(docs, F.col("doc_id").cast("bigint").alias("doc_id"))

    def scanned(scanner: Scanner):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            for batch in batches:
                texts = batch.column(1)
                rows = []
                for k in range(len(texts)):
                    data = texts[k].as_py()
                    n, hits, items = scanner.find(data)
                    spans = byte_spans(data, hits) if hits else []
                    rows.append((n, [{"first": a, "last": b} for a, b in hits], [{"first": a, "last": b} for a, b in spans], items))
                n, hits, spans, items = map(list, zip(*rows)) if rows else ([], [], [], [])
                yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(hits, pair), pa.array(spans, pair), pa.array(items, pa.list_(pa.string()))],
                                      names=["doc_id", "n_words", "hits", "spans", "items"])

        return run

    n, scanner = _dealt(benchmark, size, max_block)
    if n <= 1:
        return source.mapInArrow(scanned(scanner(0)), schema)
    # Several blocks: one pass each over the result of the pass before adds its ranges and items; one scanner at a time.
    out = via_table(source.mapInArrow(_with_text(scanned(scanner(0))), schema + ", text binary"), "hits")
    for block in range(1, n):
        out = via_table(out.mapInArrow(_adding(scanner(block)), schema + ", text binary"), "hits")
    return out.drop("text")


def _with_text(run):
    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in run(iter([batch])):
                yield pa.RecordBatch.from_arrays([*found.columns, batch.column(1)], names=[*found.schema.names, "text"])

    return both


def _adding(scanner: Scanner):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                _, hits, items = scanner.find(r["text"])
                flags = np.zeros(r["n_words"], bool)
                for a, b in [*hits, *((x["first"], x["last"]) for x in r["hits"])]:
                    flags[a:b] = True
                r["hits"] = [{"first": a, "last": b} for a, b in runs(flags)]
                r["spans"] = [{"first": a, "last": b} for a, b in byte_spans(r["text"], runs(flags))]
                r["items"] = sorted({*r["items"], *items})
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, percent: int = 5, max_block: int = MAX_BLOCK) -> DataFrame:
    """``scan`` with n_hit, n_items and contaminated: at least one hit word and ``percent`` of all words hit."""
    found = scan(docs, benchmark, size, max_block)
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, x: n + x["last"] - x["first"])
    return found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("bigint")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, percent: int = 5, max_block: int = MAX_BLOCK) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns.

    Each row is judged where it lies, whatever its id: no join and no shuffle. With several blocks the rows are written once per block but
    the last, with the word ranges hit so far.
    """
    names, place = docs.columns, docs.columns.index("text")
    n, scanner = _dealt(benchmark, size, max_block)
    kinds = T.StructType([*docs.schema, T.StructField(_unused(names), T.ArrayType(T.LongType()))])

    def marking(scanner: Scanner, first: bool):
        """Rows with the starts and ends of ranges hit, one after the other."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                marks = []
                for k in range(batch.num_rows):
                    n_words, hits, _ = scanner.find((batch.column(place)[k].as_py() or "").encode())
                    marks.append([x for r in _with(hits, [] if first else batch.column(-1)[k].as_py(), n_words) for x in r])
                columns = batch.columns if first else batch.columns[:-1]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(marks, pa.list_(pa.int64()))], names=kinds.names)

        return run

    def keeping(scanner: Scanner, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, good = batch.column(place), []
                for k in range(len(texts)):
                    n_words, hits, _ = scanner.find((texts[k].as_py() or "").encode())
                    hit = sum(b - a for a, b in (hits if first else _with(hits, batch.column(-1)[k].as_py(), n_words)))
                    good.append(not hit or hit * 100 < n_words * percent)
                kept = batch if first else pa.RecordBatch.from_arrays(batch.columns[:-1], names=names)
                yield kept.filter(pa.array(good, pa.bool_()))

        return run

    rows = bounded_batches(docs)
    for block in range(n - 1):
        rows = via_table(rows.mapInArrow(marking(scanner(block), block == 0), kinds), "hits")
    return rows.mapInArrow(keeping(scanner(max(0, n - 1)), n <= 1), docs.schema)


def _unused(names: list[str]) -> str:
    """A column name that is none of these."""
    name = "hit"
    while name.lower() in {x.lower() for x in names}:
        name = "_" + name
    return name


def _with(hits: list[tuple[int, int]], before: list[int], n_words: int) -> list[tuple[int, int]]:
    """Word ranges of both: ranges, and starts and ends one after the other."""
    if not before:
        return hits
    flags = np.zeros(n_words, bool)
    for a, b in [*hits, *zip(before[::2], before[1::2])]:
        flags[a:b] = True
    return runs(flags)


def items_digest(items: list[str]) -> str:
    """Hex SHA-256 of the item ids, comma-joined in the order given."""
    return hashlib.sha256(",".join(items).encode()).hexdigest()
