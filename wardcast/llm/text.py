"""Words and hashes of texts, as arrays.

A word's hash depends on its bytes alone, so it is the same in every task. Collisions of the 64-bit hashes
within one pair of documents have a chance below 1e-9 even at 100,000 words each.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardcast.session import via_table

_RANDOM = np.random.default_rng(20240229)
BYTE_VALUES = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15
INVERSE_BASE = pow(BASE, -1, 2**64)
PLACES = _RANDOM.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
#: ASCII white space: space and the five control characters from tab to carriage return.
IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
PART = 1 << 20
#: Texts are long rows: batches of the usual 10,000 would hold 100 MB and more in each worker and task.
BATCH_ROWS = 1_000


@cache
def _powers(base: int, bits: int) -> np.ndarray:
    """base**0 .. base**(2**bits - 1), modulo 2**64."""
    out = np.ones(1 << bits, np.uint64)
    for i in range(bits):
        half = 1 << i
        out[half:2 * half] = out[:half] * np.uint64(pow(base, half, 2**64))
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def lowered(data: bytes | None) -> bytes:
    """A-Z in lower case; null is empty."""
    return (data or b"").lower()


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where words (runs without ASCII white space) start and end."""
    space = np.ones(len(data) + 2, np.int8)
    space[1:-1] = IS_SPACE[np.frombuffer(data, np.uint8)]
    edge = np.diff(space)
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(data: bytes) -> np.ndarray:
    """One 64-bit hash per word of already lower-cased bytes, in order."""
    starts, ends = word_spans(data)
    if not len(starts):
        return np.empty(0, np.uint64)
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + PART, "right")))
        first, last = int(starts[at]), int(ends[upto - 1])
        b = np.frombuffer(data, np.uint8, last - first, first)
        bits = max(12, (last - first).bit_length())
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum(BYTE_VALUES[b] * _powers(BASE, bits)[:len(b)], out=sums[1:])
        s, e = starts[at:upto] - first, ends[at:upto] - first
        out[at:upto] = (sums[e] - sums[s]) * _powers(INVERSE_BASE, bits)[s]
        at = upto
    return mix(out)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words in order; fewer words form one run, no words none."""
    size = min(size, len(words))
    if not size:
        return np.empty(0, np.uint64)
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out += words[i:i + n] * PLACES[i % 64] if i < 64 else mix(words[i:i + n] + np.uint64(i))
    return mix(out)


def shingle_set(data: bytes | None, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(shingles(word_hashes(lowered(data)), size))


def digest(values: np.ndarray) -> bytes:
    """A 128-bit key of an array's content."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def held_out(doc_id: Column | str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text falls in the given part; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % parts == part


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on sends at most ``BATCH_ROWS`` rows at once to a Python worker, if it sent more."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def text_bytes(docs: DataFrame, *keep: str) -> DataFrame:
    """The named columns and the text as UTF-8 bytes, null as empty."""
    bounded_batches(docs)
    return docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def placed(docs: DataFrame) -> DataFrame:
    """The rows as structs: ``all`` their columns, ``place`` file (hashed) and row of each, the same in every scan. Rows not straight from files are
    written to the shared folder first."""
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("place")
    every = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("all")
    try:
        return docs.select(every, place)
    except AnalysisException:
        return via_table(docs, "documents").select(every, place)
