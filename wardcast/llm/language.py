"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (``DIMENSIONS`` of them). An n-gram's vector binds its letters' vectors by
products, each rotated by its distance from the n-gram's end. A text is the bundle (sum) of its n-grams' vectors, a language the bundle of its
training texts. A text gets the language whose prototype has the greatest cosine.

Bundling is linear, so a text's dot product with a prototype is the sum of its n-grams' dot products with it, which each worker
computes once per n-gram. A bundle's length enters by its expectation over the random vectors, sqrt(DIMENSIONS * sum of squared
counts); it is the same for all prototypes and does not affect which is nearest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardcast.llm.text import held_out, text_bytes

DIMENSIONS, GRAM, SEED = 2048, 3, 11
UNKNOWN = "und"
PART = 1 << 20
#: N-grams whose products a worker holds: 8 bytes per language each.
HELD = 500_000
BITS = 21  # of a code point


@cache
def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def letters(data: bytes | None) -> np.ndarray:
    """Code points of the lower-cased text's letters; each run of others is one 0, and one stands at either end. Empty without letters."""
    text = (data or b"").decode("utf-8", "replace").lower()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_is_letter()[points], points, 0) if len(points) else points
    if not points.any():
        return np.empty(0, np.uint64)
    points = np.concatenate(([0], points, [0])).astype(np.uint64)
    return points[(points != 0) | (np.concatenate(([1], points[:-1])) != 0)]


def grams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, each as one number, and their counts."""
    if len(points) < GRAM:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    found, counts = None, None
    for at in range(0, len(points) - GRAM + 1, PART):
        part = points[at:at + PART + GRAM - 1]
        code = sum((part[i:len(part) - GRAM + 1 + i] << np.uint64(BITS * (GRAM - 1 - i)) for i in range(GRAM)), np.uint64(0))
        values, n = np.unique(code, return_counts=True)
        if found is not None:
            values, where = np.unique(np.concatenate((found, values)), return_inverse=True)
            n = np.bincount(where, np.concatenate((counts, n))).astype(np.int64)
        found, counts = values, n
    return found, counts


class Vectors:
    """Vectors of letters and n-grams; the same in every task."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions, self.known = dimensions, {}

    def letter(self, point: int) -> np.ndarray:
        if point not in self.known:
            if len(self.known) > 20_000:
                self.known.clear()
            self.known[point] = (np.random.default_rng([SEED, point]).integers(0, 2, self.dimensions) * 2 - 1).astype(np.int8)
        return self.known[point]

    def gram(self, code: int) -> np.ndarray:
        out = np.ones(self.dimensions, np.int8)
        for back in range(GRAM):
            out *= np.roll(self.letter((code >> (BITS * back)) & ((1 << BITS) - 1)), back)
        return out


def prototypes(docs: DataFrame, train: Column | None = None, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Unit vectors per language from rows with a lang for which ``train`` holds; only one vector per language and task is shuffled."""
    rows = docs.where(F.col("lang").isNotNull())
    rows = rows.where(train) if train is not None else rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, total, waiting = Vectors(dimensions), {}, {}

        def bundle(lang: str) -> None:
            codes, where = np.unique(np.concatenate([c for c, _ in waiting[lang]]), return_inverse=True)
            n = np.bincount(where, np.concatenate([n for _, n in waiting.pop(lang)]))
            sums = total.setdefault(lang, np.zeros(dimensions))
            for code, k in zip(codes.tolist(), n.tolist()):
                sums += k * vectors.gram(code)

        sizes: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes, n = grams(letters(text.as_py()))
                if len(codes):
                    waiting.setdefault(lang, []).append((codes, n))
                    sizes[lang] = sizes.get(lang, 0) + len(codes)
                    if sizes[lang] > 4_000_000:
                        bundle(lang)
                        sizes[lang] = 0
        for lang in list(waiting):
            bundle(lang)
        yield pa.record_batch([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["lang", "sums"])

    parts = text_bytes(rows, F.col("lang").cast("string").alias("lang")).mapInArrow(count, "lang string, sums array<double>")
    sums = parts.select("lang", F.posexplode("sums")).groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    found = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")).select("lang", "v.x").collect()
    return {r["lang"]: np.array(r["x"]) / max(1e-12, float(np.linalg.norm(r["x"]))) for r in sorted(found, key=lambda r: r["lang"])}


class Judge:
    """Languages of texts by cosine with prototypes."""

    def __init__(self, names: list[str], matrix: np.ndarray):
        self.names, self.matrix = names, matrix
        self.vectors, self.products = Vectors(matrix.shape[1] if len(names) else DIMENSIONS), {}

    def __getstate__(self):
        return self.names, self.matrix

    def __setstate__(self, state):
        self.__init__(*state)

    def product(self, code: int) -> np.ndarray:
        found = self.products.get(code)
        if found is None:
            if len(self.products) > HELD:
                self.products.clear()
            found = self.products[code] = self.matrix @ self.vectors.gram(code)
        return found

    def of(self, data: bytes | None) -> tuple[str, float]:
        codes, n = grams(letters(data))
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0
        dots = n @ np.array([self.product(c) for c in codes.tolist()])
        length = np.sqrt(self.vectors.dimensions * float((n.astype(float) ** 2).sum()))
        best = int(dots.argmax())
        return self.names[best], float(np.clip(dots[best] / length, 0, 1))


def identify(docs: DataFrame, known: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred and score (cosine, 0 to 1) per row of ``docs`` (doc_id, text; other columns are ignored).

    Null, empty and letterless texts are ``und`` with score 0, as is everything without prototypes. Equal cosines give the first
    language by name.
    """
    judge = Judge(list(known), np.array(list(known.values())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge.of(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return text_bytes(docs, F.col("doc_id").cast("bigint").alias("doc_id")).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def train_part() -> Column:
    """Rows that may be learned from: all but a third of the ids."""
    return ~held_out("doc_id", 3, 1)
