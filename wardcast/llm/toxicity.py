"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words and word beginnings that the labelled texts marked toxic hold far more often than the others. To
keep it honest, the features of a training row come from a lexicon counted without the row's fold.
Trees are fitted on the other folds than 0, the calibration on fold 0. All counts and fits are Spark jobs; what reaches the driver is the
lexicon (``LEXICON`` entries) and the models.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardcast.llm.text import bounded_batches, held_out, text_bytes
from wardcast.session import via_table

#: The fit takes about this many labelled rows, chosen by a hash of their id; with fewer, all.
SAMPLE = 30_000
#: Entries of a lexicon, those with the strongest evidence first.
LEXICON = 4_000
LEAST_EVIDENCE = 3.0
FOLDS = 4
BEGINNINGS = (4, 5, 6)
NEAR = 5
MARKS = ".,;:!?\"'`()[]{}<>*%&$#|/\\-_~+=^…«»“”„’"
#: Second-person words of the languages served.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch tu toi te ton ta tes vous votre vos tú ti usted ustedes vosotros tus".split())
#: Characters that stand in for letters, and the letters.
STAND_INS = str.maketrans("01345789@$!|", "oieastbgasil")
INSIDE = re.compile(r"[^\W\d_][\d@$!|*.\-_]+[^\W\d_]")
N_FEATURES = 13


def words_of(text: str) -> list[str]:
    return [w for w in (raw.strip(MARKS) for raw in text.lower().split()) if w]


def units(word: str) -> list[str]:
    """What a word is looked up by: itself, marked as whole, and its beginnings."""
    return [f"{word}$", *(word[:n] for n in BEGINNINGS if len(word) >= n)]


class Features:
    """Dense features of texts, given a lexicon of units and weights."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.known = lexicon, {}

    def __getstate__(self):
        return self.lexicon

    def __setstate__(self, lexicon):
        self.__init__(lexicon)

    def weight(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 300_000:
                self.known.clear()
            found = self.known[word] = max((self.lexicon.get(u, 0.0) for u in units(word)), default=0.0)
        return found

    def of(self, data: bytes | None) -> list[float]:
        text = (data or b"").decode("utf-8", "replace")
        raw = text.split()
        words = words_of(text)
        n, size = max(1, len(words)), max(1, len(text))
        weights = [self.weight(w) for w in words]
        at = [i for i, x in enumerate(weights) if x]
        person = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        near = sum(any(abs(i - j) <= NEAR for j in person) for i in at) if person and at else 0
        b = np.bincount(np.frombuffer(data or b"", np.uint8), minlength=256)
        upper, lower = int(b[65:91].sum()), int(b[97:123].sum())
        marks = int(b[33:48].sum() + b[58:65].sum() + b[91:97].sum() + b[123:127].sum())
        odd = [w for w in set(raw) if INSIDE.search(w)]
        plain = sum(self.weight(re.sub(r"[\W_]+", "", w.lower().translate(STAND_INS))) > 0 and self.weight(w.lower().strip(MARKS)) == 0 for w in odd)
        strong = [weights[i] for i in at]
        return [len(at) / n, sum(strong) / n, max(strong, default=0.0), float(np.log1p(len(at))), float(np.log1p(len({words[i] for i in at}))),
                near / n, len(person) / n, upper / max(1, upper + lower), (int(b[33]) + int(b[63])) / size, marks / size,
                len(odd) / n, plain / n, float(np.log1p(len(words)))]


@dataclass
class Model:
    """A fitted model; with trees None every text gets ``prior``."""

    lexicon: dict[str, float]
    trees: object | None
    calibration: object | None
    prior: float


def _counts(sample: DataFrame) -> DataFrame:
    """Per unit: in how many toxic and other texts of each fold it occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = defaultdict(lambda: [0] * (2 * FOLDS))

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.list_(pa.int64()))], names=["unit", "n"])

        for batch in batches:
            for fold, toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for unit in {u for w in set(words_of(text.as_py().decode("utf-8", "replace"))) for u in units(w)}:
                    found[unit][2 * fold + toxic] += 1
                if len(found) > 500_000:
                    yield out()
                    found.clear()
        yield out()

    return sample.select("fold", "toxic", "text").mapInArrow(run, "unit string, n array<bigint>").groupBy("unit").agg(
        *[F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(2 * FOLDS)])


def _lexicon(counts: DataFrame, totals: list[int], without: int | None) -> dict[str, float]:
    """Units by evidence: the log odds ratio over its standard error, of all folds but one."""
    use = [f for f in range(FOLDS) if f != without]
    pos, neg = (sum((F.col(f"n{2 * f + t}") for f in use), F.lit(0)) for t in (1, 0))
    all_pos, all_neg = (sum(totals[2 * f + t] for f in use) for t in (1, 0))
    ratio = F.log((pos + 0.5) / (all_pos + 1)) - F.log((neg + 0.5) / (all_neg + 1))
    evidence = ratio / F.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    rows = counts.select("unit", evidence.alias("z"), pos.alias("p"), ratio.alias("r")).where(f"p >= 3 and z >= {LEAST_EVIDENCE} and r >= 1")
    return {r["unit"]: r["z"] / 10 for r in rows.orderBy(F.desc("z"), "unit").limit(LEXICON).collect()}


def _featured(rows: DataFrame, lexicons: list[dict[str, float]], by: str | None = None) -> DataFrame:
    """``rows`` (keep columns, text last as bytes) with text replaced by features; ``by`` names the column that picks the lexicon."""
    keep = [f for f in rows.schema.fields if f.name != "text"]
    tools = [Features(x) for x in lexicons]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(by).to_pylist() if by else [0] * batch.num_rows
            found = [tools[k].of(t.as_py()) for k, t in zip(at, batch.column("text"))]
            yield pa.record_batch([*(batch.column(f.name) for f in keep), pa.array(found, pa.list_(pa.float64()))], names=[*(f.name for f in keep), "features"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return rows.mapInArrow(run, f"{kinds}, features array<double>")


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None) -> Model:
    """Learn from rows of ``labels`` (doc_id, toxic) for which ``train``, over doc_id, holds.

    Labels that are null are left out; a doc_id labelled more than once is toxic if one label says so. With no toxic or no other
    row the model is the constant share of toxic rows (0 without rows).
    """
    id_ = F.col("doc_id").cast("bigint")
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(id_.alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    if train is not None:
        known = known.where(train)
    total = known.count()
    share = min(1.0, SAMPLE / max(1, total))
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).toDF("_id", "toxic")
    sample = text_bytes(docs, id_.alias("doc_id")).join(F.broadcast(some), F.col("doc_id") == F.col("_id"))  # about SAMPLE ids
    sample = via_table(sample.select("toxic", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"), "text"), "toxic-sample")
    tally = {(r["fold"], r["toxic"]): r["n"] for r in sample.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    totals = [tally.get((f, t), 0) for f in range(FOLDS) for t in (0, 1)]
    pos, neg = sum(totals[1::2]), sum(totals[::2])
    if not pos or not neg:
        return Model({}, None, None, pos / max(1, pos + neg))
    counts = via_table(_counts(sample), "toxic-units")
    lexicons = [_lexicon(counts, totals, f) for f in range(FOLDS)]
    rows = via_table(_featured(sample, lexicons, "fold").select("fold", F.col("toxic").cast("double").alias("toxic"), array_to_vector("features").alias("features")), "toxic-features")
    inner, outer = rows.where("fold != 0"), rows.where("fold = 0")
    kinds = [sum(totals[2 * f + t] for f in range(1, FOLDS)) for t in (0, 1)]
    if not all(kinds):
        inner = rows
    trees = GBTClassifier(featuresCol="features", labelCol="toxic", maxIter=20, maxDepth=3, stepSize=0.2, seed=7, minInstancesPerNode=5).fit(inner)
    calibration = None
    if totals[0] and totals[1]:
        scored = trees.transform(outer).select(vector_to_array("probability")[1].alias("p"), "toxic")
        calibration = IsotonicRegression(featuresCol="p", labelCol="toxic", predictionCol="calibrated").fit(scored)
    return Model(_lexicon(counts, totals, None), trees, calibration, pos / (pos + neg))


def _probability(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with features replaced by score. A twentieth of the uncalibrated probability breaks the ties of the calibration's steps."""
    if model.trees is None:
        return rows.withColumn("score", F.lit(float(model.prior))).drop("features")
    names = [c for c in rows.columns if c != "features"]
    out = model.trees.transform(rows.withColumn("features", array_to_vector("features"))).withColumn("p", vector_to_array("probability")[1])
    if model.calibration is None:
        return out.select(*names, F.col("p").alias("score"))
    out = model.calibration.transform(out.select(*names, "p"))
    return out.select(*names, (0.95 * F.least(F.greatest("calibrated", F.lit(0.0)), F.lit(1.0)) + 0.05 * F.col("p")).alias("score"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.5 on) for every row; null and empty texts get a score like any other."""
    rows = text_bytes(docs, F.col("doc_id").cast("bigint").alias("doc_id"))
    found = _probability(_featured(rows, [model.lexicon]), model)
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with a score below 0.5 and all their columns, in place: no join and no shuffle."""
    rows = bounded_batches(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return _probability(_featured(rows, [model.lexicon]), model).where("score < 0.5").select("row.*")


def train_part() -> Column:
    """Rows that may be learned from: all but a fifth of the ids."""
    return ~held_out("doc_id", 5, 0)


def top_units(model: Model, n: int = 20) -> list[tuple[str, float]]:
    return Counter(model.lexicon).most_common(n)
