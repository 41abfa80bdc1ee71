"""Fitting, tuning and keeping forecast models with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark.errors import AnalysisException
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcast.fixed_values import EXTREME_MINIMUM, FEATURES, SPIKE_MINIMUM
from wardcast.operators.quantiles import attach_by_batch, quantile_row, quantiles
from wardcast.session import cut_lineage, via_table


#: The column of assembled inputs. Tables that many fits or models read bring it, so that rows are assembled once.
VECTOR = "features"


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=VECTOR, handleInvalid="keep")


def assembled(df: DataFrame, features: Sequence[str] = tuple(FEATURES), keep: Sequence[str] = ()) -> DataFrame:
    """The columns ``keep`` and the assembled inputs."""
    return _assembler(features).transform(df).select(*keep, VECTOR)


def _pipeline(features: Sequence[str], stage) -> Pipeline:
    return Pipeline(stages=[_assembler(features), stage])


def fitted(pipeline: Pipeline, df: DataFrame) -> PipelineModel:
    """The pipeline's model. Rows that bring their assembled inputs are not assembled again; the model still takes plain rows."""
    assembler, stage = pipeline.getStages()
    return PipelineModel([assembler, stage.fit(df)]) if VECTOR in df.columns else pipeline.fit(df)


def applied(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The model's output beside rows, whose inputs may be assembled already; they are in the result."""
    return model.stages[-1].transform(df) if VECTOR in df.columns else model.transform(df)


def boosted(
    loss: str = "squared",
    label: str = "admissions",
    prediction: str = "prediction",
    features: Sequence[str] = tuple(FEATURES),
    iterations: int = 20,
    depth: int = 5,
    rate: float = 0.1,
    validation: str | None = None,
    weight: str | None = None,
    seed: int = 7,
) -> Pipeline:
    """Gradient-boosted trees; ``validation`` names a boolean column that stops early."""
    gbt = GBTRegressor(
        lossType=loss, labelCol=label, predictionCol=prediction, featuresCol="features",
        maxIter=iterations, maxDepth=depth, stepSize=rate, seed=seed, validationTol=1e-4, checkpointInterval=10,
    )
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    if weight:
        gbt = gbt.setWeightCol(weight)
    return _pipeline(features, gbt)


def fit_median(df: DataFrame, loss: str = "absolute", **options) -> PipelineModel:
    """Median model; ``df`` should be a written or cached table, it is read once per tree level."""
    return fitted(boosted(loss, prediction=options.pop("prediction", "q50"), **options), df)


def fit_second_model(df: DataFrame, features: Sequence[str] = tuple(FEATURES), label: str = "admissions", trees: int = 10, depth: int = 5, seed: int = 7) -> PipelineModel:
    """A different regressor whose median is blended with the first model's."""
    forest = RandomForestRegressor(labelCol=label, predictionCol="second", numTrees=trees, maxDepth=depth, seed=seed)
    return fitted(_pipeline(features, forest), df)


def fit_spike_booster(df: DataFrame, label: str = "residual", prediction: str = "spike", minimum: int = SPIKE_MINIMUM, **options) -> PipelineModel | None:
    """Weighted model of the residuals; None when ``weight`` is null (too few spikes)."""
    usable = df.where(F.col("weight").isNotNull())
    if usable.limit(minimum).count() < minimum:
        return None
    return fitted(boosted("squared", label, prediction, weight="weight", **options), usable)


def fit_extreme_booster(df: DataFrame, **options) -> PipelineModel | None:
    return fit_spike_booster(df, prediction="extreme", minimum=EXTREME_MINIMUM, **options)


def residual_bands(df: DataFrame, calibration: DataFrame, target: str, prediction: str, levels: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Quantile columns: prediction plus the residual quantiles of a calibration slice."""
    stats = quantile_row(calibration, {"r": F.col(target) - F.col(prediction)}, list(levels.values()), by)
    with_stats = attach_by_batch(df, stats, "__s", by)
    return with_stats.withColumns({
        name: F.col(prediction) + F.col("__s.r.q")[i] for i, name in enumerate(levels)
    }).drop("__s")


@dataclass
class PinballModel:
    """Boosted quantile model: a start value and, per tree, a value for each leaf."""

    level: float
    start: float
    rate: float
    steps: list[tuple[Model, dict[float, float]]] = field(default_factory=list)

    def _move(self, model: Model, values: dict[float, float]) -> Column:
        return F.lit(self.rate) * F.element_at(_leaf_map(values), F.col("leaf"))

    def staged_losses(self, df: DataFrame, label: str) -> list[float]:
        """Mean pinball loss of the first 0, 1, 2, ... trees, in one pass over ``df``."""
        out, names = df.withColumn("__p0", F.lit(self.start)), ["__p0"]
        for i, (model, values) in enumerate(self.steps):
            names.append(f"__p{i + 1}")
            out = model.transform(out).withColumn(names[-1], F.col(names[-2]) + self._move(model, values)).drop("leaf", "tree_prediction")
        return list(out.agg(*[F.avg(pinball(F.col(label) - F.col(n), self.level)).alias(n) for n in names]).first())

    def first(self, trees: int) -> PinballModel:
        """The model of the first trees only."""
        return PinballModel(self.level, self.start, self.rate, self.steps[:trees])

    def transform(self, df: DataFrame, prediction: str) -> DataFrame:
        out = df.withColumn(prediction, F.lit(self.start))
        for model, values in self.steps:
            out = model.transform(out).withColumn(prediction, F.col(prediction) + self._move(model, values))
            out = out.drop("leaf", "tree_prediction")
        return out


def pinball(gap: Column, level: float) -> Column:
    """Loss of a quantile that lies ``gap`` below the value."""
    return F.greatest(F.lit(level) * gap, F.lit(level - 1) * gap)


def _leaf_map(values: dict[float, float]) -> Column:
    return F.create_map(*[F.lit(float(x)) for kv in values.items() for x in kv])


def fit_quantile(df: DataFrame, level: float, label: str = "admissions", features_col: str = "features", rounds: int = 6, depth: int = 4, rate: float = 0.3, seed: int = 7,
                 validation: DataFrame | None = None, patience: int = 3) -> PinballModel:
    """Gradient boosting on the pinball loss.

    A tree is grown on the loss gradient, each leaf takes the residual quantile of its rows
    (at most ``2**depth`` leaves come to the driver), and lineage is cut every round. With ``validation`` rows the fit ends when their loss has not
    fallen for ``patience`` rounds, and keeps the trees up to its lowest.
    """
    start = quantiles(df, {"y": F.col(label)}, [level]).first()["q"][0]
    model = PinballModel(level, start, rate)
    state = df.select(features_col, F.col(label).cast("double").alias("__y"), F.lit(start).alias("__p"))
    for i in range(rounds):
        gradient = F.when(F.col("__y") > F.col("__p"), F.lit(level)).otherwise(F.lit(level - 1.0))
        tree = DecisionTreeRegressor(
            featuresCol=features_col, labelCol="__g", predictionCol="tree_prediction", leafCol="leaf", maxDepth=depth, seed=seed + i
        ).fit(state.withColumn("__g", gradient))
        leaves = tree.transform(state).select(features_col, "__y", "__p", "leaf")
        rows = quantiles(leaves, {"r": F.col("__y") - F.col("__p")}, [level], ["leaf"]).collect()
        values = {r["leaf"]: r["q"][0] for r in rows}
        model.steps.append((tree, values))
        state = cut_lineage(leaves.select(
            features_col, "__y", (F.col("__p") + F.lit(rate) * F.element_at(_leaf_map(values), F.col("leaf"))).alias("__p")
        ))
        if validation is not None:
            losses = model.staged_losses(validation, label)
            best = losses.index(min(losses))
            if len(losses) - 1 - best >= patience:
                break
    return model.first(best) if validation is not None and rounds else model


@dataclass
class Trial:
    """One combination of a search: its settings, the number of trees tried, the error of each number of trees, and the rung it reached."""

    options: dict
    trees: int
    errors: list[float]
    rung: int

    @property
    def best(self) -> int:
        """The number of trees with the smallest error; the smaller one of equals."""
        return self.errors.index(min(self.errors)) + 1

    @property
    def error(self) -> float:
        return min(self.errors)


def _staged_mae(train: DataFrame, validation: DataFrame, label: str, features: Sequence[str], trees: int, options: dict) -> list[float]:
    """Mean absolute error on the validation rows of the first 1, 2, ... trees of one fit, in one pass. Both tables bring assembled inputs."""
    model = fitted(boosted("squared", label, "prediction", features, iterations=trees, **options), train)
    rows = validation.select(VECTOR, F.col(label).cast("double").alias(label))
    return list(model.stages[1].evaluateEachIteration(rows, "absolute"))


def _staged_pinball(train: DataFrame, validation: DataFrame, label: str, features: Sequence[str], trees: int, options: dict, level: float) -> list[float]:
    model = fit_quantile(train, level, label, rounds=trees, **options)
    return model.staged_losses(validation, label)[1:]


def _stored_vectors(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Label and assembled inputs, written once for all fits of a search unless the table brings them."""
    return df if VECTOR in df.columns else via_table(assembled(df, features, [label]), "vectors")


def search(
    train: DataFrame, validation: DataFrame, grid: dict[str, Sequence], trees: int = 20, label: str = "admissions", features: Sequence[str] = tuple(FEATURES),
    level: float | None = None, keep: float = 0.5, parallelism: int = 2,
) -> list[Trial]:
    """Successive halving over all combinations of ``grid`` (depth, rate, ...), best first.

    A rung fits what is left, scores every number of trees of each fit in one pass over the later rows, and keeps the better part. The number of trees grows from
    rung to rung by as much as the combinations shrink, up to ``trees``; so a rung costs about as much as any other. Errors are mean absolute errors, or with
    ``level`` pinball losses of quantile models. Equal errors keep the order of the grid. Boosting adds trees one after the other from fixed seeds, so the best
    number of trees can be fitted by itself, on the same stored vectors. Both tables are assembled and stored once for all fits, unless they bring ``features``.
    """
    train, validation = (_stored_vectors(df, label, features) for df in (train, validation))
    combos = [dict(zip(grid, values)) for values in product(*grid.values())]
    rungs = 1
    while len(combos) * keep**rungs >= 1 and trees * keep**rungs >= 1:
        rungs += 1
    trials: dict[int, Trial] = {}
    left = list(range(len(combos)))

    def run(task: tuple[int, int]) -> tuple[int, list[float]]:
        i, size = task
        if level is None:
            return i, _staged_mae(train, validation, label, features, size, combos[i])
        return i, _staged_pinball(train, validation, label, features, size, combos[i], level)

    for rung in range(rungs):
        size = max(1, round(trees * keep ** (rungs - 1 - rung)))
        with ThreadPool(parallelism if level is None else 1) as pool:  # quantile fits cut lineage, one after the other
            for i, errors in pool.map(run, [(i, size) for i in left]):
                trials[i] = Trial(combos[i], size, errors, rung)
        left = sorted(left, key=lambda i: (trials[i].error, i))[:max(1, int(len(left) * keep))]
    return [trials[i] for i in sorted(trials, key=lambda i: (-trials[i].rung, trials[i].error, i))]


def tune(train: DataFrame, validation: DataFrame, grid: dict[str, Sequence], label: str = "admissions", features: Sequence[str] = tuple(FEATURES), parallelism: int = 2) -> list[dict]:
    """Every combination, ranked by MAE on the later rows. Combinations that differ in ``iterations`` only share one fit, that of the most."""
    rest = {k: v for k, v in grid.items() if k != "iterations"}
    counts = list(grid.get("iterations", [20]))
    combos = [dict(zip(rest, values)) for values in product(*rest.values())]
    train, validation = (_stored_vectors(df, label, features) for df in (train, validation))
    with ThreadPool(parallelism) as pool:
        errors = pool.map(lambda options: _staged_mae(train, validation, label, features, max(counts), options), combos)
    rows = [{**options, "iterations": n, "mae": own[min(n, len(own)) - 1]} for options, own in zip(combos, errors) for n in counts]
    return sorted(rows, key=lambda r: r["mae"])


def persist_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_persisted_model(spark: SparkSession, *paths: str) -> PipelineModel | None:
    """The first model found among ``paths``; None when there is none (an optional stage)."""
    for path in paths:
        try:
            spark.read.text(f"{path}/metadata")
        except AnalysisException as absent:
            if "PATH_NOT_FOUND" not in (absent.getCondition() or ""):
                raise
            continue
        return PipelineModel.load(path)
    return None
