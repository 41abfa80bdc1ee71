"""Global training and scoring as Spark jobs."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcast.fixed_values import FEATURES
from wardcast.functions.fixed import fixed_row
from wardcast.operators.bands import score_mode
from wardcast.operators.features import feature_matrix, filled_matrix
from wardcast.operators.metrics import quantile_coverage, regression_metrics
from wardcast.operators.models import (
    VECTOR, applied, assembled, fit_extreme_booster, fit_median, fit_second_model, fit_spike_booster, load_persisted_model, persist_model,
)
from wardcast.operators.ordering import time_split
from wardcast.operators.quantiles import quantile_row
from wardcast.operators.weights import extreme_weights, residuals, spike_weights
from wardcast.session import via_table
from wardcast.sources.ledger import enter, entries

KEYS = ("hospital_id", "date")
LEVELS = {"q10": 0.1, "q90": 0.9}
STAGES = ("median", "spike", "extreme", "second")


@dataclass
class GlobalModels:
    median: PipelineModel
    offsets: dict[str, float]
    spike: PipelineModel | None
    extreme: PipelineModel | None
    second: PipelineModel | None
    data: DataFrame | None


def prepare(
    panel: DataFrame, target: str = "admissions", profile: str = "train", ratio: float = 0.85, fill_gaps: bool = True
) -> DataFrame:
    """Feature table with its time split, written once because every tree level reads it.

    The cut is found on the panel's keys; the table is partitioned by the split, so reading
    the training rows skips the rest.
    """
    keep = ["city", target, "split"]
    if fill_gaps:
        return filled_matrix(time_split(panel, ratio), profile, keep, partition_by=["split"])
    return via_table(feature_matrix(time_split(panel, ratio), profile, keep=keep), "features", ["split"])


def train_global(panel: DataFrame, target: str = "admissions", second: bool = True, **options) -> GlobalModels:
    """Median, bands calibrated on the validation rows, both correction stages and the second model."""
    data = prepare(panel, target)
    marked = data.withColumn("__val", F.col("split") == "validation")
    median = fit_median(marked, label=target, validation="__val", **options)
    # the assembled inputs stay for the three fits that follow
    rows = assembled(data, keep=[*KEYS, "split", target])
    scored = via_table(residuals(applied(median, rows), target, "q50"), "scored")
    train = scored.where(F.col("split") == "train")
    spike = fit_spike_booster(spike_weights(train, target), **options)
    extreme = fit_extreme_booster(extreme_weights(train), **options)
    other = fit_second_model(train, label=target) if second else None
    held = scored.where(F.col("split") == "validation")
    gap = {"r": F.col(target) - F.col("q50")}
    found = quantile_row(held, gap, list(LEVELS.values())).first() or quantile_row(train, gap, list(LEVELS.values())).first()
    return GlobalModels(median, dict(zip(LEVELS, found["r"]["q"])), spike, extreme, other, data)


def save_models(models: GlobalModels, folder: str) -> str:
    """The whole set as a new version below one folder.

    The stages are written to a folder of their own; the entry that names it comes last, in one step. So a reader finds a whole set, the old one while the
    new one is written or if that is broken off, and never stages of two sets. Of two writers at a time both sets stay, and the one entered last counts.
    """
    spark = SparkSession.active()
    version = f"{folder}/sets/{uuid.uuid4().hex}"
    stages = [name for name in STAGES if getattr(models, name) is not None]
    for name in stages:
        persist_model(getattr(models, name), f"{version}/{name}")
    rows = [(k, float(v)) for k, v in models.offsets.items()]
    spark.createDataFrame(rows, "level string, offset double").coalesce(1).write.parquet(f"{version}/offsets")
    number = max(entries(spark, f"{folder}/versions"), default=0) + 1
    while not enter(spark, f"{folder}/versions", number, {"set": version, "stages": stages}):
        number += 1
    return folder


def load_models(spark: SparkSession, folder: str, version: int | None = None) -> GlobalModels:
    """A saved set, by default the last version; its training table is not part of it."""
    known = entries(spark, f"{folder}/versions")
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no models of version {version or 'any'} below {folder}")
    entry = known[max(known) if version is None else version]
    stages = {name: load_persisted_model(spark, f"{entry['set']}/{name}") if name in entry["stages"] else None for name in STAGES}
    offsets = {r["level"]: r["offset"] for r in spark.read.parquet(f"{entry['set']}/offsets").collect()}  # two rows
    return GlobalModels(offsets=offsets, data=None, **stages)


def raw_scores(models: GlobalModels, features: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Model outputs side by side; the inputs are assembled once, each model is one more projection, nothing is joined."""
    out = applied(models.median, features if VECTOR in features.columns else assembled(features, keep=[*KEYS, *keep]))
    out = out.withColumns({name: F.col("q50") + F.lit(models.offsets[name]) for name in LEVELS})
    columns = ["q10", "q50", "q90"]
    for name, model in (("spike", models.spike), ("extreme", models.extreme), ("second", models.second)):
        if model is not None:
            out = applied(model, out)
            columns.append(name)
        elif name != "second":
            out = out.withColumn(name, F.lit(0.0))
            columns.append(name)
    return out.select(*KEYS, *keep, *columns)


def forecast(models: GlobalModels, features: DataFrame, mode: str = "ensemble", keep: Sequence[str] = ()) -> DataFrame:
    """Ordered forecast bands; raw scores are written once because batch statistics re-read them."""
    raw = via_table(raw_scores(models, features, keep), "raw_scores")
    return score_mode(raw, mode)


def training_summary(data: DataFrame, scored: DataFrame, target: str = "y") -> DataFrame:
    """One row: quality on the validation rows, and the sizes of what was trained on."""
    sizes = data.agg(
        F.lit(len(FEATURES)).alias("n_features"),
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "validation").alias("n_val"),
        F.countDistinct("city").alias("n_cities"),
        F.countDistinct("hospital_id").alias("n_hospitals"),
    )
    metrics = regression_metrics(scored, target).drop("n_rows")
    cover = quantile_coverage(scored, target)
    named = fixed_row(metrics).alias("m"), fixed_row(cover).alias("c")
    return sizes.select("*", *named).select(*sizes.columns, "m.*", "c.*")
