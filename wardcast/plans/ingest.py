"""From panel files to one clean, stored panel, and what happened on the way."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcast.fixed_values import TRAINING_COLUMNS
from wardcast.operators.clean import count_duplicates, dedup_keep_first, require_columns
from wardcast.operators.metrics import profile_panel
from wardcast.session import via_table
from wardcast.sources.readers import scan_all_entities, scan_rejects


@dataclass
class Ingested:
    """The panel, one row per hospital and day; files and rows left out; one row each of duplicate counts and of the panel's profile."""

    panel: DataFrame
    rejects: DataFrame
    duplicates: DataFrame
    profile: DataFrame


def ingest(spark: SparkSession, base: str, cities: Sequence[str] | None = None, key: Sequence[str] = ("hospital_id", "date")) -> Ingested:
    """All panel files below ``base``, read and stored once: required columns are checked, and of several rows of a hospital and day the first stays.

    First is the one of the smallest file name and, within a file, of the smallest place; so the panel does not depend on how the files are split. The
    rows dropped are counted. Training on a panel with repeated days would shift its lags.
    """
    rows = scan_all_entities(spark, base, cities).withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_line": F.monotonically_increasing_id()})
    require_columns(rows, TRAINING_COLUMNS)
    # the running number orders the rows of one block, as read; stored, it does not change any more
    read = via_table(rows, "read")
    panel = via_table(dedup_keep_first(read, list(key), ["_file", "_block", "_line"]).drop("_file", "_block", "_line"), "ingested")
    return Ingested(panel, scan_rejects(spark, base, cities), count_duplicates(read, list(key)), profile_panel(panel))
