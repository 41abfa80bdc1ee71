"""Session settings, shared scratch space and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "wardcast", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session with adaptive execution, skew handling and UTC time.

    The number of shuffle partitions is left to the cluster (or to ``conf``): adaptive
    execution merges small ones and splits skewed ones.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by the session.

    Only a local session without the setting gets a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(found)
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="wardcast-")
    spark.sparkContext.setCheckpointDir(made)
    return made


_SCOPES: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, inside the innermost ``scratch_scope``."""
    return "/".join([shared_dir(spark).rstrip("/"), "wardcast", *_SCOPES[-1:], f"{name}-{uuid.uuid4().hex}"])


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """One job: the tables written to the shared folder inside are deleted at its end. Write or collect its results before."""
    _SCOPES.append(f"job-{uuid.uuid4().hex}")
    path = f"{shared_dir(spark).rstrip('/')}/wardcast/{_SCOPES[-1]}"
    try:
        yield
    finally:
        _SCOPES.pop()
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint store and read it from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Removes the shuffle files of a query when it ends. Nothing reads them again once its result is written.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind; the session's own setting comes back afterwards."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


def via_table(df: DataFrame, name: str, partition_by: Sequence[str] = (), codec: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder; later reads can prune columns and partitions. ``codec`` is the session's unless given."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with freed_shuffles(spark):
        df.write.partitionBy(*partition_by).parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    out.stored_at = path
    return out


def drop_table(table: DataFrame) -> None:
    """Delete what ``via_table`` wrote, once all that was made of it is written."""
    spark = table.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
