"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchpost.session import shared_dir

#: Bytes of a batch of rows sent to a Python worker, about.
BATCH_BYTES = 8_000_000
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed, and bound what they hold.

    The workers' PYTHONPATH gets the folder this checkout lies in; a cluster
    whose executors do not see that folder needs the package installed or
    passed with ``--py-files``.  Batches to Python are bounded by bytes, as
    whole texts may be long.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])
    env.setdefault("TOKENIZERS_PARALLELISM", "false")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder, deleted when the session's JVM ends."""
    path = shared_dir(spark, f"{name}-{uuid.uuid4().hex}")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """The frame written as Parquet to the shared folder and read back.

    Later steps reread the files instead of recomputing, also after a lost
    executor.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind those that a column of the frame has already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def key_of(column: str) -> Column:
    """An id as a join and order key: null sorts before every other id."""
    return F.coalesce(F.col(column).cast("long"), F.lit(-(2**63)))
