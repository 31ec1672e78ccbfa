"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pagemill")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names; a scratch folder only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="pagemill-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, name: str = "cut") -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark)}/pagemill/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back. Later plans start
    from the written files: a lost executor costs no recomputation, only the columns
    needed are read again, and the planner knows the size."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gather(parts: list[DataFrame], more: DataFrame, most: int = 20) -> list[DataFrame]:
    """``parts`` with one more. Many parts become one table, so plans over a long chain of
    levels stay short."""
    parts = [*parts, more]
    return parts if len(parts) < most else [cut(reduce(DataFrame.unionByName, parts))]


def spread(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Rows dealt out evenly when a scan has fewer partitions than the cluster has cores.
    Reading pages costs far more time than their bytes suggest, so a small file must not
    keep the other cores waiting. A scan of many files is left alone.

    A file is read by no more tasks than it has row groups, however many partitions its scan has; ``narrow`` rows, which
    cost little to move, are dealt out of fewer files than cores for that reason."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.rdd.getNumPartitions()
    few = parts < cores or (narrow and len(df.inputFiles()) < cores)
    return df.repartition(max(cores, parts)) if few else df
