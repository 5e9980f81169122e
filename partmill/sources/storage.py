"""Tables kept between jobs in the folder that the cluster shares.

The folder is the one named by ``spark.checkpoint.dir``.  Executors can be lost at any time, so lineage is cut by writing
Parquet there and reading it back, never by keeping blocks on executors.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its store's scheme, as Spark itself would resolve it (a plain path belongs to the default store)."""
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    return named.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(named).toString()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, with its scheme; only where a local session names none (tests) one is made and set.

    On a cluster a folder of the driver's own would be another one on each machine, so there the setting must be there."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-partmill-")
        spark.sparkContext.setCheckpointDir(named)
    return qualified(spark, named).rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, never used before."""
    return f"{shared_dir(spark)}/partmill/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns the table read back: one copy of the work, no lineage."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables (a Parquet file or folder)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` on every core: a small file is one task, however much is to be done for each of its rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)
