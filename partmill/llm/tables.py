"""Reading the tables that these operators work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partmill.sources.storage import read_table

#: Rows and bytes of one Arrow batch: texts can be long, and a worker holds one batch of them.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20
#: A table of fewer bytes for each core than this is small.
SMALL_BYTES = 16 << 20


def prepare(spark: SparkSession) -> None:
    """Bounds what a Python worker holds: sets the session's Arrow batch limits (they stay set; results don't depend on them)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def dealt(df: DataFrame) -> DataFrame:
    """A small table in fewer files than there are cores is dealt out; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SMALL_BYTES and len(df.inputFiles()) < cores else df


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def free_name(df: DataFrame, base: str) -> str:
    """A name that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while base in taken:
        base += "_"
    return base


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return dealt(read_table(spark, sf_dir, "documents"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return dealt(read_table(spark, sf_dir, "pages"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return read_table(spark, sf_dir, "benchmark")
