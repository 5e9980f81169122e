"""Tables kept up to date by streams, in buckets by the hash of a key, as plain Parquet with dynamic partition overwrite.

A batch reads and writes only the buckets that its keys fall into.  Buckets to be replaced are first written aside whole, then
put in place; a batch that is run again after a failure finds them and puts them in place once more, so no row is lost halfway.
Every bucket that is written also holds one row that marks it, so that a bucket whose last row goes is overwritten, too."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

#: Buckets of a table: what one changed key makes a batch rewrite is this share of it.
BUCKETS = 64


class KeptTable:
    """Rows of ``schema`` below ``folder``, found by ``key``."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType | str, key: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.folder, self.key, self.buckets = spark, folder, list(key), buckets
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        self._stored = StructType([*self.schema.fields, StructField("_row", BooleanType()), StructField("_bucket", IntegerType())])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _exists(self, path: str) -> bool:
        named = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return named.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(named)

    def _remove(self, path: str) -> None:
        named = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        named.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(named, True)

    def _all(self) -> DataFrame:
        path = f"{self.folder}/rows"
        return self.spark.read.schema(self._stored).parquet(path) if self._exists(path) else self.spark.createDataFrame([], self._stored)

    def read(self) -> DataFrame:
        return self._all().where("_row").select(self.schema.fieldNames())

    def near(self, keys: DataFrame) -> DataFrame:
        """The rows of the buckets that ``keys`` fall into; other buckets are not read."""
        own = [r[0] for r in keys.select(self.bucket()).distinct().collect()]  # at most as many as there are buckets
        return self._all().where(F.col("_bucket").isin(own) & F.col("_row")).select(self.schema.fieldNames())

    def replace(self, number: int, keys: DataFrame, rows: DataFrame) -> None:
        """Batch ``number``: the rows of ``keys`` go, and ``rows``, which have only such keys, come."""
        aside = f"{self.folder}/aside/{number}"
        if not self._exists(f"{aside}/_SUCCESS"):
            gone = keys.select(*self.key).distinct()
            new = self._without(self.near(keys), gone).select(self.schema.fieldNames()).unionByName(rows.select(self.schema.fieldNames())).withColumns({"_row": F.lit(True), "_bucket": self.bucket()})
            marks = gone.select(self.bucket().alias("_bucket")).distinct().select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields], F.lit(False).alias("_row"), "_bucket")
            new.unionByName(marks).write.mode("overwrite").parquet(aside)
        whole = self.spark.read.schema(self._stored).parquet(aside)
        whole.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{self.folder}/rows")
        self._remove(f"{self.folder}/aside/{number - 1}")

    def _without(self, rows: DataFrame, gone: DataFrame) -> DataFrame:
        named = gone.select(F.struct(*self.key).alias("_gone"))
        return rows.join(named, F.struct(*self.key).eqNullSafe(F.col("_gone")), "left_anti")


class SeenRows:
    """Rows that are only ever added: each batch writes its own below the buckets of their keys, and writes the same once more if it is
    run again."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: Sequence[str], buckets: int = BUCKETS):
        self.table = KeptTable(spark, folder, schema, key, buckets)
        self._stored = StructType([*self.table.schema.fields, StructField("_bucket", IntegerType()), StructField("_batch", IntegerType())])

    def _all(self) -> DataFrame:
        t = self.table
        return t.spark.read.schema(self._stored).parquet(t.folder) if t._exists(t.folder) else t.spark.createDataFrame([], self._stored)

    def read(self) -> DataFrame:
        return self._all().select(self.table.schema.fieldNames())

    def before(self, number: int, keys: DataFrame, more: Sequence[str] = ()) -> DataFrame:
        """The keys (and ``more`` columns) that batches before ``number`` added to the buckets of ``keys``."""
        own = [r[0] for r in keys.select(self.table.bucket()).distinct().collect()]
        return self._all().where(F.col("_bucket").isin(own) & (F.col("_batch") < number)).select(*self.table.key, *more)

    def add(self, number: int, rows: DataFrame) -> None:
        named = rows.select(self.table.schema.fieldNames()).withColumns({"_bucket": self.table.bucket(), "_batch": F.lit(number)})
        named.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket", "_batch").parquet(self.table.folder)
