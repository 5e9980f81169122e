"""Views of the test tables under the names of the marketplace's entities.

``SQL`` holds the same definitions as SQL text, which the oracle queries begin with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partmill.sources.storage import read_table

#: From this day lines count as the present stock of their part and supplier.
STOCK_FROM = "2001-01-01"

SQL = {
    "item": f"""item AS (SELECT l_partkey AS part_id, l_suppkey AS supplier_id,
        CAST(SUM(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS BIGINT) AS reported,
        CAST(SUM(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS BIGINT) AS reserved
      FROM lineitem WHERE l_shipdate >= TIMESTAMP '{STOCK_FROM}' AND l_returnflag = 'A' GROUP BY 1, 2)""",
}


def supplier_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part and supplier with stock: units reported and units reserved."""
    lines = read_table(spark, sf_dir, "lineitem").where(
        (F.col("l_shipdate") >= F.lit(STOCK_FROM).cast("timestamp_ntz")) & (F.col("l_returnflag") == "A")
    )
    units = lambda status: F.sum(F.when(F.col("l_linestatus") == status, F.col("l_quantity")).otherwise(0)).cast("long")
    return lines.groupBy(F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("supplier_id")).agg(
        units("F").alias("reported"), units("O").alias("reserved")
    )
