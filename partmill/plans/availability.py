"""Stock availability by part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partmill.sources.standins import SQL, supplier_items
from partmill.sources.storage import read_table

#: Units up to which a part's stock is low, and medium.
LOW_UNTIL, MEDIUM_UNTIL = 5, 20


def stock_band(units: Column, low: int = LOW_UNTIL, medium: int = MEDIUM_UNTIL) -> Column:
    """unknown (no eligible item) is not sold_out (items, but nothing left)."""
    return (
        F.when(units.isNull(), "unknown").when(units == 0, "sold_out").when(units <= low, "low").when(units <= medium, "medium").otherwise("high")
    )


def part_availability(items: DataFrame, suppliers: DataFrame) -> DataFrame:
    """(part_id, units, supplier_count) over items of active suppliers; over-reserved items count as zero, not less."""
    active = suppliers.where("s_acctbal >= 0").select(F.col("s_suppkey").alias("supplier_id"))
    free = F.greatest(F.col("reported") - F.col("reserved"), F.lit(0))
    return items.join(active, "supplier_id", "left_semi").groupBy("part_id").agg(
        F.sum(free).alias("units"), F.count_distinct(F.when(F.col("reported") > F.col("reserved"), F.col("supplier_id"))).alias("supplier_count")
    )


def availability_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    stock = part_availability(supplier_items(spark, sf_dir), read_table(spark, sf_dir, "supplier"))
    parts = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return parts.join(stock, F.col("p_partkey") == F.col("part_id"), "left").select(
        "p_partkey", "p_brand", "units", F.coalesce("supplier_count", F.lit(0)).alias("supplier_count"), stock_band(F.col("units")).alias("band")
    )


QUERIES = {
    "availability_by_part": (
        availability_by_part,
        f"""WITH {SQL["item"]}, avail AS (
          SELECT part_id, CAST(SUM(GREATEST(reported - reserved, 0)) AS BIGINT) AS units,
            COUNT(DISTINCT CASE WHEN reported > reserved THEN supplier_id END) AS supplier_count
          FROM item JOIN supplier ON s_suppkey = supplier_id WHERE s_acctbal >= 0 GROUP BY part_id)
        SELECT p_partkey, p_brand, units, COALESCE(supplier_count, 0) AS supplier_count,
          CASE WHEN units IS NULL THEN 'unknown' WHEN units = 0 THEN 'sold_out' WHEN units <= {LOW_UNTIL} THEN 'low'
               WHEN units <= {MEDIUM_UNTIL} THEN 'medium' ELSE 'high' END AS band
        FROM part LEFT JOIN avail ON part_id = p_partkey""",
    ),
}
