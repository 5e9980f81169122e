"""Relational building blocks that the plans share."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def top_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key under ``order``, which should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def with_flag(df: DataFrame, keys: DataFrame, on: str, name: str) -> DataFrame:
    """``df`` with a boolean column: whether its key is among ``keys``; rows stay as many."""
    seen = keys.select(on).distinct().withColumn("_seen", F.lit(True))
    return df.join(seen, on, "left").withColumn(name, F.coalesce("_seen", F.lit(False))).drop("_seen")


def sessions(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], minutes: int = 30) -> DataFrame:
    """``df`` with ``visit``: numbered from 1 within a key, a new one after more than ``minutes`` without activity."""
    w = Window.partitionBy(*keys).orderBy(ts, *order)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = micros - F.lag(micros).over(w) > minutes * 60_000_000
    opened = F.when(F.lag(ts).over(w).isNull() | gap, 1).otherwise(0)
    return df.withColumn("_new", opened).withColumn("visit", F.sum("_new").over(w)).drop("_new")


def ranges_overlap(from_a: Column, to_a: Column, from_b: Column, to_b: Column) -> Column:
    """Closed ranges; a null end is open."""
    return (from_a.isNull() | to_b.isNull() | (from_a <= to_b)) & (from_b.isNull() | to_a.isNull() | (from_b <= to_a))


def full_diff(stored: DataFrame, computed: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, change): new, stale, changed or same, comparing ``fields`` null-safely."""
    a = stored.select(F.col(key), F.struct(*fields).alias("_a"))
    b = computed.select(F.col(key), F.struct(*fields).alias("_b"))
    kind = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "stale").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, kind.alias("change"))
