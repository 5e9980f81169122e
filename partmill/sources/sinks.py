"""Writing tables: upserts, inserts, deletes, counters, ledgers, exports and restores over plain Parquet and JSON.

Parquet files don't change, so every change of a table is a join that gives its new rows; ``replace_table`` writes these beside
the old ones and returns the new table.  Keys are compared by ``=``: rows with a null key never match another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partmill.sources.storage import materialize


def replace_table(rows: DataFrame, name: str) -> DataFrame:
    """The table with these rows, in a new place."""
    return materialize(rows, name)


def upsert(stored: DataFrame, rows: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """``stored`` with ``rows`` in it: rows with a new key are added, of the others only ``columns`` change (all by default).
    ``rows`` must have each key once; columns that ``rows`` lacks are null in what is added."""
    written = [c for c in (columns or rows.columns) if c not in keys]
    new = rows.withColumn("_new", F.struct(*[F.col(c) for c in rows.columns])).select(*keys, "_new")
    old = stored.withColumn("_old", F.lit(True))
    both = old.join(new, list(keys), "full_outer")
    types = dict(rows.dtypes)
    value = lambda c: F.col(f"_new.{c}") if c in types else F.lit(None)
    pick = lambda c: F.when(F.col("_old").isNull(), value(c)).when(F.col("_new").isNotNull() & F.lit(c in written), value(c)).otherwise(F.col(c))
    return both.select(*[F.col(c) if c in keys else pick(c).cast(stored.schema[c].dataType).alias(c) for c in stored.columns])


def insert_missing(stored: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``stored`` and those of ``rows`` whose key it doesn't have; of several such rows with one key the first in order of all columns."""
    first = rows.join(stored.select(*keys), list(keys), "left_anti").groupBy(*keys).agg(F.min(F.struct(*[c for c in stored.columns if c not in keys])).alias("_row"))
    return stored.unionByName(first.select(*keys, "_row.*"))


def update_columns(stored: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``stored`` with the other columns of ``rows`` written over its own where a key matches and a value is given."""
    new = rows.select(*keys, *[F.col(c).alias(f"_{c}") for c in rows.columns if c not in keys])
    both = stored.join(new, list(keys), "left")
    return both.select(*[F.coalesce(f"_{c}", c).alias(c) if c in rows.columns and c not in keys else F.col(c) for c in stored.columns])


def delete_keys(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """``stored`` without the rows whose key is in ``keys`` (its columns are the key)."""
    return stored.join(keys.distinct(), keys.columns, "left_anti")


def add_counters(stored: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counters of ``stored`` plus the sums of ``changes``; keys that only occur in ``changes`` begin at 0."""
    counters = [c for c in stored.columns if c not in keys]
    both = stored.unionByName(changes.select(stored.columns))
    return both.groupBy(*keys).agg(*[F.sum(c).cast(stored.schema[c].dataType).alias(c) for c in counters]).select(stored.columns)


def append_ledger(ledger: DataFrame, changes: DataFrame, item: str, order: Sequence[str]) -> DataFrame:
    """``ledger`` (item, *order, change, balance) and ``changes`` (the same without balance) behind it, with the balance after
    each.  Only the last balance of each item of the ledger is read; the ledger's own rows stay as they are."""
    last = ledger.groupBy(item).agg(F.max_by("balance", F.struct(*order)).alias("_last"))
    running = F.sum("change").over(Window.partitionBy(item).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    new = changes.join(last, item, "left").withColumn("balance", F.coalesce("_last", F.lit(0)) + running)
    return ledger.unionByName(new.withColumn("balance", F.col("balance").cast(ledger.schema["balance"].dataType)).select(ledger.columns))


def export_json_lines(table: DataFrame, folder: str, key: str) -> DataFrame:
    """Writes ``table`` as gzipped JSON lines to ``folder``, which must not exist, and its manifest (rows, sha256) beside it.

    The digest is that of the digests of all rows' JSON, in order of these digests within 1024 buckets, so it depends on the rows
    alone, not on files or partitions, and no task sees all rows."""
    lines = table.select(F.to_json(F.struct(*[F.col(c) for c in table.columns]), {"ignoreNullFields": "false"}).alias("value"), F.col(key).alias("_key"))
    lines.select("value").write.mode("errorifexists").option("compression", "gzip").text(f"{folder}/rows")
    manifest = fingerprint(lines.select("value"))
    manifest.write.mode("errorifexists").json(f"{folder}/manifest")
    return table.sparkSession.read.schema(manifest.schema).json(f"{folder}/manifest")


def fingerprint(lines: DataFrame) -> DataFrame:
    """(rows, sha256) of a table of one text column ``value``, whatever its order."""
    digests = lines.select(F.sha2("value", 256).alias("d")).groupBy("d").agg(F.count("*").alias("n"))
    buckets = digests.withColumn("b", F.substring("d", 1, 3)).groupBy("b").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws("x", "d", "n"))), "\n"), 256).alias("h"), F.sum("n").alias("n"))
    return buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"), F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "b", "h"))), "\n"), 256).alias("sha256"))


def verify_export(spark: SparkSession, folder: str) -> bool:
    """Whether an export's rows are those that its manifest names."""
    named = spark.read.json(f"{folder}/manifest").select("rows", "sha256").first()
    found = fingerprint(spark.read.text(f"{folder}/rows")).select("rows", "sha256").first()
    return named == found


def restore_rows(stored: DataFrame, folder: str, key: str) -> DataFrame:
    """``stored`` with the rows of an export written back over those with the same key; rows of other keys are untouched, and
    exported rows whose key is gone are not brought back."""
    lines = stored.sparkSession.read.text(f"{folder}/rows")
    rows = lines.select(F.from_json("value", stored.schema).alias("_r")).select(F.col(f"_r.{key}").alias(key), "_r").where(F.col(key).isNotNull())
    both = stored.join(rows.groupBy(key).agg(F.max("_r").alias("_r")), key, "left")
    return both.select(*[F.when(F.col("_r").isNotNull(), F.col(f"_r.{c}")).otherwise(F.col(c)).alias(c) if c != key else F.col(c) for c in stored.columns])
