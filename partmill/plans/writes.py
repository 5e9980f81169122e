"""Writes of all kinds, each read back: the query's rows are what the written table holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from partmill.sources import sinks
from partmill.sources.storage import read_table as t
from partmill.sources.storage import shared_path

_C = ("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


def _stored(spark, sf):
    return t(spark, sf, "customer").where("c_custkey % 3 <> 0").select(*_C)


def _rows(spark, sf):
    return t(spark, sf, "customer").where("c_custkey % 2 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit("NEW").alias("c_mktsegment"))


def sink_upsert(spark, sf):
    return sinks.replace_table(sinks.upsert(_stored(spark, sf), _rows(spark, sf), ["c_custkey"], ["c_acctbal"]), "upsert")


def sink_insert_missing(spark, sf):
    rows = _rows(spark, sf)
    return sinks.replace_table(sinks.insert_missing(_stored(spark, sf), rows.union(rows), ["c_custkey"]), "insert")


def sink_update_columns(spark, sf):
    rows = _rows(spark, sf).select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.col("c_acctbal")).alias("c_acctbal"))
    return sinks.replace_table(sinks.update_columns(_stored(spark, sf), rows, ["c_custkey"]), "update")


def sink_delete_keys(spark, sf):
    return sinks.replace_table(sinks.delete_keys(_stored(spark, sf), _rows(spark, sf).select("c_custkey")), "delete")


def sink_counters(spark, sf):
    """Units by part: those of returned lines, then those of all open lines added to them."""
    lines = t(spark, sf, "lineitem")
    units = lambda where: lines.where(where).groupBy("l_partkey").agg(F.sum("l_quantity").cast("long").alias("units"), F.count("*").alias("lines"))
    changes = lines.where("l_linestatus = 'O'").select("l_partkey", F.col("l_quantity").cast("long").alias("units"), F.lit(1).cast("long").alias("lines"))
    return sinks.replace_table(sinks.add_counters(units("l_returnflag = 'R'"), changes, ["l_partkey"]), "counters")


def sink_ledger(spark, sf):
    """A day of events put behind the ledger of those before, with the balance after each."""
    moves = t(spark, sf, "events").select("user_id", "ts", "event_id", F.round(F.col("value") * 100).cast("long").alias("change"))
    order = ["ts", "event_id"]
    empty = moves.limit(0).withColumn("balance", F.lit(0).cast("long"))
    first = sinks.append_ledger(empty, moves.where("event_id % 2 = 0 AND ts < TIMESTAMP_NTZ '2024-01-10 00:00:00'"), "user_id", order)
    stored = sinks.replace_table(first, "ledger")
    return sinks.replace_table(sinks.append_ledger(stored, moves.where("ts >= TIMESTAMP_NTZ '2024-01-10 00:00:00'"), "user_id", order), "ledger")


def _export(spark, sf) -> str:
    folder = shared_path(spark, "export")
    sinks.export_json_lines(t(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), folder, "c_custkey")
    return folder


def sink_export(spark, sf):
    """Rows read back from gzipped JSON lines, with whether the manifest holds."""
    folder = _export(spark, sf)
    rows = spark.read.schema("c_custkey long, c_name string, c_nationkey int, c_mktsegment string").json(f"{folder}/rows")
    return rows.withColumn("verified", F.lit(sinks.verify_export(spark, folder)))


def sink_restore(spark, sf):
    """A table that lost names and rows, restored from the export by key."""
    damaged = t(spark, sf, "customer").where("c_custkey % 5 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.lit("?")).otherwise(F.col("c_name")).alias("c_name"), "c_nationkey", "c_mktsegment")
    return sinks.replace_table(sinks.restore_rows(damaged, _export(spark, sf), "c_custkey"), "restored")


_STORED = "s AS (SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey, upper(c_name) AS c_name, c_acctbal + 1 AS c_acctbal, 'NEW' AS c_mktsegment FROM customer WHERE c_custkey % 2 = 0)"

QUERIES = {
    "sink_upsert": (sink_upsert, f"""WITH {_STORED} SELECT c_custkey, CASE WHEN s.c_custkey IS NULL THEN n.c_name ELSE s.c_name END AS c_name, COALESCE(n.c_acctbal, s.c_acctbal) AS c_acctbal,
        CASE WHEN s.c_custkey IS NULL THEN n.c_mktsegment ELSE s.c_mktsegment END AS c_mktsegment FROM s FULL JOIN n USING (c_custkey)"""),
    "sink_insert_missing": (sink_insert_missing, f"WITH {_STORED} SELECT * FROM s UNION ALL SELECT * FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM s)"),
    "sink_update_columns": (sink_update_columns, f"WITH {_STORED} SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM s"),
    "sink_delete_keys": (sink_delete_keys, f"WITH {_STORED} SELECT * FROM s WHERE c_custkey % 2 <> 0"),
    "sink_counters": (sink_counters, "SELECT l_partkey, CAST(SUM(l_quantity) AS BIGINT) AS units, COUNT(*) AS lines FROM (SELECT * FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT * FROM lineitem WHERE l_linestatus = 'O') GROUP BY 1"),
    "sink_ledger": (sink_ledger, """WITH m AS (SELECT user_id, ts, event_id, CAST(round(value * 100) AS BIGINT) AS change FROM events WHERE ts >= TIMESTAMP '2024-01-10' OR event_id % 2 = 0)
        SELECT *, CAST(SUM(change) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS balance FROM m"""),
    "sink_export": (sink_export, "SELECT c_custkey, c_name, c_nationkey, c_mktsegment, TRUE AS verified FROM customer"),
    "sink_restore": (sink_restore, "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 5 <> 0"),
}
