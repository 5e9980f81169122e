"""Stock ledger: ordered replay, balance chain, and what the last entry leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partmill.sources.storage import read_table

#: A total order: whole rows are distinct.
ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
_ORDER_SQL = ", ".join(ORDER)
_ENTRIES_SQL = f"""WITH e AS (SELECT l_partkey AS item, l_orderkey AS entry, l_shipdate AS shipped, CAST(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE -l_quantity END AS BIGINT) AS change,
    row_number() OVER w AS seq, CAST(SUM(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE -l_quantity END) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance,
    l_orderkey FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY {_ORDER_SQL})),
l AS (SELECT item, entry, shipped, change, CAST(seq AS BIGINT) AS seq, balance, balance + CASE WHEN entry % 97 = 0 THEN 1 ELSE 0 END AS recorded FROM e),
c AS (SELECT *, COALESCE(lag(recorded) OVER (PARTITION BY item ORDER BY seq), 0) AS before FROM l)"""


def entries(spark, sf) -> DataFrame:
    """Ledger entries (item, entry, shipped, change, seq, balance, recorded); some recorded balances are wrong."""
    w = Window.partitionBy("l_partkey").orderBy(*ORDER)
    change = F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(-F.col("l_quantity")).cast("long")
    lines = read_table(spark, sf, "lineitem")
    found = lines.select(
        F.col("l_partkey").alias("item"), F.col("l_orderkey").alias("entry"), F.col("l_shipdate").alias("shipped"), change.alias("change"), F.row_number().over(w).cast("long").alias("seq"),
        F.sum(change).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("balance"),
    )
    return found.withColumn("recorded", F.col("balance") + F.when(F.col("entry") % 97 == 0, 1).otherwise(0))


def chained(ledger: DataFrame) -> DataFrame:
    """With ``before``: the balance that the entry before recorded, 0 for the first."""
    return ledger.withColumn("before", F.coalesce(F.lag("recorded").over(Window.partitionBy("item").orderBy("seq")), F.lit(0)))


def ledger_running_balance(spark, sf):
    return entries(spark, sf).select("item", "seq", "change", "balance")


def ledger_chain_breaks(spark, sf):
    return chained(entries(spark, sf)).where("recorded <> before + change").select("item", "seq", "entry", "before", "change", "recorded")


def _change():
    return F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(-F.col("l_quantity")).cast("long")


def ledger_final_mismatch(spark, sf):
    """What the last entry recorded against the sum of all: two aggregates, nothing is sorted."""
    last = read_table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg(F.max_by("l_orderkey", F.struct(*ORDER)).alias("entry"), F.sum(_change()).alias("balance"))
    return last.select("item", (F.col("balance") + F.when(F.col("entry") % 97 == 0, 1).otherwise(0)).alias("recorded"), "balance").where("recorded <> balance")


def ledger_out_of_order(spark, sf):
    """Entries whose order date precedes that of the entry before, in ledger order."""
    dated = entries(spark, sf).join(read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("entry"), F.col("o_orderdate").alias("created")), "entry")
    back = F.lag("created").over(Window.partitionBy("item").orderBy("seq")) > F.col("created")
    return dated.withColumn("back", back).where("back").groupBy("item").agg(F.count("*").alias("n"))


def ledger_available_delta(spark, sf):
    free = lambda c: F.greatest(F.col(c), F.lit(0))
    return chained(entries(spark, sf)).select("item", "seq", (free("recorded") - free("before")).alias("delta"))


def ledger_day_range(spark, sf):
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return entries(spark, sf).where((F.col("shipped") >= day("1998-03-01")) & (F.col("shipped") < day("1998-04-01"))).groupBy("item").agg(F.count("*").alias("n"), F.sum("change").alias("change"))


def problem_counts(spark, sf):
    """Breaks by direction, with the first five items of each as a sample."""
    kind = F.when(F.col("recorded") > F.col("before") + F.col("change"), "too_high").otherwise("too_low")
    broken = chained(entries(spark, sf)).where("recorded <> before + change").groupBy(kind.alias("problem"), "item").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("problem").orderBy("item"))
    sample = broken.select("problem", "item", rank.alias("rn")).where("rn <= 5").groupBy("problem").agg(F.array_join(F.sort_array(F.collect_list("item")), ",").alias("sample"))
    return broken.groupBy("problem").agg(F.sum("n").alias("n")).join(sample, "problem")


def first_seen_created(spark, sf):
    """An item's first entry, and what the balance it recorded says was there before."""
    return entries(spark, sf).where("seq = 1").select("item", F.col("shipped").alias("created_at"), (F.col("recorded") - F.col("change")).alias("before"))


QUERIES = {
    "ledger_running_balance": (ledger_running_balance, _ENTRIES_SQL + " SELECT item, seq, change, balance FROM l"),
    "ledger_chain_breaks": (ledger_chain_breaks, _ENTRIES_SQL + " SELECT item, seq, entry, before, change, recorded FROM c WHERE recorded <> before + change"),
    "ledger_final_mismatch": (ledger_final_mismatch, _ENTRIES_SQL + " SELECT item, recorded, balance FROM l QUALIFY row_number() OVER (PARTITION BY item ORDER BY seq DESC) = 1 AND recorded <> balance"),
    "ledger_out_of_order": (ledger_out_of_order, _ENTRIES_SQL + """, d AS (SELECT item, lag(o_orderdate) OVER (PARTITION BY item ORDER BY seq) > o_orderdate AS back FROM l JOIN orders ON o_orderkey = entry)
        SELECT item, COUNT(*) AS n FROM d WHERE back GROUP BY 1"""),
    "ledger_available_delta": (ledger_available_delta, _ENTRIES_SQL + " SELECT item, seq, greatest(recorded, 0) - greatest(before, 0) AS delta FROM c"),
    "ledger_day_range": (ledger_day_range, _ENTRIES_SQL + " SELECT item, COUNT(*) AS n, CAST(SUM(change) AS BIGINT) AS change FROM l WHERE shipped >= TIMESTAMP '1998-03-01' AND shipped < TIMESTAMP '1998-04-01' GROUP BY 1"),
    "problem_counts": (problem_counts, _ENTRIES_SQL + """, b AS (SELECT *, CASE WHEN recorded > before + change THEN 'too_high' ELSE 'too_low' END AS problem FROM c WHERE recorded <> before + change)
        SELECT problem, COUNT(*) AS n, array_to_string(list_sort(list(DISTINCT item))[1:5], ',') AS sample FROM b GROUP BY 1"""),
    "first_seen_created": (first_seen_created, _ENTRIES_SQL + " SELECT item, shipped AS created_at, recorded - change AS before FROM l WHERE seq = 1"),
}
