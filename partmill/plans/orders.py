"""Order and quotation reports: latest revisions, totals, missing units, unread messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partmill.operators.relational import full_diff, ranges_overlap, top_row
from partmill.plans.ledger import ORDER
from partmill.sources.storage import read_table as t

MONEY = "decimal(18,2)"
#: Groups of order states.
STATUS_GROUPS = {"open": ("O", "P"), "closed": ("F",), "active": ("P",)}
_REV_SQL = f"""WITH q AS (SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_returnflag, CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, {", ".join(ORDER)}) AS BIGINT) AS revision FROM lineitem)"""


def quotations(spark, sf) -> DataFrame:
    """Lines as numbered revisions of their order's quotation."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", *ORDER)
    return t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", F.col("l_extendedprice").cast(MONEY).alias("price"), F.row_number().over(w).cast("long").alias("revision"))


def latest_revision(spark, sf):
    """The last revision of every order: the greatest in order and the number of all, so nothing is sorted."""
    order = F.struct("l_linenumber", "l_partkey", *[c for c in ORDER if c != "l_linenumber"])
    last = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("revision"), F.max_by(F.struct(F.col("l_extendedprice").cast(MONEY).alias("price"), "l_partkey"), order).alias("q"))
    return last.select("l_orderkey", "revision", "q.price", "q.l_partkey")


def agreed_totals(spark, sf):
    missing = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    units = (F.col("l_quantity").cast("decimal(10,0)") - missing) * F.col("price")
    return quotations(spark, sf).groupBy("l_suppkey").agg(F.sum(units).cast("decimal(38,2)").alias("total"))


def agreement_totals(spark, sf):
    back = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)
    return quotations(spark, sf).groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("agreed"), F.sum(back).cast("long").alias("missing"), F.sum(F.col("l_quantity") - back).cast("long").alias("final"))


def join_inner_supplier(spark, sf):
    return t(spark, sf, "lineitem").join(t(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_name").agg(F.sum("l_quantity").cast("long").alias("units"))


def join_left_taxonomy(spark, sf):
    n, r = t(spark, sf, "nation"), t(spark, sf, "region").where("r_regionkey < 3")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_name", F.coalesce("r_name", F.lit("(none)")).alias("family"))


def semi_in_subquery(spark, sf):
    big = t(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return t(spark, sf, "orders").join(big, "o_orderkey", "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def anti_missing(spark, sf):
    return t(spark, sf, "orders").join(t(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


def semi_residual(spark, sf):
    """Parts with a line that was sold below the list price."""
    lines = t(spark, sf, "lineitem").select("l_partkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"))
    p = t(spark, sf, "part")
    return p.join(lines, (F.col("l_partkey") == F.col("p_partkey")) & (F.col("unit") < F.col("p_retailprice") * 0.5), "left_semi").select("p_partkey")


def preagg_left_join(spark, sf):
    per = t(spark, sf, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast(MONEY)).alias("spent"))
    return t(spark, sf, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("spent", F.lit(0)).cast("decimal(28,2)").alias("spent"))


def multi_preagg_join(spark, sf):
    orders = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    lines = t(spark, sf, "orders").join(t(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("lines"))
    both = t(spark, sf, "customer").select("c_custkey").join(orders, "c_custkey", "left").join(lines, "c_custkey", "left")
    return both.select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("lines", F.lit(0)).alias("lines"))


def focus_order(spark, sf):
    """A customer's newest open order, else the newest of all."""
    o = t(spark, sf, "orders").withColumn("is_open", F.col("o_orderstatus").isin(*STATUS_GROUPS["open"]))
    return top_row(o, ["o_custkey"], [F.desc("is_open"), F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "is_open")


def status_groups(spark, sf):
    return t(spark, sf, "orders").agg(*[F.count_if(F.col("o_orderstatus").isin(*v)).alias(k) for k, v in STATUS_GROUPS.items()])


def status_rank_sort(spark, sf):
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).cast("long")
    return t(spark, sf, "orders").select("o_orderkey", rank.alias("rank")).orderBy("rank", F.desc("o_orderdate"), "o_orderkey").limit(50)


def missing_units_offers(spark, sf):
    """Units sent back, with the supplier that offers most of the part and is not the one that failed."""
    missing = t(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").cast("long").alias("missing"))
    offers = t(spark, sf, "lineitem").where("l_returnflag <> 'R'").groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("offered_by")).agg(F.sum("l_quantity").cast("long").alias("units"))
    found = missing.join(offers, (F.col("l_partkey") == F.col("part")) & (F.col("l_suppkey") != F.col("offered_by")), "left")
    return top_row(found, ["l_partkey", "l_suppkey"], [F.desc_nulls_last("units"), "offered_by"]).select("l_partkey", "l_suppkey", "missing", "offered_by", "units")


def split_by_supplier(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").cast("long").alias("units"))


def unread_counts(spark, sf):
    """Messages by the other side after the reader's last own message."""
    m = t(spark, sf, "conversations")
    mark = m.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("read"))
    return m.join(mark, "conv_id", "left").where("role <> 'user' AND turn > coalesce(read, -1)").groupBy("conv_id").agg(F.count("*").alias("unread"))


def capped_history(spark, sf):
    """The newest messages of a thread within 2,000 characters, twelve at most."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    m = t(spark, sf, "conversations").select("conv_id", "turn", F.sum(F.length(F.coalesce("text", F.lit(""))).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"), F.row_number().over(w).alias("rn"))
    return m.where("running <= 2000 AND rn <= 12").select("conv_id", "turn", "running")


def monotone_mark(spark, sf):
    m = t(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("top"))
    return m.select("conv_id", F.least("top", F.greatest(F.lit(2), F.col("conv_id") % 7)).cast("long").alias("mark"))


def side_column(spark, sf):
    side = F.when(F.col("role") == "assistant", "supplier").otherwise("client")
    return t(spark, sf, "conversations").groupBy(side.alias("side")).agg(F.count("*").alias("messages"), F.count_distinct("conv_id").alias("threads"))


def window_overlap_self(spark, sf):
    """Pairs of a customer's orders whose 30-day windows overlap."""
    o = t(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    a, b = o.alias("a"), o.alias("b")
    until = lambda x: F.date_add(F.col(f"{x}.d"), 30)
    near = (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.o_orderkey") < F.col("b.o_orderkey")) & ranges_overlap(F.col("a.d"), until("a"), F.col("b.d"), until("b"))
    return a.join(b, near).select(F.col("a.o_orderkey").alias("first"), F.col("b.o_orderkey").alias("second"))


def diff_plan(spark, sf):
    stored = t(spark, sf, "part").where("p_partkey % 5 <> 0").select("p_partkey", "p_brand", (F.col("p_size") + F.when(F.col("p_partkey") % 7 == 0, 1).otherwise(0)).alias("p_size"))
    computed = t(spark, sf, "part").where("p_partkey % 6 <> 0").select("p_partkey", "p_brand", "p_size")
    return full_diff(stored, computed, "p_partkey", ["p_brand", "p_size"])


def col_to_col(spark, sf):
    return t(spark, sf, "orders").join(t(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).where("l_shipdate >= o_orderdate").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def set_union_ids(spark, sf):
    l, e = t(spark, sf, "lineitem"), t(spark, sf, "events")
    return l.where("l_quantity = 50").select(F.col("l_partkey").alias("id")).union(e.where("value > 99").select("user_id")).distinct()


def set_except_stale(spark, sf):
    return t(spark, sf, "part").select(F.col("p_partkey").alias("id")).exceptAll(t(spark, sf, "lineitem").where("l_quantity > 49 AND l_returnflag = 'A'").select("l_partkey").distinct())


def set_intersect_keys(spark, sf):
    return t(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).intersect(t(spark, sf, "supplier").where("s_acctbal > 0").select("s_nationkey"))


QUERIES = {
    "latest_revision": (latest_revision, _REV_SQL + " SELECT l_orderkey, revision, price, l_partkey FROM q QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY revision DESC) = 1"),
    "agreed_totals": (agreed_totals, _REV_SQL + " SELECT l_suppkey, CAST(SUM((CAST(l_quantity AS DECIMAL(10,0)) - CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) * price) AS DECIMAL(38,2)) AS total FROM q GROUP BY 1"),
    "agreement_totals": (agreement_totals, """SELECT l_orderkey, CAST(SUM(l_quantity) AS BIGINT) AS agreed, CAST(SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS missing,
        CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END) AS BIGINT) AS final FROM lineitem GROUP BY 1"""),
    "join_inner_supplier": (join_inner_supplier, "SELECT s_name, CAST(SUM(l_quantity) AS BIGINT) AS units FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1"),
    "join_left_taxonomy": (join_left_taxonomy, "SELECT n_name, COALESCE(r_name, '(none)') AS family FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey"),
    "semi_in_subquery": (semi_in_subquery, "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) GROUP BY 1"),
    "anti_missing": (anti_missing, "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"),
    "semi_residual": (semi_residual, "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_extendedprice / l_quantity < p_retailprice * 0.5)"),
    "preagg_left_join": (preagg_left_join, "SELECT c_custkey, CAST(COALESCE(spent, 0) AS DECIMAL(28,2)) AS spent FROM customer LEFT JOIN (SELECT o_custkey, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS spent FROM orders GROUP BY 1) ON o_custkey = c_custkey"),
    "multi_preagg_join": (multi_preagg_join, """SELECT c_custkey, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey) AS orders,
        (SELECT COUNT(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey) AS lines FROM customer"""),
    "focus_order": (focus_order, "SELECT o_custkey, o_orderkey, o_orderstatus IN ('O', 'P') AS is_open FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus IN ('O', 'P') DESC, o_orderdate DESC, o_orderkey DESC) = 1"),
    "status_groups": (status_groups, "SELECT COUNT(*) FILTER (o_orderstatus IN ('O', 'P')) AS open, COUNT(*) FILTER (o_orderstatus = 'F') AS closed, COUNT(*) FILTER (o_orderstatus = 'P') AS active FROM orders"),
    "status_rank_sort": (status_rank_sort, "SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS BIGINT) AS rank FROM orders ORDER BY rank, o_orderdate DESC, o_orderkey LIMIT 50"),
    "missing_units_offers": (missing_units_offers, """WITH m AS (SELECT l_partkey, l_suppkey, CAST(SUM(l_quantity) AS BIGINT) AS missing FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
        o AS (SELECT l_partkey AS part, l_suppkey AS offered_by, CAST(SUM(l_quantity) AS BIGINT) AS units FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2)
        SELECT l_partkey, l_suppkey, missing, offered_by, units FROM m LEFT JOIN o ON part = l_partkey AND offered_by <> l_suppkey
        QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY units DESC NULLS LAST, offered_by) = 1"""),
    "split_by_supplier": (split_by_supplier, "SELECT l_orderkey, l_suppkey, COUNT(*) AS lines, CAST(SUM(l_quantity) AS BIGINT) AS units FROM lineitem GROUP BY 1, 2"),
    "unread_counts": (unread_counts, """WITH r AS (SELECT conv_id, MAX(turn) AS read FROM conversations WHERE role = 'user' GROUP BY 1)
        SELECT c.conv_id, COUNT(*) AS unread FROM conversations c LEFT JOIN r ON r.conv_id = c.conv_id WHERE role <> 'user' AND turn > COALESCE(read, -1) GROUP BY 1"""),
    "capped_history": (capped_history, """WITH m AS (SELECT conv_id, turn, CAST(SUM(length(COALESCE(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) SELECT conv_id, turn, running FROM m WHERE running <= 2000 AND rn <= 12"""),
    "monotone_mark": (monotone_mark, "SELECT conv_id, CAST(least(MAX(turn), greatest(2, conv_id % 7)) AS BIGINT) AS mark FROM conversations GROUP BY conv_id"),
    "side_column": (side_column, "SELECT CASE WHEN role = 'assistant' THEN 'supplier' ELSE 'client' END AS side, COUNT(*) AS messages, COUNT(DISTINCT conv_id) AS threads FROM conversations GROUP BY 1"),
    "window_overlap_self": (window_overlap_self, """SELECT a.o_orderkey AS first, b.o_orderkey AS second FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
        WHERE CAST(a.o_orderdate AS DATE) <= CAST(b.o_orderdate AS DATE) + 30 AND CAST(b.o_orderdate AS DATE) <= CAST(a.o_orderdate AS DATE) + 30"""),
    "diff_plan": (diff_plan, """WITH s AS (SELECT p_partkey, p_brand, p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS p_size FROM part WHERE p_partkey % 5 <> 0), c AS (SELECT * FROM part WHERE p_partkey % 6 <> 0)
        SELECT COALESCE(s.p_partkey, c.p_partkey) AS p_partkey, CASE WHEN s.p_partkey IS NULL THEN 'new' WHEN c.p_partkey IS NULL THEN 'stale'
          WHEN s.p_brand IS NOT DISTINCT FROM c.p_brand AND s.p_size IS NOT DISTINCT FROM c.p_size THEN 'same' ELSE 'changed' END AS change FROM s FULL JOIN c ON s.p_partkey = c.p_partkey"""),
    "col_to_col": (col_to_col, "SELECT o_orderstatus, COUNT(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate GROUP BY 1"),
    "set_union_ids": (set_union_ids, "SELECT l_partkey AS id FROM lineitem WHERE l_quantity = 50 UNION SELECT user_id FROM events WHERE value > 99"),
    "set_except_stale": (set_except_stale, "SELECT p_partkey AS id FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49 AND l_returnflag = 'A'"),
    "set_intersect_keys": (set_intersect_keys, "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0"),
}
