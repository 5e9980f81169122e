"""Demand and service dashboard over usage events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from partmill.operators.relational import sessions
from partmill.sources.storage import read_table as t

#: Fixed present of the dashboard, inside the range of ``events`` and of ``orders``.
EVENTS_NOW, ORDERS_NOW = "2024-01-30 00:00:00", "2001-08-01 00:00:00"
TOP = 12


def _ntz(text):
    return F.lit(text).cast("timestamp_ntz")


def _long(c, name):
    return c.cast("long").alias(name)


def visit_totals(spark, sf):
    kind = lambda k: F.count_if(F.col("event_type") == k)
    return t(spark, sf, "events").agg(
        F.count("*").alias("events"), F.count_distinct("user_id").alias("users"), kind("view").alias("searches"), kind("click").alias("part_views"), kind("purchase").alias("basket_adds")
    )


def request_totals(spark, sf):
    o = t(spark, sf, "orders")
    late = (F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < _ntz(ORDERS_NOW) - F.expr("INTERVAL 24 HOURS"))
    is_ = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return o.agg(F.count("*").alias("total"), is_("O").alias("pending"), is_("P").alias("quoted"), is_("F").alias("delivered"), F.count_if(late).alias("pending_over_24h"))


def users_per_term(spark, sf):
    return t(spark, sf, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.when(F.col("value") > 50, F.col("user_id"))).alias("users_above_50"))


def _terms(spark, sf):
    return t(spark, sf, "events").withColumn("term", F.get_json_object("props", "$.k").cast("long"))


def top_searches(spark, sf):
    found = _terms(spark, sf).where("event_type = 'view'").groupBy("term").agg(F.count("*").alias("searches"), F.count_distinct("user_id").alias("users"))
    return found.orderBy(F.desc("searches"), "term").limit(TOP)


def missing_searches(spark, sf):
    found = _terms(spark, sf).where("term = 0").groupBy("user_id").agg(F.count("*").alias("misses"), F.max("ts").alias("last_at"))
    return found.orderBy(F.desc("misses"), "user_id").limit(TOP)


def top_visitors(spark, sf):
    found = t(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("events"), F.max("ts").alias("last_seen"))
    return found.orderBy(F.desc("events"), "user_id").limit(TOP)


def top_suppliers(spark, sf):
    lines = t(spark, sf, "lineitem").join(t(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    found = lines.groupBy("s_suppkey", "s_name").agg(F.count("*").alias("lines"), F.count_distinct("l_orderkey").alias("orders"))
    return found.orderBy(F.desc("orders"), "s_suppkey").limit(TOP)


def activity_by_canonical(spark, sf):
    part = F.col("l_partkey") - F.col("l_partkey") % 4
    return t(spark, sf, "lineitem").groupBy(part.alias("part_id")).agg(F.count("*").alias("lines"), F.sum("l_quantity").cast("long").alias("units"))


def _visits(spark, sf):
    return sessions(t(spark, sf, "events"), ["user_id"], "ts", ["event_id"])


def visits_30min(spark, sf):
    return _visits(spark, sf).groupBy("user_id", "visit").agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_seen_at"), F.count("*").alias("events"))


def returning_users(spark, sf):
    return _visits(spark, sf).groupBy("user_id").agg(F.max("visit").alias("visits")).where("visits >= 2")


_VISITS_SQL = """WITH s AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - lag(epoch_us(ts)) OVER w > 1800000000 THEN 1 ELSE 0 END AS opened
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
v AS (SELECT *, CAST(SUM(opened) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS visit FROM s)"""


def having_dup_keys(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


def _reviewed(spark, sf):
    last = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("reviewed"))
    return t(spark, sf, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey")).where("reviewed >= o_orderdate")


def _seconds(a, b):
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return F.round(F.avg(micros(b) - micros(a)) / 1_000_000).cast("long")


def avg_review_seconds(spark, sf):
    return _reviewed(spark, sf).groupBy("o_orderpriority").agg(F.count("*").alias("reviewed"), _seconds("o_orderdate", "reviewed").alias("seconds"))


def supplier_reliability(spark, sf):
    back = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)
    per = t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").cast("long").alias("units"), F.sum(back).cast("long").alias("missing"))
    share = F.round(F.col("missing").cast("double") / F.nullif(F.col("units"), F.lit(0)), 4)
    return per.withColumn("missing_share", share).orderBy(F.desc("missing_share"), "l_suppkey").limit(TOP)


def oldest_pending(spark, sf):
    return t(spark, sf, "orders").where("o_orderstatus = 'O'").groupBy("o_orderpriority").agg(F.min("o_orderdate").alias("oldest"), F.max("o_orderdate").alias("latest"))


def status_counts(spark, sf):
    return t(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def batch_rollup(spark, sf):
    return t(spark, sf, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("created"))


def grupo_rollup(spark, sf):
    return t(spark, sf, "part").groupBy("p_type", F.floor(F.col("p_size") / 10).cast("long").alias("subgroup")).agg(F.count("*").alias("parts")).rollup("p_type", "subgroup").agg(F.sum("parts").alias("parts"))


def daily_series(spark, sf):
    days = spark.range(1).select(F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-31").cast("date"))).alias("day"))
    kinds = [F.count_if(F.col("event_type") == k).alias(k) for k in ("view", "click", "purchase")]
    per = t(spark, sf, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count_distinct("user_id").alias("users"), *kinds)
    return days.join(per, "day", "left").fillna(0)


def month_spend(spark, sf):
    e = t(spark, sf, "events").where(F.trunc(F.col("ts").cast("date"), "month") == F.trunc(_ntz(EVENTS_NOW).cast("date"), "month"))
    return e.groupBy("event_type").agg(F.count("*").alias("calls"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cost"))


def basket_kpis(spark, sf):
    b = t(spark, sf, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("last"), F.count("*").alias("n"))
    return b.agg(F.count("*").alias("baskets"), F.sum("n").alias("adds"), F.count_if(F.col("last") < _ntz(EVENTS_NOW) - F.expr("INTERVAL 7 DAYS")).alias("idle"))


def top_parts(spark, sf):
    """Two aggregates merged on their key, neither multiplied by the other."""
    lines = t(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("part_id")).agg(F.count("*").alias("lines"))
    views = _terms(spark, sf).where("event_type = 'click'").groupBy(F.col("term").alias("part_id")).agg(F.count("*").alias("views"))
    both = lines.join(views, "part_id", "full_outer").select("part_id", F.coalesce("views", F.lit(0)).alias("views"), F.coalesce("lines", F.lit(0)).alias("lines"))
    return both.orderBy(F.desc("views"), F.desc("lines"), "part_id").limit(TOP)


def client_orders(spark, sf):
    o = t(spark, sf, "orders").where("o_orderstatus <> 'P'")
    return o.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.max("o_orderdate").alias("last_order"))


def table_state(spark, sf):
    return t(spark, sf, "events").agg((F.max("event_id") + 1).alias("next_version"), F.count("*").alias("rows"))


_TERM = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

QUERIES = {
    "visit_totals": (visit_totals, """SELECT COUNT(*) AS events, COUNT(DISTINCT user_id) AS users, COUNT(*) FILTER (event_type = 'view') AS searches,
        COUNT(*) FILTER (event_type = 'click') AS part_views, COUNT(*) FILTER (event_type = 'purchase') AS basket_adds FROM events"""),
    "request_totals": (request_totals, f"""SELECT COUNT(*) AS total, COUNT(*) FILTER (o_orderstatus = 'O') AS pending, COUNT(*) FILTER (o_orderstatus = 'P') AS quoted,
        COUNT(*) FILTER (o_orderstatus = 'F') AS delivered, COUNT(*) FILTER (o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '{ORDERS_NOW}' - INTERVAL 24 HOUR) AS pending_over_24h FROM orders"""),
    "users_per_term": (users_per_term, "SELECT event_type, COUNT(DISTINCT user_id) AS users, COUNT(DISTINCT CASE WHEN value > 50 THEN user_id END) AS users_above_50 FROM events GROUP BY 1"),
    "top_searches": (top_searches, f"SELECT {_TERM} AS term, COUNT(*) AS searches, COUNT(DISTINCT user_id) AS users FROM events WHERE event_type = 'view' GROUP BY 1 ORDER BY searches DESC, term LIMIT {TOP}"),
    "missing_searches": (missing_searches, f"SELECT user_id, COUNT(*) AS misses, MAX(ts) AS last_at FROM events WHERE {_TERM} = 0 GROUP BY 1 ORDER BY misses DESC, user_id LIMIT {TOP}"),
    "top_visitors": (top_visitors, f"SELECT user_id, COUNT(*) AS events, MAX(ts) AS last_seen FROM events GROUP BY 1 ORDER BY events DESC, user_id LIMIT {TOP}"),
    "top_suppliers": (top_suppliers, f"""SELECT s_suppkey, s_name, COUNT(*) AS lines, COUNT(DISTINCT l_orderkey) AS orders FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
        GROUP BY 1, 2 ORDER BY orders DESC, s_suppkey LIMIT {TOP}"""),
    "activity_by_canonical": (activity_by_canonical, "SELECT l_partkey - l_partkey % 4 AS part_id, COUNT(*) AS lines, CAST(SUM(l_quantity) AS BIGINT) AS units FROM lineitem GROUP BY 1"),
    "visits_30min": (visits_30min, _VISITS_SQL + " SELECT user_id, visit, MIN(ts) AS started_at, MAX(ts) AS last_seen_at, COUNT(*) AS events FROM v GROUP BY 1, 2"),
    "returning_users": (returning_users, _VISITS_SQL + " SELECT user_id, MAX(visit) AS visits FROM v GROUP BY 1 HAVING MAX(visit) >= 2"),
    "having_dup_keys": (having_dup_keys, "SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1"),
    "avg_review_seconds": (avg_review_seconds, """WITH r AS (SELECT l_orderkey, MAX(l_shipdate) AS reviewed FROM lineitem GROUP BY 1)
        SELECT o_orderpriority, COUNT(*) AS reviewed, CAST(round(AVG(epoch_us(r.reviewed) - epoch_us(o_orderdate)) / 1000000) AS BIGINT) AS seconds
        FROM orders JOIN r ON l_orderkey = o_orderkey WHERE r.reviewed >= o_orderdate GROUP BY 1"""),
    "supplier_reliability": (supplier_reliability, f"""WITH p AS (SELECT l_suppkey, CAST(SUM(l_quantity) AS BIGINT) AS units, CAST(SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS missing
        FROM lineitem GROUP BY 1) SELECT *, round(CAST(missing AS DOUBLE) / nullif(units, 0), 4) AS missing_share FROM p ORDER BY missing_share DESC, l_suppkey LIMIT {TOP}"""),
    "oldest_pending": (oldest_pending, "SELECT o_orderpriority, MIN(o_orderdate) AS oldest, MAX(o_orderdate) AS latest FROM orders WHERE o_orderstatus = 'O' GROUP BY 1"),
    "status_counts": (status_counts, "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1"),
    "batch_rollup": (batch_rollup, "SELECT o_orderpriority, o_orderstatus, COUNT(*) AS n, MIN(o_orderdate) AS created FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)"),
    "grupo_rollup": (grupo_rollup, "SELECT p_type, CAST(floor(p_size / 10) AS BIGINT) AS subgroup, COUNT(*) AS parts FROM part GROUP BY ROLLUP (p_type, CAST(floor(p_size / 10) AS BIGINT))"),
    "daily_series": (daily_series, """WITH d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day),
        e AS (SELECT CAST(ts AS DATE) AS day, COUNT(DISTINCT user_id) AS users, COUNT(*) FILTER (event_type = 'view') AS v, COUNT(*) FILTER (event_type = 'click') AS c,
          COUNT(*) FILTER (event_type = 'purchase') AS p FROM events GROUP BY 1)
        SELECT d.day, COALESCE(users, 0) AS users, COALESCE(v, 0) AS "view", COALESCE(c, 0) AS click, COALESCE(p, 0) AS purchase FROM d LEFT JOIN e ON e.day = d.day"""),
    "month_spend": (month_spend, f"""SELECT event_type, COUNT(*) AS calls, CAST(SUM(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cost FROM events
        WHERE date_trunc('month', ts) = date_trunc('month', TIMESTAMP '{EVENTS_NOW}') GROUP BY 1"""),
    "basket_kpis": (basket_kpis, f"""WITH b AS (SELECT user_id, MAX(ts) AS last, COUNT(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1)
        SELECT COUNT(*) AS baskets, CAST(SUM(n) AS BIGINT) AS adds, COUNT(*) FILTER (last < TIMESTAMP '{EVENTS_NOW}' - INTERVAL 7 DAY) AS idle FROM b"""),
    "top_parts": (top_parts, f"""WITH l AS (SELECT l_partkey AS part_id, COUNT(*) AS lines FROM lineitem GROUP BY 1),
        v AS (SELECT {_TERM} AS part_id, COUNT(*) AS views FROM events WHERE event_type = 'click' GROUP BY 1)
        SELECT COALESCE(l.part_id, v.part_id) AS part_id, COALESCE(views, 0) AS views, COALESCE(lines, 0) AS lines FROM l FULL JOIN v ON l.part_id = v.part_id
        ORDER BY views DESC, lines DESC, part_id LIMIT {TOP}"""),
    "client_orders": (client_orders, "SELECT o_custkey, COUNT(*) AS orders, MAX(o_orderdate) AS last_order FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1"),
    "table_state": (table_state, 'SELECT MAX(event_id) + 1 AS next_version, COUNT(*) AS "rows" FROM events'),
}
