"""Row predicates, findings and ownership: what a reviewer sees of lines, codes and holds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from partmill.operators.relational import ranges_overlap, top_row
from partmill.sources.storage import read_table as t


def scan_live_refs(spark, sf):
    """References that are not retired, and internal ones only where they are the main one."""
    p = t(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") > 40, "retired").otherwise("checked").alias("state"), F.when(F.col("p_type") == "PROMO", "internal").otherwise("oem").alias("kind"), (F.col("p_partkey") % 5 == 0).alias("is_main"))
    return p.where((F.col("state") != "retired") & ((F.col("kind") != "internal") | F.col("is_main"))).select("p_partkey", "kind")


def semi_key_lookup(spark, sf):
    keys = t(spark, sf, "events").where("event_type = 'click'").select((F.col("user_id") % 1000).alias("p_partkey"))
    return t(spark, sf, "part").join(keys, "p_partkey", "left_semi").select("p_partkey", "p_brand")


def null_as_any(spark, sf):
    """Rules without a brand fit every brand; an empty brand is none."""
    rules = spark.createDataFrame([(1, ""), (2, "Brand#1"), (3, None), (4, "Brand#9")], "rule long, brand string").withColumn("brand", F.nullif("brand", F.lit("")))
    brands = t(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("parts"))
    named = brands.join(rules.where("brand IS NOT NULL"), F.col("p_brand") == F.col("brand")).select("rule", "parts")
    free = rules.where("brand IS NULL").select("rule", F.lit(1).alias("k")).join(brands.agg(F.sum("parts").alias("parts")).withColumn("k", F.lit(1)), "k").select("rule", "parts")
    return named.unionByName(free).groupBy("rule").agg(F.sum("parts").alias("parts"))


def ci_lookup(spark, sf):
    wanted = spark.createDataFrame([("GERMANY",), ("france",), ("nation#3",), ("NATION_5",)], "name string")
    n = t(spark, sf, "nation")
    return n.join(wanted.select(F.lower("name").alias("low")).union(n.where("n_nationkey % 6 = 0").select(F.lower(F.upper("n_name")))), F.lower("n_name") == F.col("low"), "left_semi").select("n_nationkey", "n_name")


def origin_by_prefix(spark, sf):
    code = F.concat(F.when(F.col("l_returnflag") == "R", "QUOTE-").when(F.col("l_linestatus") == "F", "XLS-").otherwise("FEED-"), F.col("l_orderkey").cast("string"))
    lines = t(spark, sf, "lineitem").select(code.alias("reference"))
    origin = F.when(F.col("reference").startswith("QUOTE-"), "quotation").when(F.col("reference").startswith("XLS-"), "excel").otherwise("feed")
    return lines.groupBy(origin.alias("origin")).agg(F.count("*").alias("n"))


def json_key_cast(spark, sf):
    k = F.expr("try_cast(get_json_object(props, '$.k') AS bigint)")
    return t(spark, sf, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.max(k).alias("most"), F.count_if(k.isNull()).alias("without"))


def eav_filter(spark, sf):
    """Parts that meet every rule on their field values: one grouping, not a join a rule."""
    p = t(spark, sf, "part")
    values = p.select("p_partkey", F.lit("size").alias("field"), F.col("p_size").cast("double").alias("number"), F.lit(None).cast("string").alias("word")).unionByName(p.select("p_partkey", F.lit("type").alias("field"), F.lit(None).cast("double").alias("number"), F.col("p_type").alias("word")))
    met = ((F.col("field") == "size") & F.col("number").between(10, 30)) | ((F.col("field") == "type") & F.contains("word", F.lit("ECON")))
    return values.where(met).groupBy("p_partkey").agg(F.count_distinct("field").alias("met")).where("met = 2").select("p_partkey")


def not_matched_filter(spark, sf):
    return t(spark, sf, "orders").where(~F.coalesce(F.col("o_orderstatus").isin("F", "P"), F.lit(False))).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def line_exceptions(spark, sf):
    """Findings of every line, with their severity; exploded and counted."""
    rules = ((F.col("l_discount") > 0.08, "discount", "confirm"), (F.col("l_quantity") >= 50, "bulk", "info"), ((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.06), "returned_taxed", "block"))
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for c, code, severity in rules]))
    each = t(spark, sf, "lineitem").select("l_orderkey", F.explode(found).alias("f"))
    return each.groupBy("f.code", "f.severity").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("orders"))


def blockers_two_scenarios(spark, sf):
    """Parts that a laxer limit on size and price would set free."""
    def blockers(size, price):
        return F.array_compact(F.array(F.when(F.col("p_size") > size, "size"), F.when(F.col("p_retailprice") > price, "price"), F.when(F.col("p_type") == "PROMO", "promo")))

    p = t(spark, sf, "part").select("p_partkey", blockers(20, 950).alias("strict"), blockers(40, 1000).alias("lax"))
    return p.where((F.size("strict") > 0) & (F.size("lax") == 0)).select("p_partkey", F.array_join("strict", ",").alias("blocked_by"))


def retention_candidates(spark, sf):
    """Old orders, and newer orders of a customer whose first order is old."""
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    limit = F.lit("1996-01-01").cast("timestamp_ntz")
    old = o.where(F.col("o_orderdate") < limit)
    first = top_row(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).where(F.col("o_orderdate") < limit).select("o_custkey")
    follow = o.where((F.col("o_orderdate") >= limit) & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"))).join(first, "o_custkey", "left_semi")
    return old.select("o_orderkey", F.lit("age").alias("reason")).unionByName(follow.select("o_orderkey", F.lit("source").alias("reason")))


def range_overlap(spark, sf):
    """For every customer, with how many others of the nation the years of ordering overlap.

    Customers are first counted by nation and years, of which there are few; these meet, not customers."""
    y = t(spark, sf, "orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("lo"), F.max(F.year("o_orderdate")).alias("hi"))
    c = y.join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_nationkey", "lo", "hi")
    groups = c.groupBy("c_nationkey", "lo", "hi").agg(F.count("*").alias("n"))
    other = groups.select("c_nationkey", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), "n")
    met = groups.drop("n").join(other, "c_nationkey").where(ranges_overlap(F.col("lo"), F.col("hi"), F.col("lo2"), F.col("hi2"))).groupBy("c_nationkey", "lo", "hi").agg(F.sum("n").alias("n"))
    return c.join(met, ["c_nationkey", "lo", "hi"]).select("c_custkey", (F.col("n") - 1).alias("overlaps"))


def suffix_base_join(spark, sf):
    """Codes with a letter suffix joined to the code without it."""
    p = t(spark, sf, "part").select("p_partkey", F.concat(F.lit("AB-"), F.lpad(F.floor(F.col("p_partkey") / 3).cast("string"), 6, "0"), F.element_at(F.array(F.lit(""), F.lit("-R"), F.lit("-LH")), (F.col("p_partkey") % 3 + 1).cast("int"))).alias("code"))
    tagged = p.withColumn("base", F.regexp_extract("code", "^(.*[0-9])(-[A-Z]+)$", 1)).where("base <> ''")
    base = p.select(F.col("p_partkey").alias("line"), F.col("code").alias("base"))
    return tagged.join(base, "base").select("p_partkey", "code", "line")


def still_merged_flag(spark, sf):
    """Every part listed as merged into a line, and whether that still holds."""
    lists = t(spark, sf, "part").where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("line"), F.explode(F.sequence(F.col("p_partkey") + 1, F.col("p_partkey") + 3)).alias("source"))
    now = t(spark, sf, "part").select(F.col("p_partkey").alias("source"), F.when(F.col("p_size") < 30, F.col("p_partkey") - F.col("p_partkey") % 4).otherwise(F.col("p_partkey")).alias("owner"))
    return lists.join(now, "source", "left").select("line", "source", F.coalesce(F.col("owner") == F.col("line"), F.lit(False)).alias("still_merged"))


def suggested_owner(spark, sf):
    """A line's owner: the recorded one, else by its part's number, else by its brand, else none."""
    p = t(spark, sf, "part")
    by_number = t(spark, sf, "lineitem").where("l_quantity > 48").groupBy("l_partkey").agg(F.min("l_suppkey").alias("numbered"))
    by_brand = p.where("p_size > 45").groupBy("p_brand").agg(F.min("p_partkey").alias("branded"))
    found = p.join(by_number, F.col("p_partkey") == F.col("l_partkey"), "left").join(by_brand, "p_brand", "left")
    recorded = F.when(F.col("p_partkey") % 10 == 0, F.col("p_partkey") % 7)
    how = F.when(recorded.isNotNull(), "recorded").when(F.col("numbered").isNotNull(), "number").when(F.col("branded").isNotNull(), "brand").otherwise("none")
    return found.select("p_partkey", F.coalesce(recorded, "numbered", "branded").alias("owner"), how.alias("how"))


def shortfall_since_quote(spark, sf):
    """What a quotation relied on (no more than was free) against what is free now, by order."""
    free = t(spark, sf, "lineitem").groupBy("l_partkey").agg((F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0)) / 20).cast("long").alias("free"))
    q = t(spark, sf, "lineitem").join(free, "l_partkey").withColumn("relied", F.least(F.col("l_quantity").cast("long"), F.col("free") + 3))
    return q.groupBy("l_orderkey").agg(F.bool_or(F.col("free") < F.col("relied")).alias("short"), F.sum(F.greatest(F.col("relied") - F.col("free"), F.lit(0))).alias("units"))


def state_precedence(spark, sf):
    rank = F.when(F.col("p_type") == "ECONOMY", 3).when(F.col("p_type") == "PROMO", 2).otherwise(1)
    best = t(spark, sf, "part").groupBy((F.col("p_partkey") - F.col("p_partkey") % 4).alias("line")).agg(F.max(rank).alias("r"))
    return best.select("line", F.when(F.col("r") == 3, "published").when(F.col("r") == 2, "draft").otherwise("archived").alias("state"))


def revision_continue(spark, sf):
    past = t(spark, sf, "orders").where("o_orderdate < timestamp_ntz'1998-01-01'").groupBy("o_custkey").agg(F.count("*").alias("past"))
    new = t(spark, sf, "orders").where("o_orderdate >= timestamp_ntz'1998-01-01'")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return new.join(past, "o_custkey", "left").select("o_orderkey", (F.coalesce("past", F.lit(0)) + F.row_number().over(w)).cast("long").alias("revision"))


def consolidate_marks(spark, sf):
    """Per user: the furthest event, and the kind of the latest event that has a positive value."""
    e = t(spark, sf, "events")
    return e.groupBy("user_id").agg(F.max("event_id").alias("furthest"), F.max_by(F.when(F.col("value") > 50, F.col("event_type")), F.when(F.col("value") > 50, F.struct("ts", "event_id"))).alias("kind"))


def dedupe_keep_first(spark, sf):
    return top_row(t(spark, sf, "events").where("event_type = 'click'"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_id", "ts")


def snapshot_diff(spark, sf):
    """Leaves of two snapshots compared by path."""
    def leaves(df):
        return df.select(F.explode(F.array(*[F.struct(F.concat(F.col("p_partkey").cast("string"), F.lit(f".{c}")).alias("path"), F.col(c).cast("string").alias("leaf")) for c in ("p_brand", "p_size")])).alias("x")).select("x.*")

    p = t(spark, sf, "part")
    old = leaves(p.where("p_partkey % 9 <> 0")).withColumnRenamed("leaf", "old")
    new = leaves(p.where("p_partkey % 8 <> 0").withColumn("p_size", F.col("p_size") + F.when(F.col("p_partkey") % 5 == 0, 1).otherwise(0))).withColumnRenamed("leaf", "new")
    return old.join(new, "path", "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select("path", "old", "new")


def preflight_issues(spark, sf):
    """Nations without enough solvent suppliers for their customers."""
    s = t(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count_if(F.col("s_acctbal") > 0).alias("able"), F.max("s_acctbal").alias("best"))
    c = t(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    joined = c.join(s, F.col("c_nationkey") == F.col("s_nationkey"), "left")
    issue = F.when(F.coalesce("able", F.lit(0)) == 0, "no_supplier").when(F.col("best") < 1000, "weak").otherwise("ok")
    return joined.select("c_nationkey", "customers", issue.alias("issue"))


QUERIES = {
    "scan_live_refs": (scan_live_refs, "SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'internal' ELSE 'oem' END AS kind FROM part WHERE p_size <= 40 AND (p_type <> 'PROMO' OR p_partkey % 5 = 0)"),
    "semi_key_lookup": (semi_key_lookup, "SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT user_id % 1000 FROM events WHERE event_type = 'click')"),
    "null_as_any": (null_as_any, """WITH r(rule, brand) AS (VALUES (1, NULL), (2, 'Brand#1'), (3, NULL), (4, 'Brand#9')) SELECT CAST(rule AS BIGINT) AS rule, COUNT(*) AS parts FROM r JOIN part ON brand IS NULL OR brand = p_brand GROUP BY 1"""),
    "ci_lookup": (ci_lookup, "SELECT n_nationkey, n_name FROM nation WHERE lower(n_name) IN ('germany', 'france', 'nation#3', 'nation_5') OR n_nationkey % 6 = 0"),
    "origin_by_prefix": (origin_by_prefix, "SELECT CASE WHEN l_returnflag = 'R' THEN 'quotation' WHEN l_linestatus = 'F' THEN 'excel' ELSE 'feed' END AS origin, COUNT(*) AS n FROM lineitem GROUP BY 1"),
    "json_key_cast": (json_key_cast, """WITH e AS (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
        SELECT event_type, CAST(SUM(k) AS BIGINT) AS total, MAX(k) AS most, COUNT(*) FILTER (k IS NULL) AS without FROM e GROUP BY 1"""),
    "eav_filter": (eav_filter, "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 30 AND contains(p_type, 'ECON')"),
    "not_matched_filter": (not_matched_filter, "SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE NOT COALESCE(o_orderstatus IN ('F', 'P'), FALSE) GROUP BY 1"),
    "line_exceptions": (line_exceptions, """WITH f AS (SELECT l_orderkey, 'discount' AS code, 'confirm' AS severity FROM lineitem WHERE l_discount > 0.08 UNION ALL SELECT l_orderkey, 'bulk', 'info' FROM lineitem WHERE l_quantity >= 50
        UNION ALL SELECT l_orderkey, 'returned_taxed', 'block' FROM lineitem WHERE l_returnflag = 'R' AND l_tax > 0.06) SELECT code, severity, COUNT(*) AS n, COUNT(DISTINCT l_orderkey) AS orders FROM f GROUP BY 1, 2"""),
    "blockers_two_scenarios": (blockers_two_scenarios, """SELECT p_partkey, concat_ws(',', CASE WHEN p_size > 20 THEN 'size' END, CASE WHEN p_retailprice > 950 THEN 'price' END) AS blocked_by FROM part
        WHERE p_type <> 'PROMO' AND p_size <= 40 AND p_retailprice <= 1000 AND (p_size > 20 OR p_retailprice > 950)"""),
    "retention_candidates": (retention_candidates, """WITH f AS (SELECT o_custkey, MIN(o_orderdate) AS first FROM orders GROUP BY 1) SELECT o_orderkey, 'age' AS reason FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'
        UNION ALL SELECT o_orderkey, 'source' FROM orders JOIN f ON f.o_custkey = orders.o_custkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND first < TIMESTAMP '1996-01-01'"""),
    "range_overlap": (range_overlap, """WITH c AS (SELECT c_custkey, c_nationkey, MIN(year(o_orderdate)) AS lo, MAX(year(o_orderdate)) AS hi FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)
        SELECT a.c_custkey, COUNT(b.c_custkey) AS overlaps FROM c a LEFT JOIN c b ON a.c_nationkey = b.c_nationkey AND a.c_custkey <> b.c_custkey AND a.lo <= b.hi AND b.lo <= a.hi GROUP BY 1"""),
    "suffix_base_join": (suffix_base_join, """WITH p AS (SELECT p_partkey, concat('AB-', lpad(CAST(p_partkey // 3 AS VARCHAR), 6, '0'), CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '-R' ELSE '-LH' END) AS code FROM part)
        SELECT a.p_partkey, a.code, b.p_partkey AS line FROM p a JOIN p b ON regexp_extract(a.code, '^(.*[0-9])(-[A-Z]+)$', 1) = b.code WHERE a.p_partkey % 3 <> 0"""),
    "still_merged_flag": (still_merged_flag, """WITH l AS (SELECT p_partkey AS line, p_partkey + k AS source FROM part, (VALUES (1), (2), (3)) AS v(k) WHERE p_partkey % 4 = 0)
        SELECT line, source, COALESCE(CASE WHEN p_size < 30 THEN p_partkey - p_partkey % 4 ELSE p_partkey END = line, FALSE) AS still_merged FROM l LEFT JOIN part ON p_partkey = source"""),
    "suggested_owner": (suggested_owner, """WITH n AS (SELECT l_partkey, MIN(l_suppkey) AS numbered FROM lineitem WHERE l_quantity > 48 GROUP BY 1), b AS (SELECT p_brand, MIN(p_partkey) AS branded FROM part WHERE p_size > 45 GROUP BY 1)
        SELECT p_partkey, COALESCE(CASE WHEN p_partkey % 10 = 0 THEN p_partkey % 7 END, numbered, branded) AS owner,
          CASE WHEN p_partkey % 10 = 0 THEN 'recorded' WHEN numbered IS NOT NULL THEN 'number' WHEN branded IS NOT NULL THEN 'brand' ELSE 'none' END AS how
        FROM part LEFT JOIN n ON l_partkey = p_partkey LEFT JOIN b ON b.p_brand = part.p_brand"""),
    "shortfall_since_quote": (shortfall_since_quote, """WITH f AS (SELECT l_partkey, CAST(floor(SUM(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) / 20) AS BIGINT) AS free FROM lineitem GROUP BY 1),
        q AS (SELECT l_orderkey, free, least(CAST(l_quantity AS BIGINT), free + 3) AS relied FROM lineitem l JOIN f ON f.l_partkey = l.l_partkey)
        SELECT l_orderkey, bool_or(free < relied) AS short, CAST(SUM(greatest(relied - free, 0)) AS BIGINT) AS units FROM q GROUP BY 1"""),
    "state_precedence": (state_precedence, """SELECT p_partkey - p_partkey % 4 AS line, CASE MAX(CASE p_type WHEN 'ECONOMY' THEN 3 WHEN 'PROMO' THEN 2 ELSE 1 END) WHEN 3 THEN 'published' WHEN 2 THEN 'draft' ELSE 'archived' END AS state FROM part GROUP BY 1"""),
    "revision_continue": (revision_continue, """SELECT o_orderkey, CAST((SELECT COUNT(*) FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate < TIMESTAMP '1998-01-01') + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS revision
        FROM orders o WHERE o_orderdate >= TIMESTAMP '1998-01-01'"""),
    "consolidate_marks": (consolidate_marks, "SELECT user_id, MAX(event_id) AS furthest, arg_max(event_type, (ts, event_id)) FILTER (value > 50) AS kind FROM events GROUP BY 1"),
    "dedupe_keep_first": (dedupe_keep_first, "SELECT user_id, event_id, ts FROM events WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1"),
    "snapshot_diff": (snapshot_diff, """WITH o AS (SELECT concat(p_partkey, '.p_brand') AS path, p_brand AS old FROM part WHERE p_partkey % 9 <> 0 UNION ALL SELECT concat(p_partkey, '.p_size'), CAST(p_size AS VARCHAR) FROM part WHERE p_partkey % 9 <> 0),
        n AS (SELECT concat(p_partkey, '.p_brand') AS path, p_brand AS new FROM part WHERE p_partkey % 8 <> 0 UNION ALL SELECT concat(p_partkey, '.p_size'), CAST(p_size + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR) FROM part WHERE p_partkey % 8 <> 0)
        SELECT COALESCE(o.path, n.path) AS path, old, new FROM o FULL JOIN n ON o.path = n.path WHERE old IS DISTINCT FROM new"""),
    "preflight_issues": (preflight_issues, """WITH s AS (SELECT s_nationkey, COUNT(*) FILTER (s_acctbal > 0) AS able, MAX(s_acctbal) AS best FROM supplier GROUP BY 1), c AS (SELECT c_nationkey, COUNT(*) AS customers FROM customer GROUP BY 1)
        SELECT c_nationkey, customers, CASE WHEN COALESCE(able, 0) = 0 THEN 'no_supplier' WHEN best < 1000 THEN 'weak' ELSE 'ok' END AS issue FROM c LEFT JOIN s ON s_nationkey = c_nationkey"""),
}
