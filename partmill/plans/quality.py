"""Data-quality checks: each query returns the offending rows or counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from partmill.operators import checks
from partmill.plans.ledger import _ENTRIES_SQL, chained, entries
from partmill.sources import loads
from partmill.sources.storage import read_table as t


def dq_one_main(spark, sf):
    """Names that have no part, or more than one, marked as main (every fifth part is)."""
    per = t(spark, sf, "part").groupBy("p_name").agg(F.count_if(F.col("p_partkey") % 5 == 0).alias("mains"))
    return per.where("mains <> 1")


def dq_orphans(spark, sf):
    """Orders that lines name and that are not there, and orders without a line."""
    named, known = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key")).distinct(), t(spark, sf, "orders").select(F.col("o_orderkey").alias("key"))
    return checks.orphans(named, known, "key").select("key", F.lit("no_order").alias("kind")).unionByName(checks.orphans(known, named, "key").select("key", F.lit("no_line").alias("kind")))


def dq_key_on_two_lines(spark, sf):
    a, b = t(spark, sf, "part").where("p_size < 10").alias("a"), t(spark, sf, "part").where("p_size > 40").alias("b")
    return a.join(b, (F.col("a.p_name") == F.col("b.p_name")) & (F.col("a.p_partkey") != F.col("b.p_partkey"))).select(F.col("a.p_partkey").alias("plain"), F.col("b.p_partkey").alias("branded"))


def dq_brand_known(spark, sf):
    """Brands that are neither brand nor alias (two anti joins)."""
    p = t(spark, sf, "part")
    brands = p.where("p_size < 25").select("p_brand").distinct()
    aliases = p.where("p_type = 'PROMO'").select("p_brand").distinct()
    return p.where("p_size = 25").select("p_partkey", "p_brand").join(brands.where("p_brand < 'Brand#2'"), "p_brand", "left_anti").join(aliases.where("p_brand > 'Brand#3'"), "p_brand", "left_anti")


def dq_document_exists(spark, sf):
    """Exactly the parts that sold shall have a document: both kinds of error."""
    sold = t(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("sold", F.lit(True))
    doc = t(spark, sf, "part").where("p_partkey % 2 = 0").select("p_partkey").withColumn("doc", F.lit(True))
    both = t(spark, sf, "part").select("p_partkey").join(sold, "p_partkey", "left").join(doc, "p_partkey", "left")
    return both.select("p_partkey", F.coalesce("sold", F.lit(False)).alias("sold"), F.coalesce("doc", F.lit(False)).alias("doc")).where("sold <> doc")


def dq_merge_depth(spark, sf):
    p = t(spark, sf, "part").where("p_partkey % 3 <> 0").select("p_partkey", F.floor(F.col("p_partkey") / 3).cast("long").alias("into"))
    a, b = p.alias("a"), p.alias("b")
    return a.join(b, F.col("a.into") == F.col("b.p_partkey")).select(F.col("a.p_partkey").alias("line"), F.col("b.into").alias("beyond"))


def dq_profiles(spark, sf):
    """Rows by state, in four profiles, two of which shall have so many groups."""
    lines, orders, parts = (t(spark, sf, name) for name in ("lineitem", "orders", "part"))
    found = [
        checks.profile(lines, "line_state", [F.col("l_returnflag"), F.col("l_linestatus")]), checks.profile(orders, "order_status", [F.col("o_orderstatus")], groups=3),
        checks.profile(parts, "part_type", [F.col("p_type")]), checks.profile(parts, "part_state", [F.col("p_type") == "PROMO", F.col("p_size") > 25, F.col("p_partkey") % 4 == 0], groups=9),
    ]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def dq_ledger(spark, sf):
    c = chained(entries(spark, sf))
    return c.agg(F.count_if(F.col("recorded") != F.col("before") + F.col("change")).alias("broken"), F.count_if(F.col("recorded") < 0).alias("negative"), F.count_distinct("item").alias("items"))


def dq_entry_shape(spark, sf):
    return t(spark, sf, "lineitem").where("l_linestatus = 'O' AND l_returnflag = 'A' AND l_quantity > 49").select("l_orderkey", "l_partkey", "l_quantity")


def dq_repeated_identifier(spark, sf):
    """Every occurrence of a repeated identifier is rejected."""
    w = Window.partitionBy("l_orderkey", "l_linenumber")
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.count("*").over(w).alias("times")).where("times > 1")


def dq_conflicting_scalar(spark, sf):
    return t(spark, sf, "part").groupBy("p_name").agg(F.count_distinct("p_type").alias("types"), F.array_join(F.sort_array(F.collect_set("p_type")), ",").alias("found")).where("types > 1")


def import_validate(spark, sf):
    """Rows of a load with what is wrong in each; unreadable numbers are errors, not nulls."""
    raw = t(spark, sf, "customer").select("c_custkey", F.regexp_replace("c_name", "Customer#0*", "").alias("code"), F.when(F.col("c_acctbal") < 0, F.lit("n/a")).otherwise(F.col("c_acctbal").cast("decimal(12,2)").cast("string")).alias("amount"))
    errors = F.array_compact(F.array(F.when(F.length("code") < 2, "short_code"), F.when(F.expr("try_cast(amount AS decimal(12,2))").isNull(), "amount"), F.when(F.expr("try_cast(amount AS decimal(12,2))") > 9000, "out_of_range")))
    return raw.withColumn("errors", F.array_join(errors, ",")).where("errors <> ''").select("c_custkey", "errors")


def import_conflicts(spark, sf):
    """A catalog load grouped by name: each field that its rows do not agree on, with its values and the first row that differs
    from the group's first, and all codes of the group."""
    rows = t(spark, sf, "part").select("p_name", "p_partkey", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"p_{c}").cast("string").alias("value")) for c in ("type", "brand")])).alias("f")).select("p_name", "p_partkey", "f.*")
    first = rows.groupBy("p_name", "field").agg(F.min_by("value", "p_partkey").alias("first"), F.count_distinct("value").alias("values"), F.count("*").alias("rows"))
    differ = rows.join(first.where("values > 1"), ["p_name", "field"]).where("value <> first").groupBy("p_name", "field").agg(F.first("first").alias("kept"), F.first("values").alias("values"), F.min("p_partkey").alias("row"))
    return differ.select("p_name", "field", "kept", "values", "row")


def _mains(spark, sf):
    """The main part of each name (the largest, then the first) and the line's own code (that of its first part)."""
    p = t(spark, sf, "part")
    main = p.groupBy("p_name").agg(F.max_by("p_brand", F.struct("p_size", -F.col("p_partkey"))).alias("main_code"))
    return main, p.groupBy("p_name").agg(F.min_by("p_brand", "p_partkey").alias("line_code"))


def dq_code_of_main(spark, sf):
    main, lines = _mains(spark, sf)
    return checks.differing(lines, main, "p_name", F.col("line_code"), F.col("main_code"))


def dq_merged_hold_live(spark, sf):
    """Orders that are done (status P stands for merged) and still hold open lines."""
    live = t(spark, sf, "lineitem").where("l_linestatus = 'O'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("live"))
    return t(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_orderkey").join(live, "o_orderkey")


def dq_type_mirrors(spark, sf):
    """Orders whose status does not mirror their lines': F where all are, O where none is, else P."""
    done = F.bool_and(F.col("l_linestatus") == "F"), F.bool_or(F.col("l_linestatus") == "F")
    lines = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.when(done[0], "F").when(done[1], "P").otherwise("O").alias("mirror"))
    return checks.differing(t(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), lines, "o_orderkey", F.col("o_orderstatus"), F.col("mirror"))


def dq_item_on_line(spark, sf):
    """Lines whose supplier sits in another nation than the customer, counted by the customer's."""
    bought = t(spark, sf, "orders").join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), "c_nationkey")
    sold = t(spark, sf, "lineitem").join(t(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_nationkey")
    return checks.differing(sold, bought, "l_orderkey", F.col("s_nationkey"), F.col("c_nationkey")).groupBy("c_nationkey").agg(F.count("*").alias("n"))


def dq_matched_lines(spark, sf):
    """Parts that sold in bulk but are of no type that the catalog keeps."""
    bulk = t(spark, sf, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return t(spark, sf, "part").where(~F.col("p_type").isin("ECONOMY", "STANDARD", "PROMO")).join(bulk, "p_partkey", "left_semi").select("p_partkey", "p_type")


def dq_unattended(spark, sf):
    """Errors older than 15 minutes of users who have no large purchase."""
    e = t(spark, sf, "events")
    cases = e.groupBy("user_id").agg(F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 150)).alias("open"))
    return checks.unattended(e.where("event_type = 'error'").select("event_id", "user_id", "ts"), cases, "user_id", "ts", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).select("event_id", "user_id")


def dq_reserved_units(spark, sf):
    """Parts whose size is not the number of their open lines of one unit to three (reservations)."""
    holds = t(spark, sf, "lineitem").where("l_linestatus = 'O' AND l_quantity <= 3").select(F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").cast("long").alias("units"))
    return checks.differing_sums(t(spark, sf, "part").select("p_partkey", F.col("p_size").cast("long").alias("p_size")), holds, "p_partkey", "p_size", "units")


def dq_reservations(spark, sf):
    """Orders as holds of ten units, their lines as ledger entries: A reserves, R releases, N uses."""
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "released").otherwise("used")
    holds = t(spark, sf, "orders").select(F.col("o_orderkey").alias("hold_id"), F.lit(10).cast("long").alias("units"), status.alias("status"))
    kind = F.when(F.col("l_returnflag") == "A", "reserve").when(F.col("l_returnflag") == "R", "release").otherwise("use")
    return checks.reservation_faults(holds, t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("hold_id"), kind.alias("kind"), F.col("l_quantity").cast("long").alias("units")))


def dq_branch_units(spark, sf):
    """Suppliers whose own count of lines is not the sum over their branches (line statuses)."""
    lines = t(spark, sf, "lineitem")
    counted = lines.groupBy("l_suppkey").agg(F.count_distinct("l_orderkey").alias("n"))
    branches = lines.groupBy("l_suppkey", "l_linestatus").agg(F.count_distinct("l_orderkey").alias("n"))
    return checks.differing_sums(counted, branches, "l_suppkey", "n", "n")


def dq_foreign_codes(spark, sf):
    """Codes (names) that a load of odd parts gives to a brand while another brand has them, in it or in the catalog."""
    rows = t(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("owner"), F.concat_ws("-", "p_name", "p_size").alias("code"))
    return checks.foreign_codes(rows.where("p_partkey % 2 = 1"), rows.where("p_partkey % 2 = 0"))


def stock_load(spark, sf):
    """A stock load with its own titles, row by row with what is wrong."""
    raw = t(spark, sf, "part").select(
        F.col("p_partkey").alias("row"), F.when(F.col("p_partkey") % 10 != 3, F.concat(F.lit("51"), F.col("p_partkey") % 1000 + 100000, F.lit("-x"))).alias("Código"), F.col("p_brand").alias("Fabricante"),
        F.when(F.col("p_size") % 9 == 0, "n/a").otherwise(F.col("p_size").cast("string")).alias("existencia"), F.when(F.col("p_size") % 7 == 0, "12,500").otherwise(F.col("p_retailprice").cast("decimal(12,2)").cast("string")).alias("PRECIO"),
    )
    return loads.read_stock(raw).select("row", "clave", "brand", "quantity", "price", F.array_join("errors", ",").alias("errors"))


def price_load(spark, sf):
    """A price load with two lists, one cell in five taking its price away."""
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    raw = t(spark, sf, "part").select(F.col("p_partkey").alias("row"), F.col("p_name").alias("sku"), F.when(F.col("p_partkey") % 5 == 0, "Borrar").otherwise(price).alias("Precio A"), F.when(F.col("p_partkey") % 3 == 0, F.replace(price, F.lit("."), F.lit(","))).alias("PRECIO_B"))
    return loads.read_prices(raw)


def feed_latest_state(spark, sf):
    """The last absolute value of every item of a feed wins, whatever overlaps."""
    e = t(spark, sf, "events")
    return e.groupBy("user_id").agg(F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("last")).select("user_id", "last.event_type", "last.value")


def dup_keeper(spark, sf):
    found = t(spark, sf, "documents").where("text IS NOT NULL").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("keeper"), F.count("*").alias("copies"))
    return found.where("copies > 1").select("keeper", "copies")


def change_collapse(spark, sf):
    """Several changes of a user on a day are one: first value before, last value after, highest kind."""
    e = t(spark, sf, "events").withColumn("day", F.col("ts").cast("date"))
    order = F.struct("ts", "event_id")
    return e.groupBy("user_id", "day").agg(F.min_by("value", order).alias("before"), F.max_by("value", order).alias("after"), F.max("event_type").alias("kind"))


QUERIES = {
    "dq_one_main": (dq_one_main, "SELECT p_name, COUNT(*) FILTER (p_partkey % 5 = 0) AS mains FROM part GROUP BY 1 HAVING COUNT(*) FILTER (p_partkey % 5 = 0) <> 1"),
    "dq_orphans": (dq_orphans, """SELECT DISTINCT l_orderkey AS key, 'no_order' AS kind FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
        UNION ALL SELECT o_orderkey, 'no_line' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"""),
    "dq_key_on_two_lines": (dq_key_on_two_lines, "SELECT a.p_partkey AS plain, b.p_partkey AS branded FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_partkey <> b.p_partkey WHERE a.p_size < 10 AND b.p_size > 40"),
    "dq_brand_known": (dq_brand_known, """SELECT p_partkey, p_brand FROM part WHERE p_size = 25 AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_size < 25 AND p_brand < 'Brand#2')
        AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_type = 'PROMO' AND p_brand > 'Brand#3')"""),
    "dq_document_exists": (dq_document_exists, "WITH b AS (SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AS sold, p_partkey % 2 = 0 AS doc FROM part) SELECT * FROM b WHERE sold <> doc"),
    "dq_merge_depth": (dq_merge_depth, "WITH p AS (SELECT p_partkey, p_partkey // 3 AS into_ FROM part WHERE p_partkey % 3 <> 0) SELECT a.p_partkey AS line, b.into_ AS beyond FROM p a JOIN p b ON a.into_ = b.p_partkey"),
    "dq_profiles": (dq_profiles, """WITH s AS (SELECT concat(p_type = 'PROMO', '|', p_size > 25, '|', p_partkey % 4 = 0) AS g, COUNT(*) AS n FROM part GROUP BY 1), o AS (SELECT o_orderstatus AS g, COUNT(*) AS n FROM orders GROUP BY 1)
        SELECT 'line_state' AS profile, concat(l_returnflag, '|', l_linestatus) AS groups_of, COUNT(*) AS n, CAST(NULL AS BOOLEAN) AS as_expected FROM lineitem GROUP BY 2 UNION ALL SELECT 'order_status', g, n, (SELECT COUNT(*) FROM o) = 3 FROM o
        UNION ALL SELECT 'part_type', p_type, COUNT(*), NULL FROM part GROUP BY 2 UNION ALL SELECT 'part_state', g, n, (SELECT COUNT(*) FROM s) = 9 FROM s"""),
    "dq_ledger": (dq_ledger, _ENTRIES_SQL + " SELECT COUNT(*) FILTER (recorded <> before + change) AS broken, COUNT(*) FILTER (recorded < 0) AS negative, COUNT(DISTINCT item) AS items FROM c"),
    "dq_entry_shape": (dq_entry_shape, "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'A' AND l_quantity > 49"),
    "dq_repeated_identifier": (dq_repeated_identifier, "SELECT l_orderkey, l_linenumber, l_partkey, COUNT(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS times FROM lineitem QUALIFY times > 1"),
    "dq_conflicting_scalar": (dq_conflicting_scalar, "SELECT p_name, COUNT(DISTINCT p_type) AS types, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS found FROM part GROUP BY 1 HAVING COUNT(DISTINCT p_type) > 1"),
    "import_conflicts": (import_conflicts, """WITH r AS (SELECT p_name, p_partkey, 'type' AS field, p_type AS value FROM part UNION ALL SELECT p_name, p_partkey, 'brand', p_brand FROM part),
        f AS (SELECT *, first_value(value) OVER (PARTITION BY p_name, field ORDER BY p_partkey) AS kept FROM r), n AS (SELECT p_name, field, COUNT(DISTINCT value) AS values FROM r GROUP BY 1, 2)
        SELECT p_name, field, kept, n.values, MIN(p_partkey) AS row FROM f JOIN n USING (p_name, field) WHERE value <> kept GROUP BY 1, 2, 3, 4"""),
    "dq_code_of_main": (dq_code_of_main, "WITH m AS (SELECT p_name, arg_min(p_brand, p_partkey) AS line_code, arg_max(p_brand, (p_size, -p_partkey)) AS main_code FROM part GROUP BY 1) SELECT * FROM m WHERE line_code <> main_code"),
    "dq_merged_hold_live": (dq_merged_hold_live, "SELECT o_orderkey, COUNT(*) AS live FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' AND l_linestatus = 'O' GROUP BY 1"),
    "dq_type_mirrors": (dq_type_mirrors, """WITH m AS (SELECT l_orderkey AS o_orderkey, CASE WHEN MIN(l_linestatus) = 'F' AND MAX(l_linestatus) = 'F' THEN 'F' WHEN MIN(l_linestatus) = 'F' THEN 'P' ELSE 'O' END AS mirror FROM lineitem GROUP BY 1)
        SELECT o_orderkey, o_orderstatus, mirror FROM orders JOIN m USING (o_orderkey) WHERE o_orderstatus <> mirror"""),
    "dq_item_on_line": (dq_item_on_line, "SELECT c_nationkey, COUNT(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey IS DISTINCT FROM c_nationkey GROUP BY 1"),
    "dq_matched_lines": (dq_matched_lines, "SELECT p_partkey, p_type FROM part WHERE p_type NOT IN ('ECONOMY', 'STANDARD', 'PROMO') AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)"),
    "dq_unattended": (dq_unattended, "SELECT event_id, user_id FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-31 23:45:00' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 150)"),
    "dq_reserved_units": (dq_reserved_units, """WITH h AS (SELECT l_partkey, CAST(SUM(l_quantity) AS BIGINT) AS found FROM lineitem WHERE l_linestatus = 'O' AND l_quantity <= 3 GROUP BY 1)
        SELECT COALESCE(p_partkey, l_partkey) AS p_partkey, CAST(COALESCE(p_size, 0) AS BIGINT) AS counted, COALESCE(found, 0) AS found FROM part FULL JOIN h ON l_partkey = p_partkey WHERE COALESCE(p_size, 0) <> COALESCE(found, 0)"""),
    "dq_reservations": (dq_reservations, """WITH e AS (SELECT o_orderkey AS hold_id, o_orderstatus AS s, COUNT(*) FILTER (l_returnflag = 'A') AS a, COUNT(*) FILTER (l_returnflag = 'R') AS r, COUNT(*) FILTER (l_returnflag NOT IN ('A', 'R')) AS n,
          COALESCE(SUM(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE -l_quantity END), 0) AS held FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
        f AS (SELECT hold_id, unnest([CASE WHEN a = 0 THEN 'no_reserve' WHEN a > 1 THEN 'many_reserves' END, CASE WHEN (s = 'O' AND r + n > 0) OR (s = 'P' AND NOT (r = 1 AND n = 0)) OR (s NOT IN ('O', 'P') AND NOT (n = 1 AND r = 0)) THEN 'closing' END,
          CASE WHEN held <> CASE WHEN s = 'O' THEN 10 ELSE 0 END THEN 'left' END]) AS fault FROM e) SELECT * FROM f WHERE fault IS NOT NULL"""),
    "dq_branch_units": (dq_branch_units, """WITH c AS (SELECT l_suppkey, COUNT(DISTINCT l_orderkey) AS counted, COUNT(DISTINCT CASE WHEN l_linestatus = 'F' THEN l_orderkey END) + COUNT(DISTINCT CASE WHEN l_linestatus = 'O' THEN l_orderkey END) AS found FROM lineitem GROUP BY 1)
        SELECT * FROM c WHERE counted <> found"""),
    "dq_foreign_codes": (dq_foreign_codes, """WITH o AS (SELECT DISTINCT p_brand AS owner, concat(p_name, '-', p_size) AS code FROM part), n AS (SELECT code, COUNT(*) - 1 AS others FROM o GROUP BY 1)
        SELECT DISTINCT code, p_brand AS owner, others FROM part JOIN n ON code = concat(p_name, '-', p_size) WHERE p_partkey % 2 = 1 AND others > 0"""),
    "import_validate": (import_validate, """WITH r AS (SELECT c_custkey, regexp_replace(c_name, 'Customer#0*', '') AS code, CASE WHEN c_acctbal >= 0 THEN CAST(c_acctbal AS DECIMAL(12,2)) END AS amount FROM customer),
        e AS (SELECT c_custkey, concat_ws(',', CASE WHEN length(code) < 2 THEN 'short_code' END, CASE WHEN amount IS NULL THEN 'amount' END, CASE WHEN amount > 9000 THEN 'out_of_range' END) AS errors FROM r)
        SELECT * FROM e WHERE errors <> ''"""),
    "stock_load": (stock_load, """WITH r AS (SELECT p_partkey AS row, CASE WHEN p_partkey % 10 <> 3 THEN concat('51', p_partkey % 1000 + 100000, 'X') END AS clave, upper(p_brand) AS brand, CASE WHEN p_size % 9 <> 0 THEN CAST(p_size AS BIGINT) END AS quantity,
          CASE WHEN p_size % 7 <> 0 THEN CAST(p_retailprice AS DECIMAL(12,2)) END AS price, p_size FROM part), n AS (SELECT *, COUNT(*) OVER (PARTITION BY clave, brand) AS n FROM r)
        SELECT row, clave, brand, quantity, price, concat_ws(',', CASE WHEN clave IS NULL THEN 'code' END, CASE WHEN quantity IS NULL THEN 'quantity' END, CASE WHEN p_size % 7 = 0 THEN 'price:ambiguous' END, CASE WHEN clave IS NOT NULL AND n > 1 THEN 'repeated' END) AS errors FROM n"""),
    "price_load": (price_load, """SELECT p_partkey AS row, p_name AS code, 'A' AS list, CASE WHEN p_partkey % 5 = 0 THEN 'delete' ELSE 'set' END AS action, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_retailprice AS DECIMAL(12,2)) END AS price, CAST(NULL AS VARCHAR) AS error FROM part
        UNION ALL SELECT p_partkey, p_name, 'B', 'set', CAST(p_retailprice AS DECIMAL(12,2)), NULL FROM part WHERE p_partkey % 3 = 0"""),
    "feed_latest_state": (feed_latest_state, "SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "dup_keeper": (dup_keeper, "SELECT MIN(doc_id) AS keeper, COUNT(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY md5(text) HAVING COUNT(*) > 1"),
    "change_collapse": (change_collapse, """SELECT user_id, CAST(ts AS DATE) AS day, arg_min(value, (ts, event_id)) AS before, arg_max(value, (ts, event_id)) AS after, MAX(event_type) AS kind FROM events GROUP BY 1, 2"""),
}
