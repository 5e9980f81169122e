"""Deterministic pricing: list prices, most specific rule, volume breaks, changes between price lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partmill.operators.pricing import price_lines
from partmill.operators.pricing import volume_breaks as engine_breaks
from partmill.operators.relational import top_row
from partmill.sources.storage import read_table as t
from partmill.sources.storage import spread

#: Rules: id, target (all, brand, item), value, discount in percent or net price, least quantity, first and last day.
RULES = (
    (1, "all", None, "discount", "2.00", 1, None, None), (2, "brand", "Brand#1", "discount", "10.00", 1, None, None), (3, "brand", "Brand#1", "discount", "12.00", 20, None, None),
    (4, "brand", "Brand#2", "net_price", "800.00", 5, "1998-01-01", "1999-12-31"), (5, "item", "12", "net_price", "700.05", 1, None, None), (6, "all", None, "discount", "5.00", 40, None, None),
    (7, "item", "24", "discount", "33.33", 10, "2000-01-01", None), (8, "brand", "Brand#3", "discount", "7.50", 1, None, "1997-06-30"), (9, "all", None, "discount", "3.00", 10, None, None),
)
TODAY = "1998-06-15"
_CENTS = "decimal(12,2)"


def rules(spark) -> DataFrame:
    """The rule table; it is short and joined by key, never row by row."""
    schema = "rule_id long, target string, value string, kind string, amount string, min_quantity long, valid_from string, valid_until string"
    df = spark.createDataFrame(list(RULES), schema)
    return df.select("rule_id", "target", "value", "kind", F.col("amount").cast(_CENTS).alias("amount"), "min_quantity", F.col("valid_from").cast("date").alias("valid_from"), F.col("valid_until").cast("date").alias("valid_until"))


def _rules_sql() -> str:
    quote = lambda v: "NULL" if v is None else f"'{v}'"
    rows = ", ".join(f"({i}, {quote(target)}, {quote(v)}, {quote(k)}, CAST({quote(a)} AS DECIMAL(12,2)), {q}, CAST({quote(f)} AS DATE), CAST({quote(u)} AS DATE))" for i, target, v, k, a, q, f, u in RULES)
    return f"rule AS (SELECT * FROM (VALUES {rows}) AS r(rule_id, target, value, kind, amount, min_quantity, valid_from, valid_until))"


def valid_on(day: Column) -> Column:
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= day)) & (F.col("valid_until").isNull() | (F.col("valid_until") >= day))


def ruled_price(price: Column) -> Column:
    """A rule's price in cents, half up."""
    off = F.round(price * (F.lit(100).cast("decimal(5,0)") - F.col("amount")) / 100, 2)
    return F.when(F.col("kind") == "net_price", F.col("amount")).otherwise(off).cast(_CENTS)


def matching_rules(items: DataFrame, table: DataFrame) -> DataFrame:
    """Every (item, rule) that fits: one equi join, on the keys that an item can be targeted by."""
    keys = F.array(*[F.struct(F.lit(target).alias("target"), key.alias("key")) for target, key in (("all", F.lit("*")), ("brand", F.col("p_brand")), ("item", F.col("p_partkey").cast("string")))])
    keyed = table.withColumn("key", F.coalesce("value", F.lit("*")))
    return items.withColumn("_k", F.explode(keys)).withColumns({"target": F.col("_k.target"), "key": F.col("_k.key")}).drop("_k").join(keyed, ["target", "key"])


def _items(spark, sf):
    return t(spark, sf, "part").select("p_partkey", "p_brand", F.col("p_retailprice").cast(_CENTS).alias("list_price"))


def _specific(name="target"):
    return F.when(F.col(name) == "item", 3).when(F.col(name) == "brand", 2).otherwise(1)


def _chosen(df: DataFrame, keys: list[str]) -> DataFrame:
    return top_row(df, keys, [F.desc("specific"), F.desc("min_quantity"), F.desc("price"), "rule_id"])


def pricing_rules(spark, sf):
    """The price of every part at 12 units: the most specific fitting rule."""
    fits = matching_rules(_items(spark, sf), rules(spark)).where(valid_on(F.lit(TODAY).cast("date")) & (F.col("min_quantity") <= 12))
    return _chosen(fits.withColumns({"specific": _specific(), "price": ruled_price(F.col("list_price"))}), ["p_partkey"]).select("p_partkey", "rule_id", "list_price", "price")


def price_breaks(spark, sf):
    """The next two quantities at which a part's price differs from the one before."""
    fits = matching_rules(_items(spark, sf), rules(spark)).where(valid_on(F.lit(TODAY).cast("date"))).withColumns({"specific": _specific(), "price": ruled_price(F.col("list_price"))})
    at = F.explode(F.array(*[F.lit(q).cast("long") for q in sorted({r[5] for r in RULES})])).alias("quantity")
    chosen = _chosen(fits.select("*", at).where("min_quantity <= quantity"), ["p_partkey", "quantity"]).select("p_partkey", "quantity", "price")
    w = Window.partitionBy("p_partkey").orderBy("quantity")
    moved = chosen.withColumn("before", F.lag("price").over(w)).where("before IS NOT NULL AND price <> before")
    return moved.withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("p_partkey", "quantity", "price")


def rule_validity(spark, sf):
    day = F.lit(TODAY).cast("date")
    label = F.when(F.col("valid_from") > day, "scheduled").when(F.col("valid_until") < day, "expired").otherwise("active")
    return rules(spark).select("rule_id", label.alias("validity"))


def price_fallback(spark, sf):
    """The assigned list's price, else that of the default list (here every part has one)."""
    assigned = t(spark, sf, "lineitem").where("l_suppkey = 1").groupBy("l_partkey").agg(F.max(F.col("l_extendedprice").cast(_CENTS)).alias("own"))
    both = _items(spark, sf).join(assigned, F.col("p_partkey") == F.col("l_partkey"), "left")
    return both.select("p_partkey", F.coalesce("own", "list_price").alias("price"), F.when(F.col("own").isNull(), "default").otherwise("assigned").alias("origin"))


def price_change_kind(spark, sf):
    """Old and new prices of parts: creations, deletions, increases, decreases, with changes above half marked."""
    price = F.col("l_extendedprice").cast(_CENTS)
    lines = t(spark, sf, "lineitem")
    old = lines.where("l_linestatus = 'F' AND l_quantity < 5").groupBy("l_partkey").agg(F.max(price).alias("old"))
    new = lines.where("l_linestatus = 'O' AND l_quantity < 5").groupBy("l_partkey").agg(F.max(price).alias("new"))
    both = old.join(new, "l_partkey", "full_outer")
    kind = F.when(F.col("old").isNull(), "create").when(F.col("new").isNull(), "delete").when(F.col("new") > F.col("old"), "increase").when(F.col("new") < F.col("old"), "decrease").otherwise("same")
    big = F.abs(F.col("new") - F.col("old")) * 2 > F.col("old")
    return both.groupBy(kind.alias("kind"), F.coalesce(big, F.lit(False)).alias("big")).agg(F.count("*").alias("n"))


def price_pivot(spark, sf):
    lists = t(spark, sf, "lineitem").withColumn("list", F.concat(F.lit("LIST_"), F.col("l_suppkey") % 3))
    return lists.groupBy("l_partkey").pivot("list", ["LIST_0", "LIST_1", "LIST_2"]).agg(F.max(F.col("l_extendedprice").cast(_CENTS)))


def price_unpivot(spark, sf):
    return price_pivot(spark, sf).unpivot("l_partkey", ["LIST_0", "LIST_1", "LIST_2"], "list", "price").where("price IS NOT NULL")


def priced_missing(spark, sf):
    parts = t(spark, sf, "part").agg(F.count("*")).scalar()
    per = price_unpivot(spark, sf).groupBy("list").agg(F.count_distinct("l_partkey").alias("priced"))
    return per.select("list", "priced", F.greatest(parts - F.col("priced"), F.lit(0)).cast("long").alias("missing"))


#: Rules of the engine: id, scope, client, target, aimed at, kind, value, currency, least quantity, first and last day, active, made.
ENGINE_RULES = (
    ("r01", "all", None, "all", "", "discount", "2.00", "", 1, None, None, True, "2024-01-01"), ("r02", "all", None, "brand", "Brand#1", "discount", "10.00", "", 1, None, None, True, "2024-01-02"),
    ("r03", "all", None, "brand", "Brand#1", "discount", "12.00", "", 20, None, None, True, "2024-01-03"), ("r04", "all", None, "line", "PROMO", "discount", "15.00", "", 5, None, None, True, "2024-01-03"),
    ("r05", "all", None, "line", "PROMO", "discount", "14.00", "", 5, None, None, True, "2024-01-05"), ("r06", "all", None, "item", "12", "net_price", "700.05", "EUR", 1, None, None, True, "2024-01-01"),
    ("r07", "client", "7", "all", "", "discount", "4.00", "", 1, None, None, True, "2024-01-01"), ("r08", "client", "7", "brand", "Brand#2", "net_price", "800.00", "USD", 10, None, None, True, "2024-01-01"),
    ("r09", "all", None, "all", "", "discount", "50.00", "", 1, None, "1996-01-01", True, "2024-01-01"), ("r10", "all", None, "all", "", "discount", "60.00", "", 1, None, None, False, "2024-01-01"),
    ("r11", "all", None, "brand", "Brand#4", "discount", "5.00", "", 1, None, None, True, "2024-01-09"), ("r12", "all", None, "brand", "Brand#4", "discount", "5.00", "", 1, None, None, True, "2024-01-08"),
)
_ENGINE = "rule_id, scope, profile_id, target, target_value, kind, value, currency, min_quantity, valid_from, valid_until, active, created_at"


def pricing_engine(spark, sf):
    """Every order line priced: clients are customers modulo 20, each eleventh line asks in euros, prices are in dollars."""
    schema = "rule_id string, scope string, profile_id string, target string, target_value string, kind string, value string, currency string, min_quantity long, valid_from string, valid_until string, active boolean, created_at string"
    rules = spark.createDataFrame(list(ENGINE_RULES), schema).withColumns({"value": F.col("value").cast(_CENTS), "valid_from": F.col("valid_from").cast("date"), "valid_until": F.col("valid_until").cast("date"), "created_at": F.col("created_at").cast("timestamp_ntz")})
    lines = t(spark, sf, "lineitem").join(t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    asked = lines.select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("line_id"), (F.col("o_custkey") % 20).cast("string").alias("profile_id"), F.col("p_partkey").cast("string").alias("item_id"),
        F.col("p_brand").alias("brand"), F.col("p_type").alias("discount_group"), F.lit(TODAY).cast("date").alias("day"), F.col("l_quantity").cast("long").alias("quantity"),
        F.when(F.col("l_linenumber") * 7 % 11 == 0, "EUR").otherwise("USD").alias("currency"), F.when(F.col("p_partkey") % 13 != 0, F.col("p_retailprice").cast(_CENTS)).alias("base_price"), F.lit("USD").alias("base_currency"),
        F.lit(850).cast(_CENTS).alias("floor_price"),
    )
    found = price_lines(asked, rules)
    return found.groupBy("rule_id", "status", F.array_join("codes", ",").alias("codes"), "brand").agg(F.count("*").alias("n"), F.sum("unit_price").cast("decimal(20,2)").alias("total"))


def volume_breaks(spark, sf):
    """The next quantities at which the engine's price of a part changes, for client 7, from 2 units on."""
    schema = "rule_id string, scope string, profile_id string, target string, target_value string, kind string, value string, currency string, min_quantity long, valid_from string, valid_until string, active boolean, created_at string"
    rules = spark.createDataFrame(list(ENGINE_RULES), schema).withColumns({"value": F.col("value").cast(_CENTS), "valid_from": F.col("valid_from").cast("date"), "valid_until": F.col("valid_until").cast("date"), "created_at": F.col("created_at").cast("timestamp_ntz")})
    lines = spread(t(spark, sf, "part"), "p_partkey").select(
        F.col("p_partkey").alias("line_id"), F.when(F.col("p_partkey") % 2 == 0, "7").otherwise("8").alias("profile_id"), F.col("p_partkey").cast("string").alias("item_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("discount_group"),
        F.lit(TODAY).cast("date").alias("day"), F.lit(2).cast("long").alias("quantity"), F.lit("USD").alias("currency"), F.when(F.col("p_partkey") % 13 != 0, F.col("p_retailprice").cast(_CENTS)).alias("base_price"), F.lit("USD").alias("base_currency"),
    )
    return engine_breaks(lines, rules)


_FITS = f"""WITH {_rules_sql()}, i AS (SELECT p_partkey, p_brand, CAST(p_retailprice AS DECIMAL(12,2)) AS list_price FROM part),
fit AS (SELECT i.*, rule.*, CASE target WHEN 'item' THEN 3 WHEN 'brand' THEN 2 ELSE 1 END AS specific,
  CAST(CASE WHEN kind = 'net_price' THEN amount * 100 ELSE floor((CAST(list_price * 100 AS BIGINT) * CAST((100 - amount) * 100 AS BIGINT) + 5000) // 10000) END AS BIGINT) AS cents
  FROM i JOIN rule ON (target = 'all' OR target = 'brand' AND value = p_brand OR target = 'item' AND value = CAST(p_partkey AS VARCHAR))
  WHERE (valid_from IS NULL OR valid_from <= DATE '{TODAY}') AND (valid_until IS NULL OR valid_until >= DATE '{TODAY}'))"""
_LISTS = "WITH x AS (SELECT l_partkey, concat('LIST_', l_suppkey % 3) AS list, MAX(CAST(l_extendedprice AS DECIMAL(12,2))) AS price FROM lineitem GROUP BY 1, 2)"

def _engine_sql() -> str:
    quote = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'"
    rows = ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in ENGINE_RULES)
    return f"""WITH rule AS (SELECT * FROM (VALUES {rows}) AS r({_ENGINE}) WHERE active AND (valid_until IS NULL OR CAST(valid_until AS DATE) >= DATE '{TODAY}')),
    line AS (SELECT row_number() OVER () AS id, o_custkey % 20 AS client, p_partkey, p_brand, p_type, CAST(l_quantity AS BIGINT) AS quantity, CASE WHEN l_linenumber * 7 % 11 = 0 THEN 'EUR' ELSE 'USD' END AS asked, CASE WHEN p_partkey % 13 <> 0 THEN CAST(CAST(p_retailprice AS DECIMAL(12,2)) * 100 AS BIGINT) END AS base
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
    fit AS (SELECT line.*, rule.rule_id, rule.created_at, CASE scope WHEN 'client' THEN 2 ELSE 1 END AS s, CASE target WHEN 'item' THEN 4 WHEN 'line' THEN 3 WHEN 'brand' THEN 2 ELSE 1 END AS g, min_quantity AS q,
      CASE WHEN kind = 'net_price' THEN CASE WHEN rule.currency = asked THEN CAST(CAST(value AS DECIMAL(12,2)) * 100 AS BIGINT) END WHEN asked = 'USD' THEN (base * (10000 - CAST(CAST(value AS DECIMAL(12,2)) * 100 AS BIGINT)) + 5000) // 10000 END AS cents
      FROM line JOIN rule ON (scope = 'all' OR CAST(client AS VARCHAR) = profile_id) AND min_quantity <= quantity AND (target = 'all' OR target = 'item' AND target_value = CAST(p_partkey AS VARCHAR) OR target = 'brand' AND target_value = p_brand OR target = 'line' AND target_value = p_type)),
    ok AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, g DESC, q DESC, cents DESC, created_at, rule_id) AS rn FROM fit WHERE cents IS NOT NULL),
    won AS (SELECT a.id, a.rule_id, a.cents, EXISTS (SELECT 1 FROM ok b WHERE b.id = a.id AND (b.s, b.g, b.q) = (a.s, a.g, a.q) AND b.cents < a.cents) AS conflict FROM ok a WHERE rn = 1),
    f AS (SELECT line.*, won.rule_id, conflict, COALESCE(won.cents, CASE WHEN asked = 'USD' THEN base END) AS cents FROM line LEFT JOIN won USING (id)),
    g AS (SELECT *, CASE WHEN cents IS NOT NULL THEN 'priced' WHEN base IS NOT NULL THEN 'currency_mismatch' ELSE 'missing' END AS status FROM f)
    SELECT rule_id, status, concat_ws(',', CASE WHEN cents < 85000 THEN 'below_floor' END, CASE WHEN status = 'currency_mismatch' THEN 'currency_mismatch' END, CASE WHEN status = 'missing' THEN 'no_list_price' END, CASE WHEN conflict THEN 'rule_conflict' END) AS codes,
      p_brand AS brand, COUNT(*) AS n, CAST(CAST(SUM(cents) AS DECIMAL(20,2)) / 100 AS DECIMAL(20,2)) AS total FROM g GROUP BY 1, 2, 3, 4"""


def _breaks_sql() -> str:
    quote = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'"
    rows = ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in ENGINE_RULES)
    return f"""WITH rule AS (SELECT * FROM (VALUES {rows}) AS r({_ENGINE}) WHERE active AND (valid_until IS NULL OR CAST(valid_until AS DATE) >= DATE '{TODAY}')),
    line AS (SELECT p_partkey AS line_id, CASE WHEN p_partkey % 2 = 0 THEN '7' ELSE '8' END AS client, p_brand, p_type, CASE WHEN p_partkey % 13 <> 0 THEN CAST(CAST(p_retailprice AS DECIMAL(12,2)) * 100 AS BIGINT) END AS base FROM part),
    fit AS (SELECT line.*, rule.rule_id, rule.created_at, CASE scope WHEN 'client' THEN 2 ELSE 1 END AS s, CASE target WHEN 'item' THEN 4 WHEN 'line' THEN 3 WHEN 'brand' THEN 2 ELSE 1 END AS g, min_quantity AS q,
      CASE WHEN kind = 'net_price' THEN CASE WHEN rule.currency = 'USD' THEN CAST(CAST(value AS DECIMAL(12,2)) * 100 AS BIGINT) END ELSE (base * (10000 - CAST(CAST(value AS DECIMAL(12,2)) * 100 AS BIGINT)) + 5000) // 10000 END AS cents
      FROM line JOIN rule ON (scope = 'all' OR client = profile_id) AND (target = 'all' OR target = 'item' AND target_value = CAST(line_id AS VARCHAR) OR target = 'brand' AND target_value = p_brand OR target = 'line' AND target_value = p_type)),
    qs AS (SELECT DISTINCT line_id, q AS t FROM fit WHERE q > 2 UNION SELECT line_id, 2 FROM line),
    c AS (SELECT qs.line_id, t, arg_min(cents, (-s, -g, -q, -cents, created_at, rule_id)) AS cents, arg_min(rule_id, (-s, -g, -q, -cents, created_at, rule_id)) AS rule_id FROM qs JOIN fit ON fit.line_id = qs.line_id AND q <= t AND cents IS NOT NULL GROUP BY 1, 2),
    p AS (SELECT qs.line_id, qs.t, COALESCE(c.cents, CASE WHEN qs.t = 2 THEN base END) AS cents, c.rule_id FROM qs JOIN line USING (line_id) LEFT JOIN c ON c.line_id = qs.line_id AND c.t = qs.t),
    b AS (SELECT *, lag(cents) OVER (PARTITION BY line_id ORDER BY t) AS before FROM p WHERE cents IS NOT NULL OR t = 2)
    SELECT line_id, CAST(row_number() OVER (PARTITION BY line_id ORDER BY t) AS INTEGER) AS step, CAST(t AS BIGINT) AS min_quantity, CAST(cents / 100 AS DECIMAL(12,2)) AS unit_price, rule_id FROM b WHERE t > 2 AND cents IS DISTINCT FROM before QUALIFY step <= 2"""


QUERIES = {
    "pricing_engine": (pricing_engine, _engine_sql()),
    "volume_breaks": (volume_breaks, _breaks_sql()),
    "pricing_rules": (pricing_rules, _FITS + """ SELECT p_partkey, CAST(rule_id AS BIGINT) AS rule_id, list_price, CAST(cents / 100 AS DECIMAL(12,2)) AS price FROM fit WHERE min_quantity <= 12
        QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY specific DESC, min_quantity DESC, cents DESC, rule_id) = 1"""),
    "price_breaks": (price_breaks, _FITS + """, q AS (SELECT DISTINCT min_quantity AS quantity FROM rule),
        c AS (SELECT p_partkey, quantity, cents FROM fit JOIN q ON min_quantity <= quantity QUALIFY row_number() OVER (PARTITION BY p_partkey, quantity ORDER BY specific DESC, min_quantity DESC, cents DESC, rule_id) = 1),
        b AS (SELECT *, lag(cents) OVER (PARTITION BY p_partkey ORDER BY quantity) AS before FROM c)
        SELECT p_partkey, CAST(quantity AS BIGINT) AS quantity, CAST(cents / 100 AS DECIMAL(12,2)) AS price FROM b WHERE cents <> before QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY quantity) <= 2"""),
    "rule_validity": (rule_validity, f"WITH {_rules_sql()} SELECT CAST(rule_id AS BIGINT) AS rule_id, CASE WHEN valid_from > DATE '{TODAY}' THEN 'scheduled' WHEN valid_until < DATE '{TODAY}' THEN 'expired' ELSE 'active' END AS validity FROM rule"),
    "price_fallback": (price_fallback, """SELECT p_partkey, COALESCE(own, CAST(p_retailprice AS DECIMAL(12,2))) AS price, CASE WHEN own IS NULL THEN 'default' ELSE 'assigned' END AS origin
        FROM part LEFT JOIN (SELECT l_partkey, MAX(CAST(l_extendedprice AS DECIMAL(12,2))) AS own FROM lineitem WHERE l_suppkey = 1 GROUP BY 1) ON l_partkey = p_partkey"""),
    "price_change_kind": (price_change_kind, """WITH o AS (SELECT l_partkey, MAX(CAST(l_extendedprice AS DECIMAL(12,2))) AS old FROM lineitem WHERE l_linestatus = 'F' AND l_quantity < 5 GROUP BY 1),
        n AS (SELECT l_partkey, MAX(CAST(l_extendedprice AS DECIMAL(12,2))) AS new FROM lineitem WHERE l_linestatus = 'O' AND l_quantity < 5 GROUP BY 1)
        SELECT CASE WHEN old IS NULL THEN 'create' WHEN new IS NULL THEN 'delete' WHEN new > old THEN 'increase' WHEN new < old THEN 'decrease' ELSE 'same' END AS kind,
          COALESCE(abs(new - old) * 2 > old, FALSE) AS big, COUNT(*) AS n FROM o FULL JOIN n ON o.l_partkey = n.l_partkey GROUP BY 1, 2"""),
    "price_pivot": (price_pivot, _LISTS + """ SELECT l_partkey, MAX(price) FILTER (list = 'LIST_0') AS "LIST_0", MAX(price) FILTER (list = 'LIST_1') AS "LIST_1", MAX(price) FILTER (list = 'LIST_2') AS "LIST_2" FROM x GROUP BY 1"""),
    "price_unpivot": (price_unpivot, _LISTS + " SELECT l_partkey, list, price FROM x"),
    "priced_missing": (priced_missing, _LISTS + " SELECT list, COUNT(DISTINCT l_partkey) AS priced, greatest((SELECT COUNT(*) FROM part) - COUNT(DISTINCT l_partkey), 0) AS missing FROM x GROUP BY 1"),
}
