"""Pointers, shared keys, families, field rules, suffix chains, nested snapshots and recovered codes over stand-ins made from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from partmill.functions import suffixes
from partmill.operators import entities, snapshots
from partmill.sources import recovery
from partmill.sources.storage import read_table as t
from partmill.sources.storage import spread


def canonical_lines(spark, sf):
    """Parts merged into the part before them, twelve in a chain, and some in loops; each followed ten steps."""
    k = F.col("p_partkey")
    into = F.when(k % 130 == 0, k + 2).when(k % 13 != 0, k - 1)
    return entities.follow_pointers(t(spark, sf, "part").select(k.alias("line"), into.alias("into")), "line", "into").withColumnRenamed("end", "canonical")


def key_links(spark, sf):
    """Even parts as catalogue items, odd ones as parts of the library, linked by numbers; a few numbers are shared by many."""
    p = t(spark, sf, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    text = lambda *c: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in c])
    number = lambda x: F.floor(x).cast("long").cast("string")
    makes = lambda has: F.when(has, F.array(F.concat(F.lit("M"), (size % 4).cast("string")))).otherwise(F.array().cast("array<string>"))
    items, parts = p.where(k % 2 == 0), p.where(k % 2 == 1)
    item_keys = items.select(k.alias("item_id"), F.inline(F.array(
        F.struct(F.lit("oem").alias("kind"), text("OE-", number(k / 6 + 1000)).alias("code")), F.struct(F.lit("brand").alias("kind"), text("br ", number(k / 4 + 2000)).alias("code")), F.struct(F.lit("oem").alias("kind"), F.when(k % 10 == 0, text("HOT-", number(k / 200 + 100))).alias("code")))))
    part_keys = parts.select(k.alias("part_id"), F.inline(F.array(
        F.struct(F.lit("oem").alias("kind"), text("oe", number(k / 6 + 1000)).alias("code")), F.struct(F.lit("raw").alias("kind"), text("BR-", number(k / 4 + 2000)).alias("code")), F.struct(F.lit("raw").alias("kind"), F.when(k % 15 == 0, text("HOT", number(k / 200 + 100))).alias("code")))))
    return entities.link_by_keys(
        items.select(k.alias("item_id"), F.col("p_type").alias("product_type"), makes(size % 3 > 0).alias("makes")), item_keys,
        parts.select(k.alias("part_id"), (size % 11 == 0).alias("retired"), F.when(size % 4 > 0, F.col("p_type")).alias("product_type"), makes(size % 5 > 0).alias("makes")), part_keys,
    )


def part_families(spark, sf):
    """Codes of threes with suffixes, some with the code without suffix among them."""
    p, k, size = t(spark, sf, "part"), F.col("p_partkey"), F.col("p_size")
    base = F.concat(F.lit("77"), F.lpad(F.floor(k / 3).cast("string"), 6, "0"))
    suffix = F.when((k % 3 == 0) & (size > 25), "").otherwise(F.element_at(F.array(*map(F.lit, ("-ABC", "-XYZ", "-QRS"))), (k % 3 + 1).cast("int")))
    years = F.element_at(F.array(*map(F.lit, ("98-05", "03-08", "06-09"))), (size % 3 + 1).cast("int"))
    rows = p.select(F.concat(base, suffix).alias("sku"), F.concat(F.lit("Filtro "), F.when(size % 2 == 0, "A ").otherwise("B "), years).alias("description"), (size == 13).alias("is_oem"), k.alias("position"))
    return entities.families(rows, rows.where("position % 60 = 1").select(F.substring("sku", 1, 8).alias("base")))


_FILTERS = [(1, "ECONOMY"), (2, "PROMO"), (3, "SMALL"), (4, "ECONOMY"), (5, "STANDARD")]
_RULES = [(1, "size", "between", "10", "30"), (1, "price", "gte", "900.5", None), (2, "word", "contains", "ring", None), (2, "size", "lt", "40", None), (2, "promo", "eq", "true", None), (4, "word", "eq", "Cold Widget", None), (5, "size", "gt", "x", None)]


def eav_rules(spark, sf):
    """Parts by filters of several rules on size, price, name and kind."""
    p = t(spark, sf, "part")
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda key, number, text, flag: F.struct(F.lit(key).alias("key"), number.alias("number"), text.alias("text"), flag.alias("flag"))
    each = F.inline(F.array(
        row("size", F.col("p_size").cast("decimal(20,6)"), none("string"), none("boolean")), row("price", F.col("p_retailprice").cast("decimal(20,6)"), none("string"), none("boolean")),
        row("word", none("decimal(20,6)"), F.col("p_name"), none("boolean")), row("promo", none("decimal(20,6)"), none("string"), F.col("p_type") == "PROMO"),
    ))
    fields = spark.createDataFrame([("size", "integer", None), ("price", "number", None), ("word", "text", None), ("promo", "boolean", None)], "key string, kind string, options array<string>")
    rules = spark.createDataFrame(_RULES, "filter_id long, key string, operator string, value string, value_to string")
    return entities.parts_meeting(spark.createDataFrame(_FILTERS, "filter_id long, part_type string"), rules, fields, p.select(F.col("p_partkey").alias("part_id"), F.col("p_type").alias("part_type")), p.select(F.col("p_partkey").alias("part_id"), each))


_SUFFIXES = suffixes.Suffixes(
    {"MANDO": ("TAG", "brand"), "TAIH": ("TAG", "brand"), "NEW ERA": ("TAG", "brand"), "KYB": ("TAG", "brand"), "NAK": ("TAG", "brand"), "STD": ("VARIANT", "size"), "G": ("TAG", "genuine")}
)


def suffix_chains(spark, sf):
    """Codes with chains of suffixes: their base, the tokens read and what the chain is; the last column reads a tail as another code."""
    p, k = spread(t(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey"), F.col("p_partkey")
    tails = ("-MANDO", "-STD-TAIH", "_NEW_ERA", "-.25", "-KYB/NAK ANULADO", "-ZZZ", "")
    code = F.concat((k + 1000).cast("string"), F.lit("-A"), F.col("p_size").cast("string"), F.element_at(F.array(*map(F.lit, tails)), (k % 7 + 1).cast("int")))
    found = p.select(k, suffixes.stripped(code, _SUFFIXES).alias("s"), suffixes.chain_of(F.concat(F.lit("/"), (k % 90 + 10).cast("string"), F.lit("-G")), _SUFFIXES, base=F.concat((k + 1000).cast("string"), F.lit("-16160"))).alias("c"))
    # A base with a digit after the dot-size stays whole: the size is part of it.
    return found.select("p_partkey", "s.base", F.array_join(F.col("s.chain.tok"), "|").alias("tokens"), "s.lifecycle", "s.chain_class", F.col("c")[0]["alt_code"].alias("other_code"))


def snapshot_paths(spark, sf):
    """Parts as nested documents in two snapshots; leaves that differ, by path."""
    p, k = t(spark, sf, "part"), F.col("p_partkey")

    def documents(size, brand):
        body = F.to_json(F.struct(brand.alias("brand"), F.struct(size.alias("n"), F.array(F.col("p_type"), F.lit("x")).alias("tags")).alias("size"), F.array(F.struct(k.alias("id"), size.alias("q")), F.struct(F.lit(-1).alias("id"), F.lit(1).alias("q"))).alias("rows")))
        return snapshots.leaves(p.select("p_partkey", body.alias("body")), "p_partkey", "body")

    old = documents(F.col("p_size"), F.col("p_brand"))
    new = documents(F.col("p_size") + F.when(k % 5 == 0, 1).otherwise(0), F.when(k % 7 != 0, F.col("p_brand")))
    return snapshots.compare(old, new, "p_partkey", allow=["rows*"], ignore=["size/"])


def date_recovery(spark, sf):
    """Months of orders as codes that a sheet turned into dates, against intact codes of parts."""
    day = F.trunc(F.col("o_orderdate").cast("date"), "month")
    cells = t(spark, sf, "orders").select(F.col("o_orderkey").alias("row"), F.lit("code").alias("field"), day.alias("day"), F.lit("mmm-yy").alias("mask"), F.lit(None).cast("string").alias("description"))
    intact = t(spark, sf, "part").where("p_size <= 12").select(F.lit("code").alias("field"), F.concat_ws("-", F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 9 == 0, F.col("p_partkey") % 100 + 2000).otherwise(F.col("p_partkey") % 3 + 10).cast("string")).alias("code"), F.lit(None).cast("string").alias("description"))
    return recovery.recover_dates(cells, intact).select("row", F.array_join("candidates", ",").alias("candidates"), "suggested", "automatic", "reason")


_KEY_LINKS_SQL = """WITH i AS (SELECT p_partkey AS item, p_type AS kind, CASE WHEN p_size % 3 > 0 THEN concat('M', p_size % 4) END AS make FROM part WHERE p_partkey % 2 = 0),
  p AS (SELECT p_partkey AS part, CASE WHEN p_size % 4 > 0 THEN p_type END AS kind, CASE WHEN p_size % 5 > 0 THEN concat('M', p_size % 4) END AS make FROM part WHERE p_partkey % 2 = 1 AND p_size % 11 <> 0),
  ik AS (SELECT item, 'oem' AS src, concat('OE', item // 6 + 1000) AS key FROM i UNION ALL SELECT item, 'brand', concat('BR', item // 4 + 2000) FROM i UNION ALL SELECT item, 'oem', concat('HOT', item // 200 + 100) FROM i WHERE item % 10 = 0),
  pk AS (SELECT part, 'oem' AS src, concat('OE', part // 6 + 1000) AS key FROM p UNION ALL SELECT part, 'raw', concat('BR', part // 4 + 2000) FROM p UNION ALL SELECT part, 'raw', concat('HOT', part // 200 + 100) FROM p WHERE part % 15 = 0),
  pr AS (SELECT key, COUNT(*) AS printed FROM ik WHERE src = 'oem' GROUP BY 1),
  m AS (SELECT DISTINCT part, item, ik.src, ik.key, i.kind, p.make AS pm, i.make AS im, coalesce(printed, 0) AS printed FROM ik JOIN pk ON ik.key = pk.key AND (ik.src = 'oem' OR pk.src = 'raw') JOIN i USING (item) JOIN p USING (part) LEFT JOIN pr ON pr.key = ik.key WHERE p.kind IS NULL OR p.kind = i.kind),
  l AS (SELECT part, item, any_value(kind) AS kind, bool_or(src = 'oem') AS oem, COUNT(DISTINCT key) AS overlap, bool_or(src = 'brand' OR printed = 1) AS clean FROM m GROUP BY 1, 2
    HAVING CASE WHEN any_value(pm) IS NOT NULL AND any_value(im) IS NOT NULL THEN any_value(pm) = any_value(im) ELSE bool_or(src = 'oem') END),
  n AS (SELECT part, COUNT(*) AS items, COUNT(DISTINCT kind) AS kinds FROM l GROUP BY 1),
  s AS (SELECT DISTINCT part FROM (SELECT part, key, COUNT(DISTINCT item) AS c FROM m SEMI JOIN l USING (part, item) WHERE src = 'oem' GROUP BY 1, 2) JOIN n USING (part) WHERE c = items),
  k AS (SELECT l.* FROM l JOIN n USING (part) WHERE items = 1 OR (kinds = 1 AND part IN (SELECT part FROM s)))
  SELECT part AS part_id, item AS item_id, CASE WHEN oem THEN 'oem' ELSE 'brand' END AS method, overlap, clean, COUNT(*) OVER (PARTITION BY item) > 1 AS duplicate FROM k"""

_FAMILIES_SQL = """WITH r AS (SELECT *, concat('77', lpad(CAST(p_partkey // 3 AS VARCHAR), 6, '0')) AS base, p_partkey % 3 = 0 AND p_size > 25 AS bare, CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END AS letter, p_size % 3 AS y FROM part),
  d AS (SELECT base, bare, p_partkey AS position, letter, y, p_size = 13 AS oem, concat(base, CASE WHEN bare THEN '' ELSE ['-ABC', '-XYZ', '-QRS'][p_partkey % 3 + 1] END) AS sku, concat('FILTRO ', letter, ' ', ['98-05', '03-08', '06-09'][y + 1]) AS text, [1998, 2003, 2006][y + 1] AS f, [2005, 2008, 2009][y + 1] AS l FROM r),
  m AS (SELECT * FROM d WHERE NOT bare AND NOT oem),
  e AS (SELECT m.base, m.sku, FALSE AS proposed, p.text AS description, m.text <> p.text AS differs FROM m JOIN d p ON p.sku = m.base WHERE m.letter = p.letter AND greatest(m.f, p.f) <= least(m.l, p.l)),
  o AS (SELECT * FROM m WHERE base NOT IN (SELECT sku FROM d) AND base NOT IN (SELECT base FROM d WHERE position % 60 = 1)),
  g AS (SELECT base FROM o GROUP BY 1 HAVING COUNT(*) >= 2 AND COUNT(DISTINCT letter) = 1 AND MAX(f) <= MIN(l)),
  u AS (SELECT base, text, COUNT(*) AS n, MIN(position) AS at FROM o GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY base ORDER BY COUNT(*) DESC, MIN(position)) = 1),
  a AS (SELECT * FROM e UNION ALL SELECT o.base, o.sku, TRUE, u.text, o.text <> u.text FROM o JOIN g USING (base) JOIN u USING (base))
  SELECT base, sku, proposed, description, bool_or(differs) OVER (PARTITION BY base) AS warned FROM a"""

QUERIES = {
    "canonical_lines": (canonical_lines, """WITH RECURSIVE n AS (SELECT p_partkey AS line, CASE WHEN p_partkey % 130 = 0 THEN p_partkey + 2 WHEN p_partkey % 13 <> 0 THEN p_partkey - 1 END AS into FROM part),
        w AS (SELECT line, line AS here, 0 AS d FROM n UNION ALL SELECT w.line, n.into, d + 1 FROM w JOIN n ON n.line = w.here WHERE n.into IS NOT NULL AND d < 10) SELECT line, arg_max(here, d) AS canonical FROM w GROUP BY 1"""),
    "key_links": (key_links, _KEY_LINKS_SQL),
    "part_families": (part_families, _FAMILIES_SQL),
    "eav_rules": (eav_rules, """SELECT CAST(1 AS BIGINT) AS filter_id, p_partkey AS part_id FROM part WHERE p_type = 'ECONOMY' AND p_size BETWEEN 10 AND 30 AND p_retailprice >= 900.5 UNION ALL
        SELECT 2, p_partkey FROM part WHERE p_type = 'PROMO' AND contains(p_name, 'ring') AND p_size < 40 UNION ALL SELECT 3, p_partkey FROM part WHERE p_type = 'SMALL' UNION ALL SELECT 4, p_partkey FROM part WHERE p_type = 'ECONOMY' AND p_name = 'cold widget'"""),
    "suffix_chains": (suffix_chains, """SELECT p_partkey, concat(p_partkey + 1000, '-A', p_size, CASE WHEN p_partkey % 7 = 3 THEN '-.25' ELSE '' END) AS base, ['MANDO', 'STD|TAIH', 'NEW ERA', '', 'KYB/NAK', 'ZZZ', ''][p_partkey % 7 + 1] AS tokens, CASE WHEN p_partkey % 7 = 4 THEN 'ANULADO' ELSE '' END AS lifecycle,
        ['tag', 'variant', 'tag', 'bare', 'lifecycle', 'unknown', 'bare'][p_partkey % 7 + 1] AS chain_class, concat(p_partkey + 1000, '-161', p_partkey % 90 + 10) AS other_code FROM part"""),
    "snapshot_paths": (snapshot_paths, """WITH c AS (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS more FROM part)
        SELECT p_partkey, 'size/n' AS path, CAST(p_size AS VARCHAR) AS old, CAST(p_size + 1 AS VARCHAR) AS new, 'ignored' AS kind FROM c WHERE more = 1 UNION ALL SELECT p_partkey, concat('rows[id=', p_partkey, ']/q'), CAST(p_size AS VARCHAR), CAST(p_size + 1 AS VARCHAR), 'expected' FROM c WHERE more = 1
        UNION ALL SELECT p_partkey, 'brand', concat('"', p_brand, '"'), NULL, 'unexpected' FROM c WHERE p_partkey % 7 = 0"""),
    "date_recovery": (date_recovery, """WITH i AS (SELECT DISTINCT p_size AS head, CASE WHEN p_partkey % 9 = 0 THEN p_partkey % 100 + 2000 ELSE p_partkey % 3 + 10 END AS tail FROM part WHERE p_size <= 12),
        s AS (SELECT head, COUNT(*) FILTER (tail < 100) AS two, COUNT(*) FILTER (tail >= 100) AS four FROM i GROUP BY 1),
        c AS (SELECT o_orderkey AS row, month(o_orderdate) AS m, year(o_orderdate) AS y, COALESCE(two, 0) >= 3 AS two, COALESCE(four, 0) >= 3 AS four FROM orders LEFT JOIN s ON head = month(o_orderdate)),
        t AS (SELECT *, concat(m, '-', lpad(CAST(y % 100 AS VARCHAR), 2, '0')) AS short, concat(m, '-', y) AS long FROM c)
        SELECT row, concat(short, ',', long, CASE WHEN m < 10 THEN concat(',0', m, '-', y) ELSE '' END, ',', y, '-', m) AS candidates, CASE WHEN four AND NOT two THEN long ELSE short END AS suggested, two <> four AS automatic, CASE WHEN two <> four THEN 'pattern' ELSE 'none' END AS reason FROM t"""),
}
