"""Entity resolution and description analytics: tiered matching, groups, hints, votes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from partmill.functions.parts import code_tokens
from partmill.functions.text import compact, shape
from partmill.operators import matching
from partmill.operators.graph import connected_components
from partmill.operators.relational import top_row
from partmill.sources.storage import read_table as t
from partmill.sources.storage import spread


def canonical_rollup(spark, sf):
    p = t(spark, sf, "part").withColumn("merged_into", F.when(F.col("p_partkey") % 4 != 0, F.col("p_partkey") - F.col("p_partkey") % 4))
    return p.groupBy(F.coalesce("merged_into", "p_partkey").alias("line")).agg(F.count("*").alias("parts"), F.min("p_brand").alias("first_brand"))


def self_join_children(spark, sf):
    p = t(spark, sf, "part")
    a, b = p.alias("a"), p.alias("b")
    child = (F.col("b.p_partkey") - F.col("b.p_partkey") % 4 == F.col("a.p_partkey")) & (F.col("b.p_partkey") != F.col("a.p_partkey"))
    return a.join(b, child).select(F.col("a.p_partkey").alias("line"), F.col("b.p_partkey").alias("child"))


def tiered_match(spark, sf):
    """A line's name is looked up by (name, brand), else by name and size, else by name alone; several lines in the first tier that has any are a case."""
    items = t(spark, sf, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("item"), "p_name", "p_brand", "p_size").distinct()
    lines = t(spark, sf, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("line"), "p_name", "p_brand", "p_size")
    return matching.first_tier(items, lines, "item", "line", (("p_name", "p_brand"), ("p_name", "p_size"), ("p_name",))).withColumn("action", F.when(F.col("lines") == 1, "match").otherwise("case"))


def rare_word_hints(spark, sf):
    """Parts of other brands that share rare words, the eight best."""
    words = t(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("word"))
    rare = words.groupBy("word").agg(F.count("*").alias("df")).where("df BETWEEN 2 AND 5")
    kept = words.join(rare, "word")
    a, b = kept.select(F.col("item_id").alias("item"), "word"), kept.select(F.col("item_id").alias("line"), "word")
    shared = a.join(b, "word").where("item <> line").groupBy("item", "line").agg(F.count("*").alias("score"))
    w = Window.partitionBy("item").orderBy(F.desc("score"), "line")
    return shared.withColumn("rn", F.row_number().over(w)).where("rn <= 8").select("item", "line", "score")


def pairs_in_group(spark, sf):
    """All pairs of suppliers of a region: their number is the square of a region's suppliers, so these are spread over the cores."""
    s = t(spark, sf, "supplier").join(t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    a, b = spread(s, "s_suppkey").alias("a"), s.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.s_suppkey") < F.col("b.s_suppkey"))).select(F.col("a.n_regionkey").alias("region"), F.col("a.s_suppkey").alias("first"), F.col("b.s_suppkey").alias("second"))


def components(spark, sf):
    """Suppliers and parts of the bulk lines, grouped by who supplies what."""
    edges = t(spark, sf, "lineitem").where("l_quantity >= 50 AND l_returnflag = 'A' AND l_linestatus = 'F'").select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"))
    return connected_components(edges)


def claimant_conflicts(spark, sf):
    """Names claimed by several parts: by several brands, or by one."""
    p = t(spark, sf, "part").groupBy("p_name").agg(F.count("*").alias("claims"), F.count_distinct("p_brand").alias("brands")).where("claims > 1")
    return p.withColumn("kind", F.when(F.col("brands") > 1, "brands").otherwise("lines"))


def key_overlap_match(spark, sf):
    """Customers and suppliers of one nation whose names end alike."""
    tail = lambda c: F.regexp_extract(c, "([0-9]{2})$", 1)
    c = t(spark, sf, "customer").select("c_custkey", "c_nationkey", tail("c_name").alias("tail"))
    s = t(spark, sf, "supplier").select("s_suppkey", "s_nationkey", tail("s_name").alias("tail"))
    return c.join(s, (F.col("c_nationkey") == F.col("s_nationkey")) & (c["tail"] == s["tail"])).select("c_custkey", "s_suppkey")


def self_join_residual(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    a, b = p.alias("a"), p.alias("b")
    on = (F.col("a.p_name") == F.col("b.p_name")) & (F.col("a.p_brand") == F.col("b.p_brand")) & (F.col("a.p_partkey") < F.col("b.p_partkey"))
    return a.join(b, on).select(F.col("a.p_partkey").alias("first"), F.col("b.p_partkey").alias("second"))


def update_from_join(spark, sf):
    new = t(spark, sf, "lineitem").groupBy("l_partkey").agg(F.max("l_quantity").cast("int").alias("size"))
    return t(spark, sf, "part").join(new, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.coalesce("size", "p_size")).otherwise(F.col("p_size")).cast("long").alias("size"))


def sequence_siblings(spark, sf):
    """Customers whose number ends in the same two digits, itself excluded, the five smallest.

    Any of them is among the six smallest of the ending, so customers meet these and not each other."""
    c = t(spark, sf, "customer").select("c_custkey", F.regexp_extract("c_name", "([0-9]{2})$", 1).alias("seq"))
    first = matching.smallest_of_each(c, "seq", "c_custkey", 6).withColumnRenamed("c_custkey", "sibling")
    both = c.join(first, "seq").where("c_custkey <> sibling").select(F.col("c_custkey").alias("item"), "sibling")
    return matching.smallest_of_each(both, "item", "sibling", 5)


def matching_tiers(spark, sf):
    """Items (parts of even number) resolved to lines by references (odd parts): keys are names, every third reference is a
    supplier's own, brands have families of ten."""
    p = t(spark, sf, "part")
    number = F.regexp_replace("p_brand", "[^0-9]", "").cast("int")
    brand = F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_brand"))
    root = F.when(brand == "", "").otherwise(F.concat(F.lit("F"), F.floor(number / 10).cast("string")))
    items = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("item_id"), (F.col("p_partkey") % 5).alias("supplier_id"), F.concat_ws("/", "p_name", "p_type").alias("clave"), brand.alias("brand"), root.alias("root"))
    state = F.when(F.col("p_size") % 7 == 0, "disputa").when(F.col("p_size") % 7 == 1, "otro").otherwise("verificado")
    refs = p.where("p_partkey % 2 = 1").select(
        F.col("p_partkey").alias("ref_id"), F.floor(F.col("p_partkey") / 50).cast("long").alias("line_id"), F.concat_ws("/", "p_name", "p_type").alias("clave"), brand.alias("brand"), root.alias("root"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey") % 5).alias("supplier_id"), state.alias("state"), (F.col("p_partkey") % 4 == 1).alias("is_main"),
    )
    return matching.resolve_items(items, refs)


def candidate_pairs(spark, sf):
    """Parts that share a code token or a long prefix of one, eight for each at most."""
    code = F.concat_ws(" ", F.concat(F.lit("AB"), (F.col("p_partkey") / 3).cast("long") + 100000, F.lit("-"), F.col("p_size")), F.concat(F.lit("HOT"), F.col("p_size") % 2 + 12345))
    return matching.candidate_pairs(t(spark, sf, "part").select(F.col("p_partkey").alias("id"), code_tokens(code).alias("tokens")))


def mode_per_group(spark, sf):
    n = t(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return top_row(n, ["p_brand"], [F.desc("n"), "p_type"]).select("p_brand", "p_type", "n")


def loo_vote(spark, sf):
    """For every part, how many others of its name agree on the type, and the verdict."""
    p = t(spark, sf, "part")
    by = lambda *c: Window.partitionBy(*c)
    others = p.select("p_partkey", (F.count("*").over(by("p_name")) - 1).alias("others"), (F.count("*").over(by("p_name", "p_type")) - 1).alias("agree"))
    share = F.col("agree") / F.nullif(F.col("others"), F.lit(0))
    verdict = F.when((F.col("agree") >= 5) & (share >= 0.8), "strong").when((F.col("agree") >= 3) & (share >= 0.5), "agree").when(F.col("others") == 0, "alone").otherwise("weak")
    return others.withColumn("verdict", verdict)


def common_words(spark, sf):
    """Words in more than 5 % of a source's documents, and in more than 2."""
    d = t(spark, sf, "documents").where("text IS NOT NULL")
    words = d.select("source", "doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    totals = d.groupBy("source").agg(F.count("*").alias("docs"))
    return words.groupBy("source", "word").agg(F.count("*").alias("n")).join(totals, "source").where("n > greatest(docs * 0.05, 2)").select("source", "word", "n")


def family_candidates(spark, sf):
    """Names whose parts, three or more, are all of one type."""
    return t(spark, sf, "part").groupBy("p_name", "p_brand").agg(F.count("*").alias("members"), F.count_distinct("p_type").alias("types"), F.min("p_partkey").alias("parent")).where("members >= 2 AND types = 1")


def missing_required(spark, sf):
    """Fields that a part's type asks for and that the part has no value in."""
    fields = spark.createDataFrame([("ECONOMY", "size"), ("ECONOMY", "review"), ("PROMO", "review")], "p_type string, field string")
    values = t(spark, sf, "part").where("p_size > 20").select("p_partkey", F.lit("size").alias("field")).union(t(spark, sf, "part").where("p_partkey % 3 = 0").select("p_partkey", F.lit("review")))
    return t(spark, sf, "part").select("p_partkey", "p_type").join(fields, "p_type").join(values, ["p_partkey", "field"], "left_anti").select("p_partkey", "field")


def code_shapes(spark, sf):
    return t(spark, sf, "customer").groupBy(shape(F.col("c_name")).alias("shape")).agg(F.count("*").alias("n"), F.min(compact(F.col("c_name"))).alias("example"))


def keeper_rank(spark, sf):
    """Of parts alike in name and brand, the one to keep: most lines, then most units, then the first."""
    use = t(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").cast("long").alias("units"))
    p = t(spark, sf, "part").join(use, F.col("p_partkey") == F.col("l_partkey"), "left").fillna(0, ["lines", "units"])
    return top_row(p, ["p_name", "p_brand"], [F.desc("lines"), F.desc("units"), "p_partkey"]).select("p_name", "p_brand", F.col("p_partkey").alias("keeper"), "lines")


def ordered_distinct_codes(spark, sf):
    """Each supplier's brands in the order of their first part."""
    own = t(spark, sf, "lineitem").join(t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_brand").agg(F.min("p_partkey").alias("first"))
    return own.groupBy("l_suppkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "p_brand"))), lambda x: x["p_brand"]), ",").alias("brands"))


QUERIES = {
    "canonical_rollup": (canonical_rollup, "SELECT p_partkey - p_partkey % 4 AS line, COUNT(*) AS parts, MIN(p_brand) AS first_brand FROM part GROUP BY 1"),
    "self_join_children": (self_join_children, "SELECT a.p_partkey AS line, b.p_partkey AS child FROM part a JOIN part b ON b.p_partkey - b.p_partkey % 4 = a.p_partkey AND b.p_partkey <> a.p_partkey"),
    "tiered_match": (tiered_match, """WITH f AS (SELECT i.p_partkey AS item, l.p_partkey AS line, CAST(CASE WHEN i.p_brand = l.p_brand THEN 1 WHEN i.p_size = l.p_size THEN 2 ELSE 3 END AS BIGINT) AS tier
        FROM part i JOIN part l ON i.p_name = l.p_name WHERE i.p_partkey % 3 = 0 AND l.p_partkey % 3 <> 0), b AS (SELECT * FROM f QUALIFY tier = MIN(tier) OVER (PARTITION BY item))
        SELECT item, tier, COUNT(DISTINCT line) AS lines, MIN(line) AS line, CASE WHEN COUNT(DISTINCT line) = 1 THEN 'match' ELSE 'case' END AS action FROM b GROUP BY 1, 2"""),
    "rare_word_hints": (rare_word_hints, """WITH w AS (SELECT item_id, unnest(list_distinct(string_split(lower(text), ' '))) AS word FROM benchmark), k AS (SELECT * FROM w QUALIFY COUNT(*) OVER (PARTITION BY word) BETWEEN 2 AND 5),
        s AS (SELECT a.item_id AS item, b.item_id AS line, COUNT(*) AS score FROM k a JOIN k b ON a.word = b.word AND a.item_id <> b.item_id GROUP BY 1, 2)
        SELECT item, line, score FROM s QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, line) <= 8"""),
    "pairs_in_group": (pairs_in_group, "WITH s AS (SELECT s_suppkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey) SELECT a.n_regionkey AS region, a.s_suppkey AS first, b.s_suppkey AS second FROM s a JOIN s b ON a.n_regionkey = b.n_regionkey AND a.s_suppkey < b.s_suppkey"),
    "connected_components": (components, """WITH RECURSIVE l AS (SELECT l_partkey * 2 AS a, l_suppkey * 2 + 1 AS b FROM lineitem WHERE l_quantity >= 50 AND l_returnflag = 'A' AND l_linestatus = 'F'), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT DISTINCT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach) SELECT node, MIN(reach) AS component FROM r GROUP BY 1"""),
    "claimant_conflicts": (claimant_conflicts, "SELECT p_name, COUNT(*) AS claims, COUNT(DISTINCT p_brand) AS brands, CASE WHEN COUNT(DISTINCT p_brand) > 1 THEN 'brands' ELSE 'lines' END AS kind FROM part GROUP BY 1 HAVING COUNT(*) > 1"),
    "key_overlap_match": (key_overlap_match, "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND regexp_extract(c_name, '([0-9]{2})$', 1) = regexp_extract(s_name, '([0-9]{2})$', 1)"),
    "self_join_residual": (self_join_residual, "SELECT a.p_partkey AS first, b.p_partkey AS second FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey"),
    "update_from_join": (update_from_join, """SELECT p_partkey, CAST(CASE WHEN p_partkey % 2 = 0 THEN COALESCE(size, p_size) ELSE p_size END AS BIGINT) AS size
        FROM part LEFT JOIN (SELECT l_partkey, CAST(MAX(l_quantity) AS INT) AS size FROM lineitem GROUP BY 1) ON l_partkey = p_partkey"""),
    "sequence_siblings": (sequence_siblings, """WITH c AS (SELECT c_custkey, regexp_extract(c_name, '([0-9]{2})$', 1) AS seq FROM customer)
        SELECT a.c_custkey AS item, b.c_custkey AS sibling FROM c a JOIN c b ON a.seq = b.seq AND a.c_custkey <> b.c_custkey QUALIFY row_number() OVER (PARTITION BY a.c_custkey ORDER BY b.c_custkey) <= 5"""),
    "matching_tiers": (matching_tiers, """WITH p AS (SELECT *, concat(p_name, '/', p_type) AS clave, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_brand END AS brand, CASE WHEN p_size % 4 = 0 THEN '' ELSE concat('F', CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS INT) // 10) END AS root FROM part),
        r AS (SELECT p_partkey AS ref_id, p_partkey // 50 AS line_id, clave, brand, root, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 5 END AS supplier, CASE WHEN p_size % 7 = 0 THEN 'disputa' WHEN p_size % 7 = 1 THEN 'otro' ELSE 'verificado' END AS state FROM p WHERE p_partkey % 2 = 1),
        j AS (SELECT i.p_partkey AS item_id, i.brand AS ib, r.*, CASE WHEN supplier = i.p_partkey % 5 AND state = 'verificado' AND (r.brand = i.brand) THEN 0 WHEN supplier = i.p_partkey % 5 AND state = 'verificado' AND r.brand = '' THEN 1
          WHEN supplier = i.p_partkey % 5 AND state = 'verificado' AND i.brand = '' THEN 2 WHEN supplier IS NULL AND i.brand <> '' AND r.brand = i.brand THEN 3 WHEN supplier IS NULL AND (r.brand = '' OR i.brand = '') THEN 4
          WHEN supplier IS NULL AND r.root = i.root THEN 5 END AS tier FROM p i JOIN r ON r.clave = i.clave WHERE i.p_partkey % 2 = 0),
        k AS (SELECT *, row_number() OVER (PARTITION BY item_id, tier ORDER BY state <> 'verificado', ib = '' AND brand <> '' AND supplier IS NULL, ref_id % 4 <> 1, ref_id) AS rn FROM j WHERE tier IS NOT NULL QUALIFY tier = MIN(tier) OVER (PARTITION BY item_id)),
        g AS (SELECT item_id, tier, COUNT(DISTINCT line_id) AS lines, bool_or(state = 'verificado') AS alone, bool_or(state = 'disputa') AS disputed, MAX(line_id) FILTER (rn = 1) AS line_id, MAX(ref_id) FILTER (rn = 1) AS ref_id, bool_or(rn = 1 AND ib = '' AND brand <> '' AND supplier IS NULL) AS b FROM k GROUP BY 1, 2),
        a AS (SELECT *, tier < 3 OR (lines = 1 AND alone) AS attach FROM g)
        SELECT item_id, CASE WHEN tier < 3 THEN 'interna' WHEN attach AND tier = 4 AND b THEN 'marca_de_la_linea' ELSE ['exacta', 'sin_marca', 'familia'][tier - 2] END AS rule, CASE WHEN attach THEN 'attach' ELSE 'case' END AS action,
          CASE WHEN attach THEN line_id END AS line_id, CASE WHEN attach THEN ref_id END AS ref_id, CASE WHEN NOT attach THEN CASE WHEN disputed THEN 'disputa' ELSE 'lineas' END END AS guard, lines FROM a"""),
    "candidate_pairs": (candidate_pairs, """WITH k AS (SELECT DISTINCT p_partkey AS id, unnest([concat('AB', p_partkey // 3 + 100000, p_size), concat('^', substr(concat('AB', p_partkey // 3 + 100000, p_size), 1, 8)), concat('HOT', p_size % 2 + 12345), concat('^HOT', p_size % 2 + 12345)]) AS key FROM part),
        f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY id) <= 9), c AS (SELECT DISTINCT k.id, f.id AS candidate FROM k JOIN f USING (key) WHERE k.id <> f.id)
        SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY candidate) <= 8"""),
    "mode_per_group": (mode_per_group, "SELECT p_brand, p_type, COUNT(*) AS n FROM part GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) = 1"),
    "loo_vote": (loo_vote, """WITH o AS (SELECT p_partkey, COUNT(*) OVER (PARTITION BY p_name) - 1 AS others, COUNT(*) OVER (PARTITION BY p_name, p_type) - 1 AS agree FROM part)
        SELECT *, CASE WHEN agree >= 5 AND agree / nullif(others, 0) >= 0.8 THEN 'strong' WHEN agree >= 3 AND agree / nullif(others, 0) >= 0.5 THEN 'agree' WHEN others = 0 THEN 'alone' ELSE 'weak' END AS verdict FROM o"""),
    "common_words": (common_words, """WITH w AS (SELECT source, unnest(list_distinct(string_split(text, ' '))) AS word FROM documents WHERE text IS NOT NULL), d AS (SELECT source, COUNT(*) AS docs FROM documents WHERE text IS NOT NULL GROUP BY 1)
        SELECT w.source, word, COUNT(*) AS n FROM w JOIN d ON d.source = w.source GROUP BY 1, 2, docs HAVING COUNT(*) > greatest(docs * 0.05, 2)"""),
    "family_candidates": (family_candidates, "SELECT p_name, p_brand, COUNT(*) AS members, COUNT(DISTINCT p_type) AS types, MIN(p_partkey) AS parent FROM part GROUP BY 1, 2 HAVING COUNT(*) >= 2 AND COUNT(DISTINCT p_type) = 1"),
    "missing_required": (missing_required, """WITH f(t, field) AS (VALUES ('ECONOMY', 'size'), ('ECONOMY', 'review'), ('PROMO', 'review'))
        SELECT p_partkey, field FROM part JOIN f ON t = p_type WHERE NOT (field = 'size' AND p_size > 20) AND NOT (field = 'review' AND p_partkey % 3 = 0)"""),
    "code_shapes": (code_shapes, "SELECT regexp_replace(regexp_replace(c_name, '[0-9]', '9', 'g'), '[A-Za-z]', 'A', 'g') AS shape, COUNT(*) AS n, MIN(regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g')) AS example FROM customer GROUP BY 1"),
    "keeper_rank": (keeper_rank, """WITH u AS (SELECT l_partkey, COUNT(*) AS lines, CAST(SUM(l_quantity) AS BIGINT) AS units FROM lineitem GROUP BY 1)
        SELECT p_name, p_brand, p_partkey AS keeper, COALESCE(lines, 0) AS lines FROM part LEFT JOIN u ON l_partkey = p_partkey
        QUALIFY row_number() OVER (PARTITION BY p_name, p_brand ORDER BY COALESCE(lines, 0) DESC, COALESCE(units, 0) DESC, p_partkey) = 1"""),
    "ordered_distinct_codes": (ordered_distinct_codes, """WITH o AS (SELECT l_suppkey, p_brand, MIN(p_partkey) AS first FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
        SELECT l_suppkey, string_agg(p_brand, ',' ORDER BY first, p_brand) AS brands FROM o GROUP BY 1"""),
}
