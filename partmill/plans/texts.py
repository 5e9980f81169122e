"""Text functions at work: search words, brands and aliases, amounts, reference cells, codes and descriptions.

The test tables have no such texts, so each query first writes some from the table's columns (``_RAW``: SQL that both engines
read); what is shown is the function on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partmill.functions import parts as P
from partmill.functions import text as X
from partmill.operators.text_joins import expand_aliases, resolve_brands, typo_fixes
from partmill.sources.storage import read_table as t

#: Spellings of brands, the brand each names, and the head of its family.
ALIASES = (("B ONE", "BRAND#1", "BRAND#1"), ("BRAND#1", "BRAND#1", "BRAND#1"), ("BRAND#2", "BRAND#2", "BRAND#1"), ("BRD3", "BRAND#3", "BRAND#3"), ("RED RING", "REDRING CO", "REDRING CO"), ("BOLT", "BOLTON", "BOLTON"))
CLASSES = {"SMALL": "tag", "LARGE": "tag", "PROMO": "variant", "STD": "variant"}
TOKENS = {"BRAND": "B", "SMALL": "S", "ECONOMY": "E", "PROMO": "P"}
GROUPS = {"B": "BRANDS", "S": "SIZES", "E": "OTHER"}
RULES = (("rings", r"(SMALL|RED) RING\b"), ("bolts", "[A-Z]+ BOLT"), ("small", "SMALL"), ("red", "RED"))

_RAW = {
    "search": "concat('  ', p_name, ' de ', p_type, ' - ', CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE concat('a1 ', CAST(p_partkey AS STRING)) END)",
    "spelling": "CASE WHEN p_partkey % 4 = 0 THEN concat('  ', lower(p_brand), ' ') WHEN p_partkey % 4 = 1 THEN 'b  one' WHEN p_partkey % 4 = 2 THEN 'BRD3' ELSE p_type END",
    "amount": """CASE WHEN o_orderkey % 9 = 0 THEN CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING) WHEN o_orderkey % 9 = 1 THEN replace(CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING), '.', ',')
        WHEN o_orderkey % 9 = 2 THEN concat('1,', substr(CAST(o_orderkey + 1000 AS STRING), 1, 3), '.5') WHEN o_orderkey % 9 = 3 THEN concat('2.', substr(CAST(o_orderkey + 1000 AS STRING), 1, 3), ',25')
        WHEN o_orderkey % 9 = 4 THEN concat('3.', substr(CAST(o_orderkey + 1000 AS STRING), 1, 3)) WHEN o_orderkey % 9 = 5 THEN concat('-', CAST(o_orderkey AS STRING)) WHEN o_orderkey % 9 = 6 THEN CAST(o_orderkey AS STRING)
        WHEN o_orderkey % 9 = 7 THEN concat(CAST(o_orderkey AS STRING), '.1234') ELSE o_orderstatus END""",
    "cell": """concat(lower(p_brand), ':', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 3 = 0 THEN '; OEM:a:x1|' WHEN p_partkey % 3 = 1 THEN ' ; company:c:9' ELSE '; a:x1; OEM:a:x1' END)""",
    "sku": "concat('54', CAST(p_partkey + 10000 AS STRING), '-D', CAST(p_size AS STRING), CASE WHEN p_partkey % 3 = 0 THEN '-LH' ELSE '' END, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('-', p_type) END)",
    "described": """concat(p_name, CASE WHEN p_partkey % 4 = 0 THEN ' del izq' WHEN p_partkey % 4 = 1 THEN ' L/H rh tras' WHEN p_partkey % 4 = 2 THEN ' tras der' ELSE '' END,
        CASE WHEN p_size < 20 THEN concat(' ', CAST(p_size + 70 AS STRING), '-0', CAST(p_partkey % 10 AS STRING)) ELSE '' END)""",
    "note": "concat('OEM: ', CAST(p_partkey + 90000 AS STRING), '-01253 y $ ', CAST(p_size AS STRING), '.50 a ', p_type, '@', 'mail.com ref 12-', CAST(p_size AS STRING), ' 5 % a1b2c3')",
    "number": "CASE WHEN p_partkey % 3 = 0 THEN concat('16100-', CAST(p_partkey + 10000 AS STRING), '-000') WHEN p_partkey % 3 = 1 THEN concat('0', CAST(p_partkey + 1000000 AS STRING)) ELSE CAST(p_partkey + 100000 AS STRING) END",
    "ending": "CASE WHEN p_size % 3 = 0 THEN '-x' WHEN p_size % 3 = 1 THEN 'wxyz' ELSE '9' END",
    "make": "CASE WHEN p_size % 3 = 0 THEN ' suzuki' WHEN p_size % 3 = 1 THEN 'Opel' ELSE 'saab' END",
}


def _with(spark, sf, table: str, key: str, *names: str) -> DataFrame:
    return t(spark, sf, table).select(key, *[F.expr(_RAW[n]).alias(n) for n in names])


def _alias_table(spark) -> DataFrame:
    return spark.createDataFrame(list(ALIASES), "alias string, brand string, root string")


def text_folding(spark, sf):
    """Both foldings of every document, as digests."""
    return t(spark, sf, "documents").select("doc_id", F.md5(X.fold(F.col("text"))).alias("folded"), F.md5(X.wide_fold(F.col("text"))).alias("wide"))


def search_words(spark, sf):
    return _with(spark, sf, "part", "p_partkey", "search").select("p_partkey", F.array_join(X.search_words(F.col("search")), " ").alias("words"), X.search_key(F.col("search")).alias("key"))


def brand_resolve(spark, sf):
    return resolve_brands(_with(spark, sf, "part", "p_partkey", "spelling"), "spelling", _alias_table(spark)).select("p_partkey", "brand", "root")


def alias_expand(spark, sf):
    docs = t(spark, sf, "part").select("p_partkey", X.fold(F.concat_ws(" ", "p_name", "p_brand")).alias("text"))
    return expand_aliases(docs, "p_partkey", "text", _alias_table(spark)).select("p_partkey", F.array_join("added", "|").alias("added"))


def token_contains(spark, sf):
    """An exact token of a padded list of codes, not a part of one."""
    codes = F.array(F.upper("p_name"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")), F.upper("p_type"), F.concat(F.lit("P"), F.col("p_size").cast("string")))
    return t(spark, sf, "part").select("p_partkey", X.padded(codes).alias("codes")).where(X.has_token(F.col("codes"), F.lit("P12")))


def amount_parse(spark, sf):
    return _with(spark, sf, "orders", "o_orderkey", "amount").select("o_orderkey", P.amount(F.col("amount")).alias("a")).select("o_orderkey", "a.value", "a.error")


def reference_cells(spark, sf):
    rows = _with(spark, sf, "part", "p_partkey", "cell").select("p_partkey", P.references_in_cell(F.col("cell")).alias("c"))
    named = F.transform("c.refs", lambda r: F.concat_ws(":", r["brand"], r["code"], F.coalesce(r["ref_type"], F.lit("-"))))
    return rows.select("p_partkey", F.array_join(named, ";").alias("refs"), F.col("c.error").alias("error"))


def supplier_bases(spark, sf):
    return _with(spark, sf, "part", "p_partkey", "sku").select("p_partkey", P.supplier_base(F.col("sku")).alias("base"))


def code_tags(spark, sf):
    """Codes without their trailing tags, and what sort of tags these are."""
    found = P.code_with_tags(F.col("sku"), CLASSES)
    return _with(spark, sf, "part", "p_partkey", "sku").select("p_partkey", found.alias("f")).select("p_partkey", "f.base", F.array_join("f.tags", ",").alias("tags"), "f.chain_class")


def described_sides(spark, sf):
    rows = _with(spark, sf, "part", "p_partkey", "described").select("p_partkey", F.array_join(P.sides(F.col("described")), ",").alias("sides"), P.application(F.col("described")).alias("a"))
    return rows.select("p_partkey", "sides", F.col("a.first").alias("first"), F.col("a.last").alias("last"))


def spec_conflicts(spark, sf):
    """Neighbouring parts whose descriptions contradict each other."""
    d = _with(spark, sf, "part", "p_partkey", "described")
    pairs = d.join(d.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("described").alias("next")), "p_partkey")
    return pairs.where(P.spec_conflict(F.col("described"), F.col("next"))).select("p_partkey", "described", "next")


def noted_references(spark, sf):
    rows = _with(spark, sf, "part", "p_partkey", "note")
    return rows.select("p_partkey", F.array_join(P.labelled_references(F.col("note")), ",").alias("labelled"), F.array_join(P.code_tokens(F.col("note")), ",").alias("tokens"), P.masked(F.col("note")).alias("masked"))


def canonical_numbers(spark, sf):
    rows = _with(spark, sf, "part", "p_partkey", "make", "number")
    return rows.select("p_partkey", P.twin_scope(F.col("make")).alias("scope"), P.canonical_number(F.col("make"), F.col("number")).alias("number"))


def one_part_names(spark, sf):
    """Whether a part's code and its longer spelling name one part."""
    return _with(spark, sf, "part", "p_partkey", "sku", "ending").select("p_partkey", P.one_part(F.array(F.concat("sku", "ending"), "sku")).alias("one_part"))


def make_groups(spark, sf):
    return t(spark, sf, "part").select("p_partkey", P.make_group(F.concat_ws("-", "p_type", "p_brand"), TOKENS, GROUPS).alias("make_group"))


def rule_categories(spark, sf):
    return t(spark, sf, "part").select("p_partkey", P.first_rule(F.col("p_name"), RULES).alias("category"))


def description_heads(spark, sf):
    found = P.head_and_qualifier(F.col("p_name"), {"TINY": "SMALL"}, {"SMALL": ("RING", "BOLT"), "RED": ("WIDGET",)})
    return t(spark, sf, "part").select("p_partkey", found.alias("h")).select("p_partkey", "h.head", "h.qualifier")


def prefix_classes(spark, sf):
    """The class of a number by its make and first five characters: an equi join with the table of classes."""
    table = spark.createDataFrame([("SUZUKI", "16100", "pump"), ("OPEL", "01000", "filter"), ("SAAB", "10010", "disc")], "make string, prefix string, class string")
    rows = _with(spark, sf, "part", "p_partkey", "make", "number").withColumns({"make": X.brand_key(F.col("make")), "prefix": F.substring(X.compact(F.col("number")), 1, 5)})
    return rows.join(table, ["make", "prefix"], "left").select("p_partkey", "class")


def snippets(spark, sf):
    return t(spark, sf, "documents").select("doc_id", X.snippet(F.col("text")).alias("snippet"), X.header(F.substring(F.col("text"), 1, 40)).alias("header"), X.citation_title(F.concat_ws(" · pág. ", "lang", "source")).alias("title"))


def typo_words(spark, sf):
    """Rare words of the test items that are one swap, change, drop or addition, or two, from a word in common use."""
    words = t(spark, sf, "benchmark").select(F.explode(F.array_distinct(F.regexp_extract_all(F.upper("text"), F.lit("([A-Z]{2,})"), 1))).alias("word"))
    return typo_fixes(words.groupBy("word").agg(F.count("*").alias("n")), known=3, between=True)


def _part(columns: str, tail: str = "", **raw: str) -> str:
    given = ", ".join(f"{_RAW[n]} AS {n}" for n in raw or ())
    return f"WITH r AS (SELECT *, {given} FROM part) SELECT p_partkey, {columns} FROM r {tail}"


_SPACES = "'[ \\t\\n\\x0B\\f\\r]+'"
_COMPACT = X.sql_compact
_ALIAS_SQL = "a AS (SELECT * FROM (VALUES " + ", ".join(str(row) for row in ALIASES) + ") AS a(alias, brand, root))"
_QUOTED = lambda xs: ", ".join(f"'{x}'" for x in xs)
_FILLER = _QUOTED(X.FILLER)
_SIDE = {s: f"len(list_intersect(w, [{_QUOTED(ws)}])) > 0" for s, ws in P.SIDES.items()}
_YEAR = lambda n: f"CASE WHEN {n} >= 100 THEN {n} WHEN {n} >= 70 THEN {n} + 1900 ELSE {n} + 2000 END"
_RANGE = r"'^(.+?)\s+((?:19|20)?[0-9]{2})\s*[-–/]\s*((?:19|20)?[0-9]{2})$'"

QUERIES = {
    "text_folding": (text_folding, f"""SELECT doc_id, md5({X.sql_fold("replace(nfc_normalize(text), 'ß', 'SS')")}) AS folded,
        md5(trim(regexp_replace(strip_accents(upper(replace(text, 'ß', 'SS'))), {_SPACES}, ' ', 'g'))) AS wide FROM documents"""),
    "search_words": (search_words, f"""WITH r AS (SELECT p_partkey, {X.sql_fold(_RAW["search"])} AS f FROM part),
        w AS (SELECT p_partkey, f, list_filter(string_split_regex(trim(f), '\\s+'), lambda x: {_COMPACT("x")} <> '')[1:{X.MAX_WORDS}] AS w FROM r),
        n AS (SELECT *, list_filter(w, lambda x: x NOT IN ({_FILLER})) AS n, {_COMPACT("f")} AS k FROM w)
        SELECT p_partkey, array_to_string(CASE WHEN len(n) > 0 THEN n ELSE w END, ' ') AS words, CASE WHEN length(k) >= {X.MIN_SEARCH} AND regexp_matches(k, '[0-9]') THEN k ELSE '' END AS key FROM n"""),
    "brand_resolve": (brand_resolve, f"WITH {_ALIAS_SQL}, r AS (SELECT p_partkey, regexp_replace(upper(trim({_RAW['spelling']})), ' +', ' ', 'g') AS k FROM part) SELECT p_partkey, COALESCE(brand, k) AS brand, COALESCE(root, k) AS root FROM r LEFT JOIN a ON alias = k"),
    "alias_expand": (alias_expand, f"""WITH {_ALIAS_SQL}, r AS (SELECT p_partkey, concat(' ', regexp_replace(upper(concat(p_name, ' ', p_brand)), '[^A-Z0-9]+', ' ', 'g'), ' ') AS k FROM part),
        b AS (SELECT concat(' ', regexp_replace(alias, '[^A-Z0-9]+', ' ', 'g'), ' ') AS phrase, concat(' ', regexp_replace(brand, '[^A-Z0-9]+', ' ', 'g'), ' ') AS named, brand FROM a)
        SELECT p_partkey, COALESCE(string_agg(DISTINCT brand, '|' ORDER BY brand), '') AS added FROM r LEFT JOIN b ON contains(k, phrase) AND NOT contains(k, named) GROUP BY 1"""),
    "token_contains": (token_contains, "SELECT p_partkey, CASE WHEN p_partkey = p_size THEN concat(' ', upper(p_name), ' P', p_partkey, ' ', upper(p_type), ' ') ELSE concat(' ', upper(p_name), ' P', p_partkey, ' ', upper(p_type), ' P', p_size, ' ') END AS codes FROM part WHERE p_partkey = 12 OR p_size = 12"),
    "amount_parse": (amount_parse, f"""WITH r AS (SELECT o_orderkey, {_RAW["amount"]} AS x FROM orders), e AS (SELECT *, CASE WHEN regexp_matches(x, '^-') THEN 'negative' WHEN regexp_matches(x, '^\\d+[.,]\\d{{3}}$') THEN 'ambiguous'
        WHEN regexp_matches(x, '^\\d+[.,]\\d{{4,}}$') THEN 'decimals' WHEN NOT regexp_matches(x, '^\\d+([.,]\\d{{1,2}})?$|^\\d,\\d{{3}}\\.\\d{{1,2}}$|^\\d\\.\\d{{3}},\\d{{1,2}}$') THEN 'invalid' END AS error FROM r)
        SELECT o_orderkey, CASE WHEN error IS NULL THEN CAST(CASE WHEN regexp_matches(x, '^\\d,\\d{{3}}\\.') THEN replace(x, ',', '') WHEN regexp_matches(x, '^\\d\\.\\d{{3}},') THEN replace(replace(x, '.', ''), ',', '.') ELSE replace(x, ',', '.') END AS DECIMAL(12,2)) END AS value, error FROM e"""),
    "reference_cells": (reference_cells, """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN concat('A:X1:oem;', upper(p_brand), ':', p_partkey, ':-') WHEN p_partkey % 3 = 1 THEN concat(upper(p_brand), ':', p_partkey, ':-;C:9:company') END AS refs,
        CASE WHEN p_partkey % 3 = 2 THEN 'contradiction' END AS error FROM part"""),
    "supplier_bases": (supplier_bases, _part("CASE WHEN regexp_matches(sku, '-[A-Z]{1,12}$') AND NOT contains(sku, '-LH') AND length(regexp_replace(regexp_replace(sku, '(-[A-Z]+)+$', ''), '-', '', 'g')) >= 8 THEN regexp_replace(sku, '(-[A-Z]{1,12})+$', '') ELSE '' END AS base", sku="")),
    "code_tags": (code_tags, f"""WITH r AS (SELECT p_partkey, {_RAW["sku"]} AS sku FROM part), s AS (SELECT *, regexp_replace(sku, '(-[A-Z]+)+$', '') AS base FROM r), g AS (SELECT *, list_filter(string_split(substr(sku, length(base) + 2), '-'), lambda x: x <> '') AS g FROM s)
        SELECT p_partkey, base, array_to_string(g, ',') AS tags, CASE WHEN len(list_filter(g, lambda x: x NOT IN ({_QUOTED(CLASSES)}))) > 0 THEN 'unknown' WHEN list_contains(g, 'PROMO') OR list_contains(g, 'STD') THEN 'variant' WHEN len(g) > 0 THEN 'tag' ELSE 'bare' END AS chain_class FROM g"""),
    "described_sides": (described_sides, f"""WITH r AS (SELECT p_partkey, regexp_replace(upper({_RAW["described"]}), '\\b([LR])/H\\b', '\\1H', 'g') AS d FROM part), w AS (SELECT *, regexp_extract_all(d, '[A-Z0-9]+') AS w, regexp_extract(d, {_RANGE}, 2) AS y1, regexp_extract(d, {_RANGE}, 3) AS y2 FROM r),
        y AS (SELECT *, TRY_CAST(y1 AS INTEGER) AS a, TRY_CAST(y2 AS INTEGER) AS b FROM w), z AS (SELECT *, {_YEAR("a")} AS f, {_YEAR("b")} AS l FROM y)
        SELECT p_partkey, concat_ws(',', CASE WHEN {_SIDE["front"]} AND NOT {_SIDE["rear"]} THEN 'front' END, CASE WHEN {_SIDE["left"]} AND NOT {_SIDE["right"]} THEN 'left' END, CASE WHEN {_SIDE["rear"]} AND NOT {_SIDE["front"]} THEN 'rear' END,
          CASE WHEN {_SIDE["right"]} AND NOT {_SIDE["left"]} THEN 'right' END) AS sides, CASE WHEN f <= l THEN f END AS first, CASE WHEN f <= l THEN l END AS last FROM z"""),
    "noted_references": (noted_references, _part(r"""concat(p_partkey + 90000, '01253') AS labelled, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(upper(note), '[A-Z0-9]+(?:[-./][A-Z0-9]+)*'), lambda x: regexp_replace(x, '[^A-Z0-9]', '', 'g')),
        lambda x: length(x) >= 6 AND length(regexp_replace(x, '[^0-9]', '', 'g')) >= 3))), ',') AS tokens, regexp_replace(regexp_replace(note, '[^ ]+@mail\.com', '[email]'), '\$ [0-9.]+|5 %', '[amount]', 'g') AS masked""", note="")),
    "canonical_numbers": (canonical_numbers, _part("""CASE WHEN p_size % 3 = 0 THEN 'SUZUKI' ELSE 'GM' END AS scope, CASE WHEN p_size % 3 = 0 AND p_partkey % 3 = 0 THEN concat('16100', p_partkey + 10000)
        WHEN p_size % 3 <> 0 AND p_partkey % 3 = 1 THEN CAST(p_partkey + 1000000 AS VARCHAR) WHEN p_size % 3 = 1 AND p_partkey % 3 = 2 THEN concat('0', p_partkey + 100000) ELSE replace(number, '-', '') END AS number""", number="")),
    "one_part_names": (one_part_names, "SELECT p_partkey, p_size % 3 = 0 AS one_part FROM part"),
    "make_groups": (make_groups, "SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN 'SIZES' WHEN p_type = 'ECONOMY' THEN '' WHEN p_type = 'PROMO' THEN 'P' ELSE 'BRANDS' END AS make_group FROM part"),
    "rule_categories": (rule_categories, "SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^(small|red) ring\\b') THEN 'rings' WHEN regexp_matches(p_name, '^[a-z]+ bolt') THEN 'bolts' WHEN starts_with(p_name, 'small') THEN 'small' WHEN starts_with(p_name, 'red') THEN 'red' END AS category FROM part"),
    "description_heads": (description_heads, """WITH r AS (SELECT p_partkey, string_split(upper(p_name), ' ') AS w FROM part), h AS (SELECT *, CASE WHEN w[1] = 'TINY' THEN 'SMALL' ELSE w[1] END AS head FROM r)
        SELECT p_partkey, head, CASE WHEN (head = 'SMALL' AND w[2] IN ('RING', 'BOLT')) OR (head = 'RED' AND w[2] = 'WIDGET') THEN w[2] ELSE '' END AS qualifier FROM h"""),
    "prefix_classes": (prefix_classes, _part("CASE WHEN p_size % 3 = 0 AND starts_with(number, '16100') THEN 'pump' WHEN p_size % 3 = 1 AND starts_with(number, '01000') THEN 'filter' WHEN p_size % 3 = 2 AND starts_with(number, '10010') THEN 'disc' END AS class", number="")),
    "snippets": (snippets, f"""SELECT doc_id, CASE WHEN length(text) > 140 THEN concat(substr(text, 1, 139), '…') ELSE text END AS snippet,
        COALESCE(replace(trim(regexp_replace(strip_accents(upper(replace(substr(text, 1, 40), 'ß', 'SS'))), {_SPACES}, ' ', 'g')), ' ', '_'), '') AS header, trim(COALESCE(lang, source, '')) AS title FROM documents"""),
    "typo_words": (typo_words, """WITH w AS (SELECT unnest(list_distinct(regexp_extract_all(upper(replace(text, 'ß', 'SS')), '[A-Z]{2,}'))) AS word FROM benchmark), v AS (SELECT word, COUNT(*) AS n FROM w GROUP BY 1),
        p AS (SELECT a.word, b.word AS fix, CAST(damerau_levenshtein(a.word, b.word) AS INTEGER) AS edits FROM v a JOIN v b ON a.n < 3 AND b.n >= 3 AND abs(length(a.word) - length(b.word)) <= 2)
        SELECT * FROM p WHERE edits <= CASE WHEN length(word) >= 5 THEN 2 ELSE 1 END"""),
}

#: The described parts name no kits, measures or part nouns: sides and years can contradict each other.
_OPPOSITE = " OR ".join(f"(list_contains(a.s, '{x}') AND list_contains(b.s, '{y}'))" for x, y in (("left", "right"), ("right", "left"), ("front", "rear"), ("rear", "front")))
QUERIES["spec_conflicts"] = (spec_conflicts, f"""WITH n AS ({QUERIES["described_sides"][1]}), x AS (SELECT p_partkey, {_RAW["described"]} AS described, string_split(n.sides, ',') AS s, n.first AS f, n.last AS l FROM part JOIN n USING (p_partkey))
    SELECT a.p_partkey, a.described, b.described AS next FROM x a JOIN x b ON b.p_partkey = a.p_partkey + 1 WHERE {_OPPOSITE} OR greatest(a.f, b.f) > least(a.l, b.l) AND a.f IS NOT NULL AND b.f IS NOT NULL""")  # fmt: skip
