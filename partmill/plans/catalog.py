"""Catalog search: folded words and codes, ranking, filters and disjunctive facets over parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partmill.functions.text import code_key, compact, fold, sql_code_key, sql_compact, sql_fold
from partmill.operators.relational import all_of, with_flag
from partmill.plans.availability import part_availability, stock_band
from partmill.sources.standins import SQL, supplier_items
from partmill.sources.storage import read_table as t

PAGE = 50
#: The search that the queries run, and the filters of the facets.
WORDS, CODE = ("RING", "BRAND#1"), "Brand#11-12"
CHOSEN = {"brand": ("Brand#1", "Brand#2", "Brand#3"), "grupo": ("ECONOMY", "STANDARD")}

_BAND = "CASE WHEN units IS NULL THEN 'unknown' WHEN units = 0 THEN 'sold_out' WHEN units <= 5 THEN 'low' WHEN units <= 20 THEN 'medium' ELSE 'high' END"
_DOC = f"""WITH {SQL["item"]}, avail AS (SELECT part_id, CAST(SUM(GREATEST(reported - reserved, 0)) AS BIGINT) AS units FROM item JOIN supplier ON s_suppkey = supplier_id WHERE s_acctbal >= 0 GROUP BY 1),
doc AS (SELECT p_partkey AS part_id, concat(p_brand, '-', p_partkey) AS code, p_name AS name, p_brand AS brand, split_part(p_type, ' ', 1) AS grupo, CAST(p_size AS BIGINT) AS size,
  CASE WHEN p_partkey % 4 <> 0 THEN p_partkey - p_partkey % 4 END AS merged_into, units, {_BAND} AS band, {sql_fold("concat(p_name, ' ', p_type, ' ', p_brand)")} AS text,
  {sql_code_key("concat(p_brand, '-', p_partkey)")} AS clave FROM part LEFT JOIN avail ON part_id = p_partkey)"""


def search_documents(spark, sf) -> DataFrame:
    """One row a part: what a search reads."""
    stock = part_availability(supplier_items(spark, sf), t(spark, sf, "supplier")).select("part_id", "units")
    code = F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string"))
    parts = t(spark, sf, "part").join(stock, F.col("p_partkey") == F.col("part_id"), "left")
    return parts.select(
        F.col("p_partkey").alias("part_id"), code.alias("code"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("grupo"),
        F.col("p_size").cast("long").alias("size"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_partkey") - F.col("p_partkey") % 4).alias("merged_into"), "units", stock_band(F.col("units")).alias("band"),
        fold(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("text"), code_key(code).alias("clave"),
    )


def storefront(docs: DataFrame) -> DataFrame:
    """What is on sale: lines that were not merged away and have been offered."""
    return docs.where("merged_into IS NULL AND units IS NOT NULL")


def search_document(spark, sf):
    return search_documents(spark, sf)


def scan_storefront(spark, sf):
    return storefront(search_documents(spark, sf)).select("part_id", "code")


def scan_catalog_states(spark, sf):
    return search_documents(spark, sf).where(F.col("band").isin("low", "high") | F.col("merged_into").isNotNull()).select("part_id", "band", "merged_into")


def search_words_all(spark, sf):
    return search_documents(spark, sf).where(all_of([F.contains("text", F.lit(w)) for w in WORDS])).select("part_id", "name")


def search_code_exact(spark, sf):
    return search_documents(spark, sf).where(F.col("clave") == code_key(F.lit(CODE))).select("part_id", "code")


def _rank() -> Column:
    key = code_key(F.lit(CODE))
    return F.when(F.col("clave") == key, 0).when(F.col("clave").startswith(key), 1).otherwise(2)


def search_ranked(spark, sf):
    hits = search_documents(spark, sf).where(F.col("clave").startswith(code_key(F.lit(CODE))) | F.contains("text", F.lit("12")))
    return hits.select("part_id", "code", _rank().cast("long").alias("rank")).orderBy("rank", "code", "part_id").limit(PAGE)


def regex_whole_word(spark, sf):
    return search_documents(spark, sf).where(F.col("text").rlike("(^|[^A-Z0-9])RING([^A-Z0-9]|$)")).select("part_id", "text")


def code_compact_equal(spark, sf):
    return search_documents(spark, sf).where(compact(F.col("code")) == compact(F.lit(CODE))).select("part_id", "code")


def grid_search(spark, sf):
    has = lambda c: F.contains(F.upper(c), F.upper(F.lit("rand#1")))
    return search_documents(spark, sf).where(has("code") | has("name") | has("brand")).select("part_id")


def stock_bands(spark, sf):
    return search_documents(spark, sf).groupBy("band").agg(F.count("*").alias("parts"), F.sum("units").alias("units"))


def facet_filter_combined(spark, sf):
    return search_documents(spark, sf).where(all_of([F.col(k).isin(*v) for k, v in CHOSEN.items()])).select("part_id", "brand", "grupo")


def facets_disjunctive(spark, sf):
    """Each facet's counts leave out its own filter; chosen values stay with 0."""
    docs = search_documents(spark, sf)
    out = []
    for facet, values in CHOSEN.items():
        others = all_of([F.col(k).isin(*v) for k, v in CHOSEN.items() if k != facet])
        counts = docs.where(others).groupBy(F.col(facet).alias("value")).agg(F.count("*").alias("n"))
        chosen = spark.createDataFrame([(v,) for v in values], "value string").withColumn("chosen", F.lit(True))
        both = counts.join(chosen, "value", "full_outer")
        out.append(both.select(F.lit(facet).alias("facet"), "value", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("chosen", F.lit(False)).alias("chosen")))
    return reduce(DataFrame.unionByName, out)


def facet_stock_bands(spark, sf):
    count = lambda band: F.count_distinct(F.when(F.col("band") == band, F.col("part_id"))).alias(band)
    return storefront(search_documents(spark, sf)).agg(*[count(b) for b in ("sold_out", "low", "medium", "high")], F.count_if(F.col("units") > 0).alias("in_stock"))


def exists_flag(spark, sf):
    ordered = t(spark, sf, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("part_id"))
    return with_flag(search_documents(spark, sf).select("part_id", "brand"), ordered, "part_id", "bulk")


def page_offset(spark, sf):
    return search_documents(spark, sf).select("part_id", "code").orderBy("code", "part_id").offset(PAGE).limit(PAGE)


def keyset_page(spark, sf):
    return search_documents(spark, sf).where("part_id < 150").select("part_id", "code").orderBy(F.desc("part_id")).limit(PAGE + 1)


def null_order(spark, sf):
    return search_documents(spark, sf).select("part_id", "units").orderBy(F.col("units").desc_nulls_last(), "part_id").limit(PAGE)


def stable_sort_alias(spark, sf):
    return search_documents(spark, sf).select("part_id", "brand", F.col("units").alias("stock")).orderBy(F.col("brand").asc_nulls_first(), F.col("stock").asc_nulls_first(), "part_id").limit(PAGE)


def codepoint_sort(spark, sf):
    return search_documents(spark, sf).select("name", "part_id").orderBy("name", "part_id").limit(PAGE)


def hash_sample(spark, sf):
    return search_documents(spark, sf).select("part_id", F.md5(F.col("part_id").cast("string")).alias("digest")).orderBy("digest").limit(PAGE)


def content_fingerprint(spark, sf):
    """A digest of each brand's rows, whatever their order: rows are hashed, then the sorted hashes of each of 256 buckets, then
    the buckets' digests, so no list holds a whole brand."""
    row = F.sha2(F.concat_ws("|", F.col("part_id").cast("string"), "code", "band"), 256)
    hashed = search_documents(spark, sf).select("brand", row.alias("h")).withColumn("bucket", F.substring("h", 1, 2))
    buckets = hashed.groupBy("brand", "bucket").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), "\n"), 256).alias("h"))
    return buckets.groupBy("brand").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "h"))), lambda x: x["h"]), "\n"), 256).alias("fingerprint"))


def vocabulary(spark, sf):
    words = search_documents(spark, sf).select("part_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("parts"))


def status_case(spark, sf):
    kind = F.when(F.col("merged_into").isNotNull(), "merged").when(F.col("units").isNull(), "draft").when(F.col("units") == 0, "empty").otherwise("live")
    return search_documents(spark, sf).groupBy(kind.alias("status")).agg(F.count("*").alias("n"))


def scope_own_parts(spark, sf):
    """Only what the person's own suppliers offer: the scope is applied before everything else."""
    own = supplier_items(spark, sf).where("supplier_id IN (1, 2, 3)").select("part_id").distinct()
    return search_documents(spark, sf).join(own, "part_id", "left_semi").select("part_id", "band")


def _twin(columns: str, where: str = "", tail: str = "") -> str:
    return f"{_DOC} SELECT {columns} FROM doc {'WHERE ' + where if where else ''} {tail}"


_KEY = sql_code_key(f"'{CODE}'")
_BRANDS, _GRUPOS = (", ".join(f"'{v}'" for v in CHOSEN[k]) for k in ("brand", "grupo"))

QUERIES = {
    "search_document": (search_document, _twin("*")),
    "scan_storefront": (scan_storefront, _twin("part_id, code", "merged_into IS NULL AND units IS NOT NULL")),
    "scan_catalog_states": (scan_catalog_states, _twin("part_id, band, merged_into", "band IN ('low', 'high') OR merged_into IS NOT NULL")),
    "search_words_all": (search_words_all, _twin("part_id, name", " AND ".join(f"contains(text, '{w}')" for w in WORDS))),
    "search_code_exact": (search_code_exact, _twin("part_id, code", f"clave = {_KEY}")),
    "search_ranked": (search_ranked, _twin(f"part_id, code, CAST(CASE WHEN clave = {_KEY} THEN 0 WHEN starts_with(clave, {_KEY}) THEN 1 ELSE 2 END AS BIGINT) AS rank", f"starts_with(clave, {_KEY}) OR contains(text, '12')", f"ORDER BY rank, code, part_id LIMIT {PAGE}")),
    "regex_whole_word": (regex_whole_word, _twin("part_id, text", "regexp_matches(text, '(^|[^A-Z0-9])RING([^A-Z0-9]|$)')")),
    "code_compact_equal": (code_compact_equal, _twin("part_id, code", f"{sql_compact('code')} = {sql_compact(repr(CODE))}")),
    "grid_search": (grid_search, _twin("part_id", " OR ".join(f"contains(upper({c}), upper('rand#1'))" for c in ("code", "name", "brand")))),
    "stock_bands": (stock_bands, _twin("band, COUNT(*) AS parts, CAST(SUM(units) AS BIGINT) AS units", "", "GROUP BY 1")),
    "facet_filter_combined": (facet_filter_combined, _twin("part_id, brand, grupo", f"brand IN ({_BRANDS}) AND grupo IN ({_GRUPOS})")),
    "facets_disjunctive": (facets_disjunctive, _DOC + f""", b AS (SELECT brand AS value, COUNT(*) AS n FROM doc WHERE grupo IN ({_GRUPOS}) GROUP BY 1), g AS (SELECT grupo AS value, COUNT(*) AS n FROM doc WHERE brand IN ({_BRANDS}) GROUP BY 1),
        cb AS (SELECT unnest([{_BRANDS}]) AS value), cg AS (SELECT unnest([{_GRUPOS}]) AS value)
        SELECT 'brand' AS facet, COALESCE(b.value, cb.value) AS value, COALESCE(n, 0) AS n, cb.value IS NOT NULL AS chosen FROM b FULL JOIN cb ON b.value = cb.value
        UNION ALL SELECT 'grupo', COALESCE(g.value, cg.value), COALESCE(n, 0), cg.value IS NOT NULL FROM g FULL JOIN cg ON g.value = cg.value"""),
    "facet_stock_bands": (facet_stock_bands, _twin("COUNT(*) FILTER (band = 'sold_out') AS sold_out, COUNT(*) FILTER (band = 'low') AS low, COUNT(*) FILTER (band = 'medium') AS medium, COUNT(*) FILTER (band = 'high') AS high, COUNT(*) FILTER (units > 0) AS in_stock", "merged_into IS NULL AND units IS NOT NULL")),
    "exists_flag": (exists_flag, _twin("part_id, brand, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = part_id AND l_quantity >= 50) AS bulk")),
    "page_offset": (page_offset, _twin("part_id, code", "", f"ORDER BY code, part_id LIMIT {PAGE} OFFSET {PAGE}")),
    "keyset_page": (keyset_page, _twin("part_id, code", "part_id < 150", f"ORDER BY part_id DESC LIMIT {PAGE + 1}")),
    "null_order": (null_order, _twin("part_id, units", "", f"ORDER BY units DESC NULLS LAST, part_id LIMIT {PAGE}")),
    "stable_sort_alias": (stable_sort_alias, _twin("part_id, brand, units AS stock", "", f"ORDER BY brand NULLS FIRST, units NULLS FIRST, part_id LIMIT {PAGE}")),
    "codepoint_sort": (codepoint_sort, _twin("name, part_id", "", f"ORDER BY name, part_id LIMIT {PAGE}")),
    "hash_sample": (hash_sample, _twin("part_id, md5(CAST(part_id AS VARCHAR)) AS digest", "", f"ORDER BY digest LIMIT {PAGE}")),
    "content_fingerprint": (content_fingerprint, _DOC + """, h AS (SELECT brand, sha256(concat(part_id, '|', code, '|', band)) AS h FROM doc), b AS (SELECT brand, substr(h, 1, 2) AS bucket, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM h GROUP BY 1, 2)
        SELECT brand, sha256(string_agg(h, chr(10) ORDER BY bucket)) AS fingerprint FROM b GROUP BY 1"""),
    "vocabulary": (vocabulary, _DOC + ", w AS (SELECT part_id, unnest(list_distinct(string_split(text, ' '))) AS word FROM doc) SELECT word, COUNT(*) AS parts FROM w GROUP BY 1"),
    "status_case": (status_case, _twin("CASE WHEN merged_into IS NOT NULL THEN 'merged' WHEN units IS NULL THEN 'draft' WHEN units = 0 THEN 'empty' ELSE 'live' END AS status, COUNT(*) AS n", "", "GROUP BY 1")),
    "scope_own_parts": (scope_own_parts, _twin("part_id, band", "part_id IN (SELECT part_id FROM item WHERE supplier_id IN (1, 2, 3))")),
}
