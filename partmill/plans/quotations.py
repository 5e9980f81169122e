"""Quotations: findings, confirmations and conflicts of claims, over stand-ins made from order lines and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from partmill.operators import findings
from partmill.sources.storage import read_table as t


def quotation_findings(spark, sf):
    """Totals of findings by order status; every fifth order has confirmed what its lines asked for at first."""
    lines = t(spark, sf, "lineitem")
    k, q = F.col("l_orderkey"), F.col("l_quantity").cast("long")
    cents = lambda c: c.cast("decimal(12,2)")
    quoted = lines.select(
        k.alias("order_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("line_id"), F.least(q, F.lit(40).cast("long")).alias("requested"), F.when(q % 17 != 0, F.when(q % 13 == 0, 0).otherwise(q)).alias("quantity"),
        F.when(F.col("l_partkey") % 11 != 0, F.when(F.col("l_partkey") % 19 == 0, cents(F.lit(0))).otherwise(cents(F.col("l_extendedprice")))).alias("unit_price"), F.when(q == 39, "available").otherwise("typed").alias("quantity_source"),
        F.element_at(F.array(F.lit("engine"), F.lit("manual"), F.lit("previous")), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("price_source"), F.when(F.col("l_partkey") % 2 == 0, "old").otherwise("now").alias("stored"),
        F.lit(45).cast("long").alias("available"), (F.col("l_partkey") % 23 != 0).alias("identity_ok"), F.lit("i").alias("identity"), F.when(F.col("l_partkey") % 3 > 0, cents(F.lit(1000))).alias("suggested"), cents(F.lit(900)).alias("floor"),
        F.lit("now").alias("fingerprint"), F.when(F.col("l_partkey") % 3 > 0, "priced").otherwise("missing").alias("status"), F.when(F.col("l_linenumber") == 1, F.array(F.lit("rule_conflict"))).otherwise(F.array(F.lit("currency_parity"))).alias("codes"),
        F.lit("block").alias("stock_policy"), F.lit("confirm").alias("request_policy"),
    )
    orders = t(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), (F.col("o_orderkey") % 29 == 0).alias("outdated"), (F.col("o_custkey") % 2 == 0).alias("no_profile"), F.lit(True).alias("listed"), "o_orderstatus")
    found = findings.line_findings(quoted).unionByName(findings.order_findings(orders, quoted))
    given = quoted.where(F.col("order_id") % 5 == 0).select("order_id", "line_id", F.lit("identity_changed").alias("code"), F.lit("i").alias("context"))
    totals = findings.finding_totals(findings.acknowledged(found, given))
    return totals.join(orders, "order_id").groupBy("o_orderstatus").agg(*[F.sum(c).cast("long").alias(c) for c in ("blocking", "to_confirm", "info")])


def claim_conflicts(spark, sf):
    """Parts that claim their name and size as a key, some of them used elsewhere."""
    p, k = t(spark, sf, "part"), F.col("p_partkey")
    key = F.concat_ws("-", "p_name", F.col("p_size").cast("string"))
    tier = F.when(k % 5 == 0, "CURRENT_IS_OEM").when(k % 5 == 1, "NONE").otherwise("BASE_CLAIM")
    kinds = [name for name, _ in findings.CONFLICTS]
    uses = p.where(k % 7 == 0).select(k.alias("part_id"), F.explode(F.array(F.element_at(F.array(*map(F.lit, kinds)), (F.col("p_size") % 4 + 1).cast("int")), F.lit("partcode"))).alias("kind"))
    uses = uses.where((F.col("kind") != "partcode") | (F.col("part_id") % 14 == 0))
    found = findings.claim_conflicts(p.select(k.alias("part_id"), key.alias("key"), tier.alias("tier")), p.select(key.alias("key"), k.alias("part_id")), uses)
    return found.select("part_id", "conflict", "n_shared", F.array_join("shared_with", ",").alias("shared_with"))


QUERIES = {
    "quotation_findings": (quotation_findings, """WITH l AS (SELECT l_orderkey AS o, l_partkey AS p, l_linenumber AS n, least(CAST(l_quantity AS BIGINT), 40) AS requested, CASE WHEN CAST(l_quantity AS BIGINT) % 17 <> 0 THEN CASE WHEN CAST(l_quantity AS BIGINT) % 13 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END END AS q,
          CASE WHEN l_partkey % 11 <> 0 THEN CASE WHEN l_partkey % 19 = 0 THEN 0 ELSE CAST(l_extendedprice AS DECIMAL(12,2)) END END AS price, CAST(l_quantity AS BIGINT) = 39 AS reduced, l_suppkey % 3 AS src, l_partkey % 3 > 0 AS priced FROM lineitem),
        c AS (SELECT o, (q IS NULL)::INT + COALESCE(price IS NULL AND q <> 0, FALSE)::INT + COALESCE(q <> 0 AND p % 23 <> 0 AND q > 45, FALSE)::INT AS blocking,
          COALESCE(q <> 0 AND p % 23 = 0 AND o % 5 <> 0, FALSE)::INT + COALESCE(q <> 0 AND q > requested, FALSE)::INT + COALESCE(q <> 0 AND price = 0, FALSE)::INT + COALESCE(q <> 0 AND price < 900, FALSE)::INT
            + COALESCE(q <> 0 AND src = 0 AND p % 2 = 0 AND price IS NOT NULL AND (NOT priced OR price <> 1000), FALSE)::INT AS to_confirm,
          COALESCE(reduced AND q < requested, FALSE)::INT + COALESCE(q = 0, FALSE)::INT + COALESCE(priced AND price <> 1000 AND src > 0, FALSE)::INT + (NOT priced AND q IS DISTINCT FROM 0)::INT + (n = 1 AND q IS DISTINCT FROM 0)::INT AS info FROM l),
        s AS (SELECT o, bool_and(COALESCE(q = 0, FALSE)) AS zero, bool_or(n <> 1) AS parity FROM l GROUP BY 1),
        t AS (SELECT o, SUM(blocking) AS blocking, SUM(to_confirm) AS to_confirm, SUM(info) AS info FROM c GROUP BY 1)
        SELECT o_orderstatus, CAST(SUM(COALESCE(blocking, 0) + (o_orderkey % 29 = 0)::INT + COALESCE(zero, FALSE)::INT) AS BIGINT) AS blocking, CAST(SUM(COALESCE(to_confirm, 0)) AS BIGINT) AS to_confirm,
          CAST(SUM(COALESCE(info, 0) + (o_custkey % 2 = 0)::INT + COALESCE(parity, FALSE)::INT) AS BIGINT) AS info FROM orders LEFT JOIN t ON t.o = o_orderkey LEFT JOIN s ON s.o = o_orderkey GROUP BY 1"""),
    "claim_conflicts": (claim_conflicts, """WITH g AS (SELECT p_partkey AS part_id, concat(p_name, '-', p_size) AS key, p_partkey % 5 AS m, CASE WHEN p_partkey % 7 = 0 THEN list_distinct([p_size % 4, CASE WHEN p_partkey % 14 = 0 THEN 3 ELSE p_size % 4 END]) END AS uses, p_partkey % 14 = 0 AS coded FROM part),
        u AS (SELECT part_id, list_filter(uses, lambda x: NOT (m = 0 AND x = 2) AND (x <> 3 OR coded)) AS kinds FROM g WHERE uses IS NOT NULL),
        s AS (SELECT a.part_id, COUNT(*) AS n, array_to_string(list_sort(list(b.part_id))[1:10], ',') AS others FROM g a JOIN g b ON a.key = b.key AND a.part_id <> b.part_id WHERE a.m > 1 GROUP BY 1)
        SELECT g.part_id, CASE WHEN len(kinds) > 0 THEN ['base_is_existing_active_part', 'base_is_retired_part_sku', 'base_is_retired_sku_already_merged_into_this_part', 'base_is_alterno_of_other_part'][list_min(kinds) + 1] ELSE 'shared_base_family' END AS conflict, COALESCE(n, 0) AS n_shared, COALESCE(others, '') AS shared_with
        FROM g LEFT JOIN u ON u.part_id = g.part_id LEFT JOIN s ON s.part_id = g.part_id WHERE m <> 1 AND (len(kinds) > 0 OR n > 0)"""),
}
