"""What stands in the way of a quotation: findings by line and order, confirmations tied to what they were given for, and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partmill.operators.matching import smallest_of_each

#: A price's share after the point, as contexts show it.
_CENTS = "decimal(12,2)"
#: Kinds of conflict by rank, with the use that makes each; none of them is a base that several parts claim.
CONFLICTS = (
    ("active_sku", "base_is_existing_active_part"), ("retired_sku", "base_is_retired_part_sku"), ("retired_sku_merged_into_this", "base_is_retired_sku_already_merged_into_this_part"),
    ("partcode", "base_is_alterno_of_other_part"),
)
SHARED_BASE = "shared_base_family"
#: Tiers that claim a key, and those whose part's own code the key is.
CLAIMING, CURRENT = ("CURRENT_IS_OEM", "CURRENT_LIKELY_OEM", "BASE_CLAIM", "LOCAL_XREF"), ("CURRENT_IS_OEM", "CURRENT_LIKELY_OEM")
#: Others shown.
SHOWN = 10


def _finding(condition: Column, code: str | Column, severity: str | Column, context: Column | None = None) -> Column:
    name = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(condition, F.struct(name(code).alias("code"), name(severity).alias("severity"), F.coalesce(context, F.lit("")).alias("context") if context is not None else F.lit("").alias("context")))


def line_findings(lines: DataFrame) -> DataFrame:
    """(order_id, line_id, code, severity, context) of quoted lines.

    lines: order_id, line_id, requested, quantity, unit_price, quantity_source, price_source (engine, manual, previous), stored (fingerprint
    that the price was taken with), available, identity_ok, identity (hash of the item as it is), suggested, floor, fingerprint, status
    and codes of the price as the engine gives it now (all null where it was not asked), stock_policy and request_policy (the severity
    of offering more than there is, or was asked for).  A missing quantity or price is null; 0 is an answer."""
    q, price, suggested = F.col("quantity"), F.col("unit_price").cast(_CENTS), F.col("suggested").cast(_CENTS)
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    offered, asked_engine = F.coalesce(q != 0, F.lit(False)), F.col("fingerprint").isNotNull()
    has = lambda code: F.coalesce(F.array_contains("codes", code), F.lit(False)) & ~F.coalesce(q == 0, F.lit(False))
    known = F.coalesce(F.col("identity_ok"), F.lit(False))
    differs = suggested.isNotNull() & price.isNotNull() & (price != suggested)
    moved = asked_engine & (F.col("price_source") == "engine") & price.isNotNull() & (F.col("stored") != "") & (F.col("stored") != F.col("fingerprint")) & ~price.eqNullSafe(suggested)
    rules = [
        _finding(q.isNull(), "quantity_missing", "block"),
        _finding(price.isNull() & offered, "price_missing", "block"),
        _finding(offered & ~known, "identity_changed", "confirm", F.col("identity")),
        _finding(offered & known & (q > F.col("available")), "offered_gt_available", F.col("stock_policy"), text(q, ">", F.col("available"))),
        _finding(offered & (q > F.col("requested")), "offered_gt_requested", F.col("request_policy"), text(q, ">", F.col("requested"))),
        _finding(offered & (price == 0), "zero_price", "confirm", text(q, "@0.00")),
        _finding(offered & (price < F.col("floor")), "below_floor", "confirm", text(price, "<", F.col("floor").cast(_CENTS))),
        _finding(offered & moved, "stale_price", "confirm", text(F.substring("stored", 1, 12), ">", F.substring("fingerprint", 1, 12))),
        _finding((F.col("quantity_source") == "available") & (q < F.col("requested")), "reduced_to_stock", "info"),
        _finding(q == 0, "zero_offered", "info"),
        _finding(differs & F.col("price_source").isin("manual", "previous"), F.when(F.col("price_source") == "manual", "manual_price").otherwise("differs_from_list"), "info"),
        _finding((F.col("status") == "missing") & ~F.coalesce(q == 0, F.lit(False)), "no_list_price", "info"),
        _finding(has("fallback_list"), "fallback_list", "info"),
        _finding(has("rule_conflict"), "rule_conflict", "info"),
    ]
    return lines.select("order_id", "line_id", F.inline(F.array_compact(F.array(*rules))))


def order_findings(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """(order_id, line_id null, code, severity, context) of whole quotations.

    orders: order_id, outdated, no_profile, listed (the engine named a price list); lines as above."""
    per = lines.groupBy("order_id").agg(
        F.bool_and(F.coalesce(F.col("quantity") == 0, F.lit(False))).alias("zero"), F.bool_or(F.coalesce(F.array_contains("codes", "currency_parity"), F.lit(False))).alias("parity"), F.bool_or(F.col("status") == "currency_mismatch").alias("mismatch")
    )
    found = orders.join(per, "order_id", "left")
    rules = [
        _finding(F.col("outdated"), "draft_outdated", "block"), _finding(F.col("zero"), "all_zero", "block"), _finding(F.col("no_profile") & F.col("listed"), "no_profile", "info"),
        _finding(F.col("parity"), "currency_parity", "info"), _finding(F.col("mismatch"), "currency_mismatch", "info"),
    ]
    return found.select("order_id", F.lit(None).cast(lines.schema["line_id"].dataType).alias("line_id"), F.inline(F.array_compact(F.array(*rules))))


def acknowledged(found: DataFrame, given: DataFrame) -> DataFrame:
    """``found`` with ``acknowledged``: whether a confirmation (order_id, line_id, code, context) was given for this very context.  Only
    what asks for one can be confirmed; another context voids it."""
    name = F.struct("order_id", "line_id", "code", "context")
    seen = given.select(name.alias("_given")).distinct()
    both = found.withColumn("_name", name).join(seen, F.col("_name").eqNullSafe(F.col("_given")), "left")
    return both.withColumn("acknowledged", (F.col("severity") == "confirm") & F.col("_given").isNotNull()).drop("_name", "_given")


def finding_totals(found: DataFrame) -> DataFrame:
    """(order_id, blocking, to_confirm, info) of acknowledged findings."""
    return found.groupBy("order_id").agg(
        F.count_if(F.col("severity") == "block").alias("blocking"), F.count_if((F.col("severity") == "confirm") & ~F.col("acknowledged")).alias("to_confirm"), F.count_if(F.col("severity") == "info").alias("info")
    )


# ---- claims on a key -----------------------------------------------------------------------------------------------


def claim_conflicts(graded: DataFrame, claims: DataFrame, uses: DataFrame, claiming: tuple[str, ...] = CLAIMING, current: tuple[str, ...] = CURRENT) -> DataFrame:
    """(part_id, key, conflict, n_shared, shared_with) of parts whose key is in use already.

    graded: part_id, key, tier; claims: key, part_id; uses: part_id, kind (of ``CONFLICTS``).  Only parts of a ``claiming`` tier can be in
    conflict.  The kind of use with the highest rank names it; with none, it is a base that other parts claim, too.  For parts of a
    ``current`` tier the key is their own code: others' claims are siblings, and a retired code that was merged into the part is
    none of its conflicts.  ``shared_with``: the ``SHOWN`` smallest others."""
    own = graded.where(F.col("tier").isin(*claiming)).withColumn("own_code", F.col("tier").isin(*current))
    # A key's claims are counted, and its smallest kept, one more than are shown as one can be the part's own: parts meet these, not
    # each claim, which would be pairs as the square of a common key.
    claimed = claims.select("key", F.col("part_id").alias("other")).where("key is not null and other is not null").distinct()
    least = smallest_of_each(claimed, "key", "other", SHOWN + 1).groupBy("key").agg(F.array_sort(F.collect_list("other")).alias("least"))
    asked = own.where("not own_code").select("key", "part_id").join(claimed.groupBy("key").agg(F.count("*").alias("n")), "key").join(least, "key")
    asked = asked.join(claimed.select("key", F.col("other").alias("part_id"), F.lit(1).alias("self")), ["key", "part_id"], "left").withColumn("n", F.col("n") - F.coalesce("self", F.lit(0)))
    others = F.slice(F.filter("least", lambda x: x != F.col("part_id")), 1, SHOWN)
    shared = asked.where("n > 0").groupBy("part_id").agg(F.sum("n").alias("n_shared"), F.slice(F.array_sort(F.flatten(F.collect_list(others))), 1, SHOWN).alias("shared_with"))
    kinds = own.join(uses.select("part_id", "kind").distinct(), "part_id").where(~(F.col("own_code") & (F.col("kind") == "retired_sku_merged_into_this")))
    place = F.coalesce(*[F.when(F.col("kind") == kind, k) for k, (kind, _) in enumerate(CONFLICTS)])
    first = kinds.groupBy("part_id").agg(F.min(place).alias("place"), F.lit(True).alias("used"))
    both = own.join(first, "part_id", "left").join(shared, "part_id", "left").where("used or n_shared > 0")
    name = F.coalesce(*[F.when(F.col("place") == k, label) for k, (_, label) in enumerate(CONFLICTS)], F.lit(SHARED_BASE))
    return both.select("part_id", "key", name.alias("conflict"), F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"), F.coalesce("shared_with", F.array().cast(shared.schema["shared_with"].dataType)).alias("shared_with"))
