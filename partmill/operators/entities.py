"""Pointers followed to their end, codes matched by shared keys under vetoes, families of codes, and rules on typed field values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partmill.functions.parts import application, supplier_base
from partmill.functions.text import compact
from partmill.sources.storage import materialize

#: Steps that a chain of pointers is followed.
MAX_CHAIN = 10
#: Letters of a key that two codes can share.
MIN_KEY = 5


def follow_pointers(rows: DataFrame, node: str, target: str, steps: int = MAX_CHAIN) -> DataFrame:
    """(node, end): where each row's pointer leads within ``steps`` steps.

    A row without a pointer ends at itself, and so does a pointer to a node that has no row.  A longer chain, and a loop, ends
    where ``steps`` steps lead.  Steps are doubled, so a chain of any length takes a few joins; they end when nothing moves."""
    save = lambda df: materialize(df, "pointers")
    jump = save(rows.select(F.col(node).alias("node"), F.coalesce(target, node).alias("end")).where("node is not null").groupBy("node").agg(F.min("end").alias("end")))
    ends = jump.select("node", F.col("node").alias("end"))

    def then(first: DataFrame, second: DataFrame) -> DataFrame:
        onward = second.select(F.col("node").alias("end"), F.col("end").alias("further"))
        return first.join(onward, "end", "left").select("node", F.coalesce("further", "end").alias("end"))

    while steps:
        if steps & 1:
            ends = save(then(ends, jump))
        steps >>= 1
        if steps:
            twice = save(then(jump, jump).withColumnRenamed("end", "twice"))
            if jump.join(twice, "node").where("end <> twice").isEmpty():
                return then(ends, jump).select(F.col("node").alias(node), "end")
            jump = twice.withColumnRenamed("twice", "end")
    return ends.select(F.col("node").alias(node), "end")


# ---- shared keys ---------------------------------------------------------------------------------------------------


def key_overlap(left: DataFrame, right: DataFrame, least: int = 1) -> DataFrame:
    """(left_id, right_id, overlap) of sets (left_id, key) and (right_id, key) that share at least ``least`` keys; rows distinct.

    Left sets are looked up by their rarest keys only: of s keys all but ``least`` - 1, as sets that share ``least`` keys share one
    of these.  The frequent keys are looked up by no one they could not decide; candidates are then counted on all keys."""
    counted = lambda pairs: pairs.groupBy("left_id", "right_id").agg(F.count("*").alias("overlap")).where(F.col("overlap") >= least)
    if least == 1:
        return counted(left.join(right, "key"))
    often = right.groupBy("key").agg(F.count("*").alias("_n"))
    rank = F.row_number().over(Window.partitionBy("left_id").orderBy("_n", "key"))
    known = left.join(often, "key")  # a key that no right set has decides nothing
    ranked = known.withColumns({"_rank": rank, "_keys": F.count("*").over(Window.partitionBy("left_id"))})
    looked_up = ranked.where(F.col("_rank") <= F.col("_keys") - (least - 1)).select("left_id", "key")
    candidates = looked_up.join(right, "key").select("left_id", "right_id").distinct()
    return counted(candidates.join(known.select("left_id", "key"), "left_id").join(right, ["right_id", "key"]))


def link_by_keys(items: DataFrame, item_keys: DataFrame, parts: DataFrame, part_keys: DataFrame) -> DataFrame:
    """(part_id, item_id, method, overlap, clean, duplicate): which catalogue items stand for which parts.

    items: item_id, product_type, makes (array of make groups); item_keys: item_id, kind (oem: number of the original; brand: the
    item's own codes), code; parts: part_id, retired, product_type (null: not classified), makes; part_keys: part_id, kind (oem, raw),
    code.  Codes count in compact spelling from ``MIN_KEY`` characters on, brand codes with a digit.

    An item's oem numbers meet a part's oem and raw keys, its brand codes raw keys.  Vetoes: retired parts; parts of another product
    type (they join on the type, so a key that many types share is no hot key); parts of other makes, and parts or items without a
    make unless an oem number met.  A part with several items keeps them only if all are of one product type and one oem number of
    all of them met; else all go.  ``clean``: by a brand code, or by an oem number that no other item has.  ``duplicate``: the item
    has several parts."""
    own = item_keys.select("item_id", "kind", compact(F.col("code")).alias("key")).where((F.length("key") >= MIN_KEY) & ((F.col("kind") == "oem") | F.col("key").rlike("[0-9]"))).distinct()
    printed = own.where("kind = 'oem'").groupBy("key").agg(F.count("*").alias("printed"))
    asked = own.join(printed, "key", "left").join(items.select("item_id", F.col("product_type").alias("wanted"), F.col("makes").alias("item_makes")), "item_id")
    filed = part_keys.select("part_id", F.col("kind").alias("filed"), compact(F.col("code")).alias("key")).where(F.length("key") >= MIN_KEY).distinct()
    filed = filed.join(parts.where("not retired").select("part_id", F.col("product_type").alias("named"), F.col("makes").alias("part_makes")), "part_id")
    fits = (F.col("kind") == "oem") | (F.col("filed") == "raw")
    # Classified parts meet items of their type only; the others meet by the key.
    typed = asked.join(filed.where("named is not null"), (asked["key"] == filed["key"]) & (F.col("wanted") == F.col("named"))).drop(filed["key"])
    free = asked.join(filed.where("named is null"), "key")
    met = typed.select(free.columns).unionByName(free).where(fits)
    per = met.groupBy("part_id", "item_id").agg(
        F.bool_or(F.col("kind") == "oem").alias("by_oem"), F.count_distinct("key").alias("overlap"), F.first("item_makes").alias("item_makes"), F.first("part_makes").alias("part_makes"),
        F.first("wanted").alias("wanted"), F.bool_or((F.col("kind") == "brand") | (F.col("printed") == 1)).alias("clean"),
    )
    known = (F.size(F.coalesce("item_makes", F.array())) > 0) & (F.size(F.coalesce("part_makes", F.array())) > 0)
    links = per.where(F.when(known, F.arrays_overlap("item_makes", "part_makes")).otherwise(F.col("by_oem")))
    links = materialize(links.select("part_id", "item_id", F.when(F.col("by_oem"), "oem").otherwise("brand").alias("method"), "overlap", "clean", "wanted"), "key-links")
    of_part = links.groupBy("part_id").agg(F.count("*").alias("items"), F.count_distinct("wanted").alias("types"))
    common = met.where("kind = 'oem'").select("part_id", "item_id", "key").distinct().join(links.select("part_id", "item_id"), ["part_id", "item_id"], "left_semi")
    common = common.groupBy("part_id", "key").agg(F.count("*").alias("n")).join(of_part, "part_id").where("n = items").select("part_id").distinct().withColumn("shared", F.lit(True))
    kept = of_part.join(common, "part_id", "left").where("items = 1 or (types = 1 and shared)").select("part_id")
    links = links.join(kept, "part_id", "left_semi")
    several = per.join(links.select("part_id", "item_id"), ["part_id", "item_id"], "left_semi").groupBy("item_id").agg((F.count("*") > 1).alias("duplicate"))
    return links.join(several, "item_id").select("part_id", "item_id", "method", "overlap", "clean", "duplicate")


# ---- families ------------------------------------------------------------------------------------------------------


def families(rows: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """(base, sku, proposed, description, warned) of codes that belong to the code without their company suffix.

    rows: sku, description, is_oem, position (order, for ties); blocked: (base) that must not be proposed.  Where the base code is a
    row, its family are the codes whose description fits its own.  Where it is not, a parent is proposed for two or more codes
    whose descriptions all fit each other, with the description that most of them have.  Descriptions fit if they are equal and
    not empty, or equal but for years at the end that overlap: of many, all pairs overlap if the latest start is not after the
    earliest end, so no two rows are compared.  ``warned``: some description differs from the parent's."""
    plain = F.regexp_replace(F.upper(F.trim(F.coalesce("description", F.lit("")))), r"\s+", " ")
    named = rows.withColumns({"_text": plain, "_base": F.when(~F.col("is_oem"), supplier_base(F.col("sku"))).otherwise("")}).withColumn("_app", application(F.col("_text")))
    members = named.where("_base <> ''").select(F.col("_base").alias("base"), "sku", F.col("_text").alias("text"), F.col("_app.text").alias("app"), F.col("_app.first").alias("first"), F.col("_app.last").alias("last"), "position")
    parents = named.select(F.col("sku").alias("base"), F.col("_text").alias("parent_text"), F.col("_app").alias("parent_app"))
    with_parent = members.join(parents, "base")
    overlap = (F.col("app") != "") & (F.col("app") == F.col("parent_app.text")) & (F.greatest("first", "parent_app.first") <= F.least("last", "parent_app.last")) & F.col("first").isNotNull() & F.col("parent_app.first").isNotNull()
    fitting = with_parent.where(((F.col("text") != "") & (F.col("text") == F.col("parent_text"))) | F.coalesce(overlap, F.lit(False)))
    existing = fitting.select("base", "sku", F.lit(False).alias("proposed"), F.col("parent_text").alias("description"), (F.col("text") != F.col("parent_text")).alias("differs"))

    orphans = members.join(parents.select("base"), "base", "left_anti")
    if blocked is not None:
        orphans = orphans.join(blocked.select("base"), "base", "left_anti")
    one_text = (F.min("text") == F.max("text")) & (F.min("text") != "")
    one_use = (F.min("app") == F.max("app")) & (F.min("app") != "") & (F.count("first") == F.count("*")) & (F.max("first") <= F.min("last"))
    agree = orphans.groupBy("base").agg(F.count("*").alias("members"), (one_text | F.coalesce(one_use, F.lit(False))).alias("fits")).where("members >= 2 and fits").select("base")
    texts = orphans.groupBy("base", "text").agg(F.count("*").alias("n"), F.min("position").alias("at"))
    usual = texts.groupBy("base").agg(F.max_by("text", F.struct("n", -F.col("at"))).alias("description"))
    made = orphans.join(agree, "base", "left_semi").join(usual, "base").select("base", "sku", F.lit(True).alias("proposed"), "description", (F.col("text") != F.col("description")).alias("differs"))
    every = existing.unionByName(made)
    return every.join(every.groupBy("base").agg(F.bool_or("differs").alias("warned")), "base").select("base", "sku", "proposed", "description", "warned")


# ---- rules on field values -----------------------------------------------------------------------------------------

#: Operators that a kind of field allows.
OPERATORS = {"number": ("eq", "gt", "gte", "lt", "lte", "between"), "integer": ("eq", "gt", "gte", "lt", "lte", "between"), "text": ("eq", "contains"), "boolean": ("eq",), "choice": ("eq",)}
_NUMBER = "decimal(20,6)"


def _typed(rules: DataFrame, fields: DataFrame) -> DataFrame:
    """Rules (filter_id, key, operator, value, value_to) with their field's kind, typed values and ``error``."""
    numeric = F.col("kind").isin("number", "integer")
    number = lambda c: F.when(F.trim(c).rlike(r"^[+-]?[0-9]{1,14}(\.[0-9]{0,6})?$"), F.trim(c).try_cast(_NUMBER))
    allowed = F.create_map(*[x for kind, names in OPERATORS.items() for x in (F.lit(kind), F.array(*map(F.lit, names)))])
    word = F.upper(F.trim("value"))
    both = rules.join(fields, "key", "left").join(rules.groupBy("filter_id", "key").agg(F.count("*").alias("_times")), ["filter_id", "key"])
    both = both.withColumns({"low": F.when(numeric, number(F.col("value"))), "high": F.when(numeric & (F.col("operator") == "between"), number(F.col("value_to"))), "word": word})
    error = (
        F.when(F.col("kind").isNull(), "unknown_field")
        .when(F.col("_times") > 1, "repeated")
        .when(~F.array_contains(F.try_element_at(allowed, F.col("kind")), F.col("operator")), "operator")
        .when(numeric & (F.col("low").isNull() | ((F.col("operator") == "between") & F.col("high").isNull())), "number")
        .when(F.col("low") > F.col("high"), "order")
        .when((F.col("kind") == "boolean") & ~F.col("value").isin("true", "false"), "boolean")
        .when((F.col("kind") == "choice") & ~F.coalesce(F.array_contains("options", F.col("word")), F.lit(False)), "option")
    )
    return both.withColumn("error", error)


def rule_errors(rules: DataFrame, fields: DataFrame) -> DataFrame:
    """(filter_id, key, error) of rules that can't be: unknown_field, repeated, operator, number, order, boolean, option."""
    return _typed(rules, fields).where("error is not null").select("filter_id", "key", "error").distinct()


def parts_meeting(filters: DataFrame, rules: DataFrame, fields: DataFrame, parts: DataFrame, values: DataFrame) -> DataFrame:
    """(filter_id, part_id): parts of a filter's type that meet all its rules.

    filters: filter_id, part_type; rules: filter_id, key, operator, value, value_to; fields: key, kind (number, integer, text, boolean,
    choice), options; parts: part_id, part_type; values: part_id, key, number, text, flag.  One join of values with rules on the key,
    then a division: as many rules met as the filter has.  A filter without rules takes all parts of its type, one with a faulty
    rule none.  Text compares without regard to case; null values meet nothing."""
    typed = _typed(rules, fields).drop("number", "text", "flag")
    met = values.join(typed.where("error is null"), "key")
    n, text = F.col("number").cast(_NUMBER), F.upper("text")
    ok = (
        F.when(F.col("kind") == "boolean", F.col("flag") == (F.col("value") == "true"))
        .when((F.col("kind").isin("text", "choice")) & (F.col("operator") == "eq"), text == F.col("word"))
        .when(F.col("kind") == "text", F.contains(text, F.col("word")))
        .when(F.col("operator") == "eq", n == F.col("low")).when(F.col("operator") == "gt", n > F.col("low")).when(F.col("operator") == "gte", n >= F.col("low"))
        .when(F.col("operator") == "lt", n < F.col("low")).when(F.col("operator") == "lte", n <= F.col("low")).otherwise(n.between(F.col("low"), F.col("high")))
    )
    counted = met.where(ok).select("filter_id", "part_id", "key").distinct().groupBy("filter_id", "part_id").agg(F.count("*").alias("met"))
    needed = filters.join(rules.groupBy("filter_id").agg(F.count("*").alias("rules")), "filter_id", "left").fillna(0, ["rules"])
    some = counted.join(needed.where("rules > 0"), "filter_id").where("met = rules").join(parts, ["part_id", "part_type"]).select("filter_id", "part_id")
    return some.unionByName(needed.where("rules = 0").join(parts, "part_type").select("filter_id", "part_id"))

