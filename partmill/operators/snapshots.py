"""Nested JSON compared leaf by leaf, by path."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partmill.sources.storage import materialize


def leaves(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, leaf) of JSON texts, each leaf as JSON.

    Keys of objects are joined by ``/``.  Rows of a list that are all objects with an ``id`` of their own go by ``[id=...]``, with their
    order at ``[order]``; those of other lists by index.  An empty object or list is a leaf.  Texts that are no JSON, and nulls, have
    none.  Texts are read as VARIANT and opened a level at a time, all of them at once."""
    level = documents.select(F.col(key).alias("key"), F.lit("").alias("path"), F.try_parse_json(F.col(text)).alias("v"), F.lit(False).alias("named")).where("v is not null")
    found: list[DataFrame] = []
    while True:
        as_map, as_list = F.try_variant_get("v", "$", "map<string,variant>"), F.try_variant_get("v", "$", "array<variant>")
        own = F.when(F.col("named"), F.map_filter(as_map, lambda k, v: k != "id")).otherwise(as_map)
        opened = materialize(level.select("key", "path", "v", own.alias("m"), as_list.alias("a")), "json-level")
        ids = F.transform("a", lambda x: F.try_variant_get(x, "$.id", "string"))
        by_id = (F.size("a") > 0) & F.forall(ids, lambda x: x.isNotNull()) & (F.size(F.array_distinct(ids)) == F.size("a"))
        leaf = F.when(F.size("m") == 0, "{}").when(F.size("a") == 0, "[]").when(F.col("m").isNull() & F.col("a").isNull(), F.to_json("v"))
        found.append(opened.select("key", "path", leaf.alias("leaf")).where("leaf is not null"))
        found.append(opened.where(by_id).select("key", F.concat("path", F.lit("[order]")).alias("path"), F.to_json(ids).alias("leaf")))
        inside = opened.where("size(m) > 0").select("key", "path", F.explode("m").alias("name", "v"))
        inside = inside.select("key", F.when(F.col("path") == "", F.col("name")).otherwise(F.concat_ws("/", "path", "name")).alias("path"), "v", F.lit(False).alias("named"))
        rows = opened.where("size(a) > 0").select("key", "path", by_id.alias("named"), F.posexplode("a").alias("k", "v"))
        name = F.when(F.col("named"), F.concat(F.lit("[id="), F.try_variant_get("v", "$.id", "string"), F.lit("]"))).otherwise(F.concat(F.lit("["), F.col("k"), F.lit("]")))
        level = inside.unionByName(rows.select("key", F.concat("path", name).alias("path"), "v", "named"))
        if opened.where("size(m) > 0 or size(a) > 0").isEmpty():
            break
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out.withColumnRenamed("key", key)


def glob(pattern: str) -> str:
    """A regular expression for a pattern with ``*``, ``?`` and ``[...]``."""
    out = ""
    for piece in re.findall(r"\[!?\]?[^\]]*\]|.", pattern, re.S):
        if piece in "*?":
            out += {"*": "(?s:.*)", "?": "(?s:.)"}[piece]
        elif len(piece) > 2 and piece[0] == "[":
            out += "[" + piece[1:-1].replace("\\", "\\\\").replace("!", "^", 1 if piece[1] == "!" else 0).replace("[", "\\[") + "]"
        else:
            out += re.escape(piece)
    return f"^{out}$"


def compare(before: DataFrame, after: DataFrame, key: str, allow: Sequence[str] = (), ignore: Sequence[str] = ()) -> DataFrame:
    """(key, path, old, new, kind) of leaves that differ: ignored (its path begins with a match of an ``ignore`` expression), expected (an
    ``allow`` pattern fits all of it) or unexpected.  A leaf that is missing is null; one that is null is the JSON null."""
    old, new = before.withColumnRenamed("leaf", "old"), after.withColumnRenamed("leaf", "new")
    changed = old.join(new, [key, "path"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    any_of = lambda patterns: _any([F.col("path").rlike(p) for p in patterns])
    kind = F.when(any_of([f"^(?:{p})" for p in ignore]), "ignored").when(any_of([glob(p) for p in allow]), "expected").otherwise("unexpected")
    return changed.select(key, "path", "old", "new", kind.alias("kind"))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
