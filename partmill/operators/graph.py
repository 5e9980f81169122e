"""Connected components by repeated contraction of a distributed edge table."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partmill.sources.storage import materialize


def _ranked(node: str | Column) -> Column:
    """Hashed order of nodes: contraction shrinks a graph by a constant share a round whatever its ids are."""
    node = F.col(node) if isinstance(node, str) else node
    return F.struct(F.xxhash64(node).alias("h"), node.alias("n"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", name: str = "components") -> DataFrame:
    """(node, component) of every node on an edge; the component is its smallest node.

    Each round points every node at the lowest-ranked node of its closed neighbourhood, follows that pointer once more,
    and replaces edges by edges between the nodes pointed at.  Only ``min`` aggregates touch a hub's neighbours, so no
    neighbourhood is collected.  Null ends and loops are dropped; an empty table gives no rows.
    """
    save = partial(materialize, name=name)
    tidy = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src <> dst")
    live = save(tidy.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    labels = None
    while not live.isEmpty():
        both = live.union(live.select("dst", "src"))
        lowest = both.groupBy(F.col("src").alias("node")).agg(F.min(_ranked("dst")).alias("near"))
        step = save(lowest.select("node", F.least("near", _ranked("node"))["n"].alias("root")))
        onward = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        step = save(step.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        if labels is None:
            labels = step
        else:
            onward = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = labels.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        to = lambda end, new: step.select(F.col("node").alias(end), F.col("root").alias(new))
        moved = live.join(to("src", "a"), "src").join(to("dst", "b"), "dst").where("a <> b")
        live = save(moved.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
    if labels is None:
        return tidy.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    labels = save(labels)
    smallest = labels.groupBy("root").agg(F.min("node").alias("component"))
    return save(labels.join(smallest, "root").select("node", "component"))
