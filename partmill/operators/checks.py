"""Data-quality checks: each returns the offending rows, so an empty table is a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def differing(a: DataFrame, b: DataFrame, key: str, left: Column, right: Column) -> DataFrame:
    """Rows of ``a`` joined with ``b`` on ``key`` where ``left`` is not ``right``; two nulls are alike."""
    return a.join(b, key).where(~left.eqNullSafe(right))


def profile(rows: DataFrame, name: str, keys: list[Column], groups: int | None = None) -> DataFrame:
    """(profile, groups_of, n, as_expected): how many rows each combination of ``keys`` has; a null key is told as ``-``.  ``groups``: how
    many combinations there shall be; ``as_expected`` is null where nothing is expected."""
    shown = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("-")) for k in keys])
    counted = rows.groupBy(shown.alias("groups_of")).agg(F.count("*").alias("n"))
    # The combinations are few: one row a combination, counted over all of them.
    expected = (F.count("*").over(Window.partitionBy(F.lit(name))) == groups) if groups is not None else F.lit(None).cast("boolean")
    return counted.select(F.lit(name).alias("profile"), "groups_of", "n", expected.alias("as_expected"))


def orphans(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key no row of ``known`` has; a null key is an orphan."""
    return rows.join(known.select(key), key, "left_anti")


def differing_sums(counted: DataFrame, rows: DataFrame, key: str, column: str, units: str) -> DataFrame:
    """(key, counted, found) where ``column`` of ``counted`` is not the sum of ``units`` of ``rows``; missing is 0 on both sides."""
    sums = rows.groupBy(key).agg(F.sum(units).alias("found"))
    both = counted.select(key, F.col(column).alias("counted")).join(sums, key, "full_outer").fillna(0, ["counted", "found"])
    return both.where("counted <> found")


def unattended(items: DataFrame, cases: DataFrame, key: str, since: str, now: Column, minutes: int = 15) -> DataFrame:
    """Items older than ``minutes`` without an open case."""
    old = items.where(F.col(since) < now - F.make_dt_interval(mins=F.lit(minutes)))
    return old.join(cases.where("open").select(key), key, "left_anti")


def reservation_faults(holds: DataFrame, entries: DataFrame) -> DataFrame:
    """(hold_id, fault) of holds (hold_id, units, status: open, released, used) and their ledger entries (hold_id, kind, units).

    Faults: no_reserve or many_reserves, foreign_kind, closing (an open hold has a closing entry, or a closed one has not just the
    one of its status), left (the entries do not leave what the hold holds: its units while open, else nothing)."""
    per = entries.groupBy("hold_id").agg(
        F.count_if(F.col("kind") == "reserve").alias("reserves"), F.count_if(F.col("kind") == "release").alias("releases"), F.count_if(F.col("kind") == "use").alias("uses"),
        F.count_if(~F.col("kind").isin("reserve", "release", "use")).alias("foreign"), F.sum(F.when(F.col("kind") == "reserve", F.col("units")).otherwise(-F.col("units"))).alias("held"),
    )
    both = holds.join(per, "hold_id", "left").fillna(0, ["reserves", "releases", "uses", "foreign", "held"])
    closing = F.when(F.col("status") == "open", (F.col("releases") + F.col("uses")) == 0).when(F.col("status") == "released", (F.col("releases") == 1) & (F.col("uses") == 0)).otherwise((F.col("uses") == 1) & (F.col("releases") == 0))
    faults = F.array_compact(F.array(
        F.when(F.col("reserves") == 0, "no_reserve").when(F.col("reserves") > 1, "many_reserves"), F.when(F.col("foreign") > 0, "foreign_kind"), F.when(~closing, "closing"),
        F.when(F.col("held") != F.when(F.col("status") == "open", F.col("units")).otherwise(0), "left"),
    ))
    return both.select("hold_id", F.explode(faults).alias("fault"))


def foreign_codes(load: DataFrame, catalog: DataFrame) -> DataFrame:
    """(code, owner, others) of codes that a load (owner, code) gives to an owner while another one has them, in the load itself
    or in the catalog (owner, code); ``others``: how many."""
    owners = load.select("owner", "code").unionByName(catalog.select("owner", "code")).distinct()
    shared = owners.groupBy("code").agg(F.count("*").alias("n")).where("n > 1")
    return load.select("owner", "code").distinct().join(shared, "code").select("code", "owner", (F.col("n") - 1).alias("others"))
