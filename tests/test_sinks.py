from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from partmill.sources import sinks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_upsert_touches_listed_columns_only(spark):
    stored = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, None, 30)], "id long, name string, n int")
    new = spark.createDataFrame([(2, "x", None), (4, "y", 40)], "id long, name string, n int")
    assert rows(sinks.upsert(stored, new, ["id"], ["n"]).where("id <> 3")) == [(1, "a", 10), (2, "b", None), (4, "y", 40)]
    assert rows(sinks.upsert(stored, new, ["id"]).where("id = 2")) == [(2, "x", None)]
    assert sinks.upsert(stored, new.limit(0), ["id"]).count() == 3 and sinks.upsert(stored.limit(0), new, ["id"]).count() == 2


def test_inserts_deletes_and_counters(spark):
    stored = spark.createDataFrame([(1, 5), (None, 7)], "id long, n long")
    new = spark.createDataFrame([(1, 9), (2, 4), (2, 3)], "id long, n long")
    assert rows(sinks.insert_missing(stored, new, ["id"])) == sorted([(1, 5), (None, 7), (2, 3)], key=str)
    assert sinks.delete_keys(stored, new.select("id")).collect()[0]["n"] == 7
    assert rows(sinks.add_counters(stored, new, ["id"])) == sorted([(1, 14), (2, 7), (None, 7)], key=str)


def test_ledger_goes_on_from_the_last_balance(spark):
    empty = spark.createDataFrame([], "item string, at int, change int, balance int")
    one = sinks.append_ledger(empty, spark.createDataFrame([("a", 1, 5), ("a", 2, -2), ("b", 1, 1)], "item string, at int, change int"), "item", ["at"])
    two = sinks.append_ledger(one, spark.createDataFrame([("a", 3, 10), ("c", 9, 4)], "item string, at int, change int"), "item", ["at"])
    assert rows(two) == [("a", 1, 5, 5), ("a", 2, -2, 3), ("a", 3, 10, 13), ("b", 1, 1, 1), ("c", 9, 4, 4)]


def test_exports_are_verified_and_never_overwritten(spark, tmp_path):
    table = spark.createDataFrame([(1, "é"), (2, None), (2, None)], "id long, name string")
    folder = f"file:{tmp_path}/x"
    manifest = sinks.export_json_lines(table, folder, "id").first()
    assert manifest["rows"] == 3 and sinks.verify_export(spark, folder)
    with pytest.raises(AnalysisException):
        sinks.export_json_lines(table, folder, "id")
    again = sinks.export_json_lines(table.repartition(3), f"file:{tmp_path}/y", "id").first()
    assert again["sha256"] == manifest["sha256"]
    spark.createDataFrame([('{"id":9,"name":"z"}',)], "value string").write.mode("append").option("compression", "gzip").text(f"{folder}/rows")
    assert not sinks.verify_export(spark, folder)
    damaged = spark.createDataFrame([(1, "?"), (3, "c")], "id long, name string")
    assert rows(sinks.restore_rows(damaged, f"file:{tmp_path}/y", "id")) == [(1, "é"), (3, "c")]
    assert sinks.fingerprint(table.limit(0).select(F.col("name").alias("value"))).first()["rows"] == 0
