from __future__ import annotations

import pytest

from partmill.sources import loads


def test_stock_loads(spark):
    rows = [(1, " 51750-j9000 ", "5", "Kia", "1,234.50"), (2, None, "3", None, None), (3, "A", "x", "", "12,500"), (4, "B", "2.0", "b", "=1+1"), (5, "b", "1", "B", None), (6, None, None, None, None), (7, "C", "-1", None, None)]
    raw = spark.createDataFrame(rows, "row long, `Número de parte` string, Cant string, MARCA string, `Precio  unitario` string")
    got = {r["row"]: r for r in loads.read_stock(raw).collect()}
    assert {k: r["errors"] for k, r in got.items()} == {1: [], 2: ["code"], 3: ["quantity", "price:ambiguous"], 4: ["formula", "price:invalid", "repeated"], 5: ["repeated"], 7: ["quantity"]}
    assert (got[1]["clave"], got[1]["quantity"], str(got[1]["price"]), got[1]["brand"]) == ("51750J9000", 5, "1234.50", "KIA")
    assert loads.read_stock(raw.limit(0)).count() == 0
    with pytest.raises(ValueError, match="quantity"):
        loads.read_stock(raw.drop("Cant"))
    with pytest.raises(ValueError, match="both name"):
        loads.read_stock(raw.withColumnRenamed("MARCA", "codigo"))


def test_price_loads(spark):
    raw = spark.createDataFrame([(1, "A", "10", "borrar"), (2, "B", None, "12,500"), (3, None, "5", None)], "row long, SKU string, `Precio público` string, precio_TALLER string")
    got = sorted(((r["row"], r["list"], r["action"], r["price"] and str(r["price"]), r["error"]) for r in loads.read_prices(raw).collect()), key=str)
    assert got == [(1, "PUBLICO", "set", "10.00", None), (1, "TALLER", "delete", None, None), (2, "TALLER", "none", None, "ambiguous"), (3, "PUBLICO", "none", None, "code")]
    with pytest.raises(ValueError):
        loads.read_prices(raw.select("row", "SKU"))
