"""Loads of stock and prices as people send them: any column order and spelling of titles, all cells text, errors told by row.

A load is a DataFrame of text columns (CSV, JSON or a sheet read elsewhere) with a ``row`` number; titles are metadata and are
looked at on the driver, cells only in expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partmill.functions.parts import amount
from partmill.functions.text import MARKED, UNMARKED, code_key

#: Titles of a stock load and what else they are called; the first two must be there.
STOCK_TITLES = {
    "code": ("CODIGO", "SKU", "CODE", "REFERENCIA", "NUMERO_DE_PARTE"), "quantity": ("CANTIDAD", "CANT", "STOCK", "EXISTENCIA", "QTY"), "brand": ("MARCA", "FABRICANTE", "BRAND"),
    "description": ("DESCRIPCION", "DETALLE", "DESCRIPTION"), "price": ("PRECIO", "PRECIO_UNITARIO", "PRICE"),
}
STOCK_REQUIRED = ("code", "quantity")
#: What begins the title of a price list's column, and what a cell says to take a price away.
PRICE_PREFIX, DELETE = "PRECIO_", "BORRAR"


def folded_title(title: str) -> str:
    """A title as it is compared: without accents, upper case, words joined by underscores."""
    return "_".join(title.translate(str.maketrans(MARKED, UNMARKED)).upper().split())


def named_columns(raw: DataFrame, titles: Mapping[str, Sequence[str]], required: Sequence[str]) -> dict[str, str]:
    """Field -> column of ``raw``.  ValueError for a field that two columns name, and for a required one that none does."""
    found: dict[str, str] = {}
    for column in raw.columns:
        for field, names in titles.items():
            if folded_title(column) in names:
                if field in found:
                    raise ValueError(f"{column} and {found[field]} both name {field}")
                found[field] = column
    if missing := [f for f in required if f not in found]:
        raise ValueError(f"no column for {', '.join(missing)}")
    return found


def _cell(raw: DataFrame, column: str | None) -> Column:
    return F.nullif(F.trim(F.col(f"`{column}`").cast("string")), F.lit("")) if column else F.lit(None).cast("string")


def read_stock(raw: DataFrame) -> DataFrame:
    """(row, code, clave, brand, description, quantity, price, errors) of a stock load; rows with nothing in them are left out.

    Errors: code (missing or over 120 characters), formula, quantity (no whole number from 0), price:<why>, repeated (every row of
    a code and brand that occur more than once)."""
    at = named_columns(raw, STOCK_TITLES, STOCK_REQUIRED)
    rows = raw.select("row", *[_cell(raw, at.get(f)).alias(f) for f in STOCK_TITLES])
    rows = rows.where(" or ".join(f"{f} is not null" for f in STOCK_TITLES))
    price = amount(F.col("price"))
    whole = F.when(F.col("quantity").rlike(r"^[0-9]{1,9}(\.0+)?$"), F.col("quantity").try_cast("decimal(20,0)").cast("long"))
    rows = rows.withColumns({"clave": code_key(F.col("code")), "_price": price, "_units": whole})
    named, nameless = rows.where("code is not null"), rows.where("code is null")
    # Rows without a code repeat nothing and would all share one window.
    times = F.count("*").over(Window.partitionBy("clave", F.upper(F.coalesce("brand", F.lit("")))))
    rows = named.withColumn("_times", times).unionByName(nameless.withColumn("_times", F.lit(1).cast("long")))
    formula = F.exists(F.array(*STOCK_TITLES), lambda c: F.coalesce(c.startswith("="), F.lit(False)))
    errors = F.array_compact(F.array(
        F.when(F.col("code").isNull() | (F.length("code") > 120), "code"), F.when(formula, "formula"), F.when(F.col("_units").isNull(), "quantity"),
        F.when(F.col("_price.error").isNotNull(), F.concat(F.lit("price:"), F.col("_price.error"))), F.when(F.col("_times") > 1, "repeated"),
    ))
    return rows.select("row", "code", "clave", F.upper("brand").alias("brand"), "description", F.col("_units").alias("quantity"), F.col("_price.value").alias("price"), errors.alias("errors"))


def read_prices(raw: DataFrame) -> DataFrame:
    """(row, code, list, action, price, error) of a price load: one row for each cell of each ``PRECIO_<LIST>`` column that has
    something in it.  Action: set, delete (the cell says ``BORRAR``) or none (an error)."""
    at = named_columns(raw, {"code": STOCK_TITLES["code"]}, ["code"])
    lists = {folded_title(c).removeprefix(PRICE_PREFIX): c for c in raw.columns if folded_title(c).startswith(PRICE_PREFIX) and folded_title(c) != PRICE_PREFIX}
    if not lists:
        raise ValueError(f"no column {PRICE_PREFIX}<LIST>")
    cells = F.explode(F.array(*[F.struct(F.lit(name).alias("list"), _cell(raw, c).alias("cell")) for name, c in sorted(lists.items())]))
    each = raw.select("row", _cell(raw, at["code"]).alias("code"), cells.alias("c")).select("row", "code", "c.*").where("cell is not null")
    gone, value = F.upper("cell") == DELETE, amount(F.col("cell"))
    error = F.when(F.col("code").isNull(), "code").when(~gone, value["error"])
    return each.select("row", "code", "list", F.when(error.isNotNull(), "none").when(gone, "delete").otherwise("set").alias("action"), F.when(~gone & error.isNull(), value["value"]).alias("price"), error.alias("error"))
