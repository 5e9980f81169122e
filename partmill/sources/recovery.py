"""Codes that a spreadsheet turned into dates, recovered by what the rest of the load shows.

All spellings from which a date can come are listed, the likeliest first.  One is taken by itself if the description names it as a code,
or if it is the only one whose shape (the number before the dash, the digits after it) intact codes of the load share: two others of
the same part family, or three anywhere.  Else the likeliest is only suggested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_INTACT = r"^([0-9]{1,4})-([0-9]{1,4})$"
IN_FAMILY, IN_LOAD = 2, 3


def spellings(day: Column, mask: Column) -> Column:
    """The codes from which a cell with this date and number format can come, likeliest first."""
    mask = F.trim(F.lower(F.regexp_replace(F.coalesce(mask, F.lit("")), r"\[[^\]]*\]", "")))
    year, month, date = F.year(day), F.month(day), F.dayofmonth(day)
    plain, two, four = (lambda n: n.cast("string")), (lambda n: F.lpad(n.cast("string"), 2, "0")), (lambda n: F.lpad(n.cast("string"), 4, "0"))
    joined = lambda *parts: F.concat_ws("-", *parts)
    short, full = joined(plain(month), two(year % 100)), joined(plain(month), four(year))
    as_month = F.array(F.when(year.between(1900, 2099), short), full, short, joined(two(month), four(year)), joined(four(year), plain(month)))
    as_day = F.array(joined(plain(month), plain(date)), joined(plain(date), plain(month)), joined(two(month), two(date)), joined(two(date), two(month)))
    orders = [x for a, b in ((month, date), (date, month)) for x in (joined(plain(a), plain(b), two(year % 100)), joined(plain(a), plain(b), plain(year % 100)), joined(two(a), two(b), two(year % 100)), joined(plain(a), plain(b), four(year)))]
    whole = F.array(*orders, joined(four(year), two(month), two(date)))
    return F.array_distinct(F.array_compact(F.when(is_month(day, mask), as_month).when(mask.rlike("^d{1,2}[-/ ]m{1,4}$"), as_day).otherwise(whole)))


def is_month(day: Column, mask: Column) -> Column:
    return (F.dayofmonth(day) == 1) & mask.rlike("^m{1,4}[-/ ]y{2,4}$")


def recover_dates(cells: DataFrame, intact: DataFrame) -> DataFrame:
    """(row, field, candidates, suggested, automatic, reason) of cells that hold a date in place of a code.

    cells: row, field, day (date), mask (number format), description; intact: field, code (text), description of cells that are as
    they were.  Reason: description, pattern or none.  Cells without a date are left out; repeated intact codes count once."""
    family = lambda d: F.split(F.upper(F.trim(F.coalesce(d, F.lit("")))), " ")[0]
    code = F.upper(F.trim("code"))
    shapes = intact.select("field", code.alias("code"), family(F.col("description")).alias("family")).where(F.col("code").rlike(_INTACT))
    shapes = shapes.select("field", "code", "family", F.regexp_extract("code", _INTACT, 1).alias("head"), F.length(F.regexp_extract("code", _INTACT, 2)).alias("digits"))
    in_load = shapes.groupBy("field", "head", "digits").agg(F.count_distinct("code").alias("in_load"))
    in_family = shapes.where("family <> ''").groupBy("field", "head", "digits", "family").agg(F.count_distinct("code").alias("in_family"))

    mask = F.trim(F.lower(F.regexp_replace(F.coalesce("mask", F.lit("")), r"\[[^\]]*\]", "")))
    text = F.upper(F.trim(F.coalesce("description", F.lit(""))))
    given = cells.where("day is not null").select("row", "field", "day", text.alias("text"), family(F.col("description")).alias("family"), is_month(F.col("day"), mask).alias("month"), spellings(F.col("day"), F.col("mask")).alias("candidates"))
    each = given.select("*", F.posexplode("candidates").alias("k", "code"))
    token = F.array_contains(F.regexp_extract_all("text", F.lit(r"(?<![\w/-])([0-9]{1,4}(?:-[0-9]{1,4}){1,2})(?![\w/-])"), 1), F.col("code"))
    labelled = F.expr(r"regexp_like(text, concat('\\b(?:SKU|CODIGO|CÓDIGO|REF(?:ERENCIA)?)\\s*[:#]?\\s*', code, '\\b'))")
    distant = F.col("month") & (F.year("day") > 2099) & F.col("code").endswith(F.concat(F.lit("-"), F.lpad(F.year("day").cast("string"), 4, "0")))
    each = each.withColumns({"named": token & (labelled | distant), "head": F.regexp_extract("code", _INTACT, 1), "digits": F.length(F.regexp_extract("code", _INTACT, 2))})
    each = each.join(in_load, ["field", "head", "digits"], "left").join(in_family, ["field", "head", "digits", "family"], "left")
    shown = F.col("month") & (F.col("head") != "") & ((F.coalesce("in_family", F.lit(0)) >= IN_FAMILY) | (F.coalesce("in_load", F.lit(0)) >= IN_LOAD))
    first = lambda where: F.min(F.when(where, F.col("k")))
    per = each.groupBy("row", "field").agg(F.first("candidates").alias("candidates"), F.count_if("named").alias("names"), first(F.col("named")).alias("name"), F.count_if(shown).alias("shapes"), first(shown).alias("shape"))
    by_name, by_shape = F.col("names") == 1, F.col("shapes") == 1
    at = F.when(by_name, F.col("name")).when(by_shape, F.col("shape")).otherwise(0)
    return per.select("row", "field", "candidates", F.get("candidates", at).alias("suggested"), (by_name | by_shape).alias("automatic"), F.when(by_name, "description").when(by_shape, "pattern").otherwise("none").alias("reason"))
