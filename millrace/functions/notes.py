"""Column rules for filing notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Period kinds in a header, and what stands for an unreadable header.
PERIOD_KINDS = "FY|Q[1-4]|YTD|H[1-2]"
NO_DATE = "1970-01-01"
NO_KIND = "UNKNOWN"


def period_end(header: Column) -> Column:
    found = F.regexp_extract(header, r"(\d{4}-\d{2}-\d{2})", 1)
    return F.when(F.coalesce(found, F.lit("")) == "", F.lit(NO_DATE)).otherwise(found)


def period_kind(header: Column) -> Column:
    found = F.regexp_extract(header, rf"\(({PERIOD_KINDS})\)", 1)
    return F.when(F.coalesce(found, F.lit("")) == "", F.lit(NO_KIND)).otherwise(found)


def short_number(text: Column) -> Column:
    """A number with a B, M or K suffix; other text cut at 20 characters."""
    v = text.try_cast("double")
    size = F.abs(v)

    def digits(x: Column, n: int) -> Column:
        return F.replace(F.format_number(x, n), F.lit(","), F.lit(""))

    return (
        F.when(v.isNull() | F.isnan(v), F.substring(text, 1, 20))
        .when(size >= 1e9, F.concat(digits(v / 1e9, 1), F.lit("B")))
        .when(size >= 1e6, F.concat(digits(v / 1e6, 1), F.lit("M")))
        .when(size >= 1e3, F.concat(digits(v / 1e3, 1), F.lit("K")))
        .otherwise(digits(v, 2))
    )


def valid_month(text: Column) -> Column:
    """``YYYY-MM`` with a month from 01 to 12 and a year after 1900."""
    shaped = text.rlike(r"^\d{4}-(0[1-9]|1[0-2])$")
    return F.coalesce(shaped & (F.substring(text, 1, 4).try_cast("int") > 1900), F.lit(False))


def fiscal_quarter(month: Column, year_end_month: Column) -> Column:
    """Quarter of the fiscal year in which the month lies."""
    return (F.floor(F.pmod(month - year_end_month - 1, F.lit(12)) / 3) + 1).cast("int")


def fiscal_year(date: Column, year_end_month: Column) -> Column:
    """A fiscal year has the number of the calendar year in which it ends."""
    return F.year(date) + F.when(F.month(date) > year_end_month, 1).otherwise(0)


def quarter_status(form: Column) -> Column:
    return (
        F.when(form.isin("10-Q", "6-K"), "direct").when(form.isin("10-K", "20-F"), "from_annual_filing").otherwise("unknown")
    )


def safe_name(title: Column, fallback: Column, index: Column) -> Column:
    """Letters and digits, others as underscores, 40 characters, with an index."""
    text = F.btrim(F.coalesce(title, F.lit("")))
    text = F.when(text == "", fallback).otherwise(text)
    body = F.btrim(F.substring(F.regexp_replace(text, "[^a-zA-Z0-9]", "_"), 1, 40), F.lit("_"))
    return F.concat(body, F.lit("_D"), index.cast("string"))


def md5_of(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
