"""Column rules for financial facts and market metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Concepts that do not add up over quarters.
NON_ADDITIVE = (
    "EarningsPerShare",
    "WeightedAverageNumberOf.*Shares",
    "CommonStockDividendsPerShare",
    "AntidilutiveSecurities",
)

# Units and currency signs.
PER_SHARE_UNITS = (
    "USD per share", "USD/shares", "TWD per share", "JPY per share", "EUR per share", "GBP per share",
)
SHARE_UNITS = ("shares",)
CURRENCY_SIGNS = {
    "USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥", "TWD": "NT$", "CNY": "¥", "KRW": "₩",
    "INR": "₹", "AUD": "A$", "CAD": "C$", "CHF": "CHF", "SGD": "S$", "HKD": "HK$",
}
DASH = "—"


def quarter_label(period_end: Column, fiscal_period: Column) -> Column:
    """``YEAR-Qn``; a Q4 that ends in January to March belongs to the year before."""
    late = (fiscal_period == "Q4") & (F.month(period_end) <= 3)
    year = F.year(period_end) - F.when(late, 1).otherwise(0)
    return F.when(period_end.isNull(), F.lit("Unknown")).otherwise(
        F.concat(year.cast("string"), F.lit("-"), fiscal_period))


def is_non_additive(concept: Column) -> Column:
    return concept.rlike("|".join(NON_ADDITIVE))


def short_concept(concept: Column) -> Column:
    return F.element_at(F.split(concept, ":"), -1)


def _grouped(value: Column, digits: int) -> Column:
    return F.format_number(value, digits)


def currency_code(unit: Column) -> Column:
    """First word of the unit, upper case; null for counts."""
    word = F.upper(F.element_at(F.split(F.element_at(F.split(F.btrim(unit), r"\s+"), 1), "/"), 1))
    return F.when(~word.isin("SHARES", "PURE", ""), word)


def format_value(value: Column, unit: Column) -> Column:
    """Display text: per-share amounts, share counts, or money with its sign and a B or M suffix."""
    code = currency_code(unit)
    signs = F.create_map(*[F.lit(x) for pair in CURRENCY_SIGNS.items() for x in pair])
    sign = F.coalesce(F.try_element_at(signs, code), code, F.lit("$"))
    v = value.cast("double")
    size = F.abs(v)
    plain = lambda digits: F.replace(_grouped(v, digits), F.lit(","), F.lit(""))

    def scaled(digits: int) -> Column:
        return (
            F.when(size >= 1e9, F.concat(_grouped(v / 1e9, digits), F.lit("B")))
            .when(size >= 1e6, F.concat(_grouped(v / 1e6, digits), F.lit("M")))
            .otherwise(_grouped(v, 0))
        )

    return (
        F.when(v.isNull() | F.isnan(v), F.lit(DASH))
        .when(unit.isin(*PER_SHARE_UNITS), F.concat(sign, F.when(size >= 0.01, _grouped(v, 2)).otherwise(plain(4))))
        .when(unit.isin(*SHARE_UNITS), scaled(2))
        .otherwise(F.concat(sign, scaled(1)))
    )


def money_number(text: Column) -> Column:
    """Money text to a number: currency signs, commas, (negatives), K/M/B; null if it cannot be read."""
    t = F.btrim(text)
    negative = t.rlike(r"^\(.*\)$")
    body = F.when(negative, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
    body = F.lower(F.regexp_replace(body, "[$€, ]", ""))
    factor = (
        F.when(body.endswith("b"), 1e9).when(body.endswith("m"), 1e6).when(body.endswith("k"), 1e3).otherwise(1.0)
    )
    number = F.regexp_replace(body, "[bmk]$", "").try_cast("double") * factor
    return F.when(negative, -number).otherwise(number)


def clean_value(text: Column) -> Column:
    """Money text to a number; what cannot be read is zero, as ``unreadable`` counts."""
    return F.coalesce(money_number(text), F.lit(0.0))


# Accepted date patterns, tried in this order.
DATE_FORMATS = ("yyyy-MM-dd", "M/d/yyyy", "d/M/yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyy-MM-dd'T'HH:mm:ss")


def parse_date(text: Column) -> Column:
    """A date in one of the accepted formats, else null."""
    tries = [F.try_to_timestamp(text, F.lit(f)).cast("date") for f in DATE_FORMATS]
    return F.coalesce(*tries)


def rescale(expected: Column, calculated: Column) -> Column:
    """Bring a value to the scale of the expected one if they differ by about 10^3 or 10^6."""
    ratio = F.abs(F.try_divide(expected, calculated))
    scaled = (
        F.when((ratio > 900) & (ratio < 1100), calculated * 1000)
        .when((ratio > 900_000) & (ratio < 1_100_000), calculated * 1_000_000)
        .when((ratio > 0.0009) & (ratio < 0.0011), calculated / 1000)
        .when((ratio > 0.0000009) & (ratio < 0.0000011), calculated / 1_000_000)
    )
    blank = expected.isNull() | calculated.isNull() | F.isnan(expected) | F.isnan(calculated) | (expected == 0)
    return F.when(blank, calculated).otherwise(F.coalesce(scaled, calculated))


def is_close(a: Column, b: Column, rtol: float, atol: float = 1e-5) -> Column:
    """``|a - b| <= atol + rtol * |b|``; false if either is missing."""
    return F.coalesce(F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b), F.lit(False))
