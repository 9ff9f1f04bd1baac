"""Quarterly financial facts, for all tickers in one job.

Raw facts have ticker, concept, period_start, period_end, fiscal_period,
fiscal_year, numeric_value, unit and period_type; a blueprint lists the concepts
of one statement with label, depth, is_abstract, is_total and position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.finance import format_value, is_non_additive, quarter_label, short_concept
from millrace.plans.shapes import first_per_key, small_side, top_per_key

MAX_QUARTER_DAYS = 105
QUARTERS = ("Q1", "Q2", "Q3", "Q4")
FACT_KEY = ("ticker", "statement_type", "concept", "quarter")
UNKNOWN_ORDER = 999

# The figures shown first, by statement.
KEY_METRICS = {
    "income": {
        "us-gaap:Revenues": "Revenue",
        "us-gaap:GrossProfit": "Gross Profit",
        "us-gaap:OperatingIncomeLoss": "Operating Income",
        "us-gaap:NetIncomeLoss": "Net Income",
        "us-gaap:EarningsPerShareBasic": "EPS (Basic)",
    },
    "balance": {
        "us-gaap:Assets": "Total Assets",
        "us-gaap:Liabilities": "Total Liabilities",
        "us-gaap:StockholdersEquity": "Stockholders' Equity",
        "us-gaap:CashAndCashEquivalentsAtCarryingValue": "Cash & Equivalents",
    },
    "cashflow": {
        "us-gaap:NetCashProvidedByUsedInOperatingActivities": "Operating CF",
        "us-gaap:NetCashProvidedByUsedInInvestingActivities": "Investing CF",
    },
}


def _days() -> Column:
    return F.datediff("period_end", "period_start")


def quarterly_only(facts: DataFrame, max_days: int = MAX_QUARTER_DAYS) -> DataFrame:
    """Durations of a quarter at most, with room for a 14-week one."""
    return facts.filter(_days() <= max_days)


def in_blueprint(facts: DataFrame, blueprint: DataFrame) -> DataFrame:
    """Facts of the statement's concepts that are not headings."""
    return facts.join(blueprint.filter("NOT is_abstract").select("concept"), "concept", "left_semi")


def derive_q4(facts: DataFrame, existing: DataFrame) -> DataFrame:
    """Add fourth quarters: the year less its first nine months.

    Only for concepts that add up, where no fourth quarter with that end exists.
    The longest year and nine-month fact with the same start are paired.
    """
    additive = facts.filter(
        (F.col("period_type") == "duration") & F.col("fiscal_period").isin("FY", "Q3") & ~is_non_additive(F.col("concept")))
    key = ["ticker", "concept", "period_start"]
    longest = first_per_key(additive, [*key, "fiscal_period"], [_days().desc(), F.col("fiscal_year").desc()])
    is_year = F.col("fiscal_period") == "FY"
    rest = [c for c in facts.columns if c not in key]
    pairs = longest.groupBy(*key).agg(
        F.max(F.when(is_year, F.struct(*rest))).alias("_year"), F.max(F.when(~is_year, F.col("numeric_value"))).alias("_nine"))
    derived = (
        pairs.filter("_year.numeric_value IS NOT NULL AND _nine IS NOT NULL").select(*key, "_year.*", "_nine")
        .withColumn("numeric_value", F.col("numeric_value") - F.col("_nine"))
        .withColumn("fiscal_period", F.lit("Q4"))
        .withColumn("quarter", quarter_label(F.col("period_end"), F.lit("Q4")))
        .withColumn("period_start", F.lit(None).cast("date"))
        .select(*existing.columns)
    )
    # A year that has its fourth quarter needs none: where both are there, the existing one comes first.
    both = existing.withColumn("_derived", F.lit(0)).unionByName(derived.withColumn("_derived", F.lit(1)))
    same_end = Window.partitionBy("ticker", "concept", "period_end")
    has_q4 = F.max(F.when((F.col("_derived") == 0) & (F.col("fiscal_period") == "Q4"), 1)).over(same_end)
    wanted = both.withColumn("_has_q4", has_q4).filter("numeric_value IS NOT NULL AND (_derived = 0 OR _has_q4 IS NULL)")
    return first_per_key(
        wanted.drop("_derived", "_has_q4"), ["ticker", "concept", "quarter"], [F.col("fiscal_year").desc(), F.col("period_end").desc()])


def enrich(facts: DataFrame, blueprint: DataFrame) -> DataFrame:
    """Label, depth, total flag and order from the blueprint, with defaults for other concepts."""
    bp = blueprint.select("concept", "label", "depth", "is_total", "position")
    return (
        facts.join(bp, "concept", "left")
        .withColumn("label", F.coalesce("label", short_concept(F.col("concept"))))
        .withColumn("depth", F.coalesce("depth", F.lit(0)))
        .withColumn("is_total", F.coalesce("is_total", F.lit(False)))
        .withColumn("concept_order", F.coalesce("position", F.lit(UNKNOWN_ORDER)))
        .drop("position")
    )


def newest_quarters(facts: DataFrame, n: int, by: Sequence[str] = ("ticker",)) -> DataFrame:
    """Facts of the ``n`` newest quarters of each group, by the median period end of each label."""
    if n <= 0:
        return facts
    # Equal ends are counted together, so that a median never gathers single facts.
    ends = facts.groupBy(*by, "quarter", F.unix_date("period_end").alias("_end")).agg(F.count(F.lit(1)).alias("_n"))
    middle = ends.groupBy(*by, "quarter").agg(F.expr("percentile(_end, 0.5, _n)").alias("_mid"))
    kept = top_per_key(middle, list(by), [F.col("_mid").desc_nulls_last(), F.col("quarter").desc()], n)
    return facts.join(kept.select(*by, "quarter"), [*by, "quarter"], "left_semi")


def _newest_of_statement(facts: DataFrame, n: int) -> DataFrame:
    """As ``newest_quarters``, for statements, which have one row for each ticker, concept and quarter.

    A ticker then has no more rows than its blueprint has concepts and the calendar
    has quarters, so the windows run over tickers and nothing is computed twice.
    """
    if n <= 0:
        return facts
    middle = F.expr("percentile(unix_date(period_end), 0.5)").over(Window.partitionBy("ticker", "quarter"))
    newest = Window.partitionBy("ticker").orderBy(F.col("_mid").desc_nulls_last(), F.col("quarter").desc())
    ranked = facts.repartition("ticker").withColumn("_mid", middle).withColumn("_rank", F.dense_rank().over(newest))
    return ranked.filter(F.col("_rank") <= n).drop("_mid", "_rank")


def income(facts: DataFrame, blueprint: DataFrame, n_quarters: int) -> DataFrame:
    """Income statement: single quarters, with fourth quarters derived."""
    blueprint = small_side(blueprint)
    listed = in_blueprint(facts, blueprint)
    single = quarterly_only(listed.filter(F.col("fiscal_period").isin(*QUARTERS) & (F.col("period_type") == "duration")))
    single = first_per_key(
        single, ["ticker", "concept", "period_end", "fiscal_period"],
        [F.col("fiscal_year").desc(), F.col("period_start").desc()])
    single = single.withColumn("quarter", quarter_label(F.col("period_end"), F.col("fiscal_period")))
    whole = enrich(derive_q4(listed, single), blueprint).withColumn("statement_type", F.lit("income"))
    return _newest_of_statement(whole, n_quarters)


def balance(facts: DataFrame, blueprint: DataFrame, n_quarters: int) -> DataFrame:
    """Balance sheet: instants; where a date is given twice, the year-end fact comes first."""
    blueprint = small_side(blueprint)
    listed = in_blueprint(facts, blueprint).filter(
        F.col("fiscal_period").isin(*QUARTERS, "FY") & (F.col("period_type") == "instant"))
    one = first_per_key(listed, ["ticker", "concept", "period_end"], [F.col("fiscal_period").asc(), F.col("fiscal_year").desc()])
    one = one.withColumn("fiscal_period", F.when(F.col("fiscal_period") == "FY", "Q4").otherwise(F.col("fiscal_period")))
    one = one.withColumn("quarter", quarter_label(F.col("period_end"), F.col("fiscal_period")))
    return _newest_of_statement(enrich(one, blueprint).withColumn("statement_type", F.lit("balance")), n_quarters)


def cashflow(facts: DataFrame, blueprint: DataFrame, n_quarters: int) -> DataFrame:
    """Cash flow: year-to-date sums made into quarters.

    A quarter appears only if the sum before it, with the same start, is there.
    """
    blueprint = small_side(blueprint)
    periods = ("Q1", "Q2", "Q3", "FY")
    listed = in_blueprint(facts, blueprint).filter(
        F.col("fiscal_period").isin(*QUARTERS, "FY") & (F.col("period_type") == "duration"))
    one = first_per_key(
        listed, ["ticker", "concept", "period_start", "fiscal_period"], [_days().desc(), F.col("fiscal_year").desc()])
    picks = [
        F.max(F.when(F.col("fiscal_period") == p, F.struct("numeric_value", "period_end"))).alias(p) for p in periods
    ]
    head = F.min_by(F.struct("fiscal_year", "unit"), "fiscal_period").alias("head")
    spread = one.groupBy("ticker", "concept", "period_start").agg(*picks, head)

    def part(label: str, now: str, before: str | None) -> Column:
        value = F.col(f"{now}.numeric_value")
        if before:
            value = value - F.col(f"{before}.numeric_value")
        return F.struct(F.lit(label).alias("fiscal_period"), F.col(f"{now}.period_end").alias("period_end"), value.alias("numeric_value"))

    parts = F.array(part("Q1", "Q1", None), part("Q2", "Q2", "Q1"), part("Q3", "Q3", "Q2"), part("Q4", "FY", "Q3"))
    single = (
        spread.select("ticker", "concept", "head.fiscal_year", "head.unit", F.inline(parts))
        .filter("numeric_value IS NOT NULL")
        .withColumn("quarter", quarter_label(F.col("period_end"), F.col("fiscal_period")))
        .withColumn("period_type", F.lit("duration"))
    )
    single = first_per_key(single, ["ticker", "concept", "quarter"], [F.col("fiscal_year").desc(), F.col("period_end").desc()])
    return _newest_of_statement(enrich(single, blueprint).withColumn("statement_type", F.lit("cashflow")), n_quarters)


def fact_hash() -> Column:
    """MD5 over ticker, statement, concept, quarter and value."""
    parts = ["ticker", "statement_type", "concept", "quarter", "numeric_value"]
    return F.md5(F.concat_ws("||", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts]))


def upsert_facts(old: DataFrame, new: DataFrame) -> DataFrame:
    """New facts replace old ones with the same key; the time of creation stays."""
    from millrace.operators.sync import merge

    return merge(old, new, list(FACT_KEY), keep=["created_at"])


def query_facts(facts: DataFrame, ticker: str, statement: str, concept: str | None = None,
                start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
    """Facts of a ticker and statement, in statement order, newest quarter first."""
    found = facts.filter((F.col("ticker") == ticker.upper()) & (F.col("statement_type") == statement.lower()))
    if concept:
        found = found.filter(F.col("concept") == F.regexp_replace(F.lit(concept), "^us-gaap_", "us-gaap:"))
    if start:
        found = found.filter(F.col("quarter") >= start)
    if end:
        found = found.filter(F.col("quarter") <= end)
    ordered = found.orderBy("concept_order", F.desc("quarter"), "concept")
    return ordered if limit is None else ordered.limit(limit)


def concepts(facts: DataFrame, ticker: str, statement: str | None = None) -> DataFrame:
    found = facts.filter(F.col("ticker") == ticker.upper())
    if statement:
        found = found.filter(F.col("statement_type") == statement.lower())
    return found.select("concept").distinct().orderBy("concept")


def status(facts: DataFrame) -> DataFrame:
    """Quarters, rows and newest quarter of each statement."""
    return facts.groupBy("ticker", "statement_type").agg(
        F.countDistinct("quarter").alias("quarters"), F.count(F.lit(1)).alias("n_rows"), F.max("quarter").alias("latest"))


def covered(facts: DataFrame, n: int) -> DataFrame:
    """Whether each ticker already has ``n`` quarters of each statement."""
    return status(facts).select("ticker", "statement_type", (F.col("quarters") >= n).alias("covered"))


def key_metrics(facts: DataFrame, metrics: dict[str, dict[str, str]] | None = None, n: int = 4) -> DataFrame:
    """Named figures over the newest ``n`` quarters of each statement, with unit."""
    names = [(s, c, label) for s, m in (metrics or KEY_METRICS).items() for c, label in m.items()]
    # The list of names is fixed and short.
    table = facts.sparkSession.createDataFrame(names, "statement_type string, concept string, metric string")
    named = facts.join(F.broadcast(table), ["statement_type", "concept"])
    recent = top_per_key(
        facts.select("ticker", "statement_type", "quarter").distinct(), ["ticker", "statement_type"],
        [F.col("quarter").desc()], n, "quarter_rank")
    return named.join(recent, ["ticker", "statement_type", "quarter"]).select(
        "ticker", "statement_type", "metric", "quarter", "quarter_rank", "numeric_value", "unit")


def pivot_facts(facts: DataFrame, quarters: Sequence[str]) -> DataFrame:
    """Concepts as rows, the given quarters as columns."""
    return facts.groupBy("ticker", "statement_type", "concept").pivot("quarter", list(quarters)).agg(F.first("numeric_value", True))


def pivot_newest(facts: DataFrame, n: int = 8) -> DataFrame:
    """Concepts as rows, the newest ``n`` quarters of each statement as columns ``q1`` (newest) on."""
    key = ["ticker", "statement_type"]
    recent = top_per_key(facts.select(*key, "quarter").distinct(), key, [F.col("quarter").desc()], n, "_r")
    placed = facts.join(recent, [*key, "quarter"])
    cells = [F.max(F.when(F.col("_r") == i, F.col("numeric_value"))).alias(f"q{i}") for i in range(1, n + 1)]
    return placed.groupBy(*key, "concept").agg(*cells)


def with_display(facts: DataFrame) -> DataFrame:
    return facts.withColumn("display", format_value(F.col("numeric_value"), F.col("unit")))


def ensure_tickers(old: DataFrame, new: DataFrame) -> DataFrame:
    """The known tickers, and those of ``new`` that were not known."""
    fresh = first_per_key(new, ["ticker"], [F.col(c).asc() for c in new.columns if c != "ticker"] or [F.lit(1)])
    return old.unionByName(fresh.join(old.select("ticker"), "ticker", "left_anti"))
