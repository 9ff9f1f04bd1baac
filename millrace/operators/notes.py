"""Filing notes in tidy form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.notes import (
    fiscal_quarter, fiscal_year, md5_of, period_end, period_kind, quarter_status, short_number,
)
from millrace.operators.sync import merge
from millrace.plans.shapes import first_per_key, small_side, top_per_key

# Columns of a detail frame that describe a row; all others are periods.
META_COLUMNS = (
    "abstract", "balance", "concept", "dimension", "dimension_axis", "dimension_label", "dimension_member",
    "dimension_member_label", "is_breakdown", "label", "level", "parent_abstract_concept", "parent_concept",
    "preferred_sign", "standard_concept", "weight",
)


def to_tidy(wide: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row for each row and period column; missing values become empty text."""
    ids = [c for c in wide.columns if c in META_COLUMNS or c == "row_order" or c in keys]
    periods = [c for c in wide.columns if c not in ids]
    if not periods:
        raise ValueError("no period columns")
    texts = wide.select(*ids, *[F.coalesce(F.col(f"`{p}`").cast("string"), F.lit("")).alias(p) for p in periods])
    tidy = texts.unpivot(ids, [F.col(f"`{p}`") for p in periods], "period_raw", "value")
    return with_period(tidy)


def with_period(tidy: DataFrame) -> DataFrame:
    header = F.col("period_raw")
    return tidy.withColumn("period_end_date", period_end(header)).withColumn("period_type", period_kind(header))


def with_ids(tidy: DataFrame) -> DataFrame:
    """Row id from its place in the filing, and a hash of id and value."""
    parts = ["accession_no", "note_number", "detail_index", "concept", "period_raw", "row_order"]
    row_id = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts])
    return tidy.withColumn("detail_id", row_id).withColumn(
        "content_hash", F.md5(F.concat_ws("||", "detail_id", F.coalesce("value", F.lit("")))))


def fill_meta(tidy: DataFrame) -> DataFrame:
    """Every descriptive column as text, empty if missing; ``level`` as a whole number, 0 if unreadable."""
    for name in META_COLUMNS:
        known = name in tidy.columns
        if name == "level":
            level = F.col(name).cast("string").try_cast("double").try_cast("int") if known else F.lit(None).cast("int")
            value = F.coalesce(level, F.lit(0))
        elif known and tidy.schema[name].dataType.simpleString() == "boolean":
            value = F.coalesce(F.initcap(F.col(name).cast("string")), F.lit(""))
        else:
            value = F.coalesce(F.col(name).cast("string"), F.lit("")) if known else F.lit("")
        tidy = tidy.withColumn(name, value)
    return tidy


def registry(tidy: DataFrame, key: Sequence[str] = ("ticker", "detail_table_name", "accession_no", "note_number")) -> DataFrame:
    """Row count and distinct concepts of each detail table, with an id from its natural key.

    Concepts are made distinct first and gathered as a list; ``registry_concepts``
    gives them as rows, for tables that may have more than a list should hold.
    """
    key = list(key)
    counts = _concept_counts(tidy, key)
    named = F.when(F.coalesce("concept", F.lit("")) != "", F.col("concept"))
    return counts.groupBy(*key).agg(
        F.sum("_n").alias("row_count"), F.array_sort(F.collect_list(named)).alias("available_concepts"),
    ).withColumn("registry_id", md5_of(*[F.col(k) for k in key]))


def _concept_counts(tidy: DataFrame, key: list[str]) -> DataFrame:
    return tidy.groupBy(*key, "concept").agg(F.count(F.lit(1)).alias("_n"))


def registry_concepts(tidy: DataFrame, key: Sequence[str] = ("ticker", "detail_table_name", "accession_no", "note_number")) -> DataFrame:
    """Id of each detail table and each of its concepts, with the number of rows; nothing is gathered."""
    counts = _concept_counts(tidy, list(key)).filter(F.coalesce("concept", F.lit("")) != "")
    return counts.withColumn("registry_id", md5_of(*[F.col(k) for k in key])).select(
        "registry_id", "concept", F.col("_n").alias("row_count"))


def concept_catalog(details: DataFrame, key: Sequence[str] = ("ticker", "accession_no", "note_number"),
                    n: int | None = None) -> DataFrame:
    """Concept and member of each note: periods, first and last, and the newest label, axis and value.

    Headings and empty values do not count; a note lists its first ``n`` entries, or all.
    """
    group = [*key, "concept", "dimension_member_label"]
    shown = details.filter(~F.col("abstract") & (F.col("value") != ""))
    # One row per period first: its last entry.  Periods are then few, and distinct.
    entry = F.struct("detail_id", "label", "dimension_axis", "value")
    periods = shown.groupBy(*group, "period_end_date").agg(F.max(entry).alias("_e"))
    whole = periods.groupBy(*group).agg(
        F.count(F.lit(1)).alias("period_count"), F.min("period_end_date").alias("earliest_period"),
        F.max(F.struct("period_end_date", "_e")).alias("_last"),
    ).select(
        *group, "period_count", "earliest_period", F.col("_last.period_end_date").alias("latest_period"),
        F.col("_last._e.label").alias("label"), F.col("_last._e.dimension_axis").alias("dimension_axis"),
        short_number(F.col("_last._e.value")).alias("sample_value"))
    if n is None:
        return whole
    return top_per_key(whole, list(key), [F.col("concept").asc(), F.col("dimension_member_label").asc()], n)


def series(details: DataFrame, ticker: str, concept: str, start: str | None = None, end: str | None = None,
           n: int | None = None) -> DataFrame:
    """One concept from the first day of one month to the last day of another, newest first."""
    import re

    for month in (start, end):
        if month and not re.fullmatch(r"(19|[2-9]\d)\d{2}-(0[1-9]|1[0-2])", month):
            raise ValueError(f"not a month: {month!r}")
    found = details.filter((F.col("ticker") == ticker) & (F.col("concept") == concept))
    if start:
        found = found.filter(F.col("period_end_date") >= F.lit(f"{start}-01").cast("date"))
    if end:
        found = found.filter(F.col("period_end_date") <= F.last_day(F.lit(f"{end}-01").cast("date")))
    newest = found.orderBy(F.desc("period_end_date"), F.desc("detail_id"))
    return newest if n is None else newest.limit(n)


def filing_range(filings: DataFrame) -> DataFrame:
    """Months shown for a filing: two years back, from the month in which the fiscal year ends."""
    period = F.col("period_of_report")
    month = F.coalesce(F.nullif(F.col("fiscal_year_end_month"), F.lit(0)), F.lit(12))
    start = F.concat(F.lpad((F.year(period) - 2).cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"))
    return filings.withColumn("start_month", F.coalesce(start, F.lit(""))).withColumn(
        "end_month", F.coalesce(F.date_format(period, "yyyy-MM"), F.lit("")))


def with_fiscal_quarter(filings: DataFrame) -> DataFrame:
    month = F.col("fiscal_year_end_month")
    return filings.withColumn("quarter", fiscal_quarter(F.month("period_of_report"), month)).withColumn(
        "year", fiscal_year(F.col("period_of_report"), month))


def quarter_range(df: DataFrame, start: str, end: str, year_end_month: Column, n: int | None = None) -> DataFrame:
    """Fiscal quarters from one month to another (date columns), all of them or the first ``n``, one row each."""
    def number(col: str) -> Column:
        first = F.trunc(F.col(col), "month")
        return fiscal_year(first, year_end_month) * 4 + fiscal_quarter(F.month(first), year_end_month) - 1

    last = number(end) if n is None else F.least(number(end), number(start) + n - 1)
    quarters = F.when(last >= number(start), F.sequence(number(start), last))
    return (
        df.withColumn("_q", F.explode(quarters))
        .withColumn("fiscal_year", F.floor(F.col("_q") / 4).cast("int"))
        .withColumn("fiscal_quarter", (F.pmod("_q", F.lit(4)) + 1).cast("int"))
        .drop("_q")
    )


def fiscal_year_end(filings: DataFrame, form: str = "10-K", n: int = 5, default: int = 12) -> DataFrame:
    """Month in which the fiscal year of each ticker ends: the most common month of its newest annual filings."""
    annual = top_per_key(
        filings.filter((F.col("form") == form) & F.col("period_of_report").isNotNull()), ["ticker"],
        [F.col("filing_date").desc(), F.col("accession_no").desc()], n)
    months = annual.groupBy("ticker", F.month("period_of_report").alias("month")).agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.struct("filing_date", "accession_no")).alias("_last"))
    best = first_per_key(months, ["ticker"], [F.col("_n").desc(), F.col("_last").desc()]).select("ticker", "month")
    return filings.select("ticker").distinct().join(best, "ticker", "left").select(
        "ticker", F.coalesce("month", F.lit(default)).alias("fiscal_year_end_month"))


def newest_filings(filings: DataFrame, forms: Sequence[str], per_form: int = 20, total: int = 40) -> DataFrame:
    """The newest filings of each ticker: at most ``per_form`` of a form and ``total`` in all."""
    order = [F.col("filing_date").desc(), F.col("accession_no").desc()]
    some = top_per_key(filings.filter(F.col("form").isin(*forms)), ["ticker", "form"], order, per_form)
    return top_per_key(some, ["ticker"], order, total, "filing_rank")


def delete_filing(tables: dict[str, DataFrame], accessions: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables without the rows of the given filings, and how many rows each lost."""
    gone = small_side(accessions.select("accession_no").distinct())
    kept, lost = {}, None
    for name, df in tables.items():
        kept[name] = df.join(gone, "accession_no", "left_anti")
        count = df.join(gone, "accession_no", "left_semi").agg(F.count(F.lit(1)).alias("deleted")).select(
            F.lit(name).alias("table_name"), "deleted")
        lost = count if lost is None else lost.unionByName(count)
    return kept, lost


def notes_overview(notes: DataFrame, details: DataFrame, key: Sequence[str] = ("accession_no", "note_number"), n: int = 5) -> DataFrame:
    """Each note with its first ``n`` concepts in one text; notes without details stay."""
    key = list(key)
    named = details.filter(F.coalesce("concept", F.lit("")) != "").select(*key, "concept").distinct()
    few = top_per_key(named, key, [F.col("concept").asc()], n)
    preview = few.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("concept")), ", ").alias("preview"))
    return notes.join(preview, key, "left").withColumn("preview", F.coalesce("preview", F.lit("")))


def with_status(filings: DataFrame) -> DataFrame:
    return filings.withColumn("quarterly_status", quarter_status(F.col("form")))


def upsert_notes(old: DataFrame, new: DataFrame) -> DataFrame:
    return merge(old, new, ["detail_id"], keep=["created_at"])


def note_rows(notes: DataFrame, tables: DataFrame, details: DataFrame) -> DataFrame:
    """Notes with id, hash of their text, counts of tables and details, and a hash over all of it."""
    key = ["accession_no", "note_number"]
    n_tables = tables.groupBy(*key).agg(F.count(F.lit(1)).alias("table_count"))
    n_details = details.groupBy(*key).agg(F.count(F.lit(1)).alias("details_count"))
    zero = F.lit(0).cast("long")
    text = F.coalesce("narrative_text", F.lit(""))
    return (
        notes.join(n_tables, key, "left").join(n_details, key, "left")
        .withColumn("table_count", F.coalesce("table_count", zero))
        .withColumn("details_count", F.coalesce("details_count", zero))
        .withColumn("filing_id", F.concat_ws("|", "ticker", "form", "accession_no"))
        .withColumn("note_id", F.concat(F.col("filing_id"), F.lit("|N"), F.col("note_number").cast("string")))
        .withColumn("narrative_hash", F.when(text == "", F.lit("")).otherwise(F.md5(text)))
        .withColumn("content_hash", md5_of(*[F.col(c) for c in ("note_number", "title", "narrative_hash", "table_count", "details_count")]))
    )
