"""Queries over filing notes."""

from pyspark.sql import functions as F

from millrace.functions.notes import period_end, period_kind, quarter_status, safe_name, short_number, valid_month
from millrace.operators import notes as N
from millrace.queries.registry import query

PERIODS = ('1995-12-31 (FY)', '1996-03-31 (Q1)', '1996-06-30 (YTD)', 'to 1997-06-30')
TIDY = "tidy AS (" + " UNION ALL ".join(
    f"""SELECT ticker, concept, dimension_member_label, '{p}' AS period_raw, "{p}" AS value FROM wide_v""" for p in PERIODS) + ")"
PARSED = """CASE WHEN regexp_extract(period_raw, '(\\d{4}-\\d{2}-\\d{2})', 1) = '' THEN '1970-01-01' ELSE regexp_extract(period_raw, '(\\d{4}-\\d{2}-\\d{2})', 1) END AS period_end_date,
  CASE WHEN regexp_extract(period_raw, '\\((FY|Q[1-4]|YTD|H[1-2])\\)', 1) = '' THEN 'UNKNOWN' ELSE regexp_extract(period_raw, '\\((FY|Q[1-4]|YTD|H[1-2])\\)', 1) END AS period_type"""


@query("note_tidy", ["wide_v"], f"WITH {TIDY} SELECT *, {PARSED} FROM tidy")
def note_tidy(v):
    return N.to_tidy(v("wide_v"), ["ticker"])


@query("note_period", [], f"""
SELECT DISTINCT period_raw, {PARSED} FROM (
  SELECT concat(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), CASE o_orderstatus WHEN 'F' THEN ' (FY)' WHEN 'O' THEN ' (Q3)' ELSE ' (M1)' END) AS period_raw FROM orders
  UNION ALL SELECT o_orderpriority FROM orders)""")
def note_period(v):
    suffix = F.when(F.col("o_orderstatus") == "F", " (FY)").when(F.col("o_orderstatus") == "O", " (Q3)").otherwise(" (M1)")
    dated = v("orders").select(F.concat(F.to_date("o_orderdate").cast("string"), suffix).alias("period_raw"))
    both = dated.unionByName(v("orders").select(F.col("o_orderpriority").alias("period_raw"))).distinct()
    return both.withColumn("period_end_date", period_end(F.col("period_raw"))).withColumn("period_type", period_kind(F.col("period_raw")))


DETAIL_ID = "concat(accession_no, '|', note_number, '|0|', concept, '|', CAST(period_end_date AS VARCHAR), '|', row_order)"


@query("note_ids", ["tidy_v"], f"SELECT {DETAIL_ID} AS detail_id, md5(concat({DETAIL_ID}, '||', value)) AS content_hash FROM tidy_v")
def note_ids(v):
    rows = v("tidy_v").withColumn("period_raw", F.col("period_end_date").cast("string")).withColumn("detail_index", F.lit(0))
    return N.with_ids(rows).select("detail_id", "content_hash")


@query("note_fill", ["tidy_v"], """
SELECT detail_id, CASE WHEN abstract THEN 'True' ELSE 'False' END AS abstract, concept, '' AS balance, coalesce(CAST(TRY_CAST(value AS DOUBLE) / 100000 AS INT), 0) AS small_level FROM tidy_v""")
def note_fill(v):
    rows = v("tidy_v").withColumn("level", F.rint(F.col("value").try_cast("double") / 100000))
    return N.fill_meta(rows).select("detail_id", "abstract", "concept", "balance", F.col("level").alias("small_level"))


@query("note_registry", ["tidy_v"], """
WITH r AS (SELECT ticker, 'Lines' AS detail_table_name, accession_no, note_number, CAST(count(*) AS BIGINT) AS row_count,
  array_to_string(list_sort(list(DISTINCT concept)), ',') AS concepts FROM tidy_v GROUP BY 1, 2, 3, 4)
SELECT *, md5(concat(ticker, '|', detail_table_name, '|', accession_no, '|', note_number)) AS registry_id FROM r""")
def note_registry(v):
    made = N.registry(v("tidy_v").withColumn("detail_table_name", F.lit("Lines")))
    return made.withColumn("concepts", F.array_join("available_concepts", ",")).drop("available_concepts")


SAMPLE = """CASE WHEN TRY_CAST(value AS DOUBLE) IS NULL THEN substr(value, 1, 20) WHEN abs(TRY_CAST(value AS DOUBLE)) >= 1e9 THEN format('{:.1f}B', TRY_CAST(value AS DOUBLE) / 1e9)
  WHEN abs(TRY_CAST(value AS DOUBLE)) >= 1e6 THEN format('{:.1f}M', TRY_CAST(value AS DOUBLE) / 1e6) WHEN abs(TRY_CAST(value AS DOUBLE)) >= 1e3 THEN format('{:.1f}K', TRY_CAST(value AS DOUBLE) / 1e3)
  ELSE format('{:.2f}', TRY_CAST(value AS DOUBLE)) END"""


@query("note_catalog", ["tidy_v"], f"""
WITH g AS (SELECT ticker, accession_no, note_number, concept, dimension_member_label, CAST(count(DISTINCT period_end_date) AS BIGINT) AS period_count,
  min(period_end_date) AS earliest_period, max(period_end_date) AS latest_period, arg_max(struct_pack(l := label, a := dimension_axis, v := {SAMPLE}), (period_end_date, detail_id)) AS s
  FROM tidy_v WHERE NOT abstract AND value <> '' GROUP BY 1, 2, 3, 4, 5)
SELECT * EXCLUDE (s), s.l AS label, s.a AS dimension_axis, s.v AS sample_value FROM g
QUALIFY row_number() OVER (PARTITION BY ticker, accession_no, note_number ORDER BY concept, dimension_member_label) <= 50""")
def note_catalog(v):
    return N.concept_catalog(v("tidy_v"), n=50)


@query("note_sample", ["tidy_v"], f"""SELECT detail_id, {SAMPLE} AS sample FROM (
  SELECT detail_id, CASE WHEN concept = 'A' THEN concat('about ', label, ' and more text') WHEN concept = 'N' THEN concat(value, '00') ELSE value END AS value FROM tidy_v)""")
def note_sample(v):
    c = F.col("concept")
    text = F.when(c == "A", F.concat(F.lit("about "), "label", F.lit(" and more text"))).when(c == "N", F.concat("value", F.lit("00"))).otherwise(F.col("value"))
    return v("tidy_v").select("detail_id", short_number(text).alias("sample"))


@query("note_series", ["tidy_v"], """
SELECT period_end_date, detail_id, value, label FROM tidy_v WHERE ticker = 'BUILDING' AND concept = 'R'
  AND period_end_date >= DATE '1996-02-01' AND period_end_date <= DATE '1998-06-30' ORDER BY period_end_date DESC, detail_id DESC LIMIT 500""")
def note_series(v):
    return N.series(v("tidy_v"), "BUILDING", "R", "1996-02", "1998-06", 500).select("period_end_date", "detail_id", "value", "label")


@query("note_valid_month", [], """
SELECT DISTINCT m, regexp_matches(m, '^\\d{4}-(0[1-9]|1[0-2])$') AND TRY_CAST(substr(m, 1, 4) AS INT) > 1900 AS valid FROM (
  SELECT substr(CAST(o_orderdate AS VARCHAR), 1, 7) AS m FROM orders UNION ALL SELECT concat('1999-', day(o_orderdate)) FROM orders UNION ALL SELECT o_orderpriority FROM orders)""")
def note_valid_month(v):
    o = v("orders")
    texts = o.select(F.date_format("o_orderdate", "yyyy-MM").alias("m")).unionByName(
        o.select(F.concat(F.lit("1999-"), F.dayofmonth("o_orderdate").cast("string")).alias("m"))
    ).unionByName(o.select(F.col("o_orderpriority").alias("m"))).distinct()
    return texts.withColumn("valid", valid_month(F.col("m")))


@query("note_filing_range", ["filings_v"], """
SELECT accession_no, concat(year(period_of_report) - 2, '-', lpad(CAST(fiscal_year_end_month AS VARCHAR), 2, '0')) AS start_month, strftime(period_of_report, '%Y-%m') AS end_month FROM filings_v""")
def note_filing_range(v):
    return N.filing_range(v("filings_v")).select("accession_no", "start_month", "end_month")


FQ = "CAST(floor(((month({d}) - {m} - 1 + 24) % 12) / 3) + 1 AS INT)"
FY = "CAST(year({d}) + CASE WHEN month({d}) > {m} THEN 1 ELSE 0 END AS INT)"


@query("note_fiscal_quarter", ["filings_v"], f"""
WITH f AS (SELECT accession_no, period_of_report AS d, CAST(1 + nation / 3 AS INT) AS m FROM (SELECT accession_no, period_of_report, CAST(floor(nation / 3) * 3 AS INT) AS nation FROM filings_v))
SELECT accession_no, {FQ.format(d='d', m='m')} AS quarter, {FY.format(d='d', m='m')} AS year FROM f""")
def note_fiscal_quarter(v):
    rows = v("filings_v").withColumn("fiscal_year_end_month", (F.floor(F.col("nation") / 3) + 1).cast("int"))
    return N.with_fiscal_quarter(rows).select("accession_no", "quarter", "year")


@query("note_quarter_range", ["filings_v"], f"""
WITH s AS (SELECT ticker, form, min(period_of_report) AS a, max(period_of_report) AS b FROM filings_v GROUP BY ticker, form),
n AS (SELECT *, {FY.format(d='a', m='9')} * 4 + {FQ.format(d='a', m='9')} - 1 AS x, {FY.format(d='b', m='9')} * 4 + {FQ.format(d='b', m='9')} - 1 AS y FROM s),
e AS (SELECT ticker, form, unnest(generate_series(x, least(y, x + 11))) AS q FROM n)
SELECT ticker, form, CAST(q // 4 AS INT) AS fiscal_year, CAST(q % 4 + 1 AS INT) AS fiscal_quarter FROM e""")
def note_quarter_range(v):
    spans = v("filings_v").groupBy("ticker", "form").agg(F.min("period_of_report").alias("a"), F.max("period_of_report").alias("b"))
    return N.quarter_range(spans, "a", "b", F.lit(9), 12).select("ticker", "form", "fiscal_year", "fiscal_quarter")


@query("note_fye_mode", ["filings_v"], """
WITH f AS (SELECT concat(ticker, '-', nation) AS ticker, form, filing_date, accession_no, month(period_of_report) AS m FROM filings_v),
a AS (SELECT * FROM f WHERE form = '10-K' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY filing_date DESC, accession_no DESC) <= 5),
g AS (SELECT ticker, m, count(*) AS n, max(struct_pack(d := filing_date, a := accession_no)) AS l FROM a GROUP BY 1, 2),
b AS (SELECT ticker, m FROM g QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY n DESC, l DESC) = 1)
SELECT t.ticker, CAST(coalesce(m, 12) AS INT) AS fiscal_year_end_month FROM (SELECT DISTINCT ticker FROM f) t LEFT JOIN b ON t.ticker = b.ticker""")
def note_fye_mode(v):
    rows = v("filings_v").withColumn("ticker", F.concat("ticker", F.lit("-"), F.col("nation").cast("string")))
    return N.fiscal_year_end(rows)


@query("note_filings", ["filings_v"], """
WITH a AS (SELECT * FROM filings_v WHERE form IN ('10-K', '10-Q') QUALIFY row_number() OVER (PARTITION BY ticker, form ORDER BY filing_date DESC, accession_no DESC) <= 15)
SELECT ticker, form, accession_no, filing_date, CAST(row_number() OVER (PARTITION BY ticker ORDER BY filing_date DESC, accession_no DESC) AS BIGINT) AS filing_rank FROM a QUALIFY filing_rank <= 25""")
def note_filings(v):
    return N.newest_filings(v("filings_v"), ["10-K", "10-Q"], 15, 25).select("ticker", "form", "accession_no", "filing_date", "filing_rank")


@query("note_delete", ["tidy_v"], """
WITH g AS (SELECT accession_no FROM tidy_v GROUP BY 1 HAVING min(period_end_date) >= DATE '1995-06-01'),
r AS (SELECT DISTINCT accession_no, note_number FROM tidy_v)
SELECT 'details' AS table_name, CAST(count(*) FILTER (WHERE accession_no IN (FROM g)) AS BIGINT) AS deleted, CAST(count(*) FILTER (WHERE accession_no NOT IN (FROM g)) AS BIGINT) AS kept FROM tidy_v
UNION ALL SELECT 'registry', count(*) FILTER (WHERE accession_no IN (FROM g)), count(*) FILTER (WHERE accession_no NOT IN (FROM g)) FROM r""")
def note_delete(v):
    rows = v("tidy_v")
    gone = rows.groupBy("accession_no").agg(F.min("period_end_date").alias("d")).filter("d >= DATE '1995-06-01'")
    kept, lost = N.delete_filing({"details": rows, "registry": rows.select("accession_no", "note_number").distinct()}, gone)
    counts = [df.agg(F.count(F.lit(1)).alias("kept")).select(F.lit(t).alias("table_name"), "kept") for t, df in kept.items()]
    return lost.join(counts[0].unionByName(counts[1]), "table_name")


@query("note_overview", ["tidy_v", "filings_v"], """
WITH d AS (SELECT DISTINCT accession_no, note_number, concat(concept, '/', dimension_member_label, '/', label) AS concept FROM tidy_v WHERE NOT abstract),
p AS (SELECT accession_no, note_number, array_to_string(list(concept ORDER BY concept), ', ') AS preview FROM
  (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY accession_no, note_number ORDER BY concept) <= 5) GROUP BY 1, 2)
SELECT n.accession_no, n.note_number, n.n, coalesce(preview, '') AS preview FROM (SELECT accession_no, note_number, CAST(count(*) AS BIGINT) AS n FROM tidy_v GROUP BY 1, 2) n
LEFT JOIN p ON n.accession_no = p.accession_no AND n.note_number = p.note_number""")
def note_overview(v):
    rows = v("tidy_v")
    notes = rows.groupBy("accession_no", "note_number").agg(F.count(F.lit(1)).alias("n"))
    return N.notes_overview(notes, rows.filter("NOT abstract").withColumn("concept", F.concat_ws("/", "concept", "dimension_member_label", "label")))


@query("note_status", ["filings_v"], "SELECT accession_no, CASE form WHEN '10-Q' THEN 'direct' WHEN '10-K' THEN 'from_annual_filing' ELSE 'unknown' END AS quarterly_status FROM filings_v")
def note_status(v):
    return v("filings_v").select("accession_no", quarter_status(F.col("form")).alias("quarterly_status"))


@query("note_upsert", ["tidy_v"], """
WITH u AS (SELECT detail_id, any_value(value) AS value, any_value(concept) AS concept, any_value(note_number) AS note_number FROM tidy_v GROUP BY 1)
SELECT detail_id, CASE WHEN note_number <= 4 THEN concat(value, '!') ELSE value END AS value, 'first' AS created_at FROM u
UNION ALL SELECT concat(detail_id, '+'), concat(value, '!'), 'second' FROM u WHERE note_number > 4""")
def note_upsert(v):
    # One whole row of each id, as one value: both sides read the same columns, so Spark makes it once.
    row = F.struct("value", "note_number", F.col("period_end_date").alias("updated_at"))
    rows = v("tidy_v").groupBy("detail_id").agg(F.any_value(row).alias("_row")).select("detail_id", "_row.*")
    old = rows.withColumn("created_at", F.lit("first"))
    other = F.when(F.col("note_number") > 4, F.concat("detail_id", F.lit("+"))).otherwise(F.col("detail_id"))
    new = rows.withColumn("created_at", F.lit("second")).withColumn("value", F.concat("value", F.lit("!"))).withColumn("detail_id", other)
    return N.upsert_notes(old, new).select("detail_id", "value", "created_at")


@query("note_rows", ["filings_v"], """
WITH t AS (SELECT concat('f-', l_orderkey) AS accession_no, l_linenumber AS note_number, count(*) AS n FROM lineitem GROUP BY 1, 2),
n AS (SELECT f.accession_no, ticker, form, CAST(h AS INT) AS note_number, concat(form, ' of ', ticker) AS title, CASE WHEN form = '8-K' THEN '' ELSE concat('Text of ', f.accession_no) END AS txt
  FROM filings_v f, (SELECT unnest([1, 2]) AS h)),
j AS (SELECT n.*, CAST(coalesce(t.n, 0) AS BIGINT) AS table_count, CASE WHEN txt = '' THEN '' ELSE md5(txt) END AS narrative_hash FROM n LEFT JOIN t ON n.accession_no = t.accession_no AND n.note_number = t.note_number)
SELECT concat(ticker, '|', form, '|', accession_no, '|N', note_number) AS note_id, table_count, narrative_hash,
  md5(concat(note_number, '|', title, '|', narrative_hash, '|', table_count, '|', table_count)) AS content_hash FROM j""")
def note_rows(v):
    lines = v("lineitem").select(F.concat(F.lit("f-"), F.col("l_orderkey").cast("string")).alias("accession_no"), F.col("l_linenumber").alias("note_number"))
    notes = v("filings_v").select("accession_no", "ticker", "form", F.explode(F.array(F.lit(1), F.lit(2))).alias("note_number"))
    notes = notes.withColumn("title", F.concat("form", F.lit(" of "), "ticker")).withColumn(
        "narrative_text", F.when(F.col("form") == "8-K", "").otherwise(F.concat(F.lit("Text of "), "accession_no")))
    return N.note_rows(notes, lines, lines).select("note_id", "table_count", "narrative_hash", "content_hash")


@query("note_safe_name", [], """
SELECT p_partkey, concat(trim(substr(regexp_replace(CASE WHEN trim(t) = '' THEN concat('Note', p_size) ELSE trim(t) END, '[^a-zA-Z0-9]', '_', 'g'), 1, 40), '_'), '_D', p_size) AS name
FROM (SELECT *, CASE WHEN p_size < 10 THEN '  ' ELSE concat(p_name, ' (', p_brand, ') / ', p_type, ' ', p_name) END AS t FROM part)""")
def note_safe_name(v):
    title = F.when(F.col("p_size") < 10, "  ").otherwise(
        F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") / "), "p_type", F.lit(" "), "p_name"))
    return v("part").select("p_partkey", safe_name(title, F.concat(F.lit("Note"), F.col("p_size").cast("string")), F.col("p_size")).alias("name"))
