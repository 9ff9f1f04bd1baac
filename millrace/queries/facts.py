"""Queries over quarterly financial facts."""

from pyspark.sql import functions as F

from millrace.functions.finance import is_non_additive, quarter_label, short_concept
from millrace.operators import facts as A
from millrace.queries.registry import query

FACTS = ["facts_v", "blueprint_v"]
LABEL = """CASE WHEN fp = 'Q4' AND month(period_end) <= 3 THEN concat(year(period_end) - 1, '-', fp) ELSE concat(year(period_end), '-', fp) END"""
LISTED = "li AS (SELECT f.* FROM facts_v f WHERE concept IN (SELECT concept FROM blueprint_v WHERE NOT is_abstract))"

INCOME = f"""{LISTED},
single AS (SELECT ticker, concept, period_end, fiscal_period AS fp, fiscal_year, numeric_value FROM li
  WHERE fiscal_period IN ('Q1', 'Q2', 'Q3', 'Q4') AND period_type = 'duration' AND date_diff('day', period_start, period_end) <= 105
  QUALIFY row_number() OVER (PARTITION BY ticker, concept, period_end, fiscal_period ORDER BY fiscal_year DESC, period_start DESC) = 1),
fy AS (SELECT * FROM li WHERE fiscal_period = 'FY' AND period_type = 'duration' AND NOT regexp_matches(concept, 'EarningsPerShare|WeightedAverageNumberOf.*Shares|CommonStockDividendsPerShare|AntidilutiveSecurities')
  QUALIFY row_number() OVER (PARTITION BY ticker, concept, period_start ORDER BY date_diff('day', period_start, period_end) DESC, fiscal_year DESC) = 1),
nine AS (SELECT * FROM li WHERE fiscal_period = 'Q3' AND period_type = 'duration'
  QUALIFY row_number() OVER (PARTITION BY ticker, concept, period_start ORDER BY date_diff('day', period_start, period_end) DESC, fiscal_year DESC) = 1),
q4 AS (SELECT fy.ticker, fy.concept, fy.period_end, 'Q4' AS fp, fy.fiscal_year, fy.numeric_value - nine.numeric_value AS numeric_value
  FROM fy JOIN nine ON fy.ticker = nine.ticker AND fy.concept = nine.concept AND fy.period_start = nine.period_start
  WHERE NOT EXISTS (SELECT 1 FROM single s WHERE s.fp = 'Q4' AND s.ticker = fy.ticker AND s.concept = fy.concept AND s.period_end = fy.period_end)),
allq AS (SELECT *, {LABEL} AS quarter FROM (SELECT * FROM single UNION ALL SELECT * FROM q4)
  QUALIFY row_number() OVER (PARTITION BY ticker, concept, quarter ORDER BY fiscal_year DESC, period_end DESC) = 1)"""


def newest(source: str, n: int) -> str:
    return f"""mid AS (SELECT ticker, quarter, median(epoch(period_end)) AS m FROM {source} GROUP BY 1, 2),
keep AS (SELECT ticker, quarter FROM mid QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY m DESC, quarter DESC) <= {n})"""


@query("fact_label", ["facts_v"], f"""
SELECT DISTINCT period_end, fp AS fiscal_period, {LABEL} AS quarter FROM
  (SELECT period_end, fiscal_period AS fp FROM facts_v UNION ALL SELECT period_end - 300, 'Q4' FROM facts_v)""")
def fact_label(v):
    ends = v("facts_v").select("period_end", "fiscal_period")
    early = ends.select(F.date_sub("period_end", 300).alias("period_end"), F.lit("Q4").alias("fiscal_period"))
    both = ends.unionByName(early)
    return both.withColumn("quarter", quarter_label(F.col("period_end"), F.col("fiscal_period"))).distinct()


@query("fact_quarterly", ["facts_v"], """
SELECT ticker, concept, period_start, period_end, fiscal_period, fiscal_year, numeric_value FROM facts_v WHERE date_diff('day', period_start, period_end) <= 105""")
def fact_quarterly(v):
    return A.quarterly_only(v("facts_v")).select(
        "ticker", "concept", "period_start", "period_end", "fiscal_period", "fiscal_year", "numeric_value")


@query("fact_blueprint", FACTS, f"WITH {LISTED} SELECT ticker, concept, period_end, fiscal_period, fiscal_year, numeric_value FROM li")
def fact_blueprint(v):
    return A.in_blueprint(v("facts_v"), v("blueprint_v")).select(
        "ticker", "concept", "period_end", "fiscal_period", "fiscal_year", "numeric_value")


@query("fact_income", FACTS, f"""
WITH {INCOME}, {newest('allq', 8)}
SELECT a.ticker, a.concept, a.quarter, a.period_end, a.fiscal_year, a.numeric_value, b.label, b.depth, b.is_total, b.position AS concept_order
FROM allq a JOIN keep k ON a.ticker = k.ticker AND a.quarter = k.quarter LEFT JOIN blueprint_v b ON a.concept = b.concept""")
def fact_income(v):
    return A.income(v("facts_v"), v("blueprint_v"), 8).select(
        "ticker", "concept", "quarter", "period_end", "fiscal_year", "numeric_value", "label", "depth", "is_total", "concept_order")


@query("fact_non_additive", [], """
SELECT p_partkey, regexp_matches(concat(p_name, CASE WHEN p_size > 25 THEN ' EarningsPerShareBasic' WHEN p_size > 10 THEN ' WeightedAverageNumberOfDilutedShares' ELSE '' END),
  'EarningsPerShare|WeightedAverageNumberOf.*Shares|CommonStockDividendsPerShare|AntidilutiveSecurities') AS non_additive FROM part""")
def fact_non_additive(v):
    size = F.col("p_size")
    concept = F.concat("p_name", F.when(size > 25, " EarningsPerShareBasic").when(size > 10, " WeightedAverageNumberOfDilutedShares").otherwise(""))
    return v("part").select("p_partkey", is_non_additive(concept).alias("non_additive"))


@query("fact_q4", FACTS, f"WITH {INCOME} SELECT ticker, concept, quarter, period_end, fiscal_year, numeric_value FROM allq")
def fact_q4(v):
    listed = A.in_blueprint(v("facts_v"), v("blueprint_v"))
    single = A.quarterly_only(listed.filter("fiscal_period <> 'FY' AND period_type = 'duration'"))
    single = A.first_per_key(single, ["ticker", "concept", "period_end", "fiscal_period"], [F.desc("fiscal_year"), F.desc("period_start")])
    single = single.withColumn("quarter", quarter_label(F.col("period_end"), F.col("fiscal_period")))
    return A.derive_q4(listed, single).select("ticker", "concept", "quarter", "period_end", "fiscal_year", "numeric_value")


@query("fact_balance", FACTS, f"""
WITH {LISTED},
one AS (SELECT ticker, concept, period_end, CASE WHEN fiscal_period = 'FY' THEN 'Q4' ELSE fiscal_period END AS fp, fiscal_year, numeric_value
  FROM li WHERE period_type = 'instant' QUALIFY row_number() OVER (PARTITION BY ticker, concept, period_end ORDER BY fiscal_period, fiscal_year DESC) = 1),
named AS (SELECT *, {LABEL} AS quarter FROM one), {newest('named', 6)}
SELECT a.ticker, a.concept, a.quarter, a.fp AS fiscal_period, a.numeric_value, b.label, b.position AS concept_order
FROM named a JOIN keep k ON a.ticker = k.ticker AND a.quarter = k.quarter LEFT JOIN blueprint_v b ON a.concept = b.concept""")
def fact_balance(v):
    return A.balance(v("facts_v"), v("blueprint_v"), 6).select(
        "ticker", "concept", "quarter", "fiscal_period", "numeric_value", "label", "concept_order")


@query("fact_cashflow", FACTS, f"""
WITH {LISTED},
one AS (SELECT * FROM li WHERE period_type = 'duration' QUALIFY row_number() OVER
  (PARTITION BY ticker, concept, period_start, fiscal_period ORDER BY date_diff('day', period_start, period_end) DESC, fiscal_year DESC) = 1),
g AS (SELECT ticker, concept, period_start, min_by(fiscal_year, fiscal_period) AS fiscal_year,
  max(numeric_value) FILTER (WHERE fiscal_period = 'Q1') AS a, max(numeric_value) FILTER (WHERE fiscal_period = 'Q2') AS b,
  max(numeric_value) FILTER (WHERE fiscal_period = 'Q3') AS c, max(numeric_value) FILTER (WHERE fiscal_period = 'FY') AS d,
  max(period_end) FILTER (WHERE fiscal_period = 'Q1') AS ae, max(period_end) FILTER (WHERE fiscal_period = 'Q2') AS be,
  max(period_end) FILTER (WHERE fiscal_period = 'Q3') AS ce, max(period_end) FILTER (WHERE fiscal_period = 'FY') AS de FROM one GROUP BY 1, 2, 3),
u AS (SELECT ticker, concept, fiscal_year, 'Q1' AS fp, ae AS period_end, a AS numeric_value FROM g UNION ALL
  SELECT ticker, concept, fiscal_year, 'Q2', be, b - a FROM g UNION ALL SELECT ticker, concept, fiscal_year, 'Q3', ce, c - b FROM g UNION ALL
  SELECT ticker, concept, fiscal_year, 'Q4', de, d - c FROM g),
named AS (SELECT *, {LABEL} AS quarter FROM u WHERE numeric_value IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY ticker, concept, quarter ORDER BY fiscal_year DESC, period_end DESC) = 1), {newest('named', 12)}
SELECT n.ticker, n.concept, n.quarter, n.period_end, n.numeric_value FROM named n JOIN keep k ON n.ticker = k.ticker AND n.quarter = k.quarter""")
def fact_cashflow(v):
    return A.cashflow(v("facts_v"), v("blueprint_v"), 12).select("ticker", "concept", "quarter", "period_end", "numeric_value")


@query("fact_enrich", ["facts_v", "blueprint_v"], """
SELECT f.ticker, f.concept, f.period_end, f.fiscal_period, f.fiscal_year, f.numeric_value, coalesce(b.label, split_part(f.concept, ':', -1)) AS label,
  coalesce(b.depth, 0) AS depth, coalesce(b.is_total, false) AS is_total, coalesce(b.position, 999) AS concept_order
FROM facts_v f LEFT JOIN (SELECT * FROM blueprint_v WHERE NOT is_abstract) b ON f.concept = b.concept""")
def fact_enrich(v):
    return A.enrich(v("facts_v"), v("blueprint_v").filter("NOT is_abstract")).select(
        "ticker", "concept", "period_end", "fiscal_period", "fiscal_year", "numeric_value", "label", "depth", "is_total", "concept_order")


@query("fact_last_quarters", ["stored_v"], f"""
WITH {newest('stored_v', 5)} SELECT s.ticker, s.concept, s.quarter, s.numeric_value FROM stored_v s JOIN keep k ON s.ticker = k.ticker AND s.quarter = k.quarter""")
def fact_last_quarters(v):
    return A.newest_quarters(v("stored_v"), 5).select("ticker", "concept", "quarter", "numeric_value")


@query("fact_hash", ["stored_v"], "SELECT ticker, concept, quarter, md5(concat(ticker, '||', statement_type, '||', concept, '||', quarter, '||', numeric_value)) AS content_hash FROM stored_v")
def fact_hash(v):
    return v("stored_v").select("ticker", "concept", "quarter", A.fact_hash().alias("content_hash"))


@query("fact_upsert", ["stored_v"], """
WITH o AS (SELECT *, 'first' AS created_at FROM stored_v WHERE quarter < '2000'), n AS (SELECT *, 'second' AS created_at FROM stored_v WHERE quarter >= '1998')
SELECT coalesce(n.ticker, o.ticker) AS ticker, coalesce(n.concept, o.concept) AS concept, coalesce(n.quarter, o.quarter) AS quarter,
  coalesce(n.numeric_value + 1, o.numeric_value) AS numeric_value, coalesce(o.created_at, n.created_at) AS created_at
FROM o FULL JOIN n ON o.ticker = n.ticker AND o.statement_type = n.statement_type AND o.concept = n.concept AND o.quarter = n.quarter""")
def fact_upsert(v):
    rows = v("stored_v").withColumn("updated_at", F.col("period_end"))
    old = rows.filter("quarter < '2000'").withColumn("created_at", F.lit("first"))
    new = rows.filter("quarter >= '1998'").withColumn("created_at", F.lit("second")).withColumn("numeric_value", F.col("numeric_value") + 1)
    return A.upsert_facts(old, new).select("ticker", "concept", "quarter", "numeric_value", "created_at")


@query("fact_query", ["stored_v"], """
SELECT ticker, concept, quarter, numeric_value, concept_order FROM stored_v WHERE ticker = 'BUILDING' AND statement_type = 'income'
  AND quarter >= '1996-Q1' AND quarter <= '1999-Q4' ORDER BY concept_order, quarter DESC, concept LIMIT 100""")
def fact_query(v):
    return A.query_facts(v("stored_v"), "building", "income", start="1996-Q1", end="1999-Q4", limit=100).select(
        "ticker", "concept", "quarter", "numeric_value", "concept_order")


@query("fact_concepts", ["stored_v"], "SELECT DISTINCT concept FROM stored_v WHERE ticker = 'MACHINERY'")
def fact_concepts(v):
    return A.concepts(v("stored_v"), "machinery")


STATUS = """SELECT ticker, statement_type, CAST(count(DISTINCT quarter) AS BIGINT) AS quarters, CAST(count(*) AS BIGINT) AS n_rows, max(quarter) AS latest
FROM stored_v GROUP BY ticker, statement_type"""


@query("fact_status", ["stored_v"], STATUS)
def fact_status(v):
    return A.status(v("stored_v"))


@query("fact_covered", ["stored_v"], f"SELECT ticker, statement_type, quarters >= 27 AS covered FROM ({STATUS})")
def fact_covered(v):
    return A.covered(v("stored_v"), 27)


RECENT = """r AS (SELECT ticker, statement_type, quarter, CAST(row_number() OVER (PARTITION BY ticker, statement_type ORDER BY quarter DESC) AS BIGINT) AS quarter_rank
  FROM (SELECT DISTINCT ticker, statement_type, quarter FROM stored_v))"""


@query("fact_key_metrics", ["stored_v"], f"""
WITH {RECENT}
SELECT s.ticker, s.statement_type, CASE s.concept WHEN 'us-gaap:1-URGENT' THEN 'Urgent' WHEN 'us-gaap:3-MEDIUM' THEN 'Medium' ELSE 'Low' END AS metric,
  s.quarter, quarter_rank, numeric_value, unit
FROM stored_v s JOIN r ON s.ticker = r.ticker AND s.statement_type = r.statement_type AND s.quarter = r.quarter
WHERE quarter_rank <= 4 AND s.concept IN ('us-gaap:1-URGENT', 'us-gaap:3-MEDIUM', 'us-gaap:5-LOW')""")
def fact_key_metrics(v):
    metrics = {"income": {"us-gaap:1-URGENT": "Urgent"}, "cashflow": {"us-gaap:3-MEDIUM": "Medium", "us-gaap:5-LOW": "Low"}}
    return A.key_metrics(v("stored_v"), metrics)


@query("fact_pivot", ["stored_v"], f"""
WITH {RECENT}
SELECT s.ticker, s.statement_type, s.concept, {', '.join(f"max(numeric_value) FILTER (WHERE quarter_rank = {i}) AS q{i}" for i in range(1, 9))}
FROM stored_v s JOIN r ON s.ticker = r.ticker AND s.statement_type = r.statement_type AND s.quarter = r.quarter
WHERE quarter_rank <= 8 GROUP BY 1, 2, 3""")
def fact_pivot(v):
    return A.pivot_newest(v("stored_v"), 8)


@query("fact_format", ["stored_v"], """
SELECT ticker, concept, quarter, concat('$', CASE WHEN numeric_value >= 1000000000 THEN format('{:,.1f}B', numeric_value / 1e9)
  WHEN numeric_value >= 1000000 THEN format('{:,.1f}M', numeric_value / 1e6) ELSE format('{:,.0f}', numeric_value::DOUBLE) END) AS display FROM stored_v""")
def fact_format(v):
    return A.with_display(v("stored_v")).select("ticker", "concept", "quarter", "display")


@query("fact_tickers", [], """
SELECT c_mktsegment AS ticker, min(c_custkey) AS cik FROM customer WHERE c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_acctbal < -900) GROUP BY 1
UNION ALL SELECT c_mktsegment, max(c_custkey) FROM customer WHERE c_mktsegment NOT IN (SELECT c_mktsegment FROM customer WHERE c_acctbal < -900) GROUP BY 1""")
def fact_tickers(v):
    customers = v("customer").select(F.col("c_mktsegment").alias("ticker"), F.col("c_custkey").alias("cik"), "c_acctbal")
    poor = customers.filter("c_acctbal < -900").select("ticker").distinct()
    old = customers.join(poor, "ticker", "left_semi").groupBy("ticker").agg(F.min("cik").alias("cik"))
    new = customers.groupBy("ticker").agg(F.max("cik").alias("cik"))
    return A.ensure_tickers(old, new)


@query("fact_short_concept", ["stored_v"], "SELECT DISTINCT concept, split_part(concept, ':', -1) AS short FROM stored_v")
def fact_short_concept(v):
    return v("stored_v").select("concept", short_concept(F.col("concept")).alias("short")).distinct()
