"""Stand-in views: the given tables seen in the shape of the operators' inputs.

Each view is one SQL text that Spark and a second SQL engine read alike, so that a
query and its check start from the same rows.  Table names stand in braces; a
view may use another view the same way.  Every view covers its whole tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {}

VIEWS["logs_v"] = """
SELECT event_id AS id, ts AS log_ts,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level,
  concat('App:', event_type, ':', CAST(hour(ts) AS STRING)) AS tag,
  user_id AS job_id,
  concat(event_type, ' by ', CAST(user_id AS STRING)) AS message,
  props AS payload_json
FROM {events}
"""

VIEWS["jobs_v"] = """
SELECT user_id AS job_id, CAST(floor(user_id / 10) AS BIGINT) AS session_id,
  CASE min_by(event_type, ts) WHEN 'click' THEN 'scraper' WHEN 'view' THEN 'publisher' ELSE 'notes' END AS tool_name,
  CASE max_by(event_type, ts) WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'QUEUED' WHEN 'view' THEN 'RUNNING'
    WHEN 'click' THEN 'INTERRUPTED' ELSE 'PENDING_CALLBACK' END AS status,
  max_by(props, ts) AS args_json,
  min(ts) AS created_at, max(ts) AS updated_at,
  CAST(SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS resume_count
FROM {events}
GROUP BY user_id
"""

VIEWS["items_v"] = """
SELECT event_id AS item_id, user_id AS job_id,
  concat('{{"step":"', CASE WHEN event_type IN ('click', 'view') THEN 'scrape' ELSE 'translate' END,
    '","ulid":"u', CAST(hour(ts) AS STRING), '","retry":', CAST(minute(ts) AS STRING),
    ',"is_top10":', CASE WHEN value > 5 THEN 'true' ELSE 'false' END, '}}') AS item_metadata,
  CASE WHEN value < 2 THEN 'FAILED' WHEN value < 5 THEN 'PENDING' ELSE 'COMPLETED' END AS status,
  props AS output_data, ts AS updated_at
FROM {events}
"""

VIEWS["quarters_v"] = """
SELECT c_mktsegment AS ticker, concat('us-gaap:', o_orderpriority) AS concept,
  CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q,
  CAST(SUM(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, CAST(COUNT(*) AS BIGINT) AS n
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
GROUP BY 1, 2, 3, 4
"""

VIEWS["running_v"] = """
SELECT ticker, concept, y, q, cents,
  CAST(SUM(cents) OVER (PARTITION BY ticker, concept, y ORDER BY q) AS BIGINT) AS ytd,
  CAST(SUM(n) OVER (PARTITION BY ticker, concept, y ORDER BY q) AS BIGINT) AS held,
  CASE q WHEN 1 THEN make_date(y, 3, 31) WHEN 2 THEN make_date(y, 6, 30)
    WHEN 3 THEN make_date(y, 9, 30) ELSE make_date(y, 12, 31) END AS period_end
FROM {quarters_v}
"""

# Raw facts: single quarters, year-to-date sums, end-of-period counts, and the
# same quarters again as next year's comparatives (one unit higher).
VIEWS["facts_v"] = """
SELECT ticker, concept,
  CASE WHEN kind < 3 THEN make_date(y, 3 * q - 2, 1) WHEN kind = 3 THEN make_date(y, 1, 1) END AS period_start, period_end,
  CASE WHEN kind > 2 AND q = 4 THEN 'FY' ELSE concat('Q', CAST(q AS STRING)) END AS fiscal_period,
  CASE WHEN kind = 2 THEN y + 1 ELSE y END AS fiscal_year,
  CASE kind WHEN 1 THEN cents WHEN 2 THEN cents + 1 WHEN 3 THEN ytd ELSE held END AS numeric_value,
  CASE WHEN kind = 4 THEN 'shares' ELSE 'USD' END AS unit, CASE WHEN kind = 4 THEN 'instant' ELSE 'duration' END AS period_type
FROM (SELECT *, explode(array(1, 2, 3, 4)) AS kind FROM {running_v}) k
WHERE kind = 4 OR (kind < 3 AND q < 4) OR (kind = 3 AND q > 1)
"""

VIEWS["blueprint_v"] = """
SELECT DISTINCT concat('us-gaap:', o_orderpriority) AS concept, lower(substr(o_orderpriority, 3)) AS label,
  CAST(substr(o_orderpriority, 1, 1) AS INT) AS depth,
  o_orderpriority = '4-NOT SPECIFIED' AS is_abstract, o_orderpriority = '1-URGENT' AS is_total,
  CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS position
FROM {orders}
"""

# Stored facts: one row for each (ticker, statement, concept, quarter).
VIEWS["stored_v"] = """
SELECT ticker, CASE WHEN concept IN ('us-gaap:1-URGENT', 'us-gaap:2-HIGH') THEN 'income' ELSE 'cashflow' END AS statement_type,
  concept, concat(CAST(y AS STRING), '-Q', CAST(q AS STRING)) AS quarter, period_end,
  cents AS numeric_value, 'USD' AS unit, CAST(substr(concept, 9, 1) AS INT) - 1 AS concept_order
FROM {running_v}
"""

VIEWS["wide_v"] = """
SELECT c_mktsegment AS ticker, o_orderpriority AS concept, o_orderstatus AS dimension_member_label,
  CAST(SUM(CASE WHEN year(o_orderdate) <= 1995 THEN 1 ELSE 0 END) AS STRING) AS `1995-12-31 (FY)`,
  CAST(SUM(CASE WHEN year(o_orderdate) = 1996 AND quarter(o_orderdate) = 1 THEN 1 ELSE 0 END) AS STRING) AS `1996-03-31 (Q1)`,
  CAST(SUM(CASE WHEN year(o_orderdate) = 1996 THEN 1 ELSE 0 END) AS STRING) AS `1996-06-30 (YTD)`,
  CAST(SUM(CASE WHEN year(o_orderdate) >= 1997 THEN 1 ELSE 0 END) AS STRING) AS `to 1997-06-30`
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
GROUP BY 1, 2, 3
"""

# Tidy note rows: one for each order line, seen as a disclosure of its part.
VIEWS["tidy_v"] = """
SELECT concat('acc-', CAST(o_custkey AS STRING)) AS accession_no, c_mktsegment AS ticker,
  CAST(l_linenumber AS INT) AS note_number, CAST(l_orderkey AS BIGINT) AS row_order,
  l_returnflag AS concept, l_linestatus AS dimension_member_label, o_orderpriority AS label,
  o_orderstatus AS dimension_axis, CAST(o_orderdate AS DATE) AS period_end_date,
  CASE WHEN l_discount = 0 THEN '' ELSE CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING) END AS value,
  o_orderstatus = 'P' AS abstract,
  concat(CAST(l_orderkey AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)) AS detail_id
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
"""

VIEWS["filings_v"] = """
SELECT concat('f-', CAST(o_orderkey AS STRING)) AS accession_no, c_mktsegment AS ticker,
  CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN '10-Q' ELSE '8-K' END AS form,
  CAST(o_orderdate AS DATE) AS filing_date, CAST(o_orderdate AS DATE) AS period_of_report,
  CAST(c_nationkey AS INT) AS nation, c_custkey AS cik, CAST(month(o_orderdate) AS INT) AS fiscal_year_end_month
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""

# Articles: the first line is the title, the last line the conclusion.
VIEWS["articles_v"] = """
SELECT doc_id AS id, concat('https://www.Site.example/', lang, '/', CAST(doc_id AS STRING),
    CASE WHEN vec_id IS NULL THEN '' ELSE '?utm_source=feed' END) AS url,
  split_part(text, chr(10), 1) AS title, split_part(text, chr(10), -1) AS conclusion, text AS summary,
  CASE WHEN vec_id IS NULL THEN 'PENDING' ELSE 'EMBEDDED' END AS embedding_status, source, lang
FROM {documents} LEFT JOIN {embeddings} ON doc_id = vec_id
"""

VIEWS["details_v"] = """
SELECT d.doc_id AS detail_id, d.source AS batch_id, d.doc_id AS article_id, rk IS NOT NULL AS is_top10, rk - 1 AS top10_rank,
  CASE WHEN quality IS NULL THEN 'PENDING' WHEN toxic = 1 THEN 'FAILED' WHEN quality = 1 THEN 'PUBLISHED_ARCHIVE' ELSE 'SKIPPED' END AS publish_status
FROM {documents} d
LEFT JOIN {labels} l ON d.doc_id = l.doc_id
LEFT JOIN (
  SELECT doc_id, rk FROM (
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS BIGINT) AS rk FROM {documents}) x
  WHERE rk <= 10) t ON d.doc_id = t.doc_id
"""

# Queries for retrieval: every benchmark passage, with the vector of the same number if there is one.
VIEWS["searches_v"] = """
SELECT item_id AS query_id, text AS query_text, embedding AS query_vec
FROM {benchmark} LEFT JOIN {embeddings} ON item_id = vec_id
"""

# Two sides of one table: orders as entered, and the same orders as their lines tell.  Orders
# in process have another key here than there, so that each side has rows of its own.
VIEWS["local_v"] = """
SELECT CASE WHEN o_orderstatus = 'P' THEN -o_orderkey ELSE o_orderkey END AS id, o_orderstatus AS status,
  sha256(concat(CAST(o_orderkey AS STRING), '||', o_orderstatus)) AS content_hash,
  CAST(make_date(CAST(year(o_orderdate) AS INT), 1, 1) AS TIMESTAMP) AS updated_at
FROM {orders}
"""

VIEWS["cloud_v"] = """
SELECT l_orderkey AS id, max(l_linestatus) AS status,
  CASE WHEN count(*) = 1 THEN '' ELSE sha256(concat(CAST(l_orderkey AS STRING), '||', max(l_linestatus))) END AS content_hash,
  CAST(make_date(CAST(year(max(l_shipdate)) AS INT), 1, 1) AS TIMESTAMP) AS updated_at
FROM {lineitem} GROUP BY l_orderkey
"""

VIEWS["prices_v"] = """
SELECT c_mktsegment AS ticker, CAST(o_orderdate AS DATE) AS price_date, max(o_totalprice) AS close
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
GROUP BY 1, 2
"""

VIEWS["earnings_v"] = """
SELECT c_mktsegment AS ticker,
  make_date(CAST(year(o_orderdate) AS INT), CAST(quarter(o_orderdate) AS INT) * 3, 28) AS period_end_date,
  CAST(SUM(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS earnings, CAST(COUNT(*) AS BIGINT) AS shares
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
GROUP BY 1, 2
"""

VIEWS["messages_v"] = """
SELECT conv_id AS session_id, turn AS id, role, text AS content,
  CAST(length(text) AS BIGINT) AS char_count,
  CAST(CASE WHEN role = 'user' THEN 500 WHEN role = 'assistant' THEN 0 END AS BIGINT) AS attachment_char_count, role = 'user' AS has_screenshot
FROM {conversations}
"""

_NAME = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy scan of one given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a view over given tables, as a lazy DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    text = VIEWS[name]
    inputs = {n: view(spark, sf_dir, n) for n in sorted(set(_NAME.findall(text)))}
    # sha2 is the name Spark gives to the 256-bit hash.
    return spark.sql(re.sub(r"sha256\((concat\(.*?\)\)?)\)( END)? AS content_hash", r"sha2(\1, 256)\2 AS content_hash", text), **inputs)


def _needs(name: str, seen: list[str]) -> None:
    for dep in dict.fromkeys(_NAME.findall(VIEWS[name])):
        if dep in VIEWS:
            _needs(dep, seen)
    if name not in seen:
        seen.append(name)


def ctes(*names: str) -> str:
    """The views as ``WITH`` clauses for the checking engine."""
    order: list[str] = []
    for name in names:
        _needs(name, order)
    parts = []
    for name in order:
        text = _NAME.sub(r"\1", VIEWS[name]).replace("explode(array(1, 2, 3, 4))", "unnest([1, 2, 3, 4])").replace("{{", "{").replace("}}", "}").replace("`", '"')
        parts.append(f"{name} AS ({text.strip()})")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"
