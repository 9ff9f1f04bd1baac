"""Queries over tables and streams.

A streaming query reads its table as a stream of files up to the end of what is
there, writes to a folder of its own in the shared checkpoint folder, and gives
the rows written.
"""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import normalize_url
from millrace.queries.registry import QUERIES, query
from millrace.operators.sync import evolve
from millrace.session import ensure_checkpoint_dir
from millrace.sources import tables as A
from millrace.sources.schemas import REGISTRY
from millrace.streaming import jobs as T
from millrace.streaming import keyed as K


@query("tab_orphans", [], "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def tab_orphans(v):
    return A.orphans(v("orders"), v("lineitem"), "o_orderkey", "l_orderkey").select("o_orderkey", "o_custkey")


@query("tab_violations", ["details_v"], "SELECT detail_id, publish_status FROM details_v WHERE publish_status NOT IN ('PENDING', 'SKIPPED', 'FAILED')")
def tab_violations(v):
    return A.violations(v("details_v"), "publish_status", ["PENDING", "SKIPPED", "FAILED"]).select("detail_id", "publish_status")


@query("tab_duplicates", [], "SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def tab_duplicates(v):
    return A.duplicates(v("lineitem"), ["l_orderkey", "l_linenumber"])


@query("tab_read_sql", [], "SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_acctbal > 1000 GROUP BY c_mktsegment")
def tab_read_sql(v):
    c = v("customer")
    return A.read_sql(c.sparkSession, "SELECT c_mktsegment, count(*) AS n FROM {c} WHERE c_acctbal > :low GROUP BY c_mktsegment", {"low": 1000}, c=c)


@query("tab_scan", ["articles_v"], """
SELECT CAST(id AS VARCHAR) AS id, nullif(url, '') AS url, nullif(title, '') AS title, embedding_status FROM articles_v""")
def tab_scan(v):
    rows = v("articles_v").select(F.col("id").cast("string").alias("id"), "url", "title", "embedding_status")
    folder = f"{ensure_checkpoint_dir(rows.sparkSession)}/scan-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/scraped_articles")
    return A.scan(rows.sparkSession, folder, "scraped_articles").select("id", "url", "title", "embedding_status")


@query("tab_replace", ["stored_v"], """
WITH n AS (SELECT ticker, concept, quarter, numeric_value + 1 AS numeric_value FROM stored_v WHERE quarter >= '2000' AND ticker < 'C')
SELECT ticker, concept, quarter, numeric_value FROM stored_v WHERE ticker NOT IN (SELECT ticker FROM n) UNION ALL SELECT * FROM n""")
def tab_replace(v):
    rows = v("stored_v").select("ticker", "concept", "quarter", "numeric_value")
    new = rows.filter("quarter >= '2000' AND ticker < 'C'").withColumn("numeric_value", F.col("numeric_value") + 1)
    return A.replace_slice(rows, new, ["ticker"])


@query("tab_blank", ["tidy_v"], "SELECT detail_id, value FROM tidy_v WHERE value <> ''")
def tab_blank(v):
    return A.blank_to_null(v("tidy_v").select("detail_id", "value")).filter("value IS NOT NULL")


@query("tab_export", [], "SELECT part, c_custkey, c_name FROM customer, (SELECT unnest(['csv', 'json']) AS part)")
def tab_export(v):
    rows = v("customer").select("c_custkey", "c_name")
    spark, back = rows.sparkSession, None
    for kind in ("csv", "json"):
        folder = A.export(rows, f"{ensure_checkpoint_dir(spark)}/export-{uuid.uuid4().hex}", kind)
        read = spark.read.schema("c_custkey long, c_name string").format(kind).option("header", True).load(folder)
        part = read.select(F.lit(kind).alias("part"), "c_custkey", "c_name")
        back = part if back is None else back.unionByName(part)
    return back


@query("art_embed", ["articles_v"], """
SELECT id, 'EMBEDDED' AS embedding_status, CAST(length(t) AS DOUBLE) AS first, CAST(len(regexp_extract_all(t, 'e')) AS DOUBLE) AS second
FROM (SELECT id, concat(title, ': ', conclusion, ': ', summary) AS t FROM articles_v WHERE embedding_status = 'PENDING')""")
def art_embed(v):
    def model(texts):
        return [[float(len(t)), float(t.count("e"))] for t in texts]

    out = A.embed_articles(v("articles_v"), model, max_chars=None)
    return out.select("id", "embedding_status", F.col("embedding")[0].cast("double").alias("first"), F.col("embedding")[1].cast("double").alias("second"))


@query("sync_restore", ["articles_v", "details_v"], """
WITH w AS (SELECT id, list_filter(regexp_split_to_array(lower(concat_ws(' ', title, conclusion, summary)), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM articles_v)
SELECT 'scraped_articles' AS table_name, CAST(count(*) AS BIGINT) AS n FROM articles_v UNION ALL SELECT 'broadcast_details', count(*) FROM details_v
UNION ALL SELECT 'article_postings', (SELECT count(*) FROM (SELECT DISTINCT id, unnest(w) FROM w)) + (SELECT count(*) FROM w)""")
def sync_restore(v):
    articles, details = v("articles_v"), v("details_v")
    spark = articles.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/restore-{uuid.uuid4().hex}"
    frames = {
        "broadcast_details": evolve(details, REGISTRY["broadcast_details"].schema),
        "scraped_articles": evolve(articles, REGISTRY["scraped_articles"].schema, {"metadata_json": "{}"}),
    }
    names = [*A.restore(frames, folder), "article_postings"]
    counts = [spark.read.parquet(f"{folder}/{n}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n") for n in names]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def _table(sf_dir: str, source: str) -> str:
    """The table as a path for a stream.  It may be one file, which a stream takes from a pattern only, or a folder of files."""
    return f"{sf_dir}/{source}.parque[t]"


def stream_query(name: str, source: str, sql: str):
    """Register ``fn(stream, folder, spark, sf_dir)``; it starts a query that ends, and gives its rows."""
    query(name, [], sql)(lambda v: None)

    def register(fn):
        def run(spark, sf_dir) -> DataFrame:
            folder = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
            schema = spark.read.parquet(f"{sf_dir}/{source}.parquet").schema
            stream = T.read_files(spark, _table(sf_dir, source), schema)
            return fn(stream, folder, spark, sf_dir)

        run.__name__ = name
        QUERIES[name] = run
        return fn

    return register


def _logs(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    level = F.when(kind == "error", "ERROR").when(kind == "signup", "WARNING").when(kind == "view", "DEBUG").otherwise("INFO")
    return events.select(
        F.col("event_id").alias("id"), F.col("ts").alias("log_ts"), level.alias("level"), F.concat(F.lit("App:"), kind).alias("tag"),
        F.col("user_id").alias("job_id"), F.concat(kind, F.lit(" by "), F.col("user_id").cast("string")).alias("message"))


def _finish(stream: DataFrame, folder: str, spark) -> DataFrame:
    T.write_rows(stream, f"{folder}/rows", f"{folder}/state").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END"
CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTES FROM events)"


@stream_query("stream_tail", "events", f"SELECT event_id AS id, {LEVEL} AS level, user_id AS job_id FROM events WHERE event_type IN ('error', 'signup')")
def stream_tail(stream, folder, spark, sf_dir):
    return _finish(T.tail(_logs(stream), level="WARNING").select("id", "level", "job_id"), folder, spark)


@stream_query("stream_stats", "events", f"""
SELECT CAST(floor(epoch_us(date_trunc('hour', ts)) / 1000000) AS BIGINT) AS window_second, {LEVEL} AS level, CAST(count(*) AS BIGINT) AS entries, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS errors
FROM events GROUP BY date_trunc('hour', ts), 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {CLOSED}""")
def stream_stats(stream, folder, spark, sf_dir):
    out = _finish(T.live_stats(_logs(stream)), folder, spark)
    return out.select(F.unix_seconds("window_start").alias("window_second"), "level", "entries", "errors")


@stream_query("stream_rates", "events", f"""
WITH e AS (SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * h AS w FROM events, (SELECT unnest(range(0, 6)) AS h))
SELECT CAST(epoch(w) AS BIGINT) AS window_second, user_id, CAST(count(*) AS BIGINT) AS in_window FROM e WHERE w + INTERVAL 6 HOURS <= {CLOSED} GROUP BY 1, 2, w HAVING count(*) > 3""")
def stream_rates(stream, folder, spark, sf_dir):
    out = _finish(T.rate_alerts(stream, 3, "6 hours", "1 hour", ["user_id"]), folder, spark)
    return out.select(F.unix_seconds("window_start").alias("window_second"), "user_id", "in_window")


@stream_query("stream_rate_audit", "events", f"""
WITH c AS (SELECT user_id, ts, count(*) AS n FROM events GROUP BY 1, 2),
w AS (SELECT user_id, ts, n, sum(n) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS s FROM c)
SELECT user_id, CAST(epoch_us(ts) AS BIGINT) AS at_us, CAST(n AS BIGINT) AS at_time, CAST(s AS BIGINT) AS in_window
FROM w WHERE s > 3 AND ts <= date_trunc('milliseconds', {CLOSED})""")
def stream_rate_audit(stream, folder, spark, sf_dir):
    K.write_exact_rates(stream, 3, 6 * 3600, ["user_id"], f"{folder}/rows", f"{folder}/state").awaitTermination()
    return spark.read.schema("user_id long, at_us long, at_time long, in_window long").parquet(f"{folder}/rows")


NORM = "lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''))"


@stream_query("stream_links", "pages", f"SELECT DISTINCT {NORM} AS url FROM pages WHERE NOT starts_with({NORM}, 'https:')")
def stream_links(stream, folder, spark, sf_dir):
    known = spark.read.parquet(f"{sf_dir}/pages.parquet").select(normalize_url(F.col("url")).alias("url")).filter(F.col("url").startswith("https:"))
    seen = stream.select(normalize_url(F.col("url")).alias("url"), F.lit("2024-01-01").cast("timestamp").alias("seen_at"))
    return _finish(T.new_links(seen, known, "seen_at"), folder, spark).select("url")


@stream_query("stream_redact", "documents", r"""
SELECT doc_id, regexp_replace(text, '(?i)((?:api[_-]?key|secret|password|passwd|token|credential|auth|private[_-]?key)(?:\s*[=:]\s*))(?:bearer\s+)?(\S+)', '\1[REDACTED]', 'g') AS text FROM documents""")
def stream_redact(stream, folder, spark, sf_dir):
    return _finish(T.redact_stream(stream.select("doc_id", "text")), folder, spark)


@stream_query("stream_pending", "orders", "SELECT o_orderkey, o_custkey FROM orders")
def stream_pending(stream, folder, spark, sf_dir):
    T.stream_pending(spark, _table(sf_dir, "orders"), stream.schema, f"{folder}/rows", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select("o_orderkey", "o_custkey")


@stream_query("stream_upsert", "events", """
SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def stream_upsert(stream, folder, spark, sf_dir):
    keys, order = ["user_id"], ["ts", "event_id"]
    # All rows, then a fold, then all of them again from a checkpoint of its own: the table is the same.
    T.upsert_changes(stream, folder, keys, order, f"{folder}/state", seconds=None).awaitTermination()
    T.compact(spark, folder, keys, order)
    T.upsert_changes(stream, folder, keys, order, f"{folder}/second", seconds=None).awaitTermination()
    return T.current_rows(spark, folder, keys, order).select("user_id", "event_type", "event_id")


@stream_query("stream_dlq", "lineitem", """
SELECT 'good' AS part, concat(l_orderkey, '|', l_linenumber) AS row_id, '' AS error_message FROM lineitem WHERE l_returnflag <> 'R'
UNION ALL SELECT 'bad', concat(l_orderkey, '|', l_linenumber), concat('returned: ', l_returnflag) FROM lineitem WHERE l_returnflag = 'R'""")
def stream_dlq(stream, folder, spark, sf_dir):
    fault = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("returned: "), "l_returnflag"))
    T.with_dead_letters(
        stream, fault, "lineitem", ["l_orderkey", "l_linenumber"], f"{folder}/good", f"{folder}/bad", f"{folder}/state", seconds=None,
    ).awaitTermination()
    good = spark.read.parquet(f"{folder}/good").select(
        F.lit("good").alias("part"), F.concat_ws("|", "l_orderkey", "l_linenumber").alias("row_id"), F.lit("").alias("error_message"))
    bad = spark.read.parquet(f"{folder}/bad").select(F.lit("bad").alias("part"), "row_id", "error_message")
    return good.unionByName(bad)
