"""Queries over logs, jobs and items."""

from datetime import datetime

from pyspark.sql import functions as F

from millrace.functions.logs import since_bound
from millrace.operators import jobs as J
from millrace.operators import logs as L
from millrace.queries.registry import query

LOG = "id, log_ts, level, tag, job_id, message, payload_json"
NEWEST = "ORDER BY log_ts DESC, id DESC"


@query("log_recent", ["logs_v"], f"SELECT {LOG} FROM logs_v WHERE level IN ('INFO', 'WARNING', 'ERROR', 'CRITICAL') {NEWEST} LIMIT 50")
def log_recent(v):
    return L.recent(v("logs_v"), 50, level="info")


@query("log_errors", ["logs_v"], f"SELECT {LOG} FROM logs_v WHERE level IN ('ERROR', 'CRITICAL') AND log_ts >= TIMESTAMP '2024-01-03 00:00:00' {NEWEST} LIMIT 9999")
def log_errors(v):
    return L.errors(v("logs_v"), 9999, since="2024-01-03 00:00:00")


@query("log_by_tag", ["logs_v"], f"SELECT {LOG} FROM logs_v WHERE tag = 'App:error' OR starts_with(tag, 'App:error:') {NEWEST} LIMIT 100")
def log_by_tag(v):
    return L.by_tag(v("logs_v"), "App:error", 100)


@query("log_by_job", ["logs_v"], f"SELECT {LOG} FROM logs_v WHERE job_id = 7 ORDER BY log_ts, id LIMIT 50")
def log_by_job(v):
    return L.by_job(v("logs_v"), 7, 50)


@query("log_search", ["logs_v"], f"SELECT {LOG} FROM logs_v WHERE contains(lower(message), 'by 4') OR contains(lower(payload_json), 'by 4') {NEWEST} LIMIT 200")
def log_search(v):
    return L.search(v("logs_v"), "BY 4", 200, in_payload=True)


@query("log_filter", ["logs_v"], """
SELECT level, CAST(count(*) AS BIGINT) AS n FROM logs_v
WHERE level IN ('WARNING', 'ERROR', 'CRITICAL') AND starts_with(tag, 'App:') AND contains(lower(message), 'r by')
GROUP BY level""")
def log_filter(v):
    found = L.log_filter(v("logs_v"), level="warning", tag="App", search="R BY", strict_tag=True)
    return found.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("log_show", ["logs_v"], "SELECT id, level, json_extract_string(payload_json, '$.k') AS k FROM logs_v")
def log_show(v):
    return L.show(v("logs_v")).select("id", "level", F.col("payload")["k"].alias("k"))


@query("log_stats_total", ["logs_v"], """
SELECT CAST(count(*) AS BIGINT) AS total, min(log_ts) AS earliest, max(log_ts) AS latest,
  CAST(count(*) FILTER (WHERE level IN ('ERROR', 'CRITICAL') AND log_ts >= (SELECT max(log_ts) FROM logs_v) - INTERVAL 1 HOUR) AS BIGINT) AS errors_last_hour
FROM logs_v""")
def log_stats_total(v):
    return L.stats_total(v("logs_v"))


@query("log_stats_level", ["logs_v"], "SELECT level, CAST(count(*) AS BIGINT) AS entries FROM logs_v GROUP BY level")
def log_stats_level(v):
    return L.stats_level(v("logs_v"))


@query("log_stats_tag", ["logs_v"], "SELECT tag, CAST(count(*) AS BIGINT) AS entries FROM logs_v GROUP BY tag ORDER BY entries DESC, tag LIMIT 10")
def log_stats_tag(v):
    return L.tags(v("logs_v"), 10).drop("latest")


@query("log_tags", ["logs_v"], "SELECT tag, CAST(count(*) AS BIGINT) AS entries, max(log_ts) AS latest FROM logs_v GROUP BY tag ORDER BY entries DESC, tag LIMIT 50")
def log_tags(v):
    return L.tags(v("logs_v"), 50)


@query("log_error_context", ["logs_v"], f"""
SELECT {LOG} FROM logs_v WHERE log_ts <= (SELECT max(log_ts) FROM logs_v WHERE level = 'ERROR') {NEWEST} LIMIT 50""")
def log_error_context(v):
    logs = v("logs_v")
    newest = logs.filter("level = 'ERROR'").agg(F.lit("newest").alias("event_id"), F.max("log_ts").alias("log_ts"))
    return L.error_context(logs, newest, 50).drop("event_id")


@query("log_error_contexts", ["logs_v"], f"""
WITH e AS (SELECT id AS event_id, log_ts AS moment FROM logs_v WHERE level = 'ERROR'),
p AS (SELECT event_id, l.id, row_number() OVER (PARTITION BY event_id {NEWEST}) AS n FROM e JOIN logs_v l ON log_ts <= moment)
SELECT event_id, id FROM p WHERE n <= 5""")
def log_error_contexts(v):
    logs = v("logs_v")
    events = logs.filter("level = 'ERROR'").select(F.col("id").alias("event_id"), "log_ts")
    return L.error_context(logs, events, 5).select("event_id", "id")


@query("log_since", ["logs_v"], f"SELECT {LOG} FROM logs_v WHERE level IN ('ERROR', 'CRITICAL') AND log_ts >= TIMESTAMP '2024-01-02 12:00:00'")
def log_since(v):
    return L.errors(v("logs_v"), since=since_bound("36h", datetime(2024, 1, 4)))


@query("log_job_export", ["logs_v"], "SELECT job_id, log_ts, level, tag, message FROM logs_v")
def log_job_export(v):
    return L.job_log(v("logs_v")).select("job_id", "log_ts", "level", "tag", "message")


@query("log_job_issues", ["logs_v"], f"""
SELECT {LOG}, CAST(row_number() OVER (PARTITION BY job_id {NEWEST}) AS BIGINT) AS issue_rank
FROM logs_v WHERE level IN ('ERROR', 'WARNING', 'CRITICAL') QUALIFY issue_rank <= 10""")
def log_job_issues(v):
    return L.job_issues(v("logs_v"))


@query("job_report", ["jobs_v", "logs_v"], """
SELECT j.job_id, j.tool_name, j.status, j.created_at, j.updated_at, l.log_ts, l.level, l.tag, l.message
FROM jobs_v j LEFT JOIN logs_v l ON j.job_id = l.job_id""")
def job_report(v):
    return L.job_report(v("jobs_v"), v("logs_v"))


@query("log_tail_budget", ["logs_v"], """
WITH s AS (
  SELECT id, CASE WHEN level = 'DEBUG' THEN NULL ELSE job_id END AS job_id,
    concat(level, ' ', CASE WHEN level = 'WARNING' THEN '' ELSE tag END, ': ', message, ' | payload: ', payload_json) AS line, log_ts FROM logs_v),
c AS (
  SELECT *, sum(length(line) + 1) OVER (PARTITION BY job_id ORDER BY log_ts DESC, id DESC ROWS UNBOUNDED PRECEDING) AS cum,
    sum(length(line) + 1) OVER (PARTITION BY job_id) AS total FROM s)
SELECT id, job_id, CASE WHEN length(line) > 2000 THEN right(line, 2000) ELSE line END AS line FROM c
WHERE cum <= 2000 OR (cum = total AND total - 1 <= 2000) OR cum = length(line) + 1""")
def log_tail_budget(v):
    level = F.col("level")
    logs = v("logs_v").withColumn("job_id", F.when(level != "DEBUG", F.col("job_id"))).withColumn("tag", F.when(level != "WARNING", F.col("tag")))
    line = F.concat("level", F.lit(" "), F.coalesce("tag", F.lit("")), F.lit(": "), "message", F.lit(" | payload: "), "payload_json")
    return L.tail_budget(logs, 2000, line).select("id", "job_id", "line")


NOW = "(SELECT max(updated_at) FROM jobs_v)"


@query("job_runnable", ["jobs_v"], f"""
SELECT job_id, status, created_at FROM jobs_v
WHERE status IN ('QUEUED', 'INTERRUPTED') OR (status = 'PENDING_CALLBACK' AND updated_at < {NOW} - INTERVAL 3600 SECONDS)
ORDER BY status, created_at, job_id LIMIT 5""")
def job_runnable(v):
    jobs = v("jobs_v")
    return J.runnable(jobs, jobs.agg(F.max("updated_at")).scalar(), 3600).select("job_id", "status", "created_at")


@query("job_steps", ["jobs_v", "items_v"], """
SELECT j.job_id, session_id, tool_name, j.status, args_json, item_id, i.status AS step_status,
  json_extract_string(item_metadata, '$.step') AS step, json_extract_string(item_metadata, '$.ulid') AS ulid,
  CAST(json_extract_string(item_metadata, '$.retry') AS BIGINT) AS retry, CAST(NULL AS VARCHAR) AS error,
  json_extract_string(item_metadata, '$.is_top10') = 'true' AS is_top10, output_data
FROM jobs_v j LEFT JOIN items_v i ON j.job_id = i.job_id""")
def job_steps(v):
    return J.job_steps(v("jobs_v"), v("items_v"))


DONE = """job_id, item_id, json_extract_string(item_metadata, '$.ulid') AS ulid
FROM items_v WHERE status = 'COMPLETED' AND json_extract_string(item_metadata, '$.step') = 'translate'"""


@query("job_top_items", ["items_v"], f"""
WITH d AS (SELECT {DONE} AND json_extract_string(item_metadata, '$.is_top10') = 'true')
SELECT *, CAST(row_number() OVER (PARTITION BY job_id ORDER BY item_id) AS BIGINT) AS item_rank FROM d QUALIFY item_rank <= 10""")
def job_top_items(v):
    return J.top_items(v("items_v")).select("job_id", "item_id", "ulid", "item_rank")


@query("job_translated", ["items_v"], f"SELECT json_extract_string(item_metadata, '$.is_top10') = 'true' AS is_top10, {DONE}")
def job_translated(v):
    return J.translated(v("items_v")).select("job_id", "item_id", "ulid", "is_top10")


@query("job_resume", ["jobs_v", "items_v"], """
WITH k AS (SELECT *, json_extract_string(item_metadata, '$.step') AS step FROM items_v),
c AS (
  SELECT j.job_id, j.tool_name, j.status,
    CAST(count(*) FILTER (WHERE k.status = 'COMPLETED' AND (tool_name <> 'scraper' OR step = 'scrape')) AS BIGINT) AS items_completed,
    CAST(count(*) FILTER (WHERE k.status IN ('PENDING', 'FAILED') AND (tool_name <> 'scraper' OR step = 'scrape')) AS BIGINT) AS items_pending
  FROM jobs_v j LEFT JOIN k ON j.job_id = k.job_id GROUP BY 1, 2, 3)
SELECT *, CASE WHEN status IN ('COMPLETED', 'ABANDONED', 'SKIPPED') THEN false
  WHEN tool_name = 'scraper' THEN items_pending >= 1 OR items_completed = 0
  WHEN tool_name = 'publisher' THEN items_pending > 0
  ELSE items_pending > 0 AND items_completed > 0 END AS resumable FROM c""")
def job_resume(v):
    return J.resume_report(v("jobs_v"), v("items_v"))


STALE = f"(updated_at < {NOW} - INTERVAL 7 DAYS AND status IN ('RUNNING', 'PENDING', 'INTERRUPTED'))"


@query("job_stale", ["jobs_v", "items_v"], f"""
WITH kept AS (
  SELECT job_id, count(*) AS n FROM items_v WHERE job_id NOT IN (SELECT job_id FROM jobs_v WHERE {STALE}) GROUP BY job_id)
SELECT j.job_id, CASE WHEN {STALE} THEN 'FAILED' WHEN status IN ('RUNNING', 'PAUSED_FOR_HITL') THEN 'INTERRUPTED' ELSE status END AS new_status,
  CAST(coalesce(n, 0) AS BIGINT) AS items_left
FROM jobs_v j LEFT JOIN kept k ON j.job_id = k.job_id""")
def job_stale(v):
    jobs = v("jobs_v")
    healed, kept = J.heal(jobs, v("items_v"), jobs.agg(F.max("updated_at")).scalar())
    left = kept.groupBy("job_id").agg(F.count(F.lit(1)).alias("items_left"))
    return healed.join(left, "job_id", "left").select(
        "job_id", "new_status", F.coalesce("items_left", F.lit(0)).cast("long").alias("items_left"))


KEYED = "SELECT item_id, job_id, json_extract_string(item_metadata, '$.step') AS step, json_extract_string(item_metadata, '$.ulid') AS ulid, status, output_data, updated_at FROM items_v"


@query("item_insert", ["items_v"], f"""
WITH k AS ({KEYED}),
f AS (SELECT * FROM k WHERE status <> 'COMPLETED' QUALIFY row_number() OVER (PARTITION BY job_id, step, ulid ORDER BY item_id) = 1)
SELECT item_id, job_id, step, ulid FROM f
WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.status = 'COMPLETED' AND k.job_id = f.job_id AND k.step = f.step AND k.ulid = f.ulid)""")
def item_insert(v):
    items = v("items_v")
    return J.add_items(items.filter("status = 'COMPLETED'"), items.filter("status <> 'COMPLETED'")).select(
        "item_id", "job_id", "step", "ulid")


@query("item_update", ["items_v"], f"""
WITH k AS ({KEYED}),
u AS (SELECT * FROM k WHERE status = 'COMPLETED' QUALIFY row_number() OVER (PARTITION BY job_id, step, ulid ORDER BY updated_at DESC, item_id DESC) = 1)
SELECT k.item_id, k.job_id, k.step, k.ulid, coalesce(u.status, k.status) AS status,
  coalesce(u.output_data, k.output_data) AS output_data, coalesce(u.updated_at, k.updated_at) AS updated_at
FROM k LEFT JOIN u ON k.job_id = u.job_id AND k.step = u.step AND k.ulid = u.ulid""")
def item_update(v):
    items = v("items_v")
    return J.update_items(items, items.filter("status = 'COMPLETED'"))


@query("job_interrupted", ["jobs_v"], """
SELECT session_id, tool_name, job_id, updated_at FROM jobs_v WHERE status = 'INTERRUPTED'
QUALIFY row_number() OVER (PARTITION BY session_id, tool_name ORDER BY updated_at DESC, job_id DESC) = 1""")
def job_interrupted(v):
    return J.last_interrupted(v("jobs_v")).select("session_id", "tool_name", "job_id", "updated_at")


@query("item_cache", ["items_v"], f"""
WITH k AS ({KEYED}), a AS (SELECT DISTINCT ulid FROM k),
n AS (SELECT * FROM k WHERE step = 'translate' AND status = 'COMPLETED' QUALIFY row_number() OVER (PARTITION BY ulid ORDER BY updated_at DESC, item_id DESC) = 1),
r AS (SELECT json_extract_string(item_metadata, '$.ulid') AS ulid, max(CAST(json_extract_string(item_metadata, '$.retry') AS BIGINT)) AS retries
  FROM items_v WHERE json_extract_string(item_metadata, '$.step') = 'translate' AND status = 'FAILED' GROUP BY 1)
SELECT a.ulid, n.output_data AS cached_output, coalesce(r.retries, 0) AS retries
FROM a LEFT JOIN n ON a.ulid = n.ulid LEFT JOIN r ON a.ulid = r.ulid""")
def item_cache(v):
    items = v("items_v")
    articles = items.select(J.meta("ulid").alias("ulid")).distinct()
    return J.cached_outputs(articles, items, "$.k")


@query("job_poison", ["jobs_v"], "SELECT job_id, resume_count FROM jobs_v WHERE resume_count >= 3")
def job_poison(v):
    return J.poisoned(v("jobs_v")).select("job_id", "resume_count")


@query("job_checklist", ["jobs_v"], """
SELECT job_id, concat('{"step":"blackboard","ulid":"', s, '","retry":0}') AS item_metadata, 'PENDING' AS status
FROM jobs_v, (SELECT unnest(['gather', 'draft', 'review']) AS s) t""")
def job_checklist(v):
    return J.checklist(v("jobs_v"), ["gather", "draft", "review"])


@query("job_checklist_state", ["items_v"], "SELECT item_id, job_id, json_extract_string(item_metadata, '$.ulid') AS step_identifier, status, output_data FROM items_v")
def job_checklist_state(v):
    return J.checklist_state(v("items_v"))


@query("job_outcome", ["items_v"], """
SELECT job_id, CAST(count(*) AS BIGINT) AS attempts, CAST(count(*) FILTER (WHERE status = 'COMPLETED') AS BIGINT) AS succeeded,
  CAST(count(*) FILTER (WHERE status = 'FAILED') AS BIGINT) AS failed,
  CASE WHEN count(*) FILTER (WHERE status = 'COMPLETED') <> count(*) THEN 'PARTIAL' ELSE 'COMPLETED' END AS outcome
FROM items_v GROUP BY job_id""")
def job_outcome(v):
    return J.outcome(v("items_v"))


@query("item_retry", ["items_v"], """
SELECT item_id, CAST(json_extract_string(item_metadata, '$.retry') AS BIGINT) + 1 AS retry, '2024-02-01 00:00:00' AS stamp,
  concat('late: ', status) AS error FROM items_v""")
def item_retry(v):
    now = "2024-02-01 00:00:00"
    changed = J.set_error(J.bump_retry(v("items_v"), now), F.concat(F.lit("late: "), "status"), now)
    return changed.select(
        "item_id", J.meta("retry").cast("long").alias("retry"), J.meta("timestamp").alias("stamp"), J.meta("error").alias("error"))
