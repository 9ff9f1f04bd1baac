"""Log analytics over a frame with id, log_ts, level, tag, job_id, message, payload_json."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.logs import contains_text, level_at_least, under_tag
from millrace.plans.shapes import budget_prefix, ordered_sums, same_key, top_per_key, under_keys

ERROR_LEVELS = ("ERROR", "CRITICAL")
ISSUE_LEVELS = ("ERROR", "WARNING", "CRITICAL")


def _newest() -> list[Column]:
    return [F.col("log_ts").desc(), F.col("id").desc()]


def _time(moment: datetime | str | None, like: DataFrame) -> Column | None:
    if moment is None:
        return None
    if isinstance(moment, datetime):
        moment = moment.replace(tzinfo=None).isoformat(sep=" ")
    return F.lit(moment).cast(like.schema["log_ts"].dataType)


def log_filter(
    df: DataFrame,
    *,
    level: str | None = None,
    tag: str | None = None,
    job_id=None,
    since: datetime | str | None = None,
    search: str | None = None,
    in_payload: bool = False,
    strict_tag: bool = False,
) -> DataFrame:
    """AND of the conditions that are given; works on batch and streaming frames."""
    if level:
        df = df.filter(level_at_least(level))
    if tag:
        df = df.filter(under_tag(tag, strict=strict_tag))
    if job_id is not None:
        df = df.filter(F.col("job_id") == F.lit(job_id))
    if since is not None:
        df = df.filter(F.col("log_ts") >= _time(since, df))
    if search:
        df = df.filter(contains_text(search, *(["message", "payload_json"] if in_payload else ["message"])))
    return df


def _first(df: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    """Rows in order, all of them or the first ``limit``."""
    ordered = df.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def recent(df: DataFrame, limit: int | None = None, **conditions) -> DataFrame:
    """The matching rows, newest first; all of them unless a limit is given (a console shows 50)."""
    return _first(log_filter(df, **conditions), _newest(), limit)


def errors(df: DataFrame, limit: int | None = None, since=None) -> DataFrame:
    return recent(df, limit, level="ERROR", since=since)


def by_tag(df: DataFrame, tag: str, limit: int | None = None, since=None, strict: bool = False) -> DataFrame:
    return recent(df, limit, tag=tag, since=since, strict_tag=strict)


def by_job(df: DataFrame, job_id, limit: int | None = None) -> DataFrame:
    """The rows of a job, oldest first."""
    return _first(log_filter(df, job_id=job_id), [F.col("log_ts").asc(), F.col("id").asc()], limit)


def search(df: DataFrame, text: str, limit: int | None = None, in_payload: bool = False, level=None) -> DataFrame:
    return recent(df, limit, search=text, in_payload=in_payload, level=level)


def show(df: DataFrame, entry_id=None, payload_schema: str = "map<string,string>") -> DataFrame:
    """Entries with their payload opened; text that is not JSON stays closed."""
    if entry_id is not None:
        df = df.filter(F.col("id") == F.lit(entry_id))
    return df.withColumn("payload", F.from_json("payload_json", payload_schema))


def stats_total(df: DataFrame, now: Column | None = None, hours: int = 1) -> DataFrame:
    """Row count, first and last time, and errors in the hours before ``now`` (default: the last time)."""
    if now is None:
        now = df.agg(F.max("log_ts")).scalar()
    late_error = (F.col("log_ts") >= now - F.expr(f"INTERVAL {int(hours)} HOURS")) & F.col("level").isin(*ERROR_LEVELS)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.min("log_ts").alias("earliest"),
        F.max("log_ts").alias("latest"),
        F.count_if(late_error).alias("errors_last_hour"),
    )


def stats_level(df: DataFrame) -> DataFrame:
    return df.groupBy("level").agg(F.count(F.lit(1)).alias("entries"))


def tags(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Tags with the time of their last entry, the most used first."""
    counted = df.groupBy("tag").agg(F.count(F.lit(1)).alias("entries"), F.max("log_ts").alias("latest"))
    return _first(counted, [F.desc("entries"), F.col("tag").asc()], limit)


def error_context(df: DataFrame, events: DataFrame, n: int = 50) -> DataFrame:
    """The newest ``n`` rows at or before the time of each event (event_id, log_ts), as rows with its ``event_id``.

    Times and ids alone are put in order, rows and events together, in ranges of equal count, so an hour of any size is
    spread over tasks; each row then has its exact number and each event the number of the last row before it.  An event
    asks for the ``n`` numbers up to its own, and whole rows join these by id and time, which name one row.  No rows are
    paired by a range.  Rows and events without a time have no place and no context.
    """
    rows = df.filter(F.col("log_ts").isNotNull()).select(F.col("log_ts").alias("_at"), F.lit(1).alias("_row"), F.col("id").alias("_id"))
    asked = events.filter(F.col("log_ts").isNotNull()).select(F.col("log_ts").alias("_at"), F.lit(0).alias("_row"), "event_id")
    both = rows.unionByName(asked, allowMissingColumns=True)
    placed = ordered_sums(both, [], [F.col("_at").asc(), F.col("_row").desc(), F.col("_id").asc()], "_row", "_n")
    wanted = placed.filter("_row = 0 AND _n > 0").select(
        "event_id", F.explode(F.sequence(F.greatest(F.col("_n") - (n - 1), F.lit(1)), F.col("_n"))).alias("_n"))
    found = wanted.join(placed.filter("_row = 1").select("_n", "_at", "_id"), "_n")
    return found.join(df, F.col("_id").eqNullSafe(df["id"]) & (F.col("_at") == df["log_ts"])).select("event_id", *[df[c] for c in df.columns])


def job_log(df: DataFrame, job_id=None) -> DataFrame:
    """Every line of a job (or of all jobs), oldest first."""
    return log_filter(df, job_id=job_id).orderBy("job_id", "log_ts", "id")


def job_issues(df: DataFrame, n: int = 10) -> DataFrame:
    """The newest errors and warnings of each job."""
    return top_per_key(df.filter(F.col("level").isin(*ISSUE_LEVELS)), ["job_id"], _newest(), n, "issue_rank")


def job_report(jobs: DataFrame, logs: DataFrame) -> DataFrame:
    """Each job with its log lines, one row per line; a job without lines keeps one row.

    The lines stay rows, for a job may have more of them than one task can hold.
    """
    lines = logs.select("job_id", "log_ts", "level", "tag", "message")
    head = jobs.select("job_id", "tool_name", "status", "created_at", "updated_at")
    return head.join(lines, "job_id", "left")


def tail_budget(df: DataFrame, max_chars: int, line: Column | None = None) -> DataFrame:
    """The newest whole lines of each job whose text, joined by newlines, fits in ``max_chars``.

    If even the newest line is too long, its end is kept.  A missing field is an empty part of its line, and lines
    without a job are one job.
    """
    if line is None:
        said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("log_ts", "level", "tag", "message")]
        line = F.concat(said[0], F.lit(" "), said[1], F.lit(" "), said[2], F.lit(": "), said[3])
    lined = df.withColumn("line", F.coalesce(line, F.lit(""))).withColumn("_cost", (F.length("line") + 1).cast("long"))
    kept = budget_prefix(
        lined, ["job_id"], [("log_ts", True), ("id", True)], "_cost", max_chars + 1, keep_first=True, positive=True
    )
    # A line needs its leading newline inside the tail, unless nothing is older.
    size = under_keys(lined.groupBy("job_id").agg(F.sum("_cost").alias("_all")), ["job_id"])
    fits = (F.col("running_cost") <= max_chars) | (F.col("running_cost") == F.col("_all")) | (
        F.col("running_cost") == F.col("_cost"))
    return (
        kept.join(size, same_key(["job_id"])).filter(fits)
        .withColumn("line", F.right("line", F.lit(max_chars)))
        .drop("_cost", "_all", "_k_job_id", "running_cost")
    )
