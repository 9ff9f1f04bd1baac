"""Bookkeeping over ``jobs`` and ``job_items`` frames."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.shapes import first_per_key, top_per_key

META = "step string, ulid string, retry long, timestamp string, model string, error string, is_top10 boolean"
CLOSED = ("COMPLETED", "ABANDONED", "SKIPPED")
MAX_RESUMES = 3


def meta(path: str, column: str = "item_metadata") -> Column:
    return F.get_json_object(column, f"$.{path}")


def with_keys(items: DataFrame) -> DataFrame:
    """Open the JSON keys once, as columns."""
    return items.withColumn("step", meta("step")).withColumn("ulid", meta("ulid"))


def runnable(jobs: DataFrame, now: Column, delay_seconds: int, n: int = 5) -> DataFrame:
    """Queued and interrupted jobs, and callbacks that have waited long enough; oldest first per status."""
    due = (F.col("status") == "PENDING_CALLBACK") & (
        F.col("updated_at") < now - F.expr(f"INTERVAL {int(delay_seconds)} SECONDS"))
    ready = F.col("status").isin("QUEUED", "INTERRUPTED") | due
    return jobs.filter(ready).orderBy("status", "created_at", "job_id").limit(n)


def job_steps(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """Each job with its steps, one row per step, JSON opened and defaults filled."""
    opened = items.withColumn("_m", F.from_json("item_metadata", META)).select(
        "job_id", "item_id", F.col("status").alias("step_status"),
        F.coalesce("_m.step", F.lit("unknown")).alias("step"),
        F.coalesce("_m.ulid", F.lit("")).alias("ulid"),
        F.coalesce("_m.retry", F.lit(0)).cast("long").alias("retry"),
        F.col("_m.error").alias("error"),
        F.coalesce("_m.is_top10", F.lit(False)).alias("is_top10"),
        F.coalesce("output_data", F.lit("{}")).alias("output_data"),
    )
    head = jobs.select("job_id", "session_id", "tool_name", "status", F.coalesce("args_json", F.lit("{}")).alias("args_json"))
    return head.join(opened, "job_id", "left")


def _finished(items: DataFrame, step: str) -> DataFrame:
    return with_keys(items).filter((F.col("status") == "COMPLETED") & (F.col("step") == step))


def top_items(items: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` finished translations of each job that are among its top ten."""
    chosen = _finished(items, "translate").filter(meta("is_top10").isin("true", "1"))
    return top_per_key(chosen, ["job_id"], [F.col("item_id").asc()], n, "item_rank")


def translated(items: DataFrame) -> DataFrame:
    """All finished translations."""
    return _finished(items, "translate").withColumn(
        "is_top10", F.coalesce(meta("is_top10").isin("true", "1"), F.lit(False)))


def resume_report(jobs: DataFrame, items: DataFrame, min_pending: int = 1) -> DataFrame:
    """Finished and open items of each job, and whether its tool may resume.

    A scraper counts its scrape steps and may resume when something is pending or
    nothing is done; a publisher when something is pending; notes when something
    is pending and something is done.  A closed job may not.
    """
    opened = with_keys(items)
    done, pending = F.col("status") == "COMPLETED", F.col("status").isin("PENDING", "FAILED")
    scrape = F.col("step") == "scrape"
    counts = opened.groupBy("job_id").agg(
        F.count_if(done).alias("_done"), F.count_if(pending | (F.col("status") == "RUNNING")).alias("_open"),
        F.count_if(done & scrape).alias("_scraped"), F.count_if(pending & scrape).alias("_unscraped"),
    )
    is_scraper = F.col("tool_name") == "scraper"
    zero = F.lit(0).cast("long")
    completed = F.coalesce(F.when(is_scraper, F.col("_scraped")).otherwise(F.col("_done")), zero)
    unfinished = F.coalesce(F.when(is_scraper, F.col("_unscraped")).otherwise(F.col("_open")), zero)
    rule = (
        F.when(F.col("status").isin(*CLOSED), F.lit(False))
        .when(is_scraper, (F.col("items_pending") >= min_pending) | (F.col("items_completed") == 0))
        .when(F.col("tool_name") == "publisher", F.col("items_pending") > 0)
        .otherwise((F.col("items_pending") > 0) & (F.col("items_completed") > 0))
    )
    return (
        jobs.select("job_id", "tool_name", "status").join(counts, "job_id", "left")
        .withColumn("items_completed", completed).withColumn("items_pending", unfinished)
        .withColumn("resumable", rule)
        .drop("_done", "_open", "_scraped", "_unscraped")
    )


def publisher_report(batches: DataFrame, details: DataFrame) -> DataFrame:
    """Resume report of publishing batches, from the statuses of their articles."""
    status = F.col("publish_status")
    counts = details.groupBy("batch_id").agg(
        F.count_if(status.isin("PUBLISHED_ARCHIVE", "PUBLISHED_BRIEFING", "SKIPPED")).alias("items_completed"),
        F.count(F.lit(1)).alias("_all"), F.count_if(status == "FAILED").alias("_failed"),
    )
    left = F.col("_all") - F.col("items_completed")
    may = (
        F.when(F.col("status") == "COMPLETED", F.lit(False))
        .when((F.col("_failed") > 0) & (F.col("status") != "PUBLISHING"), F.lit(True))
        .otherwise(F.col("status").isin("PENDING", "PARTIAL", "PUBLISHING") & (left > 0))
    )
    return batches.join(counts, "batch_id").select(
        "batch_id", "status", "items_completed", left.alias("items_pending"), may.alias("resumable"))


def heal(jobs: DataFrame, items: DataFrame, now: Column, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """Stuck jobs become interrupted, long untouched ones failed; items of failed ones go."""
    touched = F.col("status").isin("RUNNING", "PAUSED_FOR_HITL")
    old = F.col("updated_at") < now - F.expr(f"INTERVAL {int(days)} DAYS")
    stale = old & F.col("status").isin("RUNNING", "PENDING", "INTERRUPTED")
    healed = jobs.withColumn(
        "new_status",
        F.when(stale, "FAILED").when(touched, "INTERRUPTED").otherwise(F.col("status")),
    )
    kept = items.join(jobs.filter(stale).select("job_id"), "job_id", "left_anti")
    return healed, kept


def add_items(items: DataFrame, new: DataFrame) -> DataFrame:
    """New items whose (job, step, ulid) is not there yet; one row per key."""
    keys = ["job_id", "step", "ulid"]
    fresh = first_per_key(with_keys(new), keys, [F.col("item_id").asc()])
    return fresh.join(with_keys(items).select(*keys).distinct(), keys, "left_anti")


def update_items(items: DataFrame, updates: DataFrame) -> DataFrame:
    """Give items the status, output and time of the update with their (job, step, ulid), if there is one."""
    keys = ["job_id", "step", "ulid"]
    last = first_per_key(with_keys(updates), keys, [F.col("updated_at").desc(), F.col("item_id").desc()]).select(
        *keys, F.col("status").alias("_status"), F.col("output_data").alias("_output"), F.col("updated_at").alias("_at"))
    return with_keys(items).join(last, keys, "left").select(
        "item_id", *keys,
        F.coalesce("_status", "status").alias("status"),
        F.coalesce("_output", "output_data").alias("output_data"),
        F.coalesce("_at", "updated_at").alias("updated_at"),
    )


def last_interrupted(jobs: DataFrame) -> DataFrame:
    """The most recently interrupted job of each session and tool."""
    return first_per_key(
        jobs.filter(F.col("status") == "INTERRUPTED"), ["session_id", "tool_name"],
        [F.col("updated_at").desc(), F.col("job_id").desc()])


def cached_outputs(articles: DataFrame, items: DataFrame, title_path: str = "$.translated_title") -> DataFrame:
    """Articles with the newest finished translation and the highest retry count known for them."""
    work = with_keys(items).filter(F.col("step") == "translate")
    newest = first_per_key(
        work.filter("status = 'COMPLETED'"), ["ulid"], [F.col("updated_at").desc(), F.col("item_id").desc()])
    usable = newest.filter(F.get_json_object("output_data", title_path).isNotNull()).select(
        "ulid", F.col("output_data").alias("cached_output"))
    retries = (
        work.filter("status = 'FAILED'").groupBy("ulid").agg(F.max(meta("retry").try_cast("long")).alias("retries"))
    )
    return (
        articles.join(usable, "ulid", "left").join(retries, "ulid", "left")
        .withColumn("retries", F.coalesce("retries", F.lit(0)).cast("long"))
    )


def poisoned(jobs: DataFrame, max_resumes: int = MAX_RESUMES) -> DataFrame:
    return jobs.filter(F.coalesce("resume_count", F.lit(0)) >= max_resumes)


def checklist(jobs: DataFrame, steps: Sequence[str]) -> DataFrame:
    """One pending item for each job and step."""
    step = F.explode(F.array(*[F.lit(s) for s in steps]))
    return jobs.select("job_id", step.alias("_step")).select(
        "job_id",
        F.to_json(F.struct(F.lit("blackboard").alias("step"), F.col("_step").alias("ulid"),
                           F.lit(0).alias("retry"))).alias("item_metadata"),
        F.lit("PENDING").alias("status"),
    )


def checklist_state(items: DataFrame) -> DataFrame:
    """Name (ulid, else step, else unknown), status and output of each item."""
    name = F.coalesce(
        F.when(meta("ulid") != "", meta("ulid")), F.when(meta("step") != "", meta("step")), F.lit("unknown"))
    return items.select("item_id", "job_id", name.alias("step_identifier"), "status", "output_data")


def outcome(items: DataFrame) -> DataFrame:
    """PARTIAL if an item failed or not every attempt succeeded, else COMPLETED."""
    counts = items.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(F.col("status") == "COMPLETED").alias("succeeded"),
        F.count_if(F.col("status") == "FAILED").alias("failed"),
    )
    partial = (F.col("failed") > 0) | (F.col("succeeded") != F.col("attempts"))
    return counts.withColumn("outcome", F.when(partial, "PARTIAL").otherwise("COMPLETED"))


def _rewrite_meta(items: DataFrame, **changes: Column) -> DataFrame:
    opened = items.withColumn("_m", F.from_json("item_metadata", META))
    body = F.col("_m")
    for name, value in changes.items():
        body = body.withField(name, value)
    return opened.withColumn("item_metadata", F.to_json(body)).drop("_m")


def bump_retry(items: DataFrame, now: datetime | str) -> DataFrame:
    """One more retry, with a new time."""
    return _rewrite_meta(
        items, retry=F.coalesce("_m.retry", F.lit(0)) + F.lit(1), timestamp=F.lit(str(now)))


def set_error(items: DataFrame, message: Column, now: datetime | str) -> DataFrame:
    return _rewrite_meta(items, error=message, timestamp=F.lit(str(now)))
