"""Session messages under a size budget.

Messages have session_id, id (growing), content, char_count, attachment_char_count
and has_screenshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.shapes import budget_prefix, first_per_key, same_key, under_keys

RESERVE = 1000


def effective_cost(messages: DataFrame) -> DataFrame:
    """Cost of each message; of the screenshots of a session only the newest counts.  A missing size is 0."""
    shots = messages.filter("has_screenshot").groupBy("session_id").agg(F.max("id").alias("_newest"))
    newest = under_keys(shots, ["session_id"])
    stale = F.col("has_screenshot") & (F.col("id") < F.col("_newest"))
    attached = F.when(stale, 0).otherwise(F.coalesce("attachment_char_count", F.lit(0)))
    return (
        messages.join(newest, same_key(["session_id"]), "left")
        .withColumn("cost", (F.coalesce("char_count", F.lit(0)) + attached).cast("long"))
        .drop("_newest", "_k_session_id")
    )


def context(messages: DataFrame, budget: int) -> DataFrame:
    """The newest messages of each session, up to the first that would overflow."""
    return budget_prefix(effective_cost(messages), ["session_id"], [("id", True)], "cost", budget)


def session_cost(messages: DataFrame, budget: int) -> DataFrame:
    """Cost of the messages that fit, for every session."""
    kept = context(messages, budget).groupBy("session_id").agg(F.sum("cost").alias("cost"))
    every = messages.select("session_id").distinct()
    return every.join(under_keys(kept, ["session_id"]), same_key(["session_id"]), "left").select(
        "session_id", F.coalesce("cost", F.lit(0)).cast("long").alias("cost"))


def would_exceed(messages: DataFrame, extra: int, budget: int) -> DataFrame:
    return session_cost(messages, budget).withColumn("exceeds", F.col("cost") + extra > budget)


def evict(messages: DataFrame, budget: int, keep_last: bool = True) -> DataFrame:
    """The newest messages of each session that fit together, oldest dropped first.

    With ``keep_last`` a newest message that is too large alone stays, cut to the
    budget less a reserve; without it, it goes as well.
    """
    size = F.coalesce("char_count", F.lit(0)) + F.coalesce("attachment_char_count", F.lit(0))
    sized = messages.withColumn("_size", size.cast("long"))
    kept = budget_prefix(sized, ["session_id"], [("id", True)], "_size", budget, keep_first=False)
    if keep_last:
        newest = first_per_key(sized, ["session_id"], [F.col("id").desc()])
        large = newest.filter(F.col("_size") > budget).withColumn(
            "content", F.substring("content", 1, max(budget - RESERVE, RESERVE)))
        large = large.withColumn("char_count", F.length("content").cast("long")).withColumn(
            "attachment_char_count", F.lit(0).cast("long")).withColumn("running_cost", F.lit(None).cast("long"))
        kept = kept.unionByName(large.select(*kept.columns))
    return kept.drop("_size", "running_cost")
