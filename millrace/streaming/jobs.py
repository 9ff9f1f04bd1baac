"""Structured Streaming forms of the operators.

Times must be of type ``timestamp`` (with zone) to carry a watermark.  Late rows
beyond the watermark are dropped; their number shows in the query progress.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from millrace.operators.logs import ERROR_LEVELS, log_filter
from millrace.operators.pages import redact_all
from millrace.operators.sync import dead_letters
from millrace.plans.shapes import first_per_key

WATERMARK = "10 minutes"


def read_files(spark: SparkSession, folder: str, schema: StructType, pattern: str | None = None,
               files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).format("parquet")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def stamped(stream: DataFrame, time: str, watermark: str = WATERMARK) -> DataFrame:
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, watermark)


def tail(stream: DataFrame, **conditions) -> DataFrame:
    """Follow the log; the checkpoint keeps the place, so no row is lost or seen twice."""
    return log_filter(stream, **conditions)


def live_stats(stream: DataFrame, time: str = "log_ts", width: str = "1 hour") -> DataFrame:
    """Rows and errors of each level and window."""
    return (
        stamped(stream, time).groupBy(F.window(time, width), "level")
        .agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("level").isin(*ERROR_LEVELS)).alias("errors"))
        .select(F.col("window.start").alias("window_start"), "level", "entries", "errors")
    )


def rate_alerts(stream: DataFrame, max_rows: int, period: str, slide: str, by: Sequence[str] = (), time: str = "ts") -> DataFrame:
    """Sliding windows that hold more rows than allowed."""
    counted = stamped(stream, time).groupBy(F.window(time, period, slide), *by).agg(F.count(F.lit(1)).alias("in_window"))
    return counted.filter(F.col("in_window") > max_rows).select(F.col("window.start").alias("window_start"), *by, "in_window")


def new_links(stream: DataFrame, known: DataFrame, time: str, url: str = "url", watermark: str = WATERMARK) -> DataFrame:
    """Links that are not known and were not seen within the watermark."""
    fresh = stream.join(known.select(F.col(url)).distinct(), url, "left_anti")
    return stamped(fresh, time, watermark).dropDuplicatesWithinWatermark([url])


def redact_stream(stream: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return redact_all(stream, columns)


def write_rows(stream: DataFrame, path: str, checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Append to Parquet; all that is there now, or every few seconds without end."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)
    return writer.start()


def stream_pending(spark: SparkSession, folder: str, schema: StructType, path: str, checkpoint: str, pattern: str | None = None) -> StreamingQuery:
    """Rows that came since the last run, each once; the checkpoint is the watermark of the sync."""
    return write_rows(read_files(spark, folder, schema, pattern), path, checkpoint)


def _run_of(spark: SparkSession, checkpoint: str) -> str:
    """The id that a streaming query keeps in its checkpoint; another checkpoint has another one."""
    return spark.read.json(f"{checkpoint}/metadata").first().id


def upsert_changes(stream: DataFrame, root: str, keys: Sequence[str], order: Sequence[str], checkpoint: str,
                   seconds: int | None = 5) -> StreamingQuery:
    """Append each micro-batch's last row of each key to the change log under ``root``.

    A batch writes to a folder of its query and its own number, so a repeated batch
    overwrites itself and a query with a new checkpoint, which counts from 0 again,
    overwrites nothing.  Its rows carry ``_seq``, which goes on from the highest number
    under ``root`` and orders the batches of all queries that wrote there, one after
    the other.  The cost follows the batch, not the table; ``current_rows`` merges on
    read and ``compact`` folds the changes in.  A column ``op`` with ``delete`` removes
    a key.  One query at a time may write to a root.
    """
    latest = [F.col(c).desc() for c in order]
    spark = stream.sparkSession
    before = _last_seq(spark, root)
    first: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        first.append(number)
        rows = first_per_key(batch, keys, latest).withColumn("_seq", F.lit(before + 1 + number - first[0]).cast("long"))
        rows.write.mode("overwrite").parquet(f"{root}/changes/run={_run_of(spark, checkpoint)}/batch={number}")

    return _each_batch(stream, write, checkpoint, seconds)


def _each_batch(stream: DataFrame, write, checkpoint: str, seconds: int | None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)
    return writer.start()


def _load(spark: SparkSession, path: str) -> DataFrame | None:
    """A folder, or nothing if it isn't there; one that can't be read is an error."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _changes(spark: SparkSession, root: str) -> DataFrame | None:
    changes = _load(spark, f"{root}/changes")
    return None if changes is None else changes.drop("run", "batch")


def _base(spark: SparkSession, root: str) -> tuple[DataFrame | None, int]:
    """The newest published base and the number up to which it holds the changes."""
    published = _load(spark, f"{root}/published")
    if published is None:
        return None, -1
    last = published.orderBy(F.desc("upto"), F.desc("at")).first()
    return spark.read.parquet(f"{root}/base/{last.folder}"), last.upto


def _last_seq(spark: SparkSession, root: str) -> int:
    _, upto = _base(spark, root)
    changes = _changes(spark, root)
    highest = None if changes is None else changes.agg(F.max("_seq")).first()[0]
    return max(upto, -1 if highest is None else highest)


def current_rows(spark: SparkSession, root: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The table as of its last batch: newest batch wins, then the order inside it."""
    changes, (base, upto) = _changes(spark, root), _base(spark, root)
    if base is None and changes is None:
        raise ValueError(f"no rows under {root}")
    rows = changes if base is None else base.withColumn("_seq", F.lit(upto).cast("long"))
    if base is not None and changes is not None:
        rows = rows.unionByName(changes.filter(F.col("_seq") > upto), allowMissingColumns=True)
    newest = first_per_key(rows, keys, [F.col("_seq").desc(), *[F.col(c).desc() for c in order]])
    if "op" in newest.columns:
        newest = newest.filter(F.coalesce("op", F.lit("upsert")) != "delete")
    return newest.drop("_seq")


def compact(spark: SparkSession, root: str, keys: Sequence[str], order: Sequence[str]) -> int | None:
    """Fold all changes into a new base and publish it.

    The base is written to a folder of its own; a row in ``published`` names it once
    it is whole, so no reader sees a part of it and folding twice does no harm.
    Folders of folded changes and of older bases aren't read any more; the caller
    removes them when no reader is left on them.
    """
    changes = _changes(spark, root)
    if changes is None:
        return None
    upto = changes.agg(F.max("_seq")).first()[0]
    if upto is None:
        return None
    folder = uuid.uuid4().hex
    current_rows(spark, root, keys, order).write.parquet(f"{root}/base/{folder}")
    entry = spark.createDataFrame([(upto, folder)], "upto long, folder string").withColumn("at", F.current_timestamp())
    entry.coalesce(1).write.mode("append").parquet(f"{root}/published")
    return upto


def with_dead_letters(stream: DataFrame, fault: Column, table: str, keys: Sequence[str], good_path: str, bad_path: str,
                      checkpoint: str, seconds: int | None = 5) -> StreamingQuery:
    """Good rows to one folder and faulty ones, as dead letters, to another, in the same batch.

    ``fault`` is null for a good row, else the reason.  Both have a folder for each
    query and batch: a repeated batch overwrites itself, a new checkpoint nothing.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        place = f"run={_run_of(spark, checkpoint)}/batch={number}"
        checked = batch.withColumn("_fault", fault).persist()
        try:
            good = checked.filter("_fault IS NULL").drop("_fault")
            bad = checked.filter("_fault IS NOT NULL").drop("_fault")
            good.write.mode("overwrite").parquet(f"{good_path}/{place}")
            dead_letters(bad, table, keys, fault).write.mode("overwrite").parquet(f"{bad_path}/{place}")
        finally:
            checked.unpersist()

    return _each_batch(stream, write, checkpoint, seconds)
