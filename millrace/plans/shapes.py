"""Plan shapes shared by the operators.

Each shape is written for inputs in which a single key may hold a large part of
all rows: ranked picks are cut down before the shuffle, budget walks are salted,
as-of lookups and sliding counts are split along time.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import ensure_checkpoint_dir

SMALL_SIDE_ROWS = 50_000
SMALL_SIDE_BYTES = 8 << 20
#: Above this many rows of a key Spark no longer cuts input tasks down by rank.
GROUP_LIMIT = 1000
MIN_SALTS = 32


def is_small(df: DataFrame, max_rows: int = SMALL_SIDE_ROWS, max_bytes: int = SMALL_SIDE_BYTES) -> bool:
    """Whether a frame has at most so many rows and bytes, both read off its rows; reading stops one row past the bound."""
    size = F.coalesce(F.octet_length(F.to_json(F.struct(*df.columns))), F.lit(0))
    rows, held = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(size)).first()
    return rows <= max_rows and (held or 0) <= max_bytes


def small_side(df: DataFrame, max_rows: int = SMALL_SIDE_ROWS, max_bytes: int = SMALL_SIDE_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast only if ``is_small``; a larger frame has no hint, so that the join shuffles instead."""
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank_col: str | None = None
) -> DataFrame:
    """First ``n`` rows of each key.

    Spark turns the rank filter into a group limit on the map side, so at most
    ``n`` rows per key and input task are shuffled, however large the key is.  It
    does so up to ``GROUP_LIMIT`` rows; for more, a key is first split over salts
    and each part cut to ``n`` rows by itself, so that the last step sorts no more
    than ``n`` rows of a key and salt.
    """
    rank = rank_col or "_rank"
    if n > GROUP_LIMIT:
        salts = max(MIN_SALTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        spread = [c for c in df.columns if "map<" not in df.schema[c].dataType.simpleString()]
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts))).withColumn(
            "_part", F.row_number().over(part)).filter(F.col("_part") <= n).drop("_salt", "_part")
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)
    if rank_col is None:
        return ranked.drop(rank)
    return ranked.withColumn(rank, F.col(rank).cast("long"))


def ordered_ranks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], into: str = "rank") -> DataFrame:
    """All rows with their exact number (from 1, long) within their key, in the given order.

    Rows are dealt by sampled splitters over (keys, order, hash of the row) into ranges of about equal *count*, sorted
    there and written to the checkpoint folder.  A row's number is its place in its range and the rows of its key in the
    ranges before; only one row per key and range is counted.  So one key, and one value of its order, may own all rows
    without meeting in one task (rows that are equal in every column do meet).  Pass keys, order and id columns only, and
    join the rest to the few rows wanted.
    """
    keys = list(keys)
    ensure_checkpoint_dir(df.sparkSession)
    hashed = [c for c in df.columns if "map<" not in df.schema[c].dataType.simpleString()]
    by = [*[F.col(k).asc() for k in keys], *order, F.xxhash64(*hashed).asc()]
    # The number of a range and the place in it: given after the sort, where the rows are.
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(*keys, part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    # As many rows as a key has ranges.
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    meets = part == F.col("_part")
    for k in keys:
        meets = meets & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return placed.join(starts, meets).withColumn(into, F.col("_before") + F.col("_at") - F.col("_first") + 1).select(*df.columns, into)


def ordered_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column], weight: str, into: str) -> DataFrame:
    """All rows with the exact sum (long) of ``weight`` (0 or more, null is 0) up to and with each, within its key, in the
    given order.  Dealt, written and offset as ``ordered_ranks`` does; the sum within a range runs through Arrow batches."""
    keys = list(keys)
    ensure_checkpoint_dir(df.sparkSession)
    hashed = [c for c in df.columns if "map<" not in df.schema[c].dataType.simpleString()]
    by = [*[F.col(k).asc() for k in keys], *order, F.xxhash64(*hashed).asc()]
    dealt = df.withColumn("_weight", F.coalesce(F.col(weight).cast("long"), F.lit(0))).repartitionByRange(*by).sortWithinPartitions(*by)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)

    def run(batches):
        total = 0
        for batch in batches:
            sums = np.cumsum(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64)) + total
            total = int(sums[-1]) if len(sums) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums)], [*batch.schema.names, "_run"])

    placed = dealt.mapInArrow(run, f"{kinds}, _run long").withColumn("_range", F.spark_partition_id()).checkpoint()
    counts = placed.groupBy(*keys, F.col("_range").alias("_part")).agg(
        F.sum("_weight").alias("_n"), F.min(F.col("_run") - F.col("_weight")).alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    meets = F.col("_range") == F.col("_part")
    for k in keys:
        meets = meets & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return placed.join(starts, meets).withColumn(into, F.col("_before") + F.col("_run") - F.col("_first")).select(*df.columns, into)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the given order."""
    return top_per_key(df, keys, order, 1)


def under_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with its key columns renamed, so that it can meet a frame of the same origin."""
    return df.withColumnsRenamed({k: f"_k_{k}" for k in keys})


def same_key(keys: Sequence[str]) -> Column:
    """Null-safe equality of plain keys with those renamed by ``under_keys``."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])


def budget_prefix(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[tuple[str, bool]],
    cost: str,
    budget: int | Column,
    *,
    keep_first: bool = False,
    positive: bool = False,
    running: str = "running_cost",
    salts: int | None = None,
) -> DataFrame:
    """Rows of each key, in order, up to the first one that overflows the budget.

    ``order`` lists (column, descending) pairs that order a key fully; ``cost`` is
    a column of whole numbers, not negative; null counts as 0.  ``keep_first`` keeps the first
    costly row of a key even if it is too large by itself.  ``positive`` says that
    every row costs something, which leaves out the last step below.

    A plain running sum would sort a whole key in one task.  Here the key is
    first split over ``salts`` parts (as many as the session shuffles to, unless
    given) and each part is cut at the budget by itself, which never drops a row of the answer: a sum over part of the rows
    is at most the sum over all of them.  What is left of a key is at most
    ``salts * (budget + 1)`` rows, and the exact sum runs over those.  Rows that
    cost nothing are judged against the place of the cut, by a join.
    """
    if salts is None:
        salts = max(MIN_SALTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    budget_col = F.lit(budget) if isinstance(budget, int) else budget
    exprs = [F.col(c).desc() if desc else F.col(c).asc() for c, desc in order]
    order_cols = [c for c, _ in order]
    base = df.withColumn("_budget", budget_col.cast("long")).withColumn(cost, F.coalesce(cost, F.lit(0)))

    costly = base.filter(F.col(cost) > 0)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in order_cols]), F.lit(salts))
    part = Window.partitionBy(*keys, "_salt").orderBy(*exprs).rowsBetween(Window.unboundedPreceding, 0)
    survivors = (
        costly.withColumn("_salt", salt)
        .withColumn("_part", F.sum(cost).over(part))
        .filter(F.col("_part") - F.col(cost) <= F.col("_budget"))
        .drop("_salt", "_part")
    )
    whole = Window.partitionBy(*keys).orderBy(*exprs).rowsBetween(Window.unboundedPreceding, 0)
    summed = survivors.withColumn(running, F.sum(cost).over(whole).cast("long"))
    fits = F.col(running) <= F.col("_budget")
    if keep_first:
        fits = fits | (F.col(running) == F.col(cost))
    kept = summed.filter(fits)
    if positive:
        return kept.drop("_budget")

    free = base.filter(F.col(cost) == 0)
    over = summed.filter(~fits)
    cut = first_per_key(over, list(keys), exprs).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.lit(True).alias("_has_cut"),
        *[F.col(c).alias(f"_cut_{c}") for c in order_cols],
    )
    before = F.lit(False)
    tied = F.lit(True)
    for c, desc in order:
        here, there = F.col(c), F.col(f"_cut_{c}")
        # As the sort has it: nulls come first going up and last going down.
        if desc:
            earlier = here.isNotNull() & (there.isNull() | (here > there))
        else:
            earlier = there.isNotNull() & (here.isNull() | (here < there))
        before = before | (tied & F.coalesce(earlier, F.lit(False)))
        tied = tied & here.eqNullSafe(there)
    free_kept = (
        free.join(cut, same_key(keys), "left")
        .filter(F.col("_has_cut").isNull() | before)
        .withColumn(running, F.lit(None).cast("long"))
        .select(*kept.columns)
    )
    return kept.unionByName(free_kept).drop("_budget")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: str,
    left_on: str,
    right_on: str,
    values: Sequence[str],
    *,
    bucket: str = "day",
) -> DataFrame:
    """Give each left row the newest right row at or before it, for the same key.

    Both sides are cut along time into calendar buckets, so a key with very many
    rows is spread over its buckets.  A bucket starts from the last right row of
    any earlier bucket; that row is found on one row per (key, bucket), which the
    calendar bounds.  No join condition on ranges is needed.  Right rows are
    distinct in key and time.
    """
    def cut(col: str) -> Column:
        return F.date_trunc(bucket, F.col(col))

    pack = F.struct(F.col(right_on).alias("_at"), *[F.col(v) for v in values])
    rights = right.select(F.col(by), F.col(right_on).alias("_when"), cut(right_on).alias("_bucket"), pack.alias("_r"))
    lefts = left.withColumn("_when", F.col(left_on)).withColumn("_bucket", cut(left_on))

    # One row per (key, bucket): the last right row, or none.
    lasts = rights.groupBy(by, "_bucket").agg(F.max_by("_r", "_when").alias("_last"))
    starts = lefts.select(by, "_bucket").distinct()
    marks = lasts.join(starts, [by, "_bucket"], "full")
    earlier = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        marks.withColumn("_r", F.last("_last", ignorenulls=True).over(earlier))
        .filter(F.col("_r").isNotNull())
        .select(by, "_bucket", F.lit(None).cast(left.schema[left_on].dataType).alias("_when"), "_r")
    )

    left_cols = left.columns
    tagged = lefts.select(
        by, "_bucket", "_when", F.lit(1).alias("_side"), F.struct(*left_cols).alias("_l"),
        F.lit(None).cast(rights.schema["_r"].dataType).alias("_r"),
    )
    known = rights.select(by, "_bucket", "_when", "_r").unionByName(carried).select(
        by, "_bucket", "_when", F.lit(0).alias("_side"),
        F.lit(None).cast(tagged.schema["_l"].dataType).alias("_l"), "_r",
    )
    walk = (
        Window.partitionBy(by, "_bucket")
        .orderBy(F.col("_when").asc_nulls_first(), F.col("_side"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    both = tagged.unionByName(known).withColumn("_hit", F.last("_r", ignorenulls=True).over(walk))
    return both.filter("_side = 1").select(
        *[F.col(f"_l.{c}").alias(c) for c in left_cols],
        *[F.col(f"_hit.{v}").alias(v) for v in values],
    )


def sliding_count(
    df: DataFrame, time_us: str, period_us: int, by: Sequence[str] = (), *, blocks: int = 16
) -> DataFrame:
    """Rows in the closed window ``[t - period, t]`` for every distinct time of each group.

    Equal times are counted together first.  Time is then cut into blocks of
    ``blocks`` periods and the last period of a block is also sent to the next
    one, so no task holds a whole group.  A block has at most one row for each
    microsecond it spans.
    """
    span = period_us * blocks
    counts = df.groupBy(*by, F.col(time_us).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    block = F.floor(F.col("_t") / F.lit(span)).cast("long")
    near_end = F.col("_t") >= (F.col("_b") + 1) * F.lit(span) - F.lit(period_us)
    placed = (
        counts.withColumn("_b", block)
        .withColumn(
            "_to",
            F.explode(F.when(near_end, F.array(F.col("_b"), F.col("_b") + 1)).otherwise(F.array(F.col("_b")))),
        )
    )
    window = Window.partitionBy(*by, "_to").orderBy("_t").rangeBetween(-period_us, 0)
    return (
        placed.withColumn("in_window", F.sum("_n").over(window).cast("long"))
        .filter(F.col("_to") == F.col("_b"))
        .select(*by, F.col("_t").alias(time_us), F.col("_n").alias("at_time"), "in_window")
    )


def islands(df: DataFrame, keys: Sequence[str], number: str, *, block: int = 4096) -> DataFrame:
    """Runs of consecutive whole numbers of each key, as first, last and length.

    Numbers are looked at in blocks of ``block``; only runs that touch the edge
    of a block, two for each block at most, meet in a second step.
    """
    rows = df.select(*keys, F.col(number).cast("long").alias("_n")).distinct()
    rows = rows.withColumn("_b", F.floor(F.col("_n") / block).cast("long"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_n")
    runs = (
        rows.withColumn("_g", F.col("_n") - F.row_number().over(inside))
        .groupBy(*keys, "_b", "_g").agg(F.min("_n").alias("first"), F.max("_n").alias("last"))
    )
    edge = (F.pmod("first", F.lit(block)) == 0) | (F.pmod("last", F.lit(block)) == block - 1)
    across = Window.partitionBy(*keys).orderBy("first")
    joined = (
        runs.filter(edge)
        .withColumn("_new", F.when(F.lag("last").over(across) == F.col("first") - 1, 0).otherwise(1))
        .withColumn("_run", F.sum("_new").over(across.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .drop("_run")
    )
    whole = runs.filter(~edge).select(*keys, "first", "last").unionByName(joined)
    return whole.withColumn("length", F.col("last") - F.col("first") + 1)
