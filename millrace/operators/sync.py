"""Two-sided table sync: hashes, differences, resolution, merge, health.

Keys stay separate typed columns and are compared null-safely, so no text form of
a composite key exists.  The difference needs keys, hash and time only; payload
columns join it afterwards, for the rows that move.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.shapes import first_per_key, same_key, under_keys

# Columns that do not count as content.
VOLATILE = ("updated_at", "content_hash", "scraped_at", "embedding", "vec_rowid", "created_at")
BARS = "||"
STRATEGIES = ("operational_wins", "cloud_wins", "newest_overall_wins")
CLASSES = ("op_only", "cloud_only", "identical", "timestamp_drift", "conflict", "legacy_conflict")
_SPACES = " \t\n\r\x0b\x0c"
_EPOCH = "1970-01-01 00:00:00"


def _hash_text(df: DataFrame, name: str) -> Column:
    """Trimmed text of a value; anything empty, zero or false counts as missing."""
    kind, col = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.BooleanType):
        return F.when(col, F.lit("True")).otherwise(F.lit(""))
    text = F.btrim(col.cast("string"), F.lit(_SPACES))
    if isinstance(kind, T.NumericType):
        text = F.when(col == 0, F.lit("")).otherwise(text)
    return F.coalesce(text, F.lit(""))


def row_hash(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """SHA-256 over the content columns (all but the volatile ones, unless named)."""
    chosen = columns or [c for c in df.columns if c.lower() not in VOLATILE]
    return F.sha2(F.concat_ws(BARS, *[_hash_text(df, c) for c in chosen]), 256)


def _no_hash() -> Column:
    return F.coalesce("content_hash", F.lit("")) == ""


def backfill_hash(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Fill empty hashes; filled ones stay as they are."""
    return df.withColumn("content_hash", F.when(_no_hash(), row_hash(df, columns)).otherwise(F.col("content_hash")))


def count_backfill(df: DataFrame) -> DataFrame:
    """How many rows a fill would touch."""
    return df.agg(F.count_if(_no_hash()).alias("to_fill"), F.count(F.lit(1)).alias("total"))


def _changed(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    known = under_keys(target.select(*keys, F.col("content_hash").alias("_h"), F.lit(True).alias("_there")), keys)
    manifest = source.select(*keys, "content_hash").join(known, same_key(keys), "left")
    moved = manifest.filter(F.col("_there").isNull() | ~F.col("content_hash").eqNullSafe(F.col("_h")))
    return moved.withColumn(
        "reason", F.when(F.col("_there").isNull(), "missing").otherwise("different")).select(*keys, "reason")


def to_push(local: DataFrame, cloud: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of local rows that the cloud lacks or holds with another hash."""
    return _changed(local, cloud, keys)


def to_pull(local: DataFrame, cloud: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of cloud rows that the local side lacks or holds with another hash."""
    return _changed(cloud, local, keys)


def payload(rows: DataFrame, moved: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whole rows of the keys that move."""
    return rows.join(under_keys(moved.select(*keys), keys), same_key(keys), "left_semi")


def classify(local: DataFrame, cloud: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of both sides with their class, hashes and times, by one full outer join."""
    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(
            *[F.col(k).alias(f"{p}_{k}") for k in keys], F.col("content_hash").alias(f"{p}_hash"),
            F.col("updated_at").alias(f"{p}_ts"), F.lit(True).alias(f"in_{p}"))

    op, cl = side(local, "op"), side(cloud, "cloud")
    on = reduce(lambda a, b: a & b, [F.col(f"op_{k}").eqNullSafe(F.col(f"cloud_{k}")) for k in keys])
    hashed = (F.coalesce("op_hash", F.lit("")) != "") & (F.coalesce("cloud_hash", F.lit("")) != "")
    same_time = F.col("op_ts").eqNullSafe(F.col("cloud_ts"))
    kind = (
        F.when(F.col("in_cloud").isNull(), "op_only")
        .when(F.col("in_op").isNull(), "cloud_only")
        .when(hashed & (F.col("op_hash") != F.col("cloud_hash")), "conflict")
        .when(hashed & ~same_time, "timestamp_drift")
        .when(~hashed & ~same_time, "legacy_conflict")
        .otherwise("identical")
    )
    return op.join(cl, on, "full").select(
        *[F.coalesce(f"op_{k}", f"cloud_{k}").alias(k) for k in keys],
        kind.alias("class"), "op_hash", "cloud_hash", "op_ts", "cloud_ts")


def summary(classes: DataFrame) -> DataFrame:
    """Rows of each class, with the number in which either side is newer."""
    return classes.groupBy("class").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("op_ts") > F.col("cloud_ts")).alias("op_newer"),
        F.count_if(F.col("cloud_ts") > F.col("op_ts")).alias("cloud_newer"),
    )


def winner(strategy: str) -> Column:
    """Which side of a conflict wins; equal or missing times need a person."""
    if strategy == "operational_wins":
        return F.lit("operational")
    if strategy == "cloud_wins":
        return F.lit("cloud")
    if strategy == "newest_overall_wins":
        return (
            F.when(F.col("op_ts") > F.col("cloud_ts"), "operational")
            .when(F.col("cloud_ts") > F.col("op_ts"), "cloud")
            .otherwise("manual")
        )
    return F.lit("manual")


def resolve(classes: DataFrame, strategy: str) -> DataFrame:
    """Conflicts of both kinds with the winning side."""
    return classes.filter(F.col("class").isin("conflict", "legacy_conflict")).withColumn("verdict", winner(strategy))


def _totals(counts: DataFrame) -> DataFrame:
    def rows_of(*names: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("class").isin(*names), F.col("n"))), F.lit(0)).cast("long")

    drift = F.col("class") == "timestamp_drift"
    return counts.agg(
        rows_of("op_only").alias("op_only"), rows_of("cloud_only").alias("cloud_only"),
        rows_of("conflict", "legacy_conflict").alias("conflicts"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"),
        F.coalesce(F.sum(F.when(drift, F.col("op_newer"))), F.lit(0)).cast("long").alias("op_newer"),
        F.coalesce(F.sum(F.when(drift, F.col("cloud_newer"))), F.lit(0)).cast("long").alias("cloud_newer"),
    )


def recommend(counts: DataFrame) -> DataFrame:
    """A strategy and a confidence from the share of conflicts."""
    rate = F.coalesce(F.try_divide(F.col("conflicts") * 100.0, F.col("total")), F.lit(0.0))
    none = F.col("conflicts") == 0
    return _totals(counts).select(
        "conflicts", "cloud_only", "total", F.round(rate, 4).alias("conflict_rate"),
        F.when(none & (F.col("cloud_only") == 0), "operational_wins").when(none | (rate < 20), "newest_overall_wins")
        .otherwise("abort").alias("strategy"),
        F.when(none & (F.col("cloud_only") == 0), 0.95).when(none, 0.90).when(rate < 5, 0.85).when(rate < 20, 0.60)
        .otherwise(0.90).alias("confidence"),
    )


def outcomes(counts: DataFrame) -> DataFrame:
    """What each strategy would move, delete and let win, one row per strategy."""
    c = F.col
    zero = F.lit(0).cast("long")
    undecided = F.greatest(zero, c("conflicts") - c("op_newer") - c("cloud_newer"))

    def row(name, up, down, op_del, cloud_del, op_win, cloud_win):
        return F.struct(
            F.lit(name).alias("strategy"), up.alias("op_to_cloud"), down.alias("cloud_to_op"), op_del.alias("op_deletes"),
            cloud_del.alias("cloud_deletes"), op_win.alias("conflict_op_wins"), cloud_win.alias("conflict_cloud_wins"))

    rows = F.array(
        row("operational_wins", c("op_only"), zero, zero, c("cloud_only"), c("conflicts"), zero),
        row("cloud_wins", zero, c("cloud_only"), c("op_only"), zero, zero, zero),
        row("newest_overall_wins", c("op_only"), c("cloud_only"), zero, zero, c("op_newer") + undecided, c("cloud_newer")),
    )
    return _totals(counts).select(F.inline(rows))


# Columns that tell which of two rows is newer, in this order of preference.
AGE_COLUMNS = ("updated_at", "hashed_at", "completed_at", "scraped_at", "created_at", "timestamp")


def merge(target: DataFrame, source: DataFrame, keys: Sequence[str], newest: str = "updated_at",
          keep: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """Upsert ``source`` into ``target``: one row per key, newest source row, columns in ``keep`` stay as they were.

    Without the column ``newest`` the first of ``AGE_COLUMNS`` that is there decides, or else the hash of the row, so
    that the same rows always give the same result.
    """
    age = [c for c in (newest, *AGE_COLUMNS) if c in source.columns][:1]
    order = [*[F.col(c).desc_nulls_last() for c in age], *[F.col(c).desc() for c in tie]]
    if not age:
        order.append(F.xxhash64(*source.columns).desc())
    fresh = first_per_key(source, list(keys), order)
    shared = [c for c in target.columns if c in fresh.columns and c not in keys]
    # Sides meet as groups of a window, for which null keys are equal as they are: a side that is dealt by its keys stays so.
    both = target.unionByName(
        fresh.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in shared], F.lit(True).alias("_new")), allowMissingColumns=True)
    group = Window.partitionBy(*keys)
    # A key has one new row at most: what it holds is the first value that is not null, or none is.
    given = [F.first(c, ignorenulls=True).over(group).alias(c) for c in (*[f"_s_{c}" for c in shared], "_new")]
    held = F.count_if(F.col("_new").isNull()).over(group)
    met = both.select(*target.columns, *given, (F.col("_new").isNull() | (held == 0)).alias("_stays")).filter("_stays")
    columns = []
    for name in target.columns:
        if name in keys or name not in shared:
            columns.append(F.col(name))
        elif name in keep:
            columns.append(F.coalesce(name, f"_s_{name}").alias(name))
        else:
            columns.append(F.when(F.col("_new"), F.col(f"_s_{name}")).otherwise(F.col(name)).alias(name))
    return met.select(*columns)


def apply_sync(local: DataFrame, cloud: DataFrame, keys: Sequence[str], strategy: str) -> DataFrame:
    """The local table after the sync, with what was done to each row.

    Cloud rows come in where the strategy restores them or lets them win; under
    ``cloud_wins`` rows only known locally go.  A conflict that needs a person
    keeps the local row and is marked ``manual``.
    """
    value_cols = [c for c in local.columns if c not in keys]
    cl = under_keys(
        cloud.select(*keys, *[F.col(c).alias(f"_c_{c}") for c in value_cols], F.lit(True).alias("_in_cloud")), keys)
    both = local.withColumn("_in_op", F.lit(True)).join(cl, same_key(keys), "full")
    h, ch = F.coalesce("content_hash", F.lit("")), F.coalesce("_c_content_hash", F.lit(""))
    same_time = F.col("updated_at").eqNullSafe(F.col("_c_updated_at"))
    hashed = (h != "") & (ch != "")
    conflict = (hashed & (h != ch)) | (~hashed & ~same_time)
    newer_cloud = F.col("_c_updated_at") > F.col("updated_at")
    newer_op = F.col("updated_at") > F.col("_c_updated_at")
    verdict = {
        "operational_wins": F.lit("keep"),
        "cloud_wins": F.lit("replace"),
        "newest_overall_wins": F.when(newer_cloud, "replace").when(newer_op, "keep").otherwise("manual"),
    }.get(strategy, F.lit("manual"))
    action = (
        F.when(F.col("_in_op").isNull(), "skip" if strategy == "operational_wins" else "restore")
        .when(F.col("_in_cloud").isNull(), "delete" if strategy == "cloud_wins" else "keep")
        .when(conflict, verdict)
        .otherwise("keep")
    )
    take = F.col("action").isin("restore", "replace")
    return (
        both.withColumn("action", action)
        .filter(~F.col("action").isin("skip", "delete"))
        .select(
            *[F.coalesce(k, f"_k_{k}").alias(k) for k in keys],
            *[F.when(take, F.col(f"_c_{c}")).otherwise(F.col(c)).alias(c) for c in value_cols], "action")
    )


def table_counts(tables: dict[str, DataFrame], name: str = "n_rows") -> DataFrame:
    """Row count of each table, as one frame."""
    counts = [df.agg(F.count(F.lit(1)).alias(name)).select(F.lit(t).alias("table_name"), name) for t, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def verify_counts(local: DataFrame, cloud: DataFrame) -> DataFrame:
    """Counts of both sides next to each other; -1 where a side lacks the table."""
    joined = local.select("table_name", F.col("n_rows").alias("local_rows")).join(
        cloud.select("table_name", F.col("n_rows").alias("cloud_rows")), "table_name", "full")
    missing = F.lit(-1).cast("long")
    out = joined.select(
        "table_name", F.coalesce("local_rows", missing).alias("local_rows"), F.coalesce("cloud_rows", missing).alias("cloud_rows"))
    return out.withColumn("matches", F.col("local_rows") == F.col("cloud_rows"))


def startup_action(local: DataFrame, cloud: DataFrame) -> DataFrame:
    """One row: skip, pull_only, push_only or bidirectional, from the counts of both sides.

    Tables compared are those of the local side; no cloud counts at all means skip.
    """
    joined = local.select("table_name", F.col("n_rows").alias("l"), F.lit(True).alias("here")).join(
        cloud.select("table_name", F.col("n_rows").alias("c")), "table_name", "full")
    l_sum = F.coalesce(F.sum(F.greatest("l", F.lit(0))), F.lit(0)).cast("long")
    c_sum = F.coalesce(F.sum(F.greatest("c", F.lit(0))), F.lit(0)).cast("long")
    diverged = F.count_if(F.col("here") & (F.coalesce("l", F.lit(0)) != F.coalesce("c", F.lit(0))))
    facts = joined.agg(l_sum.alias("local_rows"), c_sum.alias("cloud_rows"), diverged.alias("diverged"))
    action = (
        F.when(F.col("cloud_rows") + F.col("local_rows") == 0, "skip")
        .when(F.col("local_rows") == 0, "pull_only")
        .when(F.col("cloud_rows") == 0, "push_only")
        .when(F.col("diverged") == 0, "skip")
        .otherwise("bidirectional")
    )
    return facts.withColumn("action", action).withColumn(
        "strategy",
        F.when(F.col("action") == "pull_only", "cloud_wins").when(F.col("action") == "bidirectional", "newest_overall_wins")
        .otherwise("operational_wins"))


def watermark(ledger: DataFrame, table: str) -> Column:
    """End of the last completed sync of the table, or the epoch, as a scalar."""
    done = ledger.filter((F.col("state") == "COMPLETED") & F.col("table_name").isin(table, "ALL"))
    kind = ledger.schema["completed_at"].dataType
    return done.agg(F.coalesce(F.max("completed_at"), F.lit(_EPOCH).cast(kind))).scalar()


def pending(df: DataFrame, ledger: DataFrame, table: str) -> DataFrame:
    """Rows changed since the last completed sync; every row if the table keeps no time."""
    if "updated_at" not in df.columns:
        return df
    return df.filter(F.col("updated_at") > watermark(ledger, table))


def ledger_row(result: DataFrame, table: str, direction: str, started_at, completed_at, state: str = "COMPLETED",
               error: str | None = None) -> DataFrame:
    """One ledger entry for a finished step over ``result``."""
    n = result.agg(F.count(F.lit(1)).alias("row_count"))
    started, completed = F.lit(started_at).cast("timestamp"), F.lit(completed_at).cast("timestamp")
    return n.select(
        F.md5(F.concat_ws("|", F.lit(table), F.lit(direction), started.cast("string"))).alias("operation_id"),
        F.lit(table).alias("table_name"), F.lit(direction).alias("direction"), "row_count",
        F.lit(state).alias("state"), started.alias("started_at"), completed.alias("completed_at"),
        F.lit(error).cast("string").alias("error_message"))


def schema_frame(spark, schema: T.StructType, prefix: str) -> DataFrame:
    rows = [(f.name.lower(), f.dataType.simpleString(), f.nullable) for f in schema.fields]
    return spark.createDataFrame(rows, f"column string, {prefix}_type string, {prefix}_nullable boolean")


def schema_diff(spark, actual: T.StructType, desired: T.StructType) -> DataFrame:
    """Columns that are missing, extra, of another type, or of another nullability.

    Types are compared without parameters (precision, length).
    """
    joined = schema_frame(spark, actual, "actual").join(schema_frame(spark, desired, "desired"), "column", "full")
    base = lambda c: F.regexp_replace(c, r"\(.*\)$", "")
    issue = (
        F.when(F.col("actual_type").isNull(), "missing")
        .when(F.col("desired_type").isNull(), "extra")
        .when(base("actual_type") != base("desired_type"), "type")
        .when(F.col("actual_nullable") & ~F.col("desired_nullable"), "nullability")
    )
    return joined.withColumn("issue", issue).filter(F.col("issue").isNotNull())


def evolve(df: DataFrame, desired: T.StructType, defaults: dict[str, object] | None = None,
           fillers: dict[str, Callable[[DataFrame], Column]] | None = None) -> DataFrame:
    """The frame in the desired schema: shared columns cast, new ones defaulted, others dropped, computed ones filled.

    A filler gives the value of a column where it is empty.
    """
    defaults, fillers = defaults or {}, fillers or {}
    have = {c.lower(): c for c in df.columns}
    out = []
    for field in desired.fields:
        source = have.get(field.name.lower())
        default = F.lit(defaults.get(field.name)).cast(field.dataType)
        value = default if source is None else F.col(source).try_cast(field.dataType)
        if source is not None and not field.nullable:
            value = F.coalesce(value, default)
        if field.name in fillers:
            empty = value.isNull()
            if isinstance(field.dataType, T.StringType):
                empty = empty | (value == "")
            value = F.when(empty, fillers[field.name](df)).otherwise(value)
        out.append(value.alias(field.name))
    return df.select(*out)


def dead_letters(bad: DataFrame, table: str, keys: Sequence[str], reason: Column) -> DataFrame:
    """Failed rows as letters: table, row id, the row as JSON (without bytes) and the reason.

    The row id is the keys joined by a bar, else ``id``, else ``rowid``, else a hash of the row.
    """
    plain = [f.name for f in bad.schema.fields if not isinstance(f.dataType, T.BinaryType)]
    body = F.to_json(F.struct(*[F.col(c) for c in plain]), {"ignoreNullFields": "false"})
    if keys and all(k in bad.columns for k in keys):
        row_id = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("None")) for k in keys])
    elif "id" in bad.columns:
        row_id = F.col("id").cast("string")
    elif "rowid" in bad.columns:
        row_id = F.col("rowid").cast("string")
    else:
        row_id = F.md5(F.to_json(F.struct(*[F.col(c) for c in sorted(plain)])))
    return bad.select(
        F.md5(F.concat_ws("|", F.lit(table), row_id, body)).alias("dlq_id"), F.lit(table).alias("table_name"),
        row_id.alias("row_id"), body.alias("row_data"), reason.alias("error_message"))


def sanitize(df: DataFrame) -> DataFrame:
    """Booleans as 0/1, NaN and infinities as null, decimals as doubles, day intervals as seconds."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.BooleanType):
            c = c.cast("int").cast("long")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def health(ledger: DataFrame, letters: DataFrame) -> DataFrame:
    """Dead letters and the end of the last completed sync, as one row."""
    last = ledger.filter("state = 'COMPLETED'").agg(F.max("completed_at")).scalar()
    return letters.agg(F.count(F.lit(1)).alias("dead_letters"), F.any_value(last).alias("last_sync"))


def delete_keys(df: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``keys_df``."""
    return df.join(under_keys(keys_df.select(*keys).distinct(), keys), same_key(keys), "left_anti")


