"""Queries over the two sides of a table."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import digests as D
from millrace.operators import sync as S
from millrace.queries.registry import query
from millrace.session import ensure_checkpoint_dir

SIDES = ["local_v", "cloud_v"]
BOTH = """
b AS (SELECT coalesce(l.id, c.id) AS id, l.id AS lid, c.id AS cid, l.content_hash AS lh, c.content_hash AS ch,
  l.status AS ls, c.status AS cs, l.updated_at AS lt, c.updated_at AS ct
  FROM local_v l FULL JOIN cloud_v c ON l.id = c.id),
k AS (SELECT *, CASE WHEN cid IS NULL THEN 'op_only' WHEN lid IS NULL THEN 'cloud_only'
  WHEN lh <> '' AND ch <> '' AND lh <> ch THEN 'conflict' WHEN lh <> '' AND ch <> '' AND lt <> ct THEN 'timestamp_drift'
  WHEN (lh = '' OR ch = '') AND lt <> ct THEN 'legacy_conflict' ELSE 'identical' END AS class FROM b)"""
TOTALS = BOTH + """,
t AS (SELECT CAST(count(*) FILTER (WHERE class = 'op_only') AS BIGINT) AS op_only, CAST(count(*) FILTER (WHERE class = 'cloud_only') AS BIGINT) AS cloud_only,
  CAST(count(*) FILTER (WHERE class IN ('conflict', 'legacy_conflict')) AS BIGINT) AS conflicts, CAST(count(*) AS BIGINT) AS total,
  CAST(count(*) FILTER (WHERE class = 'timestamp_drift' AND lt > ct) AS BIGINT) AS op_newer,
  CAST(count(*) FILTER (WHERE class = 'timestamp_drift' AND ct > lt) AS BIGINT) AS cloud_newer FROM k)"""


def _classes(v):
    return S.classify(v("local_v"), v("cloud_v"), ["id"])


@query("sync_hash", [], """
SELECT c_custkey, sha256(concat(CASE WHEN c_custkey = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END, '||', trim(c_name), '||',
  CASE WHEN c_nationkey = 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END, '||', trim(c_mktsegment))) AS row_hash FROM customer""")
def sync_hash(v):
    df = v("customer")
    return df.select("c_custkey", S.row_hash(df, ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]).alias("row_hash"))


@query("sync_backfill", ["cloud_v"], """
SELECT id, CASE WHEN content_hash = '' THEN sha256(concat(CASE WHEN id = 0 THEN '' ELSE CAST(id AS VARCHAR) END, '||', status)) ELSE content_hash END AS content_hash FROM cloud_v""")
def sync_backfill(v):
    return S.backfill_hash(v("cloud_v")).select("id", "content_hash")


@query("sync_backfill_count", ["cloud_v"], """
SELECT CAST(count(*) FILTER (WHERE content_hash = '') AS BIGINT) AS to_fill, CAST(count(*) AS BIGINT) AS total FROM cloud_v""")
def sync_backfill_count(v):
    return S.count_backfill(v("cloud_v"))


@query("sync_push", SIDES, f"""
WITH {BOTH.strip()} SELECT id, CASE WHEN cid IS NULL THEN 'missing' ELSE 'different' END AS reason FROM k
WHERE lid IS NOT NULL AND (cid IS NULL OR lh <> ch)""")
def sync_push(v):
    return S.to_push(v("local_v"), v("cloud_v"), ["id"])


@query("sync_pull", SIDES, f"""
WITH {BOTH.strip()} SELECT id, CASE WHEN lid IS NULL THEN 'missing' ELSE 'different' END AS reason FROM k
WHERE cid IS NOT NULL AND (lid IS NULL OR lh <> ch)""")
def sync_pull(v):
    return S.to_pull(v("local_v"), v("cloud_v"), ["id"])


@query("sync_classify", SIDES, f"WITH {BOTH.strip()} SELECT id, class FROM k")
def sync_classify(v):
    return _classes(v).select("id", "class")


def _digested(v) -> list[str]:
    """Both sides by ranges of a composite key, in folders of their own."""
    folder = f"{ensure_checkpoint_dir(v('local_v').sparkSession)}/digests-{uuid.uuid4().hex}"
    sides = [v(n).withColumn("tier", F.concat(F.lit("t"), F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(3)))) for n in SIDES]
    splits = D.key_splits(sides[0], ["tier", "id"])
    for name, side in zip(SIDES, sides):
        D.write_side(side, ["tier", "id"], splits, f"{folder}/{name}")
    return [f"{folder}/{n}" for n in SIDES]


@query("sync_difference", SIDES, f"WITH {BOTH.strip()} SELECT id, class FROM k WHERE class <> 'identical'")
def sync_difference(v):
    return D.difference(v("local_v").sparkSession, *_digested(v), ["tier", "id"]).select("id", "class")


@query("sync_difference_counts", SIDES, f"WITH {BOTH.strip()} SELECT class, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY class")
def sync_difference_counts(v):
    return D.summary(v("local_v").sparkSession, *_digested(v), ["tier", "id"])


@query("sync_summary", SIDES, f"""
WITH {BOTH.strip()} SELECT class, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE lt > ct) AS BIGINT) AS op_newer,
  CAST(count(*) FILTER (WHERE ct > lt) AS BIGINT) AS cloud_newer FROM k GROUP BY class""")
def sync_summary(v):
    return S.summary(_classes(v))


@query("sync_merge", SIDES, """
SELECT coalesce(l.id, c.id) AS id, CASE WHEN c.id IS NOT NULL THEN c.status ELSE l.status END AS status,
  CAST(coalesce(c.updated_at, l.updated_at) AS DATE) AS updated_on FROM local_v l FULL JOIN cloud_v c ON l.id = c.id""")
def sync_merge(v):
    cloud = v("cloud_v")
    older = cloud.withColumn("updated_at", F.col("updated_at") - F.expr("INTERVAL 400 DAYS")).withColumn("status", F.lit("old"))
    merged = S.merge(v("local_v"), cloud.unionByName(older), ["id"])
    return merged.select("id", "status", F.to_date("updated_at").alias("updated_on"))


@query("sync_resolve", SIDES, f"""
WITH {BOTH.strip()} SELECT id, class, CASE WHEN lt > ct THEN 'operational' WHEN ct > lt THEN 'cloud' ELSE 'manual' END AS verdict
FROM k WHERE class IN ('conflict', 'legacy_conflict')""")
def sync_resolve(v):
    return S.resolve(_classes(v), "newest_overall_wins").select("id", "class", "verdict")


@query("sync_recommend", SIDES, f"""
WITH {TOTALS.strip()} SELECT conflicts, cloud_only, total, round(conflicts * 100.0 / total, 4)::DOUBLE AS conflict_rate,
  CASE WHEN conflicts = 0 AND cloud_only = 0 THEN 'operational_wins' WHEN conflicts = 0 OR conflicts * 100.0 / total < 20 THEN 'newest_overall_wins' ELSE 'abort' END AS strategy,
  CASE WHEN conflicts = 0 AND cloud_only = 0 THEN 0.95 WHEN conflicts = 0 THEN 0.9 WHEN conflicts * 100.0 / total < 5 THEN 0.85 WHEN conflicts * 100.0 / total < 20 THEN 0.6 ELSE 0.9 END::DOUBLE AS confidence
FROM t""")
def sync_recommend(v):
    return S.recommend(S.summary(_classes(v)))


@query("sync_outcomes", SIDES, f"""
WITH {TOTALS.strip()}
SELECT 'operational_wins' AS strategy, op_only AS op_to_cloud, 0::BIGINT AS cloud_to_op, 0::BIGINT AS op_deletes, cloud_only AS cloud_deletes, conflicts AS conflict_op_wins, 0::BIGINT AS conflict_cloud_wins FROM t
UNION ALL SELECT 'cloud_wins', 0, cloud_only, op_only, 0, 0, 0 FROM t
UNION ALL SELECT 'newest_overall_wins', op_only, cloud_only, 0, 0, op_newer + greatest(0, conflicts - op_newer - cloud_newer), cloud_newer FROM t""")
def sync_outcomes(v):
    return S.outcomes(S.summary(_classes(v)))


for _name, _cond, _verdict in (
    ("operational_wins", "lid IS NOT NULL", "'keep'"),
    ("cloud_wins", "cid IS NOT NULL", "CASE WHEN class IN ('conflict', 'legacy_conflict') THEN 'replace' ELSE 'keep' END"),
    ("newest_overall_wins", "true",
     "CASE WHEN class NOT IN ('conflict', 'legacy_conflict') THEN 'keep' WHEN ct > lt THEN 'replace' WHEN lt > ct THEN 'keep' ELSE 'manual' END"),
):
    def _apply(v, strategy=_name):
        return S.apply_sync(v("local_v"), v("cloud_v"), ["id"], strategy).select("id", "status", "action")

    query("sync_apply" if _name == "newest_overall_wins" else f"sync_apply_{_name}", SIDES, f"""
WITH {BOTH.strip()}, a AS (SELECT *, CASE WHEN lid IS NULL THEN 'restore' ELSE {_verdict} END AS action FROM k WHERE {_cond})
SELECT id, CASE WHEN action IN ('restore', 'replace') THEN cs ELSE ls END AS status, action FROM a""")(_apply)


def _local_counts(v):
    return S.table_counts({"orders": v("local_v"), "customer": v("customer"), "part": v("part")})


def _cloud_counts(v):
    return S.table_counts({"orders": v("cloud_v"), "customer": v("customer"), "supplier": v("supplier")})


COUNTS = """
l AS (SELECT 'orders' AS table_name, count(*) AS n FROM local_v UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'part', count(*) FROM part),
c AS (SELECT 'orders' AS table_name, count(*) AS n FROM cloud_v UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier)"""


@query("sync_action", SIDES, f"""
WITH {COUNTS.strip()} SELECT CAST(sum(l.n) AS BIGINT) AS local_rows, CAST(sum(c.n) AS BIGINT) AS cloud_rows,
  CAST(count(*) FILTER (WHERE l.table_name IS NOT NULL AND l.n <> coalesce(c.n, 0)) AS BIGINT) AS diverged,
  CASE WHEN count(*) FILTER (WHERE l.table_name IS NOT NULL AND l.n <> coalesce(c.n, 0)) = 0 THEN 'skip' ELSE 'bidirectional' END AS action,
  CASE WHEN count(*) FILTER (WHERE l.table_name IS NOT NULL AND l.n <> coalesce(c.n, 0)) = 0 THEN 'operational_wins' ELSE 'newest_overall_wins' END AS strategy
FROM l FULL JOIN c ON l.table_name = c.table_name""")
def sync_action(v):
    return S.startup_action(_local_counts(v), _cloud_counts(v))


@query("sync_verify", SIDES, f"""
WITH {COUNTS.strip()} SELECT coalesce(l.table_name, c.table_name) AS table_name, CAST(coalesce(l.n, -1) AS BIGINT) AS local_rows,
  CAST(coalesce(c.n, -1) AS BIGINT) AS cloud_rows, coalesce(l.n, -1) = coalesce(c.n, -1) AS matches FROM l FULL JOIN c ON l.table_name = c.table_name""")
def sync_verify(v):
    return S.verify_counts(_local_counts(v), _cloud_counts(v))


# A ledger of past syncs: one entry for each customer segment and order year.
LEDGER = """
ledger AS (SELECT c_mktsegment AS table_name, CAST(COUNT(*) AS BIGINT) AS row_count,
  CASE WHEN min(o_orderstatus) = 'F' AND year(o_orderdate) < 1999 THEN 'COMPLETED' ELSE 'FAILED' END AS state, max(o_orderdate) AS completed_at
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, year(o_orderdate))"""


def _ledger(v):
    joined = v("orders").join(v("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_mktsegment").alias("table_name"), F.year("o_orderdate").alias("y")).agg(
        F.count(F.lit(1)).alias("row_count"), F.min("o_orderstatus").alias("_s"), F.max("o_orderdate").alias("completed_at"),
    ).withColumn("state", F.when((F.col("_s") == "F") & (F.col("y") < 1999), "COMPLETED").otherwise("FAILED"))


@query("sync_pending", ["local_v"], f"""
WITH {LEDGER.strip()} SELECT o_orderkey, o_orderdate FROM orders
WHERE o_orderdate > (SELECT coalesce(max(completed_at), TIMESTAMP '1970-01-01') FROM ledger WHERE state = 'COMPLETED' AND table_name IN ('BUILDING', 'ALL'))""")
def sync_pending(v):
    rows = v("orders").withColumnRenamed("o_orderdate", "updated_at")
    return S.pending(rows, _ledger(v), "BUILDING").select("o_orderkey", F.col("updated_at").alias("o_orderdate"))


@query("sync_ledger", SIDES, f"""
WITH {BOTH.strip()} SELECT md5('orders|LOCAL_TO_CLOUD|2024-03-01 00:00:00') AS operation_id, 'orders' AS table_name, 'LOCAL_TO_CLOUD' AS direction,
  CAST(count(*) AS BIGINT) AS row_count, 'COMPLETED' AS state FROM k WHERE lid IS NOT NULL AND (cid IS NULL OR lh <> ch)""")
def sync_ledger(v):
    moved = S.to_push(v("local_v"), v("cloud_v"), ["id"])
    return S.ledger_row(moved, "orders", "LOCAL_TO_CLOUD", "2024-03-01 00:00:00", "2024-03-01 00:05:00").select(
        "operation_id", "table_name", "direction", "row_count", "state")


@query("sync_dlq", [], """
SELECT 'lineitem' AS table_name, concat(l_orderkey, '|', l_linenumber) AS row_id, concat('{"l_orderkey":', l_orderkey, ',"l_linenumber":', l_linenumber, ',"l_returnflag":"', l_returnflag, '"}') AS row_data,
  concat('returned: ', l_returnflag) AS error_message FROM lineitem WHERE l_returnflag = 'R'""")
def sync_dlq(v):
    bad = v("lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_returnflag")
    letters = S.dead_letters(bad, "lineitem", ["l_orderkey", "l_linenumber"], F.concat(F.lit("returned: "), "l_returnflag"))
    return letters.drop("dlq_id")


@query("sync_sanitize", [], """
SELECT o_orderkey, CAST(o_orderstatus = 'F' AS BIGINT) AS finished, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_totalprice END AS price,
  CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS DOUBLE) AS cents FROM orders""")
def sync_sanitize(v):
    nan = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    return S.sanitize(v("orders").select(
        "o_orderkey", (F.col("o_orderstatus") == "F").alias("finished"), nan.alias("price"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").cast("decimal(20,0)").alias("cents")))


@query("sync_health", ["local_v"], f"""
WITH {LEDGER.strip()} SELECT (SELECT CAST(count(*) AS BIGINT) FROM lineitem WHERE l_returnflag = 'R') AS dead_letters,
  (SELECT max(completed_at) FROM ledger WHERE state = 'COMPLETED') AS last_sync""")
def sync_health(v):
    return S.health(_ledger(v), v("lineitem").filter("l_returnflag = 'R'"))


@query("sync_delete", [], "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def sync_delete(v):
    gone = v("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return S.delete_keys(v("orders").select("o_orderkey", "o_custkey"), gone, ["o_orderkey"])


@query("schema_diff", [], """
WITH kinds AS (SELECT * FROM (VALUES ('BIGINT', 'bigint'), ('VARCHAR', 'string')) t(k, ty)),
a AS (SELECT CASE column_name WHEN 'n_chars' THEN 'role' ELSE column_name END AS c, ty FROM (DESCRIBE documents) JOIN kinds ON k = column_type),
d AS (SELECT column_name AS c, ty FROM (DESCRIBE conversations) JOIN kinds ON k = column_type),
n AS (SELECT 'doc_id' AS c, count(doc_id) AS n FROM documents UNION ALL SELECT 'text', count(text) FROM documents UNION ALL SELECT 'lang', count(lang) FROM documents
  UNION ALL SELECT 'source', count(source) FROM documents UNION ALL SELECT 'role', count(n_chars) FROM documents)
SELECT coalesce(a.c, d.c) AS "column", a.ty AS actual_type, d.ty AS desired_type, CASE WHEN a.c IS NULL THEN 'missing' WHEN d.c IS NULL THEN 'extra' ELSE 'type' END AS issue,
  CAST(coalesce(n.n, 0) AS BIGINT) AS n_values
FROM a FULL JOIN d ON a.c = d.c LEFT JOIN n ON n.c = a.c WHERE a.c IS NULL OR d.c IS NULL OR a.ty <> d.ty""")
def schema_diff(v):
    actual = v("documents").withColumnRenamed("n_chars", "role")
    counts = actual.agg(*[F.count(c).alias(c) for c in actual.columns])
    held = counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_values")) for c in actual.columns])))
    issues = S.schema_diff(actual.sparkSession, actual.schema, v("conversations").schema)
    return issues.join(held, "column", "left").select(
        "column", "actual_type", "desired_type", "issue", F.coalesce("n_values", F.lit(0).cast("long")).alias("n_values"))


@query("schema_evolve", [], """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS INT) AS o_custkey, 'web' AS channel, CAST(1 AS BIGINT) AS batch,
  sha256(concat(CASE WHEN o_orderkey = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END, '||', o_orderstatus)) AS content_hash FROM orders""")
def schema_evolve(v):
    desired = T.StructType([
        T.StructField("o_orderkey", T.StringType()), T.StructField("o_custkey", T.IntegerType()), T.StructField("channel", T.StringType()),
        T.StructField("batch", T.LongType()), T.StructField("content_hash", T.StringType())])
    return S.evolve(v("orders"), desired, {"channel": "web", "batch": 1}, {"content_hash": lambda d: S.row_hash(d, ["o_orderkey", "o_orderstatus"])})
