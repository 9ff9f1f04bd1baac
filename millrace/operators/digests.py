"""Two-sided difference by digests of key ranges.

Each side is written by ranges of its keys, with a digest of every range; nodes above the ranges have the sums of theirs.
Two sides are compared from the root down, and only rows of ranges that differ are read and joined.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators.sync import classify

#: Ranges of a node, and nodes below the root.
FAN = 16
#: Keys drawn for each range to find where it ends.
DRAWN = 20


def key_splits(df: DataFrame, keys: Sequence[str], fan: int = FAN) -> list[tuple]:
    """Where the ranges of keys end: ``fan * fan - 1`` keys at most, in order, from a draw by a hash.

    Both sides need the same; whichever side they are from, they change what is read and never the answer.
    """
    drawn = df.select(*keys).distinct().orderBy(F.xxhash64(*keys), *keys).limit(fan * fan * DRAWN)
    rows = [tuple(r) for r in drawn.orderBy(*keys).collect()]
    n = fan * fan
    return list(dict.fromkeys(rows[len(rows) * i // n] for i in range(1, n))) if rows else []


def _leafed(df: DataFrame, keys: Sequence[str], splits: list[tuple]) -> DataFrame:
    """``df`` with the number of the range of each key, ``_leaf``: how many splits are at or before it; null sorts first.

    Found by halves, one column for each step: a step is compiled, and a key is compared with one split in it.
    """
    kinds = [df.schema[k].dataType for k in keys]
    said = [F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(s, kinds))]) for s in splits]
    out = df.withColumn("_leaf", F.lit(0))
    if not said:
        return out
    out = out.withColumn("_own", F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]))
    for step in (1 << bit for bit in reversed(range(len(said).bit_length()))):
        # Beyond the last split there is null, which isn't passed.
        passed = F.get(F.array(*said), F.col("_leaf") + step - 1) <= F.col("_own")
        out = out.withColumn("_leaf", F.col("_leaf") + F.when(passed, step).otherwise(0))
    return out.drop("_own")


def write_side(df: DataFrame, keys: Sequence[str], splits: list[tuple], path: str) -> None:
    """Write a side (keys, content_hash, updated_at and what else it has) by key ranges, and its digests.

    A range's digest is the number of its rows and two sums of hashes of key, content hash and time, so that rows may come
    in any order and any number of times.
    """
    leafed = _leafed(df, keys, splits)
    df.sparkSession.createDataFrame([(leafed.schema.json(),)], "value string").write.text(f"{path}/columns")
    leafed.repartition("_leaf").write.partitionBy("_leaf").parquet(f"{path}/rows")
    parts = [F.struct(*keys), F.coalesce("content_hash", F.lit("")), F.col("updated_at").cast("timestamp")]
    hashes = {f"d{i}": F.sum(F.xxhash64(F.lit(i), *parts).cast("decimal(20,0)")) for i in (1, 2)}
    _rows(df.sparkSession, path).groupBy("_leaf").agg(
        F.count(F.lit(1)).alias("n"), *[h.alias(c) for c, h in hashes.items()]).write.parquet(f"{path}/digests")


def _rows(spark: SparkSession, path: str, leaves: list[int] | None = None) -> DataFrame:
    """Rows of a side, or of some of its ranges; a side may have none."""
    columns = StructType.fromJson(json.loads(spark.read.text(f"{path}/columns").first().value))
    rows = spark.read.schema(columns).parquet(f"{path}/rows")
    if leaves is None:
        return rows
    return rows.filter(F.col("_leaf").isin(*leaves) if leaves else F.lit(False)).drop("_leaf")


def unequal_leaves(spark: SparkSession, one: str, other: str, fan: int = FAN) -> tuple[list[int], int]:
    """Ranges whose digests differ, and the rows of those that don't; both sides have at most ``fan * fan`` digests."""
    sides = [{r["_leaf"]: (r["n"], r["d1"], r["d2"]) for r in spark.read.parquet(f"{p}/digests").collect()} for p in (one, other)]
    none = (0, 0, 0)

    def of_node(side: dict, node: int | None) -> tuple:
        held = [d for leaf, d in side.items() if node is None or leaf // fan == node]
        return tuple(map(sum, zip(*held))) if held else none

    found: list[int] = []
    if of_node(sides[0], None) != of_node(sides[1], None):
        for node in sorted({leaf // fan for s in sides for leaf in s}):
            if of_node(sides[0], node) != of_node(sides[1], node):
                found += [x for x in range(node * fan, node * fan + fan) if sides[0].get(x, none) != sides[1].get(x, none)]
    return found, sum(d[0] for leaf, d in sides[0].items() if leaf not in set(found))


def difference(spark: SparkSession, local: str, cloud: str, keys: Sequence[str], fan: int = FAN) -> DataFrame:
    """Keys that aren't identical on both sides (written by ``write_side`` with the same splits), as ``classify`` has them.

    Only files of ranges that differ are read.
    """
    leaves, _ = unequal_leaves(spark, local, cloud, fan)
    rows = [_rows(spark, p, leaves) for p in (local, cloud)]
    return classify(*rows, keys).filter("class <> 'identical'")


def summary(spark: SparkSession, local: str, cloud: str, keys: Sequence[str], fan: int = FAN) -> DataFrame:
    """Rows of each class; those of equal ranges are counted from the digests."""
    leaves, same = unequal_leaves(spark, local, cloud, fan)
    rows = [_rows(spark, p, leaves) for p in (local, cloud)]
    counts = classify(*rows, keys).groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    equal = spark.createDataFrame([("identical", same)], "class string, n long")
    return counts.unionByName(equal).groupBy("class").agg(F.sum("n").alias("n")).filter("n > 0")
