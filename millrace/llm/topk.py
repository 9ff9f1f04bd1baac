"""Exact top-k search by inner product with a three-phase uniform threshold.

The dimensions are parted into lists.  Phase 1: every task gives the best entries of each of its lists, with their whole
scores; the k-th best of these is a score that the answer reaches for certain.  Phase 2: this cutoff goes out to all
tasks.  An entry whose score reaches it must reach an equal share of it in at least one list, so tasks collect only those
that do.  Phase 3: the whole scores of these entries are worked out exactly and ranked.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut, named

LISTS = 2
#: Distinct query vectors that travel to the tasks at once.
BLOCK = 2048
#: Numbers of a tile of scores, which bounds what a task holds.
_TILE = 1 << 21
_EXACT = float(1 << 53)
#: Range of a long.
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def whole_numbers(vectors: DataFrame, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """`vec_id, v`: components as floor(scale * x), x as double; whole numbers as double, since they may pass a long.  Only
    vectors that are null or hold a null or non-finite component are left out."""
    rows = named(vectors, vec_id=vec_id, embedding=embedding)
    x = F.transform("embedding", lambda e: e.cast("double"))
    fine = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    # From 2^52 on a double has no fraction.
    whole = lambda y: F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)
    return rows.select("vec_id", x.alias("x")).where(F.col("x").isNotNull() & F.coalesce(fine, F.lit(False))).select(
        "vec_id", F.transform("x", lambda e: whole(e * scale)).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), dims)


def _integers(a: np.ndarray) -> np.ndarray:
    """Whole numbers as Python's integers."""
    return np.array([int(x) for x in a.ravel()], object).reshape(a.shape)


def _products(a: np.ndarray, b: np.ndarray, parts: list[slice]) -> list[np.ndarray]:
    """Inner products of whole numbers by parts, exact: as floats where no sum can pass 2^53, else as Python's integers."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] >= _EXACT:
        a, b = _integers(a), _integers(b)
    return [a[:, s] @ b[:, s].T for s in parts]


def _parts(dims: int) -> list[slice]:
    edges = np.linspace(0, dims, min(LISTS, max(1, dims)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]


def _tiles(batches: Iterable[pa.RecordBatch], queries: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Class numbers and vectors of equal length, in pieces whose scores against the queries fit a tile."""
    for batch in batches:
        column = batch.column("v")
        sizes = np.asarray(column.value_lengths())
        for dims in np.unique(sizes):
            if int(dims) not in queries:
                continue
            at = np.flatnonzero(sizes == dims)
            step = max(1, _TILE // max(1, len(queries[int(dims)][0])))
            for i in range(0, len(at), step):
                rows = at[i:i + step]
                taken = batch.take(pa.array(rows))
                yield taken.column("cls").to_numpy(), _matrix(taken.column("v"), int(dims)), int(dims)


def _out(q: list, cls: list, score: list) -> pa.RecordBatch:
    scores = [int(s) for part in score for s in part]
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate(q), pa.int64()), pa.array(np.concatenate(cls), pa.int64()),
        pa.array([max(_LEAST, min(_MOST, s)) for s in scores], pa.int64()), pa.array([not _LEAST <= s <= _MOST for s in scores], pa.bool_()),
    ], ["q", "cls", "score", "beyond"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, block: int = BLOCK) -> DataFrame:
    """`query_id, rank, vec_id, score`: the `k` highest inner products of each query with all rows but itself.

    `vectors` has `vec_id, v` (array of whole numbers, as long or double); rows where `is_query` holds are the queries.  Ties go to the smaller
    vec_id; a null vec_id comes first and is no query.  A query meets vectors of its own length only.  Fewer other rows
    give fewer results, no rows none.  Rows that repeat an id are rows of their own, but none is a result for the id.
    A result with a score beyond a long is an error.

    Equal vectors score alike, so they are one class; of its ids only the `k + 1` smallest can be in any answer.  The
    search runs over classes.  Query classes travel in blocks of at most `block`, one after the other, each written to
    the checkpoint folder as it ends.
    """
    by_vector = Window.partitionBy("v").orderBy(F.asc_nulls_first("vec_id"))
    smallest = vectors.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)
    # Numbered after they are written: reading them again gives the same numbers.
    members = cut(smallest.groupBy("v").agg(F.collect_list(F.struct("vec_id")).alias("ids"))).withColumn(
        "cls", F.monotonically_increasing_id())
    classes = members.select("cls", "v")
    asked = cut(vectors.where(is_query & F.col("vec_id").isNotNull()).select("v", F.col("vec_id").alias("query_id")))
    query_classes = cut(asked.select("v").distinct()).withColumn("q", F.monotonically_increasing_id())
    blocks = max(1, -(-query_classes.count() // block))
    found = None
    for b in range(blocks):
        # At most about `block` vectors, by a hash.
        rows = query_classes.where(F.pmod(F.xxhash64(F.lit("block"), "v"), F.lit(blocks)) == b).toPandas() if blocks > 1 else query_classes.toPandas()
        part = cut(_search(classes, rows, k))
        found = part if found is None else found.unionByName(part)
    listed = found.join(members.select("cls", "ids"), "cls").select(
        "q", "score", "beyond", F.explode("ids").alias("id")).select("q", "score", "beyond", "id.vec_id")
    pairs = asked.join(query_classes, "v").select("q", "query_id").join(listed, "q").where(~F.col("vec_id").eqNullSafe(F.col("query_id")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_first("vec_id"))
    score = F.when(F.col("beyond"), F.raise_error(F.lit("a score is beyond a long")).cast("long")).otherwise(F.col("score"))
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", score.alias("score"))


def _search(classes: DataFrame, rows, k: int) -> DataFrame:
    """Rows (q, cls, score, beyond) that hold the `k + 1` best classes of each query of a block; scores
    `beyond` a long are cut to it, which keeps their order towards all others."""
    spark = classes.sparkSession
    queries: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    sizes = rows["v"].map(len).to_numpy(dtype=np.int64) if len(rows) else np.zeros(0, np.int64)
    for dims in np.unique(sizes):
        at = np.flatnonzero(sizes == dims)
        stacked = np.array([np.asarray(v, np.float64) for v in rows["v"].iloc[at]]).reshape(len(at), int(dims))
        queries[int(dims)] = (rows["q"].to_numpy()[at], stacked)
    sent = spark.sparkContext.broadcast(queries)
    keep = k + 1  # the query's own class may hold the query alone
    schema = "q long, cls long, score long, beyond boolean"

    def local_lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for cls, matrix, dims in _tiles(batches, sent.value):
            names, asked = sent.value[dims]
            partial = _products(matrix, asked, _parts(dims))
            total = sum(partial)
            rows_of = [np.argpartition(-p.astype(np.float64), keep - 1, axis=0)[:keep] if len(cls) > keep else
                       np.repeat(np.arange(len(cls))[:, None], len(names), 1) for p in partial]
            at = np.concatenate(rows_of)
            cols = np.arange(len(names))
            entry, score = cls[at], total[at, cols]
            if dims in best:
                entry, score = np.concatenate([best[dims][0], entry]), np.concatenate([best[dims][1], score])
            # The same entry may lead several lists; it counts once.
            order = np.lexsort((entry, -score.astype(np.float64)), axis=0) if score.dtype != object else np.argsort(-score, axis=0, kind="stable")
            entry, score = np.take_along_axis(entry, order, 0), np.take_along_axis(score, order, 0)
            fill = entry[:2 * keep * len(partial)], score[:2 * keep * len(partial)]
            best[dims] = fill
        for dims, (entry, score) in best.items():
            names = sent.value[dims][0]
            q = np.repeat(names[None, :], len(entry), 0)
            yield _out([q.ravel()], [entry.ravel()], [score.ravel()])

    first = classes.mapInArrow(local_lists, schema).distinct()
    ranked = Window.partitionBy("q").orderBy(F.desc("score"))
    floor = first.withColumn("n", F.row_number().over(ranked)).where(F.col("n") == keep).select("q", "score").toPandas()
    # A score cut to the least long says nothing of how low it is.
    cutoff = {q: s for q, s in zip(floor["q"], floor["score"]) if s > _LEAST}
    cuts = {dims: np.array([cutoff.get(q, -np.inf) for q in names], np.float64) for dims, (names, _) in queries.items()}
    sent_cuts = spark.sparkContext.broadcast(cuts)

    def sufficient(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cls, matrix, dims in _tiles(batches, sent.value):
            names, asked = sent.value[dims]
            least = sent_cuts.value[dims]
            parts = _parts(dims)
            partial = _products(matrix, asked, parts)
            # A float cutoff may round up by its last bit; the share is taken a little lower.
            share = (least - np.abs(least) * 1e-12) / len(parts)
            held = np.zeros(partial[0].shape, bool)
            for p in partial:
                held |= p >= share
            i, j = np.nonzero(held)
            score = sum(p[i, j] for p in partial)
            enough = score >= least[j] - np.abs(least[j]) * 1e-12
            if enough.any():
                yield _out([names[j[enough]]], [cls[i[enough]]], [score[enough]])

    return classes.mapInArrow(sufficient, schema)
