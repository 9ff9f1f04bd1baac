"""Vector codes: product quantisation over Hilbert-sorted blocks.

Vectors are cut into parts.  The parts at a position are sorted along a Hilbert curve and cut into flat blocks, each with
its members, the box around them and their sum.  In a round the distances of a block's box to the entries of the codebook
leave a shortlist: an entry that is farther from the whole box than another one is at most can't be nearest to any member.
A block with one entry left gives its count and sum at once, the others compare members with their shortlist only, in
whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, named

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Members of a block.
BLOCK = 128
#: Bits of the place on the curve.
_KEY_BITS = 64
#: Vectors that a task turns into parts at once.
_STEP = 4096
_SMALL, _LONG = 2.0**53, 2.0**63
#: A component past this is an error: its sums would pass the 38 digits that Spark adds up.
_MOST = 2.0**100


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places (unsigned 64 bits) of points on the Hilbert curve, from whole coordinates of `bits` bits, one row a point."""
    x = cells.astype(np.uint64).T.copy()
    dims, one = len(x), np.uint64(1)
    # From the outermost bit inwards each cube is turned as the curve enters it.
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        low = q - one
        for i in range(dims):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        turn = np.where((x[-1] & q) != 0, turn ^ (q - one), turn)
    x ^= turn
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            place = (place << one) | ((x[i] >> np.uint64(b)) & one)
    return place


def _numbers(a: np.ndarray) -> np.ndarray:
    """Whole numbers as Python's integers."""
    return np.array([int(x) for x in a.ravel()], object).reshape(a.shape)


def _exact(most: float, dims: int, *arrays: np.ndarray) -> list[np.ndarray]:
    """Arrays of whole numbers up to `most` in the smallest kind in which sums of squared differences are exact."""
    room = 4.0 * max(dims, 1) * most * most
    if room < _SMALL:
        return [a.astype(np.float64) for a in arrays]
    if room < _LONG:
        return [a.astype(np.int64) for a in arrays]
    return [a if a.dtype == object else _numbers(a) for a in arrays]


def _largest(*arrays: np.ndarray) -> float:
    return max((float(np.abs(a).max()) for a in arrays if a.size), default=0.0)


def shortlist(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Entries, ascending, that may be nearest to a point of the box."""
    if not len(low):
        return np.zeros(1, np.int64)
    low, high, entries = _exact(_largest(low, high, entries), len(low), low, high, entries)
    below, above = low - entries, entries - high
    least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=1)
    most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(axis=1)
    return np.flatnonzero(least <= most.min())


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each point, of equally near ones the first, and the squared distance, exact."""
    dims = points.shape[1]
    points, entries = _exact(_largest(points, entries), dims, points, entries)
    if points.dtype == np.float64:
        # Every term stays below 2^53, so the products are exact.
        far = (points**2).sum(axis=1)[:, None] + (entries**2).sum(axis=1) - 2 * (points @ entries.T)
        code = far.argmin(axis=1)
        return code, far[np.arange(len(code)), code].astype(np.int64)
    code, best = np.zeros(len(points), np.int64), None
    for i, e in enumerate(entries):
        far = ((points - e) ** 2).sum(axis=1)
        if best is None:
            best = far
        else:
            closer = far < best
            code[closer], best[closer] = i, far[closer]
    return code, best


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers as 32 bits each, as doubles if one doesn't fit."""
    return values.astype("<i4").tobytes() if _largest(values) < 2**31 else values.astype("<f8").tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<i4" if len(data) == 4 * n else "<f8").astype(np.float64)


def _edges(dims: int, parts: int) -> list[tuple[int, int]]:
    cuts = [dims * i // parts for i in range(parts + 1)]
    return list(zip(cuts[:-1], cuts[1:]))


def _kept(vectors: DataFrame, scale: int, vec_id: str, embedding: str, label: str) -> DataFrame:
    """`row, vec_id, label, dims, v` of rows whose vector is whole; `v` holds floor(scale * x), packed."""
    rows = named(vectors, vec_id=vec_id, embedding=embedding, label=label)
    x = F.transform("embedding", lambda e: e.cast("double"))
    fine = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    sound = rows.select("vec_id", "label", x.alias("x")).where(F.col("x").isNotNull() & F.coalesce(fine, F.lit(False)))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("x")
            flat = np.floor(column.flatten().to_numpy(zero_copy_only=False) * scale)
            if _largest(flat) > _MOST:
                raise ValueError("a component is too large for exact sums")
            ends = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths(), np.int64))])
            packed = [_pack(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(np.diff(ends), pa.int32()), pa.array(packed, pa.binary())],
                ["vec_id", "label", "dims", "v"])

    # Numbered after they are written: reading them again gives the same numbers.
    return cut(sound.mapInArrow(run, f"vec_id {kinds[0]}, label {kinds[1]}, dims int, v binary")).withColumn("row", F.monotonically_increasing_id())


def blocks_of(rows: DataFrame, dims: int, parts: int, samples: np.ndarray, block: int = BLOCK) -> DataFrame:
    """`part, n, low, high, total, members, v`: the parts of vectors (`row, v`) in Hilbert order, cut into flat blocks.

    The curve runs over cells between the 5th and the 95th hundredth of `samples`; these decide speed alone.  Equal parts,
    however many, are dealt over ranges by their row.
    """
    spans = []
    for a, b in _edges(dims, parts):
        used = min(b - a, _KEY_BITS)  # more dimensions than bits add nothing to the order
        bits = max(1, min(8, _KEY_BITS // max(used, 1)))
        low, high = np.quantile(samples[:, a:a + used], [0.05, 0.95], axis=0) if used else (np.zeros(0), np.zeros(0))
        spans.append((a, b, used, bits, low, np.maximum(high - low, 1e-9)))

    def cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), _STEP):
                batch = whole.slice(at, _STEP)
                matrix = np.array([_unpack(v, dims) for v in batch.column("v").to_pylist()]).reshape(len(batch), dims)
                for part, (a, b, used, bits, low, width) in enumerate(spans):
                    cell = np.clip((matrix[:, a:a + used] - low) / width * 2**bits, 0, 2**bits - 1).astype(np.uint64)
                    place = hilbert(cell, bits) if used else np.zeros(len(batch), np.uint64)
                    signed = (place ^ np.uint64(1 << 63)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(batch), part), pa.int32()), pa.array(signed), batch.column("row"),
                        pa.array([_pack(x) for x in matrix[:, a:b]], pa.binary())], ["part", "place", "row", "v"])

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, members, held = None, [], []

        def flat() -> pa.RecordBatch:
            a, b = _edges(dims, parts)[part]
            matrix = np.array([_unpack(v, b - a) for v in held]).reshape(len(held), b - a)
            total = _exact(_largest(matrix) * len(held), 1, matrix)[0].sum(axis=0)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([len(held)], pa.int32()),
                *[pa.array([x.astype("<f8").tobytes()], pa.binary()) for x in (matrix.min(axis=0), matrix.max(axis=0))],
                pa.array([[str(int(x)) for x in total]], pa.list_(pa.string())),
                pa.array([np.array(members, "<i8").tobytes()], pa.binary()), pa.array([_pack(matrix)], pa.binary()),
            ], ["part", "n", "low", "high", "total", "members", "v"])

        for batch in batches:
            for p, row, v in zip(batch.column("part").to_pylist(), batch.column("row").to_pylist(), batch.column("v").to_pylist()):
                if held and (p != part or len(held) >= block):
                    yield flat()
                    members, held = [], []
                part = p
                members.append(row)
                held.append(v)
        if held:
            yield flat()

    sorted_parts = rows.select("row", "v").mapInArrow(cells, "part int, place long, row long, v binary").repartitionByRange(
        "part", "place", "row").sortWithinPartitions("part", "place", "row")
    return cut(sorted_parts.mapInArrow(gather, "part int, n int, low binary, high binary, total array<string>, members binary, v binary"))


def _members(batch: pa.RecordBatch, dims: int, parts: int, books: list[np.ndarray]):
    """Of every block: its row of the batch, part, shortlist, and members and their parts."""
    edges = _edges(dims, parts)
    for i, part in enumerate(batch.column("part").to_pylist()):
        a, b = edges[part]
        low, high = (np.frombuffer(batch.column(c)[i].as_py(), "<f8") for c in ("low", "high"))
        n = batch.column("n")[i].as_py()
        yield i, part, shortlist(low, high, books[part]), n, lambda: _unpack(batch.column("v")[i].as_py(), n * (b - a)).reshape(n, b - a)


def _next_books(blocks: DataFrame, dims: int, parts: int, books: list[np.ndarray]) -> list[np.ndarray]:
    """Entries after one round: the floor of the mean of what is nearest to them, or as they were."""
    sent = blocks.sparkSession.sparkContext.broadcast(books)
    most = max(b - a for a, b in _edges(dims, parts))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            for i, part, few, n, points in _members(batch, dims, parts, sent.value):
                if len(few) == 1:
                    groups = [(int(few[0]), n, [int(x) for x in batch.column("total")[i].as_py()])]
                else:
                    matrix = points()
                    code, _ = nearest(matrix, sent.value[part][few])
                    order = np.argsort(code, kind="stable")
                    used, starts, counts = np.unique(code[order], return_index=True, return_counts=True)
                    whole = _exact(_largest(matrix) * n, 1, matrix)[0][order]
                    totals = np.add.reduceat(whole, starts, axis=0) if whole.shape[1] else np.zeros((len(used), 0))
                    groups = [(int(few[c]), int(k), [int(x) for x in t]) for c, k, t in zip(used, counts, totals)]
                for entry, k, total in groups:
                    old = sums.get((part, entry))
                    sums[part, entry] = [k, total] if old is None else [old[0] + k, [x + y for x, y in zip(old[1], total)]]
        if sums:
            keys = sorted(sums)
            yield pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
                pa.array([sums[k][0] for k in keys], pa.int64()),
                pa.array([[str(x) for x in sums[k][1]] for k in keys], pa.list_(pa.string())),
            ], ["part", "entry", "n", "total"])

    found = blocks.mapInArrow(run, "part int, entry int, n long, total array<string>").groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(i)).cast("decimal(38,0)")) for i in range(most)]).alias("total"))
    new = [b.copy() for b in books]
    for row in found.collect():  # at most as many rows as the codebooks have entries
        at = new[row["part"]]
        mean = np.array([int(x) // row["n"] for x in row["total"][:at.shape[1]]], object)
        if at.dtype != object and _largest(mean) >= _SMALL:
            at = new[row["part"]] = _numbers(at)
        at[row["entry"]] = mean if at.dtype == object else mean.astype(np.float64)
    return new


def _coded(blocks: DataFrame, dims: int, parts: int, books: list[np.ndarray]) -> DataFrame:
    """`row, part, code, far` of every part: its nearest entry and the squared distance."""
    sent = blocks.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, part, few, n, points in _members(batch, dims, parts, sent.value):
                code, far = nearest(points(), sent.value[part][few])
                members = np.frombuffer(batch.column("members")[i].as_py(), "<i8")
                yield pa.RecordBatch.from_arrays([
                    pa.array(members), pa.array(np.full(n, part), pa.int32()), pa.array(few[code], pa.int32()),
                    pa.array([int(x) for x in far], pa.int64())], ["row", "part", "code", "far"])

    return blocks.mapInArrow(run, "row long, part int, code int, far long")


def compress(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", block: int = BLOCK) -> DataFrame:
    """`vec_id, label, codes, error, books_sha256` of every row with a whole vector: its codes by part (array of int), the
    squared distance to the entries they name, and the digest of the codebooks.

    Components are floor(scale * x).  A vector is cut into `parts` consecutive parts, equal ones if its length allows, else
    as equal as may be.  The codebook of a position starts as that part of the vectors with the `entries` smallest ids, null
    last, equal ids by their components; `rounds` times every part goes to the nearest entry, equally near ones to the lower
    index, and every entry that has parts becomes the floor of their mean.  Fewer rows give fewer entries.  Rows that
    repeat an id, or all columns, are rows of their own.  Vectors that are null, or hold a null or a number that is not
    finite, give no row; empty vectors have the code 0 everywhere.  Vectors of different lengths have codebooks of their own.
    All numbers are whole and exact whatever their size; an error beyond a long, or a component beyond 2^100, is an error.

    What goes through the driver: `entries` vectors, and of each round the codebooks.
    """
    rows = _kept(vectors, scale, vec_id, embedding, label)
    sizes = sorted(r[0] for r in rows.select("dims").distinct().collect())
    found = [_compress(rows.where(F.col("dims") == d), d, parts, entries, rounds, block) for d in sizes]
    if not found:
        return rows.select("vec_id", "label", F.array(F.lit(0)).alias("codes"), F.lit(0).cast("long").alias("error"), F.lit("").alias("books_sha256"))
    return reduce(DataFrame.unionByName, found)


def _compress(rows: DataFrame, dims: int, parts: int, entries: int, rounds: int, block: int) -> DataFrame:
    firsts = [_unpack(r["v"], dims) for r in rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()]
    start = np.array(firsts).reshape(len(firsts), dims)
    books = [start[:, a:b].copy() for a, b in _edges(dims, parts)]
    blocks = blocks_of(rows, dims, parts, start, block)
    for _ in range(rounds):
        books = _next_books(blocks, dims, parts, books)
    digest = hashlib.sha256(",".join(str(int(x)) for book in books for entry in book for x in entry).encode()).hexdigest()
    # Names and codes of a row meet in one shuffle of small rows.
    coded = _coded(blocks, dims, parts, books).select(
        "row", F.lit(None).cast(rows.schema["vec_id"].dataType).alias("vec_id"), F.lit(None).cast(rows.schema["label"].dataType).alias("label"),
        "part", "code", "far")
    own = rows.select("row", "vec_id", "label", F.lit(-1).alias("part"), F.lit(0).alias("code"), F.lit(0).cast("long").alias("far"))
    of = lambda c, p: F.max(F.when(F.col("part") == p, F.col(c)))
    return coded.unionByName(own).groupBy("row").agg(
        of("vec_id", -1).alias("vec_id"), of("label", -1).alias("label"),
        F.array(*[of("code", p) for p in range(parts)]).alias("codes"), F.sum("far").alias("error"),
    ).select("vec_id", "label", "codes", "error", F.lit(digest).alias("books_sha256"))
