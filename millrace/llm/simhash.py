"""Near-duplicates by SimHash fingerprints and BK-trees.

Fingerprints that differ in at most `radius` of 64 bits agree on all but `radius` of the parts that the bits are cut into.
Each set of parts that may agree is a table, and fingerprints that agree on a set meet in a shard.  A shard is a BK-tree,
the children of a node keyed by their Hamming distance to it, and a search follows only the edges within the radius.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.chunks import by_volume
from millrace.llm.common import cut, free_name, named
from millrace.llm.components import components

BITS = 64
RADIUS = 3
#: Parts that the bits are cut into: sets of PARTS - RADIUS of them agree, here 2 of 5, in 10 tables.
PARTS = 5
SHINGLE = 3
SEED = 42
#: Shingles that are hashed before their bits are counted.
_BATCH = 1 << 14


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text with A-Z in lower case: a bit is set if it is in over half the hashes of the shingles."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = min(shingle, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes).tolist()
    stops = (ends - 1).tolist()[size - 1:]
    counts = np.zeros(BITS, np.int64)
    total = len(stops)
    for at in range(0, total, _BATCH):
        hashes = [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[at:at + _BATCH], stops[at:at + _BATCH])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


class Tree:
    """A BK-tree over whole numbers under the Hamming distance, from which found nodes are taken out.

    Taken nodes still lead to their children; branches without a node left are not entered any more.  So a search costs
    what is left to find near it, and a dense group is found once instead of once for each of its members.
    """

    def __init__(self, values: Iterable[int]):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.parent: list[int] = []
        for v in values:
            self._add(v)
        self.here = [True] * len(self.values)
        self.left = [1] * len(self.values)  # nodes left at and below a node
        for i in range(len(self.values) - 1, 0, -1):
            self.left[self.parent[i]] += self.left[i]

    def _add(self, value: int) -> None:
        node, new = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        self.parent.append(-1)
        if not new:
            return
        while True:
            d = (value ^ self.values[node]).bit_count()
            below = self.children[node].get(d)
            if below is None:
                self.children[node][d] = new
                self.parent[new] = node
                return
            node = below

    def take(self, node: int) -> None:
        self.here[node] = False
        while node >= 0:
            self.left[node] -= 1
            node = self.parent[node]

    def near(self, value: int, radius: int) -> list[int]:
        """Nodes left within the radius."""
        found, stack = [], [0] if self.values and self.left[0] else []
        while stack:
            node = stack.pop()
            d = (value ^ self.values[node]).bit_count()
            if d <= radius and self.here[node]:
                found.append(node)
            for edge, child in self.children[node].items():
                if d - radius <= edge <= d + radius and self.left[child]:
                    stack.append(child)
        return found


def linked(values: list[int], radius: int = RADIUS) -> Iterator[tuple[int, int]]:
    """Positions (member, first) of values that chains of links within the radius connect, each member once."""
    tree = Tree(values)
    for first in range(len(values)):
        if not tree.here[first]:
            continue
        tree.take(first)
        reached = [first]
        while reached:
            for node in tree.near(values[reached.pop()], radius):
                tree.take(node)
                reached.append(node)
                yield node, first


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """`doc_id, fp` of every row, the 64 bits as a long.  Null, empty and blank texts have the fingerprint 0."""
    return with_fingerprint(named(docs, doc_id=doc_id, text=text), "fp", shingle).select("doc_id", "fp")


def with_fingerprint(docs: DataFrame, into: str, shingle: int = SHINGLE) -> DataFrame:
    """All rows and columns of `docs` and the fingerprint of `text`, in column `into`."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at = docs.columns.index("text")
    names = [*docs.columns, into]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            found: list[int] = []
            for first, last in by_volume(texts):
                found += [fingerprint(t.encode(), shingle) if t else 0 for t in texts.slice(first, last - first).to_pylist()]
            bits = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, bits], names)

    return docs.mapInArrow(run, f"{kinds}, `{into}` long")


def _tables(parts: int, radius: int) -> list[int]:
    """A mask of bits for each set of parts that may agree."""
    edges = [round(i * BITS / parts) for i in range(parts + 1)]
    of_part = [((1 << (b - a)) - 1) << a for a, b in zip(edges[:-1], edges[1:])]
    return [sum(of_part[i] for i in kept) for kept in combinations(range(parts), parts - radius)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def near_duplicates(found: DataFrame, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """`doc_id, fp, component_id, component_fp` of fingerprinted rows `doc_id, fp`, linked at `radius` or fewer bits.

    `component_id` is the smallest doc_id that links reach, the row's own included; null where all of them are null.
    `component_fp` is the fingerprint of that document, so that both name a component even then.
    Equal fingerprints, of copies or of empty texts, are one class before anything else is done, so a group of copies
    costs one row; repeated rows stay.  No link between classes is lost: two of them that are near enough meet in at least
    one table.  Shards are searched where the shuffle puts them; they are not broadcast, as they grow with the corpus.
    """
    rows = cut(found.select("doc_id", "fp"))
    # Classes are compared by their smallest id, null last, then by fingerprint, so that the smallest has the smallest id.
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first"))).select(
        "fp", F.struct(F.col("first").isNull().alias("none"), "first", "fp").alias("v"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    vertex = f"struct<none:boolean,first:{id_type},fp:bigint>"
    keys: list[Column] = [
        F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key"))
        for i, mask in enumerate(_tables(parts, radius))]
    meeting = classes.select("v", F.explode(F.array(*keys)).alias("shard")).select("v", "shard.table", "shard.key")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v_type, out = None, []

        def rows_of() -> Iterator[tuple]:
            nonlocal v_type
            for b in batches:
                v_type = b.schema.field("v").type
                yield from zip(b.column("table").to_pylist(), b.column("key").to_pylist(), b.column("v").to_pylist())

        for _, shard in groupby(rows_of(), key=lambda r: r[:2]):
            members = [r[2] for r in shard]
            if len(members) > 1:
                # Sorted by the smallest id, so the first of a group is its smallest.
                out += [(members[a], members[b]) for a, b in linked([m["fp"] & (1 << 64) - 1 for m in members], radius)]
            if len(out) >= 10_000:
                yield _pairs(out, v_type)
                out = []
        if out:
            yield _pairs(out, v_type)

    links = meeting.repartition("table", "key").sortWithinPartitions("table", "key", "v").mapInArrow(
        search, f"v {vertex}, u {vertex}")
    labels = components(links)
    named_classes = classes.join(labels, "v", "left").select(
        F.col("fp").alias("class_fp"), F.coalesce("label", "v").alias("head")).select(
        "class_fp", F.col("head.first").alias("component_id"), F.col("head.fp").alias("component_fp"))
    # Both sides are plain frames, so that adaptive execution can split a class of very many rows.
    return rows.join(cut(named_classes), F.col("fp") == F.col("class_fp")).select("doc_id", "fp", "component_id", "component_fp")


def _pairs(out: list[tuple], v_type: pa.DataType) -> pa.RecordBatch:
    v, u = zip(*out)
    return pa.RecordBatch.from_arrays([pa.array(v, v_type), pa.array(u, v_type)], ["v", "u"])


def one_of_each(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: that of the smallest doc_id, null last.

    Rows that repeat both id and fingerprint are one document, of which one row stays, any of them.
    """
    fp_name, key_name = free_name(docs, "near_fp"), free_name(docs, "near_key")
    grouped = near_duplicates(fingerprints(docs, shingle=shingle), radius)
    key = lambda doc_id, fp: F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.col(fp))
    heads = grouped.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("fp") == F.col("component_fp"))).select(
        key("doc_id", "fp").alias(key_name)).distinct()
    marked = with_fingerprint(docs, fp_name, shingle).withColumn(key_name, key("doc_id", fp_name))
    return marked.join(heads, key_name, "left_semi").dropDuplicates([key_name]).select(
        *[F.col(f"`{c}`") for c in docs.columns])
