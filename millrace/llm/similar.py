"""Near-duplicate texts by word shingles: SimHash trees find them, an exact check of similarity decides.

Two texts are linked if the sets of their shingles of five words have a Jaccard similarity of 0.8 or more.  Fingerprints of
such texts may differ in a third of their bits, so parts of the bits can't bring them together; the smallest hashes of the
shingles do.  Texts that agree on a band of four of them share a shard, which is a BK-tree over SimHash fingerprints, and
what the tree finds within the radius is compared shingle by shingle.

Texts with the same words are one class before anything else, of which one row goes on.  Classes are compared in two steps,
so that a dense group doesn't give all its pairs: first each class with the hub of its group, the member closest to what
most of the group's bits say; then, only where that left several groups in one shard, members of different groups, in the
task that holds the shard, until links connect the groups or nothing is left to compare.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.chunks import by_volume
from millrace.llm.common import cut, free_name, named
from millrace.llm.components import components
from millrace.llm.simhash import BITS, SEED, Tree, linked
from millrace.session import ensure_checkpoint_dir

SHINGLE = 5
SIMILARITY = 0.8
#: Bits in which fingerprints of linked texts may differ: 10 are expected at 0.8, 12 in texts of some ten words.
RADIUS = 22
#: Bands of smallest hashes.  Texts of similarity s share one with 1 - (1 - s^4)^16: 0.9998 at 0.8, more above.
BANDS, BAND_SIZE = 16, 4
_BATCH = 1 << 12
_RESULTS = 10_000


def _mixers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors and summands that make orders of hashes out of one hash, and the factors that join a band's hashes."""
    rng = np.random.default_rng(SEED)
    draw = lambda n: rng.integers(0, 1 << 64, n, np.uint64)
    return draw(BANDS * BAND_SIZE) | np.uint64(1), draw(BANDS * BAND_SIZE), draw(BANDS * BAND_SIZE) | np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    """Runs of other than ASCII white space, A-Z in lower case.  Null has none."""
    return (text or "").encode().lower().split()


def shingle_set(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the shingles, sorted.  Fewer words are one shingle; no words have none."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes).tolist()
    stops = (ends - 1).tolist()[min(shingle, len(words)) - 1:]
    hashes = np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(stops))
    return np.unique(hashes)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is in over half the distinct shingles' hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _BATCH):
        part = hashes[at:at + _BATCH].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def bands(hashes: np.ndarray, mixers: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[int]:
    """The shards of a text: for each band its number and smallest hashes in one long.  A text without words has none."""
    if not len(hashes):
        return []
    factor, summand, join = mixers
    least = np.full(BANDS * BAND_SIZE, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), _BATCH):
        np.minimum(least, (hashes[at:at + _BATCH, None] * factor + summand).min(axis=0), out=least)
    # The factors differ from band to band, so equal hashes in two bands give different shards.
    return (least * join).reshape(BANDS, BAND_SIZE).sum(axis=1, dtype=np.uint64).view(np.int64).tolist()


def _written(df: DataFrame) -> DataFrame:
    """A frame as a table in the shared folder, of which later steps read the columns they need."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/similar-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _sketched(docs: DataFrame, text: str, names: list[str], shingle: int) -> DataFrame:
    """All rows and columns of `docs`, and digest of the words, fingerprint and shards in columns of the given names."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at = docs.columns.index(text)
    columns = [*docs.columns, *names]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        mixers = _mixers()
        for batch in batches:
            texts = batch.column(at)
            keys, prints, shards = [], [], []
            for first, last in by_volume(texts):
                for t in texts.slice(first, last - first).to_pylist():
                    words = words_of(t)
                    hashes = shingle_set(words, shingle)
                    keys.append(xxh3_128_digest(b" ".join(words)))
                    prints.append(fingerprint(hashes))
                    shards.append(bands(hashes, mixers))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(keys, pa.binary()), pa.array(prints, pa.int64()),
                 pa.array(shards, pa.list_(pa.int64()))], columns)

    key, fp, shard = names
    return docs.mapInArrow(run, f"{kinds}, `{key}` binary, `{fp}` long, `{shard}` array<long>")


def hub_of(values: list[int]) -> int:
    """The position of the value closest to the bits that most values have set, the first one of several."""
    most = sum(1 << b for b in range(BITS) if 2 * sum(v >> b & 1 for v in values) > len(values))
    return min(range(len(values)), key=lambda i: ((values[i] ^ most).bit_count(), i))


def hubs(shard: list[tuple], radius: int) -> Iterator[tuple[int, int, int]]:
    """(member, hub, size) of the groups that links of fingerprints make of a shard's rows (class, fp)."""
    values = [r[1] & (1 << 64) - 1 for r in shard]
    groups: dict[int, list[int]] = {}
    for node, first in linked(values, radius):
        groups.setdefault(first, [first]).append(node)
    for group in groups.values():
        hub = group[hub_of([values[i] for i in group])]
        for i in group:
            if i != hub:
                yield shard[i][0], shard[hub][0], len(group)


def connecting(shard: list[tuple], radius: int, similarity: float) -> Iterator[tuple[int, int]]:
    """Links (class, class) that connect the groups of a shard of rows (class, fp, group, shingles as packed hashes).

    Groups leave the tree one after the other, smallest first, and their members are then searched in what is left; what is
    within the radius is compared shingle by shingle, nearest first, unless links already connect the two groups.  So a
    shard gives fewer links than it has groups, however many of its pairs are alike.
    """
    of_group: dict[int, list[int]] = {}
    for i, r in enumerate(shard):
        of_group.setdefault(r[2], []).append(i)
    if len(of_group) < 2:
        return
    values = [r[1] & (1 << 64) - 1 for r in shard]
    sizes = [len(r[3]) // 8 for r in shard]
    ends = np.cumsum(sizes).tolist()
    # Shingles as numbers from 0, so that those of one text can be marked in an array.
    kinds, codes = np.unique(np.frombuffer(b"".join(r[3] for r in shard), np.int64), return_inverse=True)
    codes = codes.astype(np.int32)
    marked = np.zeros(len(kinds), bool)
    of = lambda i: codes[ends[i] - sizes[i]:ends[i]]
    head = {g: g for g in of_group}

    def find(group: int) -> int:
        while head[group] != group:
            head[group] = head[head[group]]
            group = head[group]
        return group

    tree, apart = Tree(values), len(of_group)
    for group in sorted(of_group, key=lambda g: len(of_group[g]))[:-1]:
        for i in of_group[group]:
            tree.take(i)
        for i in of_group[group]:
            mine = find(group)
            near = [j for j in tree.near(values[i], radius) if find(shard[j][2]) != mine]
            if not near:
                continue
            marked[of(i)] = True
            for j in sorted(near, key=lambda j: (values[i] ^ values[j]).bit_count()):
                if min(sizes[i], sizes[j]) < similarity * max(sizes[i], sizes[j]) or find(shard[j][2]) == mine:
                    continue
                common = int(np.count_nonzero(marked[of(j)]))
                if common / (sizes[i] + sizes[j] - common) >= similarity:
                    yield shard[i][0], shard[j][0]
                    head[find(shard[j][2])] = mine
                    apart -= 1
                    if apart == 1:
                        return
            marked[of(i)] = False


def _by_shard(meeting: DataFrame, columns: list[str], find, kinds: str) -> DataFrame:
    """What `find` gives for the rows of each shard, in the order of their classes."""
    names = [k.split()[0] for k in kinds.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of() -> Iterator[tuple]:
            for b in batches:
                yield from zip(b.column("shard").to_pylist(), *[b.column(c).to_pylist() for c in columns])

        out: list[tuple] = []
        for _, shard in groupby(rows_of(), key=lambda r: r[0]):
            members = [r[1:] for r in shard]
            if len(members) > 1:
                for row in find(members):
                    out.append(row)
                    if len(out) >= _RESULTS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)
                        out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    spread = meeting.select("shard", *columns).repartition("shard").sortWithinPartitions("shard", columns[0])
    return spread.mapInArrow(run, kinds)


def _sets(rows: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """`row, has` of the texts, rows (row, text), that `rows` asks for: the distinct hashes of the shingles, packed."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in by_volume(batch.column("text")):
                part = batch.slice(first, last - first)
                sets = [shingle_set(words_of(t), shingle).astype("<u8").tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(sets, pa.binary())], ["row", "has"])

    return _written(texts.join(rows.select("row"), "row", "left_semi").mapInArrow(run, "row long, has binary"))


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the distinct pairs (v, u) whose sets of shingles are as similar as asked for."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a"), batch.column("b")):
                left, right = (np.frombuffer(x.as_py(), "<u8") for x in (a, b))
                common = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(common / (len(left) + len(right) - common) >= similarity)
            yield batch.select(["v", "u"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("row").alias("v"), F.col("has").alias("a")), "v").join(
        sets.select(F.col("row").alias("u"), F.col("has").alias("b")), "u")
    return both.select("v", "u", "a", "b").mapInArrow(run, "v long, u long")


def _linked_classes(classes: DataFrame, texts: DataFrame, similarity: float, shingle: int, radius: int) -> DataFrame:
    """`v, label` of classes `row, fp, shards` that links connect to a smaller one, the smallest row being the label."""
    meeting = classes.select("row", "fp", F.explode("shards").alias("shard"))
    offers = _by_shard(meeting, ["row", "fp"], lambda rows: hubs(rows, radius), "v long, u long, size long")
    # The hub that most shards offer; a class has at most one in each of its shards.
    votes = offers.repartition("v").groupBy("v", "u").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    best = cut(votes.groupBy("v").agg(F.max(F.struct("n", "size", "u")).alias("best")).select("v", "best.u"))
    near = best.select(F.explode(F.array("v", "u")).alias("row")).distinct()
    sets = _sets(near, texts, shingle)
    groups = components(cut(_alike(best, sets, similarity)))

    grouped = near.join(groups.withColumnRenamed("v", "row"), "row", "left").select(
        "row", F.coalesce("label", "row").alias("label"))
    others = cut(classes.join(grouped, "row").select("row", "fp", "label", F.explode("shards").alias("shard")))
    # Shards of one group have nothing left to find.
    open_shards = others.groupBy("shard").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    asked = others.join(open_shards, "shard", "left_semi").join(sets, "row")
    more = _by_shard(asked, ["row", "fp", "label", "has"], lambda rows: connecting(rows, radius, similarity), "v long, u long")
    return components(cut(groups.select("v", F.col("label").alias("u")).unionByName(more.select("v", "u"))))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
                shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: that of the smallest doc_id, null last.

    A group is what chains of links connect.  Texts without words (null, empty, blank) are one group; repeated rows are
    copies of each other.  Of rows with the same id and words one stays, any of them.  An empty frame gives an empty one.
    A link is missed only if two texts share no band or their fingerprints differ in more than `radius` bits, which the
    constants above put below one in a thousand at a similarity of 0.8, and far lower above it; no text is linked without
    the exact check.  A shard passes through one task, which gives fewer links than it has texts; texts in it that aren't
    near each other cost the square of their number in comparisons.
    """
    names = ["near_key", "near_fp", "near_shards"]
    key, fp, shards = (free_name(docs, n) for n in names)
    row = free_name(docs, "near_row")
    marked = _written(_sketched(docs, text, [key, fp, shards], shingle).withColumn(row, F.monotonically_increasing_id()))
    rows = named(marked, doc_id=doc_id, row=row, key=key, fp=fp, shards=shards)
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    classes = cut(rows.groupBy("key").agg(smallest.alias("v"), F.first("fp").alias("fp"), F.first("shards").alias("shards")
                                          ).select("v", F.col("v.row").alias("row"), "fp", "shards"))
    labels = _linked_classes(classes, named(marked, row=row, text=text), similarity, shingle, radius)
    heads = cut(classes.select("v", "row").join(labels.withColumnRenamed("v", "row"), "row", "left").groupBy(
        F.coalesce("label", "row").alias("label")).agg(F.min("v").alias("v")).select(F.col("v.row").alias(row)))
    return marked.join(heads, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
