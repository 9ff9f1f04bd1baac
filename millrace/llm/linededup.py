"""Line deduplication by pairwise alignment.

Lines that are rare by their length, or together with their neighbours, name a document: the smallest runs of lines with
enough words.  A document is paired with the earliest holder of each of its runs, the two are aligned by patience diff, and
the blocks that align go from the later one.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.chunks import by_volume
from millrace.llm.common import cut, free_name, named

#: Words that an aligned block must have to go: shorter ones are headings, licenses and the like, common by nature.
BLOCK_WORDS = 20
#: Code points that count as a word in scripts that don't part words by spaces.
WORD_POINTS = 3
#: Letters of such scripts: Thai, Lao, Tibetan, Burmese, Khmer, Tai, Javanese, Japanese and Chinese.
_UNPARTED = re.compile(
    "[\u0E00-\u0FFF\u1000-\u109F\u1780-\u17FF\u1950-\u19FF\u1A20-\u1AAF\u3005-\u3007\u3040-\u312F\u31A0-\u31BF\u31F0-\u31FF\u3400-\u4DBF"
    "\u4E00-\u9FFF\uA980-\uA9FF\uAA60-\uAADF\uF900-\uFAFF\uFF66-\uFF9F\U0001B000-\U0001B16F\U00020000-\U0003FFFF]")


def line_words(said: bytes) -> int:
    """Words of a line, one at least: runs of other than white space.  Where scripts don't part words, a run is as many
    words as its letters fill at `WORD_POINTS` each."""
    if said.isascii():
        return len(said.split())
    return max(1, sum(max(1, len(_UNPARTED.findall(w)) // WORD_POINTS) for w in said.decode().split()))


def smallest_blocks(words: list[int], block_words: int) -> list[tuple[int, int]]:
    """Ranges of lines (end exclusive) with `block_words` words that have fewer without their first or without their last line.

    Every longer block is made of such ranges, and which ranges it has follows from its own lines alone.  So a line belongs
    to a block that two documents share only if it belongs to a smallest one that they share.
    """
    least = max(1, block_words)
    found: set[tuple[int, int]] = set()
    first = total = 0
    for last, n in enumerate(words):
        total += n
        while total - words[first] >= least:
            total -= words[first]
            first += 1
        if total >= least:
            found.add((first, last + 1))
    last = total = 0
    for first, n in enumerate(words):
        while last < len(words) and total < least:
            total += words[last]
            last += 1
        if total < least:
            break
        found.add((first, last))
        total -= n
    return sorted(found)


def _lines(docs: DataFrame) -> DataFrame:
    """`doc_id, text_hash, names, words, places` of every text: digests of its lines with a word, how many words they have,
    and which lines of all they are, packed."""
    source = named(docs, doc_id="doc_id", text="text").where(F.col("text").isNotNull()).withColumn("text_hash", F.xxhash64("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            texts = batch.column("text")
            for from_row, to_row in by_volume(texts):
                out = []
                for text in texts.slice(from_row, to_row - from_row).to_pylist():
                    place, words, lines = [], [], []
                    for at, raw in enumerate(text.encode().split(b"\n")):
                        said = raw.strip()
                        if said:
                            place.append(at)
                            words.append(line_words(said))
                            lines.append(xxh3_128_digest(said))
                    out.append((b"".join(lines), np.array(words, "<u4").tobytes(), np.array(place, "<u4").tobytes()))
                part = batch.slice(from_row, to_row - from_row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), *[pa.array(x, pa.binary()) for x in zip(*out)]],
                    ["doc_id", "text_hash", "names", "words", "places"])

    return source.mapInArrow(run, f"doc_id {id_type}, text_hash long, names binary, words binary, places binary")


def _unpacked(names: bytes, words: bytes) -> tuple[list[bytes], list[int]]:
    return [names[i:i + 16] for i in range(0, len(names), 16)], np.frombuffer(words, "<u4").tolist()


def _marks(names: list[bytes], words: list[int], block_words: int) -> Iterator[tuple[bytes, int, int]]:
    """The digest of each smallest block, its first line and its end."""
    from xxhash import xxh3_128_digest

    for a, b in smallest_blocks(words, block_words):
        yield names[a] if b - a == 1 else xxh3_128_digest(b"".join(names[a:b])), a, b


def _marked(lines: DataFrame, block_words: int) -> DataFrame:
    """`doc_id, text_hash, h1, h2`: the distinct marks of every text."""
    id_type = lines.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, found = [], []
            for i, (names, words) in enumerate(zip(batch.column("names").to_pylist(), batch.column("words").to_pylist())):
                own = {m for m, _, _ in _marks(*_unpacked(names, words), block_words)}
                row += [i] * len(own)
                found += own
            pair = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("text_hash").take(at), pa.array(pair[:, 0]), pa.array(pair[:, 1])],
                ["doc_id", "text_hash", "h1", "h2"])

    return lines.mapInArrow(run, f"doc_id {id_type}, text_hash long, h1 long, h2 long")


def _increasing(positions: list[int]) -> list[int]:
    """Indices of a longest increasing run of positions, as patience sorting finds it."""
    tops: list[int] = []
    heads: list[int] = []
    before: list[int] = []
    for i, p in enumerate(positions):
        at = bisect_left(tops, p)
        before.append(heads[at - 1] if at else -1)
        if at == len(tops):
            tops.append(p)
            heads.append(i)
        else:
            tops[at] = p
            heads[at] = i
    out, i = [], heads[-1] if heads else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def aligned_blocks(mine: list[bytes], marks: list[tuple[bytes, int, int]], theirs: list[bytes], held: dict[bytes, int]) -> list[tuple[int, int]]:
    """Runs of lines (end exclusive) of the later document that align with the earlier one, `theirs`.

    Patience diff: the marks that both have, the later one's in order with where the earlier one has them first (`held`),
    are thinned to a longest run that is in order on both sides, and each that is left grows as far as lines are equal.
    Marks that no aligned block took along were moved or repeated, and grow from where they are.
    """
    shared = [(a, b, held[m]) for m, a, b in marks if m in held]
    chain = _increasing([at for _, _, at in shared])
    taken = set(chain)
    out: list[tuple[int, int]] = []
    for group in (chain, [i for i in range(len(shared)) if i not in taken]):
        reached = -1, 0  # the diagonal of the last block and its end
        for i in group:
            a, b, at = shared[i]
            if reached[0] == a - at and b <= reached[1]:
                continue
            first, last, shift = a, b, at - a
            while first > 0 and first + shift > 0 and mine[first - 1] == theirs[first - 1 + shift]:
                first -= 1
            while last < len(mine) and last + shift < len(theirs) and mine[last] == theirs[last + shift]:
                last += 1
            out.append((first, last))
            reached = a - at, last
    return out


def deleted_ranges(blocks: Iterable[tuple[int, int, int, int]]) -> tuple[list[tuple[int, int]], int]:
    """Ranges of all lines (end exclusive) that go from a document, and how many lines with a word are in them, from the
    `first, last, start, end` of its aligned blocks.  Blocks that overlap or touch are one range."""
    out: list[tuple[int, int]] = []
    removed = reached = 0
    for first, last, start, end in sorted(set(blocks)):
        if out and first <= reached:
            out[-1] = out[-1][0], max(out[-1][1], end)
            removed += max(0, last - reached)
        else:
            out.append((start, end))
            removed += last - first
        reached = max(reached, last)
    return out, removed


def pairs(lines: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`doc_id, text_hash, holder, holder_hash`: documents that share a mark, each with the earliest holder of that mark.

    A mark costs each later holder one row, however many there are, and never a row for each pair of holders; all marks
    count, so frequent ones need no other way.
    """
    marks = cut(_marked(lines, block_words))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    firsts = cut(marks.groupBy("h1", "h2").agg(F.min(order).alias("first"), F.max(order).alias("last")).where(
        (F.col("first.none") != F.col("last.none")) | ~F.col("first.doc_id").eqNullSafe(F.col("last.doc_id"))
        | (F.col("first.text_hash") != F.col("last.text_hash"))).select(
        F.col("h1").alias("f1"), F.col("h2").alias("f2"), F.col("first.doc_id").alias("holder"), F.col("first.text_hash").alias("holder_hash")))
    # Both sides are plain frames, so that adaptive execution can split a mark of very many documents.
    return marks.join(firsts, (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2"))).where(
        ~(F.col("holder").eqNullSafe(F.col("doc_id")) & (F.col("holder_hash") == F.col("text_hash")))).select(
        "doc_id", "text_hash", "holder", "holder_hash").distinct()


def common_blocks(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`doc_id, text_hash, ranges, removed` of documents that lose lines: ranges of lines, end exclusive, and how many lines
    with a word are in them.

    Documents are in order of `doc_id`, null last, then of a hash of the text.  A pair costs the digests of both documents'
    lines, 16 bytes a line, where it is aligned.
    """
    lines = cut(_lines(docs))
    found = cut(pairs(lines, block_words))
    asked = found.select(F.col("doc_id").alias("i"), F.col("text_hash").alias("t")).unionByName(
        found.select(F.col("holder").alias("i"), F.col("holder_hash").alias("t"))).distinct()
    # Rows that repeat id and text are one document.
    few = cut(lines.join(asked, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("t")), "left_semi").dropDuplicates(
        ["doc_id", "text_hash"]))
    id_type = lines.schema["doc_id"].dataType.simpleString()
    mine = few.select(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash"), "names", "words", "places")
    theirs = few.select(F.col("doc_id").alias("their_id"), F.col("text_hash").alias("their_hash"), F.col("names").alias("their_names"),
                        F.col("words").alias("their_words"))
    met = found.join(mine, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash"))).drop("own_id", "own_hash")
    # Pairs of one holder come one after the other, but for where adaptive execution parts them.
    met = met.join(theirs, F.col("holder").eqNullSafe(F.col("their_id")) & (F.col("holder_hash") == F.col("their_hash"))).select(
        "doc_id", "text_hash", "names", "words", "places", "their_names", "their_words")

    def align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, theirs, held = None, [], {}
        for batch in batches:
            row, found = [], []
            for i in range(len(batch)):
                names, words, places, their_names, their_words = (batch.column(c)[i].as_py() for c in range(2, 7))
                if their_names != last:
                    last, held = their_names, {}
                    theirs, their_sizes = _unpacked(their_names, their_words)
                    for m, a, _ in _marks(theirs, their_sizes, block_words):
                        held.setdefault(m, a)
                own, sizes = _unpacked(names, words)
                place = np.frombuffer(places, "<u4")
                for a, b in aligned_blocks(own, list(_marks(own, sizes, block_words)), theirs, held):
                    row.append(i)
                    found.append((a, b, int(place[a]), int(place[b - 1]) + 1))
            at = pa.array(row, pa.int64())
            cols = list(zip(*found)) if found else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("text_hash").take(at), *[pa.array(x, pa.int32()) for x in cols]],
                ["doc_id", "text_hash", "first", "last", "start", "end"])

    shared = met.mapInArrow(align, f"doc_id {id_type}, text_hash long, first int, last int, start int, end int")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*[b.column(c).to_pylist() for c in ("doc_id", "text_hash", "first", "last", "start", "end")])

        out: list[tuple] = []
        for (doc_id, text_hash), of_doc in groupby(rows(), key=lambda r: r[:2]):
            ranges, removed = deleted_ranges(r[2:] for r in of_doc)
            out.append((doc_id, text_hash, [{"start": a, "end": b} for a, b in ranges], removed))
            if len(out) >= 10_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        ids, hashes, ranges, removed = zip(*out)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(hashes, pa.int64()), pa.array(ranges, kind), pa.array(removed, pa.int64())],
            ["doc_id", "text_hash", "ranges", "removed"])

    grouped = shared.repartition("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash")
    return grouped.mapInArrow(run, f"doc_id {id_type}, text_hash long, ranges array<struct<start:int,end:int>>, removed long")


def without_repeated_lines(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All rows of `docs` and their columns, `text` without the blocks that earlier documents hold, and `removed_lines`
    (a column of that name is replaced).

    Every document stays; one that loses all its lines gets the empty text.  A line is what stands between line feeds,
    compared without white space around it; lines without a word are never compared and stay where they are, unless
    nothing else does.  Null and empty texts stay as they are.  Rows that repeat both id and text are one document and
    change alike; another text under the same or a null id is another document.  A line goes only with a block of
    `block_words` words that one earlier document holds as it stands, its lines next to each other but for lines without
    a word, and with every such block, however often it repeats it; all else stays, however often it comes.
    """
    docs = docs.drop("removed_lines")
    own = [free_name(docs, c) for c in ("block_id", "block_hash", "block_ranges", "block_removed")]
    blocks = common_blocks(docs, block_words).toDF(*own)
    block_id, block_hash, ranges, removed = map(F.col, own)
    joined = docs.join(blocks, docs["doc_id"].eqNullSafe(block_id) & F.xxhash64(docs["text"]).eqNullSafe(block_hash), "left")
    left = F.when(ranges.isNull(), F.col("text")).otherwise(_rest(F.col("text"), ranges))
    return joined.withColumn("text", left).select(
        *[F.col(f"`{c}`") for c in docs.columns], F.coalesce(removed, F.lit(0).cast("long")).alias("removed_lines"))


def _rest(text: Column, ranges: Column) -> Column:
    """The text without the ranges of lines; empty if only blank lines are left."""
    gone = lambda i: F.exists(ranges, lambda r: (i >= r["start"]) & (i < r["end"]))
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~gone(i)), "\n")
    return F.when(left.rlike(r"[^ \t\n\x0B\f\r]"), left).otherwise("")
