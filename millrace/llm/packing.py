"""Best-fit packing of documents into training sequences by hierarchical residual packing.

Partitions of bounded size pack their pieces best-fit, largest first.  Nearly full bins are done.  Underfull bins become
items themselves and meet those of other partitions in a tree of groups, round after round, until one group is left.
"""

from __future__ import annotations

import os
import sys
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.chunks import by_volume, segments, split
from millrace.llm.common import cut, named, worker_state

TOKENIZER_FILE = "word_bpe_49k.json"
#: Distinct parts of texts whose ids a Python worker keeps; others are encoded again.
KEPT_CHUNKS = 300_000
#: Pieces that one task packs in the first round.
LOCAL_ITEMS = 100_000
#: Groups that meet in one group of the next round.
FAN_IN = 32
#: Bytes of text that are encoded at once.
_VOLUME = 1 << 22
PIECE_SCHEMA = "piece int, start long, length long, ids binary"


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: ASCII that is neither letter, digit, white space nor part of a contraction or a special token.
_TAIL = ".,;:!?*&%$#"


class ChunkEncoder:
    """Ids of texts by a tokenizer whose pieces never cross ASCII white space.

    Chunks between white space repeat a lot.  The tokenizer folds case and parts ASCII letters from punctuation, so the
    distinct chunks of a batch are folded and parted from their tails first; each distinct part is looked up once and the
    ids of the texts are gathered from the parts.  A bounded number of parts is kept from batch to batch.  Chunks with an
    apostrophe (contractions are pieces of their own) or the opening of a special token are encoded as they stand.
    """

    def __init__(self, path: str, keep: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keep = keep
        self.known: dict[str, bytes] = {}

    def _ids(self, parts: list[str]) -> list[bytes]:
        if len(self.known) > self.keep:  # the oldest half goes
            self.known = dict(islice(self.known.items(), len(self.known) - self.keep // 2, None))
        known = self.known
        new = [p for p in parts if p not in known]
        for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            known[p] = _little_endian(e.ids)
        return [known[p] for p in parts]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null is the empty text."""
        chunks, index, bounds = split(texts)
        whole = pc.or_(pc.match_substring(chunks, "'"), pc.match_substring(chunks, "<|"))
        low = pc.if_else(pc.and_(pc.string_is_ascii(chunks), pc.invert(whole)), pc.ascii_lower(chunks), chunks)
        base = pc.ascii_rtrim(low, characters=_TAIL)
        base = pc.if_else(pc.and_(pc.match_substring_regex(base, "[A-Za-z]$"), pc.invert(whole)), base, low)
        cut = pc.not_equal(pc.binary_length(base), pc.binary_length(low))
        tail = pc.if_else(cut, pc.replace_substring_regex(low, f"^.*[^{_TAIL}]", ""), "")
        bases, tails = base.dictionary_encode(), tail.dictionary_encode()
        ids = self._ids(bases.dictionary.to_pylist()) + self._ids(tails.dictionary.to_pylist())
        sizes = np.fromiter((len(x) >> 2 for x in ids), np.int64, len(ids))
        pool = np.frombuffer(b"".join(ids), "<u4")
        starts = np.cumsum(sizes) - sizes
        # Each chunk is its base and its tail, one after the other.
        pair = np.stack([bases.indices.to_numpy(), tails.indices.to_numpy() + len(bases.dictionary)], axis=1).astype(np.int32)
        index = pair[index].ravel()
        lengths = sizes[index]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        gather = np.repeat((starts[index] - ends[:-1]).astype(np.int32), lengths)
        del index, lengths
        gather += np.arange(len(gather), dtype=np.int32)
        out = pool[gather]
        cuts = ends[2 * bounds]
        return [out[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def _little_endian(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.asarray(ids, dtype="<u4").tobytes()


def token_pieces(
    docs: DataFrame, capacity: int = 2048, path: str | None = None, end_id: int = 0, doc_id: str = "doc_id",
    text: str = "text", keep_chunks: int = KEPT_CHUNKS,
) -> DataFrame:
    """Documents as pieces of at most `capacity` token ids: `doc_id, piece, start, length, ids`.

    A document is the ids of its whole text and then `end_id`; null is the empty text, which gives one piece of length 1.
    Only longer documents are cut, every `capacity` ids.  `ids` holds little-endian unsigned 32-bit numbers.  Each row
    gives its own pieces, also where ids or rows repeat.
    """
    if path is None:
        path = tokenizer_path()
    source = named(docs, doc_id=doc_id, text=text)
    id_type = source.schema["doc_id"].dataType.simpleString()
    end = np.asarray([end_id], dtype="<u4").tobytes()
    width = 4 * capacity

    def ids_of(encoder: ChunkEncoder, texts: pa.Array) -> Iterator[tuple[int, bytes]]:
        for first, last in by_volume(texts, _VOLUME):
            if last - first > 1:
                for i, ids in enumerate(encoder.encode(texts.slice(first, last - first))):
                    yield first + i, ids.tobytes() + end
            else:
                parts = segments((texts[first].as_py() or "").encode())
                yield first, b"".join(encoder.encode(pa.array([p.decode()]))[0].tobytes() for p in parts) + end

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = worker_state(f"encoder {path} {keep_chunks}", lambda: ChunkEncoder(path, keep_chunks))
        for batch in batches:
            rows: list[tuple[int, int, int, bytes]] = []
            volume = 0
            for i, ids in ids_of(encoder, batch.column("text")):
                for piece, at in enumerate(range(0, len(ids), width)):
                    rows.append((i, piece, at // 4, ids[at:at + width]))
                    volume += width
                    if volume >= 1 << 24:
                        yield _piece_batch(batch, rows)
                        rows, volume = [], 0
            if rows:
                yield _piece_batch(batch, rows)

    return source.mapInArrow(run, f"doc_id {id_type}, {PIECE_SCHEMA}")


def _piece_batch(batch: pa.RecordBatch, rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    row, piece, start, ids = zip(*rows)
    return pa.RecordBatch.from_arrays([
        batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
        pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
    ], ["doc_id", "piece", "start", "length", "ids"])


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Largest first, each into the fullest bin that still takes it: bin and offset of every item, fill of every bin."""
    bins, offsets, fills = [0] * len(lengths), [0] * len(lengths), []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        at = bisect_left(rooms, need)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += need
        room -= need
        if room:
            if not by_room[room]:
                insort(rooms, room)
            by_room[room].append(b)
    return bins, offsets, fills


def _open_bins(fills: list[int], capacity: int, slack: int, merges: int) -> list[bool]:
    """Which bins may still gain from others.

    After a best-fit pass at most one bin is half full or less, and only such bins can go into others.  On the way up
    the tree a group meets at most `merges` of them, and bins of equal fill are interchangeable, so more than that many
    of one fill can never be used.  This bounds what a group hands on, whatever it has packed.
    """
    seen: dict[int, int] = defaultdict(int)
    keep = []
    for fill in fills:
        seen[fill] += 1
        keep.append(capacity - fill > slack and seen[fill] <= merges)
    return keep


def pack_pieces(
    pieces: DataFrame, capacity: int = 2048, local_items: int = LOCAL_ITEMS, fan_in: int = FAN_IN, slack: int = 16,
) -> DataFrame:
    """Rows of `pieces` with `sequence_id, offset`: their place in as few sequences of `capacity` as best fit finds.

    Columns of these two names are replaced.  `length` (1 to `capacity`) decides; all other columns are carried, so keep them small or lower `local_items`, the
    number of rows that one task holds.  The offsets of a sequence have no gaps.  Each row is placed once, repeated rows
    too; an empty frame stays empty.
    """
    pieces = pieces.drop("sequence_id", "offset")
    names = [f"c{i}" for i in range(len(pieces.columns))]
    back = [F.col(c).alias(old) for c, old in zip(names, pieces.columns)]
    of_length = names[pieces.columns.index("length")]
    items = cut(pieces.toDF(*names))
    count = items.count()
    groups = max(1, -(-count // local_items))
    levels, reach = 0, 1
    while reach < groups:
        levels, reach = levels + 1, reach * fan_in
    merges = fan_in * max(1, levels)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        node = TaskContext.get().partitionId()
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        bins, offsets, fills = best_fit(table.column(of_length).to_pylist(), capacity)
        keep = _open_bins(fills, capacity, slack, merges)
        bins = np.asarray(bins, dtype=np.int64)
        table = table.append_column("bin", pa.array(bins + (node << 32)))
        table = table.append_column("at", pa.array(offsets, pa.int64()))
        table = table.append_column("fill", pa.array(np.asarray(fills, dtype=np.int64)[bins]))
        table = table.append_column("open", pa.array(np.asarray(keep)[bins]))
        yield from table.combine_chunks().to_batches(max_chunksize=10_000)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema.fields)
    local = items.repartition(groups).mapInArrow(pack, f"{schema}, bin long, at long, fill long, open boolean")
    if groups == 1:
        return local.select(*back, F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    local = cut(local)
    node = F.shiftright("bin", 32)
    opened = local.where("open").where("at = 0").select(
        node.alias("node"), "bin", "fill", F.array(F.struct("bin", F.lit(0).cast("long").alias("shift"))).alias("members"))

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        rows.sort(key=lambda r: (-r["fill"], r["bin"]))
        bins, offsets, fills = best_fit([r["fill"] for r in rows], capacity)
        keep = _open_bins(fills, capacity, slack, merges)
        out: list[dict] = [{"fill": f, "open": k, "members": []} for f, k in zip(fills, keep)]
        for r, b, at in zip(rows, bins, offsets):
            out[b]["members"] += [{"bin": m["bin"], "shift": m["shift"] + at} for m in r["members"]]
        for o in out:
            o["node"], o["bin"] = rows[0]["node"], o["members"][0]["bin"]
        return pa.Table.from_pylist(out, pa.schema([
            ("node", pa.int64()), ("bin", pa.int64()), ("fill", pa.int64()), ("open", pa.bool_()),
            ("members", pa.list_(pa.struct([("bin", pa.int64()), ("shift", pa.int64())])))]))

    done = None
    for level in range(levels):
        merged = cut(opened.withColumn("node", F.floor(F.col("node") / fan_in).cast("long")).groupBy("node").applyInArrow(
            merge, "node long, bin long, fill long, open boolean, members array<struct<bin:long,shift:long>>"))
        last = level == levels - 1
        closed = (merged if last else merged.where(~F.col("open"))).select("bin", "members")
        done = closed if done is None else done.unionByName(closed)
        opened = merged.where("open").select("node", "bin", "fill", "members")
    moved = done.select(F.col("bin").alias("root"), F.explode("members").alias("m")).select(
        "root", F.col("m.bin").alias("leaf"), F.col("m.shift").alias("shift"))
    still = local.where(~F.col("open")).select(*back, F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    placed = local.where("open").join(moved, F.col("bin") == F.col("leaf")).select(
        *back, F.col("root").alias("sequence_id"), (F.col("at") + F.col("shift")).alias("offset"))
    return still.unionByName(placed)


def sequences(placed: DataFrame) -> DataFrame:
    """Training sequences `sequence_id, length, ids, doc_ids` of placed pieces that carry their `ids`, in order of offset."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("length"),
        F.aggregate("parts", F.lit(b""), lambda ids, p: F.concat(ids, p["ids"])).alias("ids"),
        F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"))
