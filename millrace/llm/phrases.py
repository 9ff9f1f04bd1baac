"""Phrase collocations from a weighted de Bruijn graph.

Pieces of texts are walks through a graph: its nodes are pairs of words that follow each other, its edges triples, each of
which leads from its first pair to its last.  Only edges are counted, with the ends of pieces as edges to nowhere.  What a
node sends out is how often its pair occurs, what all nodes of a first word send out is how often the word does; the ends
of pieces are the correction.  Of the edges that are frequent, those that follow each other without a way in or out are
made one path, along which all counts are the same.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.chunks import by_volume
from millrace.llm.common import cut, named
from millrace.plans.shapes import ordered_ranks

LEAST = 10
COVER = 50
MOST = 2000
#: Bytes of texts that a task counts at once.
VOLUME = 2 << 20
#: Buckets of edges a shuffle partition; a task unpacks one after the other.
SHARES = 4
#: Kinds of bytes: part of a word, gap, end of a piece.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words up to which three numbers of words fit a long.
_ROOM = 1 << 21
#: The word that is none: what follows the end of a piece.
_NONE = 0


def walks(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of texts, the word at every place, and which places are the last of their piece."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    cuts = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[cuts[0]:cuts[-1]]
    kind = _KIND[data]
    inside = kind == 0
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    # A word also ends where its text does.
    bounds = (cuts - cuts[0])[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < len(data))]
    between = np.unique(bounds[inside[bounds] & inside[bounds - 1]]) if len(bounds) else bounds
    first = np.sort(np.concatenate([np.flatnonzero(edge == 1), between]))
    last = np.sort(np.concatenate([np.flatnonzero(edge == -1), between]))
    if not len(first):
        return pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(last - first)])
    said = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(_LOWER[data[inside]])])
    found = said.dictionary_encode()
    # A word is the last of its piece if an end of a piece, or of a text, stands before the next word.
    stops, done = np.flatnonzero(kind == 2), np.ones(len(first), bool)
    text_of = np.searchsorted(cuts - cuts[0], first, side="right")
    done[:-1] = (np.searchsorted(stops, first[1:]) > np.searchsorted(stops, last[:-1])) | (text_of[1:] != text_of[:-1])
    return found.dictionary.cast(pa.binary()), found.indices.to_numpy(zero_copy_only=False).astype(np.int64), done


def counted(a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray, words: int) -> tuple[np.ndarray, ...]:
    """Distinct triples of word numbers below `words` in order, with the sums of `n`."""
    if words < _ROOM:
        key = (a << 42) | (b << 21) | c
    else:
        _, pair = np.unique(a * words + b, return_inverse=True)
        key = pair.astype(np.int64) * words + c
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    first = order[starts]
    return a[first], b[first], c[first], np.add.reduceat(n[order], starts) if len(starts) else n[:0]


def _mix(*ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.zeros(len(ids[0]), np.uint64)
        for x in ids:
            h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(1)


def _in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _parts(batch: pa.RecordBatch, seed: int, volume: int):
    """Texts of a batch by language and volume: the language, ids of the distinct words, their texts, the triples of all
    places (numbers of words, 0 being no word), and the places."""
    from xxhash import xxh64_intdigest

    langs = pc.fill_null(batch.column("lang"), "und").dictionary_encode()
    which = langs.indices.to_numpy(zero_copy_only=False)
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        texts = batch.column("text").take(pa.array(np.flatnonzero(which == i)))
        salt = xxh64_intdigest(lang, seed)
        for first, last in by_volume(texts, volume):
            words, at, done = walks(texts.slice(first, last - first))
            if not len(at):
                continue
            said = words.to_pylist()
            ids = np.fromiter((xxh64_intdigest(w, salt) or 1 for w in said), np.uint64, len(said))
            a = at + 1
            b = np.where(done, 0, np.concatenate([a[1:], [0]]))
            last_two = done | np.concatenate([done[1:], [True]])
            c = np.where(last_two, 0, np.concatenate([a[2:], [0, 0]])[:len(a)])
            yield lang, np.concatenate([np.array([_NONE], np.uint64), ids]), said, a, b, c


def _source(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return named(docs, text=text, lang=lang).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


def _lexicon(source: DataFrame, seed: int, buckets: int, volume: int) -> DataFrame:
    """`kind, id, lang, word, n`: every word of every language (kind 0) with its id; words (1) and pairs (2) that are a large
    share of some part of the texts, with their count there; words of each language in all (3)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, ids, said, a, b, _ in _parts(batch, seed, volume):
                least = max(2, len(a) / (8 * buckets))
                n = np.bincount(a, minlength=len(ids))
                often = np.flatnonzero(n >= least)
                pairs, n_pairs = np.unique(_mix(ids[a], ids[b])[(b > 0) & _in(a, often)], return_counts=True)
                heavy = n_pairs >= least
                kinds = np.repeat([0, 1, 2, 3], [len(said), len(often), heavy.sum(), 1])
                names = np.concatenate([ids[1:], ids[often], pairs[heavy], np.zeros(1, np.uint64)]).view(np.int64)
                counts = np.concatenate([np.zeros(len(said), np.int64), n[often], n_pairs[heavy], [len(a)]])
                none = pa.nulls(len(kinds) - len(said), pa.binary())
                yield pa.RecordBatch.from_arrays([
                    pa.array(kinds, pa.int32()), pa.array(names), pa.array([lang] * len(kinds), pa.string()),
                    pa.concat_arrays([pa.array(said, pa.binary()), none]).cast(pa.string()), pa.array(counts.astype(np.int64))],
                    ["kind", "id", "lang", "word", "n"])

    found = source.mapInArrow(run, "kind int, id long, lang string, word string, n long")
    return cut(found.groupBy("kind", "id", "lang", "word").agg(F.sum("n").alias("n")))


def _blocks(source: DataFrame, seed: int, buckets: int, heavy_words: np.ndarray, heavy_pairs: np.ndarray, volume: int) -> DataFrame:
    """`bucket, ids, edges`: distinct edges of a part of the texts with their counts, packed by bucket.

    All edges from a first word are in one bucket; those of words that are a large share of all go by their pair, and those
    of such pairs by the whole triple, so that no bucket hangs on one word.
    """
    sent = source.sparkSession.sparkContext.broadcast((heavy_words, heavy_pairs))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = sent.value
        for batch in batches:
            for _, ids, said, a, b, c in _parts(batch, seed, volume):
                a, b, c, n = counted(a, b, c, np.ones(len(a), np.int64), len(ids))
                ia, ib, ic = ids[a], ids[b], ids[c]
                place = _mix(ia)
                often = _in(ia, words)
                pair = _mix(ia, ib)
                place[often] = pair[often]
                both = often & _in(pair, pairs)
                place[both] = _mix(ia[both], ib[both], ic[both])
                bucket = (place % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                out = []
                for k in np.flatnonzero(np.diff(starts)):
                    at = order[starts[k]:starts[k + 1]]
                    used, places = np.unique(np.concatenate([a[at], b[at], c[at]]), return_inverse=True)
                    small = places.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32)
                    counts = n[at]
                    out.append((int(k), ids[used].tobytes(), small.tobytes(),
                                counts.astype("<u2" if counts.max() < 1 << 16 else "<i8").tobytes(), len(at)))
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(cols[0], pa.int32()), *[pa.array(x, pa.binary()) for x in cols[1:4]], pa.array(cols[4], pa.int32())],
                        ["bucket", "ids", "places", "counts", "n"])

    return source.mapInArrow(run, "bucket int, ids binary, places binary, counts binary, n int")


def _graph(source: DataFrame, seed: int, buckets: int, heavy_words: np.ndarray, heavy_pairs: np.ndarray, least: int, volume: int) -> DataFrame:
    """`kind, a, b, c, n`: frequent edges (3), pairs (2) and words (1); of heavy pairs and words, parts of their counts."""
    packed = _blocks(source, seed, buckets, heavy_words, heavy_pairs, volume)
    sent = source.sparkSession.sparkContext.broadcast((heavy_words, heavy_pairs))

    def flows(blocks: list[tuple]) -> pa.RecordBatch:
        words, pairs = sent.value
        ids = np.unique(np.concatenate([np.array([_NONE], np.uint64), *[np.frombuffer(b[0], np.uint64) for b in blocks]]))
        a, b, c, n = [], [], [], []
        for names, places, counts, size in blocks:
            at = np.searchsorted(ids, np.frombuffer(names, np.uint64)).astype(np.int64)
            p = at[np.frombuffer(places, np.uint16 if len(places) == 6 * size else np.uint32)]
            a.append(p[:size])
            b.append(p[size:2 * size])
            c.append(p[2 * size:])
            n.append(np.frombuffer(counts, "<u2" if len(counts) == 2 * size else "<i8").astype(np.int64))
        a, b, c, n = counted(*map(np.concatenate, (a, b, c, n)), len(ids))
        blocks.clear()
        edge = (c > 0) & (n >= least)
        new_word = np.concatenate([[True], a[1:] != a[:-1]])
        new_pair = new_word | np.concatenate([[True], b[1:] != b[:-1]])
        at_pair, at_word = np.flatnonzero(new_pair), np.flatnonzero(new_word)
        n_pair, n_word = np.add.reduceat(n, at_pair), np.add.reduceat(n, at_word)
        pa_, pb, wa = ids[a[at_pair]], ids[b[at_pair]], ids[a[at_word]]
        often = _in(wa, words)
        split = _in(pa_, words) & _in(_mix(pa_, pb), pairs)
        pair = (pb != _NONE) & ((n_pair >= least) | split)
        word = (n_word >= least) | often
        none = np.zeros
        cols = [
            np.repeat([3, 2, 1], [edge.sum(), pair.sum(), word.sum()]),
            np.concatenate([ids[a[edge]], pa_[pair], wa[word]]),
            np.concatenate([ids[b[edge]], pb[pair], none(word.sum(), np.uint64)]),
            np.concatenate([ids[c[edge]], none(pair.sum() + word.sum(), np.uint64)]),
            np.concatenate([n[edge], n_pair[pair], n_word[word]]),
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int32()), *[pa.array(x.view(np.int64)) for x in cols[1:4]], pa.array(cols[4])], ["kind", "a", "b", "c", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = None, []
        for batch in batches:
            for i, k in enumerate(batch.column("bucket").to_pylist()):
                if k != now and blocks:
                    yield flows(blocks)
                    blocks = []
                now = k
                blocks.append([batch.column(c)[i].as_py() for c in ("ids", "places", "counts", "n")])
        if blocks:
            yield flows(blocks)

    # A task a bucket: what it unpacks at once is one bucket, however the shuffle sizes its tasks.
    found = packed.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(run, "kind int, a long, b long, c long, n long")
    # Parts of heavy pairs and words are a few rows a bucket.
    return cut(found.groupBy("kind", "a", "b", "c").agg(F.sum("n").alias("n")).where(F.col("n") >= least))


def paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """`words, n`: frequent edges (a, b, c, n) compacted along their unary paths, the words of each and its count.

    A pair is passed through if one edge in and one edge out have its whole count (a, b, n): then no other edge, and no
    piece's end or beginning, is at it.  Such edges are linked, and every edge finds the first of its path and its distance
    by doubling, in as many rounds as the longest path has binary digits.  A path is never longer than a piece that walks it.
    """
    numbered = cut(edges).withColumn("e", F.monotonically_increasing_id())
    own = numbered.select("e", F.col("b").alias("x"), F.col("c").alias("y"), "n")
    through = own.join(pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "n"), ["x", "y", "n"])
    links = cut(numbered.select(F.col("e").alias("to"), F.col("a").alias("x"), F.col("b").alias("y"), "n").join(
        through, ["x", "y", "n"]).select(F.col("to").alias("e"), F.col("e").alias("up"), F.lit(1).cast("long").alias("d")))
    while True:
        above = links.select(F.col("e").alias("up"), F.col("up").alias("top"), F.col("d").alias("more"))
        step = cut(links.join(above, "up", "left").select(
            "e", F.coalesce("top", "up").alias("up"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d"), F.col("top").isNotNull().alias("moved")))
        links = step.select("e", "up", "d")
        if not step.where("moved").limit(1).count():
            break
    placed = numbered.join(links, "e", "left").select(
        F.coalesce("up", "e").alias("path"), F.struct(F.coalesce("d", F.lit(0)).alias("d"), "a", "b", "c").alias("edge"), "n")
    whole = placed.groupBy("path").agg(F.array_sort(F.collect_list("edge")).alias("edges"), F.first("n").alias("n"))
    return whole.select(F.concat(F.array(F.col("edges")[0]["a"], F.col("edges")[0]["b"]), F.transform("edges", lambda e: e["c"])).alias("words"), "n")


def score_of(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact up to counts of 15 digits."""
    whole = lambda c: c.cast("decimal(15,0)")
    top = (whole(a) * whole(a) * F.lit(1_000_000).cast("decimal(7,0)")).alias("top")
    return F.call_function("div", top, whole(left) * whole(right)).cast("long")


def collocations(docs: DataFrame, least: int = LEAST, cover: int = COVER, most: int = MOST, text: str = "text", lang: str = "lang",
                 volume: int = VOLUME, seed: int = 0) -> DataFrame:
    """`lang, rank, phrase, a, l, r, n, score`: the `most` best phrases of two or three words of each language.

    Texts have A-Z lower-cased and are cut at `. , ; : ! ?` and line ends into pieces, pieces at blanks and tabs into words.
    `a` is how often a phrase occurs, at least `least`; cut after its first word or words it has the counts `l` and `r` and
    the score floor(1000000 a a / (l r)), of two cuts that with the lower score, then the first.  A phrase that stands in a
    longer one of at least `cover` hundredths of its count goes.  `n` counts all words of the language.  Ranks go by score,
    count, both from the highest, and phrase.  A null language is `und`, null and empty texts hold nothing, repeated rows
    count each time, empty frames give no row; other columns are not looked at.

    Words are 64 bits of hash with their language; two that share one are found when the words are listed, and then all is
    done anew with another seed, so counts are those of words.  The texts are read twice, and only packed counts of each
    part's distinct edges are shuffled.  The driver holds words and pairs of more than an eighth of a bucket's share of some
    part, at most 16 times the buckets, and one number a language.
    """
    source = _source(docs, text, lang)
    spark = docs.sparkSession
    buckets = SHARES * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    while True:
        lexicon = _lexicon(source, seed, buckets, volume)
        if not lexicon.where("kind = 0").groupBy("id").count().where("count > 1").limit(1).count():
            break
        seed += 1
    total = lexicon.where("kind = 3").agg(F.sum("n")).first()[0] or 0
    large = lexicon.where(f"kind in (1, 2) and n * {16 * buckets} >= {total}").select("kind", "id").collect()
    heavy = [np.sort(np.array([r["id"] for r in large if r["kind"] == k], np.int64).view(np.uint64)) for k in (1, 2)]
    graph = _graph(source, seed, buckets, *heavy, least, volume)
    words = graph.where("kind = 1").select("a", "n")
    pairs = graph.where("kind = 2").select("a", "b", "n")
    found = cut(paths(graph.where("kind = 3").select("a", "b", "c", "n"), pairs))

    # Triples: pairs within a path have the count of the path, those at its ends are looked up.
    steps = found.select("n", "words", F.explode(F.sequence(F.lit(0), F.size("words") - 3)).alias("i"))
    triples = cut(steps.select(
        F.get("words", F.col("i")).alias("a"), F.get("words", F.col("i") + 1).alias("b"), F.get("words", F.col("i") + 2).alias("c"), "n",
        F.when(F.col("i") > 0, F.col("n")).alias("ab"), F.when(F.col("i") < F.size("words") - 3, F.col("n")).alias("bc")))
    pair_of = lambda x, y, into: pairs.select(F.col("a").alias(f"_{x}"), F.col("b").alias(f"_{y}"), F.col("n").alias(into))

    def with_pair(df: DataFrame, x: str, y: str, into: str) -> DataFrame:
        open_ = df.where(F.col(into).isNull()).drop(into).join(
            pair_of(x, y, into), (F.col(x) == F.col(f"_{x}")) & (F.col(y) == F.col(f"_{y}"))).drop(f"_{x}", f"_{y}")
        return df.where(F.col(into).isNotNull()).unionByName(open_)

    def with_word(df: DataFrame, x: str, into: str) -> DataFrame:
        return df.join(words.select(F.col("a").alias("_w"), F.col("n").alias(into)), F.col(x) == F.col("_w")).drop("_w")

    threes = with_word(with_word(with_pair(with_pair(triples, "a", "b", "ab"), "b", "c", "bc"), "a", "na"), "c", "nc")
    cuts = [F.struct(score_of(F.col("n"), F.col(x), F.col(y)).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r"))
            for k, x, y in ((1, "na", "bc"), (2, "ab", "nc"))]
    threes = threes.select("a", "b", "c", "n", F.least(*cuts).alias("cut")).select("a", "b", "c", "n", "cut.l", "cut.r", "cut.score")
    # Pairs: gone if an edge that they begin or end has most of their count.
    around = triples.select("a", "b", F.col("n").alias("m")).unionByName(triples.select(F.col("b").alias("a"), F.col("c").alias("b"), F.col("n").alias("m")))
    held = around.groupBy(F.col("a").alias("_a"), F.col("b").alias("_b")).agg(F.max("m").alias("m"))
    left = pairs.join(held, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left").where(
        F.col("m").isNull() | (100 * F.col("m") < cover * F.col("n"))).select("a", "b", "n")
    twos = with_word(with_word(left, "a", "l"), "b", "r").select(
        "a", "b", F.lit(None).cast("long").alias("c"), "n", "l", "r", score_of(F.col("n"), F.col("l"), F.col("r")).alias("score"))

    candidates = threes.unionByName(twos)
    named_words = lexicon.where("kind = 0").join(words.select(F.col("a").alias("id")), "id", "left_semi").select("id", "word", "lang")
    name = lambda x: named_words.select(F.col("id").alias(f"_{x}"), F.col("word").alias(f"word_{x}"))
    said = candidates.join(named_words.select(F.col("id").alias("_a"), F.col("word").alias("word_a"), "lang"), F.col("a") == F.col("_a"))
    said = said.join(name("b"), F.col("b") == F.col("_b")).join(name("c"), F.col("c") == F.col("_c"), "left")
    listed = cut(said.select("lang", F.concat_ws(" ", "word_a", "word_b", "word_c").alias("phrase"), F.col("n").alias("a"), "l", "r", "score"))
    ranked = ordered_ranks(listed, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")]).where(F.col("rank") <= most)
    sizes = lexicon.where("kind = 3").groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
