"""A keyword index kept in immutable segments, and a ranked search that skips blocks.

A segment holds the words of some documents in blocks: the postings of a word within a bucket of documents, with the most
occurrences and the shortest length in it.  These bound what the word can add to any score of the bucket, whatever weights
the word has by then.  Documents are put into buckets by length, so that the bounds differ.  An update writes one segment
of what changed and the ids that it voids; a merge makes one segment of several of about equal size.  A row in
``published`` names the segments once they are whole, so readers never see a part of an update.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.words import count_words, word_letters
from millrace.operators.retrieval import _WORD_GAP, BM25_B, BM25_K1, GONE_ROWS, IDF_FLOOR, MAX_QUERY_BYTES, _wanted
from millrace.plans.shapes import is_small, small_side, top_per_key
from millrace.session import ensure_checkpoint_dir
from millrace.streaming.jobs import _load

#: Documents of a bucket, about.
BUCKET_DOCS = 1024
#: Classes of length between a length and its double.
CLASSES = 8
#: Segments of a size that are merged into one.
FAN = 4
#: Words of a bucket at most, unless one document has more, and of a range of blocks, about.
BUCKET_WORDS = 1_000_000
#: Buckets of a query that are scored before the first threshold, and before the second.
WAVES = (2, 16)
#: Bounds and scores are added up in different orders.
SLACK = 1e-9


class Segment(NamedTuple):
    folder: str
    seq: int
    docs: int


def _cut(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def segments(spark: SparkSession, root: str) -> list[Segment]:
    """The segments of the newest published version; none if there is no index."""
    published = _load(spark, f"{root}/published")
    if published is None:
        return []
    last = published.orderBy(F.desc("version"), F.desc("at")).first()
    return [Segment(*s) for s in last["segments"]]


def _publish(spark: SparkSession, root: str, found: list[Segment]) -> None:
    published = _load(spark, f"{root}/published")
    version = 0 if published is None else published.agg(F.max("version")).first()[0] + 1
    kind = "version long, segments array<struct<folder:string,seq:long,docs:long>>"
    entry = spark.createDataFrame([(version, [tuple(s) for s in found])], kind)
    entry.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/published")


def _tables(spark: SparkSession, root: str, name: str, found: list[Segment]) -> DataFrame | None:
    """One table of several segments, with the number and the sequence of each."""
    parts = [spark.read.parquet(f"{root}/{s.folder}/{name}").withColumns({"seg": F.lit(i), "seq": F.lit(s.seq).cast("long")})
             for i, s in enumerate(found)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def _few(df: DataFrame) -> DataFrame:
    """Ids or places, written once; they travel with the tasks up to a bound that is read first."""
    return small_side(_cut(df), GONE_ROWS, MAX_QUERY_BYTES)


def _voided(spark: SparkSession, root: str, found: list[Segment]) -> DataFrame:
    """`_gone, _until`: ids and the sequence before which their documents don't count any more."""
    return _few(_tables(spark, root, "dead", found).groupBy(F.col("id").alias("_gone")).agg(F.max("until").alias("_until")))


def _alive(df: DataFrame, voided: DataFrame) -> DataFrame:
    late = (F.col("id") == F.col("_gone")) & (F.col("seq") < F.col("_until"))
    return df.join(voided, late, "left_anti")


def _words(texts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Documents with the number of their words, their distinct words in order, and how often they have each."""
    spark = texts.sparkSession
    letters = spark.sparkContext.broadcast(word_letters(spark, _WORD_GAP))
    lower = texts.filter("id IS NOT NULL").select("id", F.lower(F.concat_ws(" ", *[F.col(c) for c in columns])).alias("_t"))
    kind = texts.schema["id"].dataType.simpleString()
    return lower.mapInArrow(lambda batches: count_words(batches, letters.value), f"id {kind}, length int, words array<string>, times array<long>")


def _buckets(docs: DataFrame) -> tuple[Column, int]:
    """The bucket of an id and length: a class of lengths, cut by a hash into buckets of about `BUCKET_DOCS` documents and no more
    than about `BUCKET_WORDS` words.  Also the number of ranges that the words of the documents take."""
    kind = lambda: F.floor(F.log2(F.col("length") + 1) * CLASSES).cast("int")
    # A few hundred: lengths are bounded by their logarithm.
    counts = docs.groupBy(kind().alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("words")).collect()
    shares = F.create_map(*[F.lit(x) for r in counts for x in (r["kind"], max(-(-r["n"] // BUCKET_DOCS), -(-r["words"] // BUCKET_WORDS)))]) if counts else F.create_map(F.lit(0), F.lit(1))
    part = F.pmod(F.xxhash64("id"), F.coalesce(F.element_at(shares, kind()), F.lit(1)))
    return F.shiftleft(kind().cast("long"), 40) + part, max(1, -(-sum(r["words"] for r in counts) // BUCKET_WORDS))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of documents (bucket, id, length, words, times) sorted by bucket, the blocks of some whole buckets at a time."""
    held, words, last = [], 0, None
    for batch in batches:
        bucket, length = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        edges = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1), len(bucket)] if len(bucket) else [0]
        for low, high in zip(edges, edges[1:]):
            if words >= BUCKET_WORDS // 2 and bucket[low] != last:
                yield _block_rows(pa.concat_batches(held))
                held, words = [], 0
            held.append(batch.slice(low, high - low))
            words, last = words + int(length[low:high].sum()), bucket[low]
    if words:
        yield _block_rows(pa.concat_batches(held))


def _block_rows(docs: pa.RecordBatch) -> pa.RecordBatch:
    docs = docs.take(pc.sort_indices(docs, sort_keys=[("bucket", "ascending"), ("id", "ascending")]))
    bucket, ids, length, words, times = docs.columns
    doc = np.repeat(np.arange(len(docs)), pc.list_value_length(words).to_numpy())
    coded = words.flatten().dictionary_encode()
    in_order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(in_order), np.int64)
    rank[in_order] = np.arange(len(in_order))
    token = rank[coded.indices.to_numpy()]
    # A document has a word once, and documents are in order of their buckets: postings by word, bucket and document.
    order = np.argsort(token * len(docs) + doc)
    token, doc, tf = token[order], doc[order], times.flatten().to_numpy()[order]
    here, size = bucket.to_numpy()[doc], length.to_numpy()[doc]
    starts = np.append(0, np.flatnonzero((token[1:] != token[:-1]) | (here[1:] != here[:-1])) + 1)
    ends = np.append(starts, len(token))
    postings = pa.StructArray.from_arrays([ids.take(pa.array(doc)), pa.array(tf), pa.array(size)], ["id", "tf", "length"])
    return pa.RecordBatch.from_arrays(
        [coded.dictionary.take(pa.array(in_order[token[starts]])), pa.array(here[starts]), pa.array(np.diff(ends)),
         pa.array(np.maximum.reduceat(tf, starts)), pa.array(np.minimum.reduceat(size, starts)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), postings)],
        ["token", "bucket", "n", "max_tf", "min_length", "postings"])


def _write_docs(root: str, docs: DataFrame) -> tuple[str, DataFrame]:
    """The folder of a new segment, and its documents as written there."""
    folder = f"segment-{uuid.uuid4().hex}"
    docs.write.parquet(f"{root}/{folder}/docs")
    return folder, docs.sparkSession.read.parquet(f"{root}/{folder}/docs")


def _write_blocks(root: str, folder: str, docs: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """The blocks of a segment, sorted by ranges of words, from its documents (id, length, words, times) or their postings
    (token, id, tf, length).  Returned as written.

    Whole documents move to their bucket, where their words are put together; of postings, one a row, none move.
    """
    spark = docs.sparkSession
    bucket, ranges = _buckets(docs)
    if postings is None:
        dealt = docs.select(bucket.alias("bucket"), "id", "length", "words", "times").repartition(ranges, "bucket").sortWithinPartitions("bucket")
        kind = docs.schema["id"].dataType.simpleString()
        made = "token string, bucket long, n long, max_tf long, min_length int"
        blocks = dealt.mapInArrow(_blocks, f"{made}, postings array<struct<id:{kind},tf:long,length:int>>")
    else:
        blocks = postings.withColumn("bucket", bucket).groupBy("token", "bucket").agg(
            F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("length").alias("min_length"),
            F.array_sort(F.collect_list(F.struct("id", "tf", "length"))).alias("postings"))  # a bucket's documents at most
    blocks = blocks.repartitionByRange(ranges, "token", "bucket").sortWithinPartitions("token", "bucket")
    blocks.write.parquet(f"{root}/{folder}/blocks")
    return spark.read.parquet(f"{root}/{folder}/blocks")


def _counts(words: DataFrame, docs: DataFrame, sign: int = 1) -> DataFrame:
    """From words with their numbers of documents (token, n), and documents: those of each word, and under the empty word all documents and their length."""
    every = docs.select(F.lit("").alias("token"), F.lit(1).cast("long").alias("n"), F.col("length").cast("long").alias("length"))
    rows = words.select("token", F.col("n").cast("long").alias("n"), F.lit(0).cast("long").alias("length")).unionByName(every)
    return rows.groupBy("token").agg((sign * F.sum("n")).alias("df"), (sign * F.sum("length")).alias("total"))


def update(spark: SparkSession, root: str, changed: DataFrame, columns: Sequence[str], removed: DataFrame | None = None) -> Segment:
    """Bring the index under ``root`` (made if there is none) up to date: documents of ``changed`` (id and texts) come or are
    replaced, those of ``removed`` (id) go.

    One segment is written, as large as the change: the documents, their postings, the ids of the index that they void and
    by how much each word's number of documents rises or falls.  Ids are distinct within a change; null ids are left out.
    One writer at a time; readers go on with the version that they began with.
    """
    found = segments(spark, root)
    seq = max((s.seq for s in found), default=-1) + 1
    # Texts are cut into words once; all else comes from what is written here.
    folder, docs = _write_docs(root, _words(changed, columns))
    dead = f"{root}/{folder}/dead"
    stats = _counts(_write_blocks(root, folder, docs).select("token", "n"), docs)
    if not found:
        docs.select("id", F.lit(seq).cast("long").alias("until")).limit(0).write.parquet(dead)
    else:
        gone = docs.select("id") if removed is None else docs.select("id").unionByName(removed.select("id"))
        old = _alive(_tables(spark, root, "docs", found), _voided(spark, root, found))
        old.select("id").join(_few(gone.distinct()), "id", "left_semi").select("id", F.lit(seq).cast("long").alias("until")).write.parquet(dead)
        # The words of documents are read where these go only.
        old = old.join(small_side(spark.read.parquet(dead).select("id"), GONE_ROWS, MAX_QUERY_BYTES), "id", "left_semi")
        less = _counts(old.select(F.explode("words").alias("token"), F.lit(1).alias("n")), old, -1)
        stats = stats.unionByName(less).groupBy("token").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    stats.write.parquet(f"{root}/{folder}/stats")
    made = Segment(folder, seq, docs.count())
    _publish(spark, root, [*found, made])
    return made


def merge(spark: SparkSession, root: str, fan: int = FAN) -> int:
    """Merge segments of about equal size, ``fan`` at a time, until no ``fan`` of a size are left; how many merges it took.

    Sizes go by powers of ``fan``, the smallest first, so a document is rewritten once for each power that it climbs.
    Postings of voided documents are dropped, and voided ids that no older segment holds any more.  The merged segment is
    sorted by ranges of words.  Folders of merged segments aren't read any more; the caller removes them when no reader is
    left on them.
    """
    merges = 0
    while True:
        found = segments(spark, root)
        tiers: dict[int, list[Segment]] = {}
        for s in found:
            tiers.setdefault(int(math.log(max(s.docs, 1), fan)), []).append(s)
        due = [tiers[t] for t in sorted(tiers) if len(tiers[t]) >= fan]
        if not due:
            return merges
        merged = due[0]
        rest = [s for s in found if s not in merged]
        _merge(spark, root, found, merged, rest)
        merges += 1


def _merge(spark: SparkSession, root: str, found: list[Segment], merged: list[Segment], rest: list[Segment]) -> None:
    seq = max(s.seq for s in merged)
    voided = _voided(spark, root, found)
    docs = _alive(_tables(spark, root, "docs", merged), voided)
    # Segments of before have words alone, how often a document has them is in their blocks.
    timed = all("times" in spark.read.parquet(f"{root}/{s.folder}/docs").columns for s in merged)
    postings = None if timed else _alive(_tables(spark, root, "blocks", merged).select("token", "seq", F.explode("postings").alias("p")).select(
        "token", "seq", "p.id", "p.tf", "p.length"), voided).drop("seq")
    oldest = min((s.seq for s in rest), default=None)
    dead = _tables(spark, root, "dead", merged).select("id", "until")
    dead = dead.limit(0) if oldest is None else dead.filter(F.col("until") > oldest)
    stats = _tables(spark, root, "stats", merged).groupBy("token").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    folder, kept = _write_docs(root, docs.select("id", "length", "words", *(["times"] if timed else [])))
    _write_blocks(root, folder, kept, postings)
    dead.write.parquet(f"{root}/{folder}/dead")
    stats.filter("df <> 0 OR total <> 0 OR token = ''").write.parquet(f"{root}/{folder}/stats")
    _publish(spark, root, [*rest, Segment(folder, seq, kept.count())])


def _gain(idf: Column, tf: Column, length: Column, mean: Column) -> Column:
    return idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / mean))


def search(spark: SparkSession, root: str, queries: DataFrame, k: int, *, allowed: DataFrame | None = None,
           waves: Sequence[int] = WAVES, report: bool = False):
    """The ``k`` best documents that hold all words of a query, by BM25: ``query_id, id, score, rank``, as ``bm25`` has it.

    A bucket counts only where all words of the query have a block in it, and its bound is the sum of theirs.  Buckets are
    scored in waves, the highest bounds first: once a query has ``k`` documents, buckets that can't reach the score of the
    last of them are never unpacked.  The last wave takes all others that can, so the answer is exact.  Weights follow the
    documents that the index holds now.  With ``report`` also ``query_id, buckets, scored, postings, unpacked``.
    """
    found = segments(spark, root)
    terms, hint, wanted = _wanted(queries)
    stats = _tables(spark, root, "stats", found).join(hint(wanted), "token", "left_semi").groupBy("token").agg(
        F.sum("df").alias("_df"), F.sum("total").alias("_total"))
    every = stats.filter("token = ''").agg(F.max("_df").alias("n"), F.max("_total").alias("total")).first()
    n, mean = every["n"] or 0, F.lit(float(every["total"] or 0) / (every["n"] or 1))
    idf = F.log((n - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    known = terms.join(stats.filter("token <> '' AND _df > 0"), "token").select(
        "query_id", "token", "n_terms", F.when(idf <= 0, F.lit(IDF_FLOOR)).otherwise(idf).alias("_idf"))
    weighted = _cut(known)
    # The blocks are gone through once.  Those of words that are asked for are kept, dealt by bucket, as a word may have many.
    blocks = _cut(_tables(spark, root, "blocks", found).join(hint(weighted.select("token").distinct()), "token", "left_semi").select(
        "seg", "seq", "bucket", "token", "n", "max_tf", "min_length", *[F.col(f"postings.{c}").alias(c) for c in ("id", "tf", "length")]).repartition("seg", "bucket"))
    bound = _gain(F.col("_idf"), F.col("max_tf"), F.col("min_length"), mean)
    spots = blocks.select("seg", "seq", "bucket", "token", "n", "max_tf", "min_length").join(hint(weighted), "token").groupBy(
        "query_id", "n_terms", "seg", "seq", "bucket").agg(F.count(F.lit(1)).alias("_have"), F.sum(bound).alias("_bound"), F.sum("n").alias("_n"))
    order = Window.partitionBy("query_id").orderBy(F.desc("_bound"), "seg", "bucket")
    spots = _cut(spots.filter("_have = n_terms").withColumn("_place", F.row_number().over(order)))
    voided = _voided(spark, root, found)

    def scored(chosen: DataFrame) -> DataFrame:
        places = chosen.select("query_id", "seg", "bucket")
        if is_small(places, GONE_ROWS, MAX_QUERY_BYTES):
            # Words and places travel, so that no block is shuffled.
            rows = blocks.drop("n").join(hint(weighted), "token").join(F.broadcast(places), ["query_id", "seg", "bucket"])
        else:
            rows = blocks.drop("n").join(places.join(hint(weighted), "query_id"), ["seg", "bucket", "token"])
        rows = rows.select("query_id", "n_terms", "seg", "seq", "token", "_idf", F.explode(F.arrays_zip("id", "tf", "length")).alias("p"))
        gain = _gain(F.col("_idf"), F.col("p.tf"), F.col("p.length"), mean)
        hits = rows.groupBy("query_id", "n_terms", "seg", "seq", F.col("p.id").alias("id")).agg(
            F.array_sort(F.collect_list(F.struct("token", gain.alias("gain")))).alias("_gains")).filter(F.size("_gains") == F.col("n_terms"))
        # Added up in order of words, so that equal documents have equal scores to the last digit.
        hits = _alive(hits, voided).select("query_id", "id", F.aggregate("_gains", F.lit(0.0), lambda s, g: s + g["gain"]).alias("score"))
        if allowed is not None:
            hits = hits.join(allowed.select("id"), "id", "left_semi")
        return _cut(top_per_key(hits, ["query_id"], [F.col("score").desc(), F.col("id").asc()], k))

    best, taken, low = None, None, 0
    for high in [*waves, None]:
        chosen = spots.filter(F.col("_place") > low) if high is None else spots.filter(F.col("_place").between(low + 1, high))
        if best is not None:
            last = top_per_key(best, ["query_id"], [F.col("score").desc(), F.col("id").asc()], k, "_rank").filter(F.col("_rank") == k).select(
                F.col("query_id").alias("_q"), F.col("score").alias("_least"))
            chosen = chosen.join(hint(last), F.col("query_id") == F.col("_q"), "left").filter(
                F.col("_least").isNull() | (F.col("_bound") * (1 + SLACK) >= F.col("_least"))).drop("_q", "_least")
        chosen = _cut(chosen)
        more = scored(chosen)
        best = more if best is None else best.unionByName(more)
        taken = chosen if taken is None else taken.unionByName(chosen)
        low = high
    ranked = top_per_key(best, ["query_id"], [F.col("score").desc(), F.col("id").asc()], k, "rank")
    if not report:
        return ranked
    work = lambda df, a, b: df.groupBy("query_id").agg(F.count(F.lit(1)).alias(a), F.sum("_n").alias(b))
    return ranked, work(spots, "buckets", "postings").join(work(taken, "scored", "unpacked"), "query_id").select(
        "query_id", "buckets", "scored", "postings", "unpacked")
