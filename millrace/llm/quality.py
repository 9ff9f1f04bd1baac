"""Quality classifier: logistic regression over hashed word n-grams, fitted by follow-the-regularised-leader updates."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.chunks import Chunked, chunked, sums
from millrace.llm.common import named
from millrace.llm.sampling import thinned

#: Labelled texts of each class that a model is fitted on, at most.
TRAIN_ROWS = 4000
BUCKETS = 1 << 18
#: A feature's value is its share of the text's n-grams times this.
SCALE = 10.0
#: Words keep their case; runs of punctuation are words too.
_TOKEN = re.compile(r"\w+|[^\w\s]+")


#: A word and itself again is one feature, whatever the word.
_TWICE = np.uint64(1)


class Model(NamedTuple):
    weights: np.ndarray
    bias: float


def _features(part: Chunked) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and word pairs of each text of a part, and where each text begins and ends."""
    of_chunk = [[zlib.crc32(t.encode()) for t in _TOKEN.findall(c)] for c in part.chunks]
    sizes = np.fromiter(map(len, of_chunk), np.int64, len(of_chunk))
    pool = np.fromiter((h for hs in of_chunk for h in hs), np.uint64, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    ends = np.concatenate([[0], np.cumsum(sizes[part.index])]).astype(np.int64)
    words = pool[np.repeat(starts[part.index] - ends[:-1], sizes[part.index]) + np.arange(ends[-1])]
    cuts = ends[part.cuts]
    pairs = words * np.uint64(0x9E3779B97F4A7C15)
    pairs[:-1] ^= words[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    pairs ^= pairs >> np.uint64(31)
    pairs[:-1][words[1:] == words[:-1]] = _TWICE
    held = np.ones(len(words), bool)
    held[cuts[1:][cuts[1:] > cuts[:-1]] - 1] = False  # the last word of a text begins no pair
    both = np.stack([words, pairs], axis=1) % np.uint64(BUCKETS)
    keep = np.stack([np.ones(len(words), bool), held], axis=1).ravel()
    counts = np.concatenate([[0], np.cumsum(keep)])
    return both.ravel()[keep].astype(np.int64), counts[2 * cuts]


def _sparse(features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = np.unique(features, return_counts=True)
    return at.astype("<u4"), (n * (SCALE / max(1, len(features)))).astype("<f4")


def _train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int, alpha: float, beta: float, l1: float, l2: float) -> Model:
    """Follow-the-regularised-leader, coordinate by coordinate, one text after another in a fixed mixed order."""
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    zb = nb = bias = 0.0
    each = [max(1, sum(r[2] == c for r in rows)) for c in (0, 1)]
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, value, label = rows[i]
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            bias = -zb / ((beta + np.sqrt(nb)) / alpha)
            p = 1 / (1 + np.exp(-np.clip(bias + w @ value, -35, 35)))
            g = (p - label) * len(rows) / (2 * each[label])  # both classes weigh the same
            grads = g * value
            z[at] = zi + grads - (np.sqrt(ni + grads * grads) - np.sqrt(ni)) / alpha * w
            n[at] = ni + grads * grads
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * bias
            nb += g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return Model(w.astype(np.float32), float(-zb / ((beta + np.sqrt(nb)) / alpha)))


def fit(
    docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text",
    label: str = "quality", epochs: int = 3, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.05, l2: float = 1.0,
) -> Model:
    """A model from labelled texts, label 0 or 1; at most about `train_rows` whole texts of each class.

    Rows without label, id or text teach nothing; an id with several labels counts with the highest.  The executors count
    n-grams, the driver gets the sparse counts of the sample and makes the updates, which go one after the other.
    """
    marks = named(labels, doc_id=doc_id, label=label).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    drawn = thinned(marks.where(F.col("label").isin(0, 1)), train_rows, "label", "doc_id")
    # The draw has at most some thousand ids, whatever the size of the tables.
    rows = named(docs, doc_id=doc_id, text=text).where(F.col("text").isNotNull()).join(F.broadcast(drawn), "doc_id")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column("label").to_pylist()
            for part in chunked(batch.column("text")):
                features, cuts = _features(part)
                found = [_sparse(features[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([
                    pa.array([x.tobytes() for x, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary()),
                    pa.array([marks[r] for r in part.rows], pa.int32()),
                ], ["at", "value", "label"])

    sample = rows.select("text", F.col("label").cast("int").alias("label")).mapInArrow(count, "at binary, value binary, label int")
    found = sorted((bytes(r[0]), bytes(r[1]), r[2]) for r in sample.toLocalIterator(prefetchPartitions=True))
    examples = [(np.frombuffer(a, "<u4").astype(np.int64), np.frombuffer(v, "<f4"), y) for a, v, y in found]
    return _train(examples, epochs, alpha, beta, l1, l2)


def grade(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, score` of every row: the probability of label 1 for the whole text.

    A null or empty text has no n-gram and gets the score of the bias alone.  Repeated rows are scored each.
    """
    source = named(docs, doc_id=doc_id, text=text)
    shared = source.sparkSession.sparkContext.broadcast(tuple(model))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            dots, sizes = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for part in chunked(batch.column("text")):
                features, cuts = _features(part)
                np.add.at(dots, part.rows, sums(weights[features], cuts))
                np.add.at(sizes, part.rows, np.diff(cuts))
            value = bias + SCALE * dots / np.maximum(sizes, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(value, -35, 35))))], ["doc_id", "score"])

    return source.mapInArrow(score, f"doc_id {id_type}, score double")
