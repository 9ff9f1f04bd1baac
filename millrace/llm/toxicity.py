"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; texts drawn without regard to labels, toxic ones among them, are the unlabelled.
With the class prior p, the risk of a classifier is p * R+(positives) + max(0, R-(unlabelled) - p * R-(positives)), where
the last part is the negatives' risk as the unlabelled texts show it, kept from falling below zero.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.chunks import Chunked, chunked
from millrace.llm.common import free_name, named
from millrace.llm.sampling import thinned

#: Texts of either kind that a model is fitted on, at most.
TRAIN_ROWS = 6000
#: Features that a model keeps: those that tell positives from unlabelled texts best.
KEPT_FEATURES = 4096
#: Texts of the sample that must hold a feature.
LEAST_TEXTS = 5
#: Standard errors between its shares of positives and of unlabelled texts that a feature must have.
LEAST_GAP = 4.0
_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_STEM = 5


class Model(NamedTuple):
    features: np.ndarray
    weights: np.ndarray
    bias: float


def _hashes(chunk: str) -> tuple[int, ...]:
    """A chunk's word, and the beginning of a longer word, hashed."""
    word = chunk.strip(_STRIP).lower()
    if not word:
        return ()
    found = zlib.crc32(b"w" + word.encode())
    return (found, zlib.crc32(b"s" + word[:_STEM].encode())) if len(word) > _STEM else (found,)


def _text_features(part: Chunked) -> Iterator[np.ndarray]:
    """The distinct features of each text of a part."""
    of_chunk = np.full((len(part.chunks), 2), -1, np.int64)
    for i, c in enumerate(part.chunks):
        hs = _hashes(c)
        of_chunk[i, :len(hs)] = hs
    for a, b in zip(part.cuts[:-1], part.cuts[1:]):
        found = np.unique(of_chunk[np.unique(part.index[a:b])])
        yield found[found >= 0].astype("<u4")


def _texts_with(names: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """How many texts hold each feature, from the features of all texts, each once for a text."""
    found, counts = np.unique(pool, return_counts=True)
    out = np.zeros(len(names), np.int64)
    out[np.searchsorted(names, found)] = counts
    return out


def _train(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, epochs: int = 300, rate: float = 0.05) -> Model:
    """Full-batch Adam on the non-negative risk with the logistic loss, over the features that tell the two kinds apart."""
    n_pos, n_unl = max(1, len(pos)), max(1, len(unl))
    l2 = 0.2 / max(100, n_pos)  # the fewer positives, the less a feature is trusted
    pools = [np.concatenate([*texts, np.zeros(0, np.uint32)]) for texts in (pos, unl)]
    names = np.union1d(*pools)
    a, b = (_texts_with(names, pool) for pool in pools)
    share = (a + b) / (n_pos + n_unl)
    gap = (a / n_pos - b / n_unl) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_pos + 1 / n_unl))
    gap[a + b < LEAST_TEXTS] = 0
    best = np.argsort(-np.abs(gap), kind="stable")[:KEPT_FEATURES]
    kept = np.sort(names[best[np.abs(gap[best]) > LEAST_GAP]])
    sizes = np.fromiter(map(len, [*pos, *unl]), np.int64, len(pos) + len(unl))
    pool = np.concatenate(pools)
    col = np.searchsorted(kept, pool)
    held = np.flatnonzero(kept[np.minimum(col, len(kept) - 1)] == pool) if len(kept) else np.zeros(0, np.int64)
    row, col = np.searchsorted(np.cumsum(sizes), held, side="right"), col[held]
    w, bias = np.zeros(len(kept)), 0.0
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    is_pos = np.arange(len(sizes)) < len(pos)
    for step in range(1, epochs + 1):
        value = bias + np.bincount(row, w[col], len(sizes))
        p = 1 / (1 + np.exp(-np.clip(value, -35, 35)))  # slope of the loss as a negative; p - 1 as a positive
        neg_loss = np.logaddexp(0, value)
        negatives = neg_loss[~is_pos].sum() / n_unl - prior * neg_loss[is_pos].sum() / n_pos
        as_pos = np.where(is_pos, prior * (p - 1) / n_pos, 0.0)
        as_neg = np.where(is_pos, -prior * p / n_pos, p / n_unl)
        slope = as_pos + as_neg if negatives >= 0 else -as_neg  # below zero only the negatives' part is mended
        grad = np.append(np.bincount(col, slope[row], len(kept)) + l2 * w, slope.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        bias -= move[-1]
    return Model(kept.astype(np.int64), w, float(bias))


def fit(
    docs: DataFrame, unlabelled: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, prior: float | None = None,
    doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
) -> Model:
    """A model from confirmed positives (`labels` with 1, texts from `docs`) and the texts of `unlabelled`.

    At most about `train_rows` whole texts of either kind are read.  `prior` is the share of toxic texts; None takes the
    share of ones among the labels given, which is all that the zeros are used for.  Rows without label, id or text teach
    nothing; an id with several labels counts with the highest.  Without positives every text scores low.
    """
    marks = named(labels, doc_id=doc_id, label=label).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    if prior is None:
        ones, n = marks.select(F.sum((F.col("label") == 1).cast("int")), F.count("*")).first()
        prior = min(0.9, max(1e-3, (ones or 0) / n)) if n else 0.1
    positives = thinned(marks.where("label = 1"), train_rows, "label", "doc_id").select("doc_id")
    texts = named(docs, doc_id=doc_id, text=text).where(F.col("text").isNotNull())
    # The draw has at most some thousand ids, whatever the size of the tables.
    pos = texts.join(F.broadcast(positives), "doc_id").select("text", F.lit(1).alias("kind"))
    unl = thinned(
        named(unlabelled, doc_id=doc_id, text=text).where(F.col("text").isNotNull()).withColumn("kind", F.lit(0)),
        train_rows, "kind", "doc_id", "text").select("text", "kind")

    def collect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column("kind").to_pylist()
            for part in chunked(batch.column("text")):
                found = [x.tobytes() for x in _text_features(part)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.binary()), pa.array([kinds[r] for r in part.rows], pa.int32())], ["features", "kind"])

    sample = pos.unionByName(unl).mapInArrow(collect, "features binary, kind int")
    found = sorted((bytes(r[0]), r[1]) for r in sample.toLocalIterator(prefetchPartitions=True))
    kinds = [[np.frombuffer(x, "<u4") for x, kind in found if kind == k] for k in (1, 0)]
    return _train(kinds[0], kinds[1], prior)


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """All rows and columns of `docs` and the chance that the whole text is toxic, in column `into`; one of that name is replaced.

    A null or empty text has no feature and gets the score of the bias alone.  Repeated rows are scored each.
    """
    docs = docs.drop(into)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at = docs.columns.index(text)
    names = [*docs.columns, into]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weights, bias = shared.value
        place = {int(f): i for i, f in enumerate(features)}
        for batch in batches:
            held: list[set[int]] = [set() for _ in range(batch.num_rows)]
            for part in chunked(batch.column(at)):
                known = [[place[h] for h in _hashes(c) if h in place] for c in part.chunks]
                told = np.fromiter(map(bool, known), bool, len(known))
                found = np.flatnonzero(told[part.index])
                texts = part.rows[np.searchsorted(part.cuts, found, side="right") - 1]
                for pair in np.unique(texts * max(1, len(known)) + part.index[found]).tolist():
                    held[pair // len(known)].update(known[pair % len(known)])
            value = bias + np.array([weights[sorted(h)].sum() if h else 0.0 for h in held])
            chance = pa.array(1 / (1 + np.exp(-np.clip(value, -35, 35))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, chance], names)

    return docs.mapInArrow(run, f"{kinds}, `{into}` double")


def without_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of `docs`, with their columns, whose text scores below the limit."""
    into = free_name(docs, "toxicity")
    return score(docs, model, into=into).where(F.col(f"`{into}`") < limit).drop(into)
