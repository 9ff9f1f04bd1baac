"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.chunks import chunked, sums
from millrace.llm.common import named
from millrace.llm.sampling import thinned

#: Texts of each language that a model is fitted on, at most.
TRAIN_ROWS = 3000
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Language of texts without a letter.
UNKNOWN = "und"


def _grams(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of each chunk, in lower case and between blanks; where each chunk begins and ends."""
    padded = [f" {c.lower()} " for c in chunks]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), "<u4").astype(np.uint64)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(codes))  # characters to the end of the chunk
    found = np.zeros((len(ORDERS), len(codes)), np.int64)
    held = np.zeros((len(ORDERS), len(codes)), bool)
    for row, n in enumerate(ORDERS):
        value = np.full(len(codes), 1469598103934665603 + n, np.uint64)
        for j in range(n):
            value = (value ^ np.roll(codes, -j)) * np.uint64(1099511628211)
            value ^= value >> np.uint64(29)
        found[row] = (value % np.uint64(BUCKETS)).astype(np.int64)
        held[row] = left >= n
    found, held = found.T.ravel(), held.T.ravel()
    counts = np.concatenate([[0], np.cumsum(held)])
    cuts = counts[np.concatenate([[0], ends]) * len(ORDERS)]
    return found[held], cuts


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities by bucket, from rows with a text and a language.

    At most about `train_rows` texts of each language are read, whole.  Counts are added up on the executors; the driver
    gets one row for each language and bucket that occurs, so 65 536 numbers for a language.
    """
    rows = named(docs, text=text, lang=lang).dropna()
    sample = thinned(rows, train_rows, "lang", "lang", "text")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for part in chunked(batch.column("text")):
                buckets, cuts = _grams(part.chunks)
                of_part = np.asarray([langs[r] for r in part.rows], dtype=object)
                for name in set(of_part):
                    here = np.repeat(of_part == name, np.diff(part.cuts))
                    times = np.bincount(part.index[here], minlength=len(part.chunks))
                    add = np.bincount(buckets, np.repeat(times, np.diff(cuts)), BUCKETS)
                    totals[name] = totals.get(name, 0) + add
        for name, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))],
                ["lang", "bucket", "n"])

    found = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n")).toPandas()
    names = sorted(found["lang"].unique())
    counts = np.full((len(names), BUCKETS), 0.2)
    place = {name: i for i, name in enumerate(names)}
    np.add.at(counts, (found["lang"].map(place).to_numpy(dtype=np.int64), found["bucket"].to_numpy()), found["n"].to_numpy())
    return names, np.log(counts / counts.sum(axis=1, keepdims=True))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, lang_pred, score` of every row: the likeliest language of the whole text and its posterior probability.

    A text that is null, empty or without a letter is `und` with score 0; so is every text where nothing was learned.
    Repeated rows are scored each; ties go to the first language in order.
    """
    names, logs = model
    source = named(docs, doc_id=doc_id, text=text)
    shared = source.sparkSession.sparkContext.broadcast(logs.astype(np.float32))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            n = batch.num_rows
            letters = np.zeros(n)
            likely = np.zeros((len(names), n))
            for part in chunked(batch.column("text")):
                has = np.fromiter((any(ch.isalpha() for ch in c) for c in part.chunks), np.float64, len(part.chunks))
                np.add.at(letters, part.rows, sums(has[part.index], part.cuts))
                buckets, cuts = _grams(part.chunks)
                for k in range(len(names)):
                    of_chunk = sums(table[k][buckets], cuts)
                    np.add.at(likely[k], part.rows, sums(of_chunk[part.index], part.cuts))
            if names:
                best = likely.argmax(axis=0)
                chance = 1 / np.exp(likely - likely.max(axis=0)).sum(axis=0)
            else:
                best, chance, letters = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            known = letters > 0
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([names[b] if k else UNKNOWN for b, k in zip(best, known)], pa.string()),
                pa.array(np.where(known, chance, 0.0)),
            ], ["doc_id", "lang_pred", "score"])

    return source.mapInArrow(score, f"doc_id {id_type}, lang_pred string, score double")
