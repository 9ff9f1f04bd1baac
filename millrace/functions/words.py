"""Words of texts, cut and counted in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are cut at a time; a longer text by itself.
CUT_BYTES = 4 << 20


def word_letters(spark: SparkSession, pattern: str) -> np.ndarray:
    """For each code point whether it is part of a word.  The session's own regular expressions say so: ``pattern`` is a gap."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    left = spark.createDataFrame([(every,)], "t string").select(F.regexp_replace("t", pattern, "")).collect()[0][0]
    table = np.zeros(0x110000, bool)
    table[np.frombuffer(left.encode("utf-32-le"), np.uint32)] = True
    return table


#: By length of a character in UTF-8 above 1: the bits that mark its first byte, these marks, and the bits that it holds.
_LEADS = {2: (0xE0, 0xC0, 0x1F), 3: (0xF0, 0xE0, 0x0F), 4: (0xF8, 0xF0, 0x07)}


def _is_word(data: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 whether it is part of a word."""
    word = np.append(letters[:128], np.zeros(128, bool))[data]
    for size, (mask, mark, bits) in _LEADS.items():
        lead = np.flatnonzero((data & mask) == mark)
        if len(lead):
            point = (data[lead] & bits).astype(np.int32)
            for i in range(1, size):
                point = (point << 6) | (data[lead + i] & 0x3F)
            for i in range(size):
                word[lead + i] = letters[point]
    return word


def _sound(texts: pa.Array) -> pa.Array:
    """Bytes that are no UTF-8 become the replacement character, which is part of no word."""
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:
        return pa.array([t.decode(errors="replace") for t in texts.cast(pa.large_binary()).to_pylist()], pa.large_string())
    return texts


def _counted(texts: pa.Array, letters: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Of each text the number of its words, its distinct words in order, and how often it has each."""
    texts = _sound(texts)
    n = len(texts)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    word = _is_word(data, letters)
    first = word.copy()
    first[1:] &= ~word[:-1]
    opens = at[:-1][at[:-1] < len(word)]
    first[opens] = word[opens]
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    starts = np.flatnonzero(first)
    length = np.diff(np.searchsorted(starts, at))
    # The bytes of the words alone, one after the other, are the buffer of an array of words.
    places = np.append(0, np.cumsum(np.flatnonzero(last) + 1 - starts)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(data[word]))
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    many = max(len(order), 1)
    keys, times = np.unique(np.repeat(np.arange(n), length) * many + rank[coded.indices.to_numpy()], return_counts=True)
    ends = pa.array(np.searchsorted(keys, np.arange(n + 1) * many), pa.int32())
    found = coded.dictionary.take(pa.array(order[keys % many])).cast(pa.string())
    return length, pa.ListArray.from_arrays(ends, found), pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))


def count_words(batches: Iterator[pa.RecordBatch], letters: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of batches of id and lower-case text: id, length, words, times.  Texts are cut some megabytes at a time, so that what
    is held follows neither the batch nor the table."""
    for batch in batches:
        texts = batch.column(1).cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else [0]
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + CUT_BYTES, side="right")) - 1)
            length, words, times = _counted(texts.slice(low, high - low), letters)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(low, high - low), pa.array(length, pa.int32()), words, times], ["id", "length", "words", "times"])
            low = high
