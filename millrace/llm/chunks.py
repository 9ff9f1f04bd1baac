"""Texts of Arrow batches as chunks between ASCII white space: every distinct chunk of a part once, and where it stands."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_GAP = re.compile(rb"[ \t\n\r\x0b\f]")


class Chunked(NamedTuple):
    """A part of a batch.  Text j of the part belongs to row `rows[j]` and is the chunks `index[cuts[j]:cuts[j + 1]]`."""

    rows: np.ndarray
    chunks: list[str]
    index: np.ndarray
    cuts: np.ndarray


def segments(text: bytes, size: int = 1 << 22) -> Iterator[bytes]:
    """A text in parts of about `size` bytes, parted at white space."""
    at = 0
    while len(text) - at > size:
        found = _GAP.search(text, at + size)
        if not found:
            break
        yield text[at:found.end()]
        at = found.end()
    yield text[at:]


def by_volume(texts: pa.Array, volume: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of an array of texts that hold about `volume` bytes each."""
    first = total = 0
    for i, size in enumerate(pc.binary_length(texts).to_pylist()):
        total += size or 0
        if total >= volume:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct chunks, the chunk at every place, and where each text begins and ends."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    found = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy()
    return found.dictionary, found.indices.to_numpy(zero_copy_only=False), offsets - offsets[0]


def chunked(texts: pa.Array) -> Iterator[Chunked]:
    """A batch of texts in parts of bounded size.  A very long text comes in several parts, with the same row."""
    for first, last in by_volume(texts):
        if last - first > 1:
            chunks, index, cuts = split(texts.slice(first, last - first))
            yield Chunked(np.arange(first, last), chunks.to_pylist(), index, cuts)
        else:
            for part in segments((texts[first].as_py() or "").encode()):
                chunks, index, cuts = split(pa.array([part.decode()], pa.string()))
                yield Chunked(np.array([first]), chunks.to_pylist(), index, cuts)


def sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of values between the cuts; 0 between equal cuts."""
    ends = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return ends[cuts[1:]] - ends[cuts[:-1]]
