"""Hashes of the words of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Keep the first so many bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_A, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C
    x = (x ^ (x >> np.uint64(27))) * _D
    return x ^ (x >> np.uint64(31))


def portions(batches: Iterator[pa.RecordBatch], column: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about so many bytes in a binary column, a row at least, so that what is worked out for their words
    stays small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        start = 0
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of binary texts (not null), one after another, and where each text's words begin (with the
    number of all words at the end). Words are runs of other than ASCII white space, with A-Z in lower case."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    size = int(offsets[-1] - offsets[0])
    if not size:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    # Eight bytes more, so that the last word can be read in eights.
    data = np.zeros(size + 8, np.uint8)
    data[:size] = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8, size, int(offsets[0]))]
    offsets -= offsets[0]
    space = _SPACE[data[:size]]
    # Words end with their text.
    opens = ~space
    closes = opens.copy()
    inner = offsets[(offsets > 0) & (offsets < size)]
    border = np.zeros(size, bool)
    border[inner] = True
    opens[1:] &= space[:-1] | border[1:]
    closes[:-1] &= space[1:] | border[1:]
    start = np.flatnonzero(opens)
    length = np.flatnonzero(closes) + 1 - start
    eights = np.ndarray(size + 1, "<u8", data, strides=(1,))
    hashes = mixed((eights[start] & _FIRST[np.minimum(length, 8)]) + length.astype(np.uint64) * _A)
    longer = np.flatnonzero(length > 8)
    done = 8
    while len(longer):
        part = eights[start[longer] + done] & _FIRST[np.minimum(length[longer] - done, 8)]
        hashes[longer] = mixed(hashes[longer] * _A ^ part)
        done += 8
        longer = longer[length[longer] > done]
    return hashes, np.searchsorted(start, offsets)
