"""Sequences in two bits per base, four to a byte and the first one highest, many at a time over Arrow arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..operators.packed import INVALID, as_bytes, base_table, strings

LETTERS = "ACTG"
#: Bases that are worked on at once; a longer sequence alone.
CHUNK = 1 << 18
_CODES = base_table(LETTERS, "skip")
_SPELLED = np.frombuffer(LETTERS.encode(), np.uint8)[np.arange(256, dtype=np.uint8)[:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3]


def slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most CHUNK bases in all, or of one row."""
    upto, at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + CHUNK, "right")) - 1)
        yield at, to
        at = to


def places(start: np.ndarray, size: np.ndarray) -> np.ndarray | slice:
    """The places of runs, one after another."""
    if len(start) == 1:
        return slice(int(start[0]), int(start[0] + size[0]))
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def binaries(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of binary values, and where each begins, with the end of the last; null is empty."""
    whole = pc.fill_null(array.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
    data = whole.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), offsets


def packed(codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The runs of codes as binary values."""
    wide = -(-size // 4)
    ends = np.cumsum(wide)
    four = np.zeros(4 * int(wide.sum()), np.uint8)
    four[places(4 * (ends - wide), size)] = codes[places(start, size)]
    four = four.reshape(-1, 4)
    data = four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(data.tobytes())])


def unpacked(data: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.Array:
    """Sequences of n bases whose bytes begin at ``start``."""
    wide = -(-n // 4)
    letters = _SPELLED[data[places(start, wide)]].ravel()
    return strings(letters[places(4 * (np.cumsum(wide) - wide), n)], n)


def pieces(texts: pa.Array, min_length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """Row, number in its row, length and packed bases of the pieces between other letters that have min_length bases at least."""
    for first, to in slices(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)):
        own = [as_bytes(t) for t in texts.slice(first, to - first).to_pylist()]
        begins = np.cumsum([0, *(len(x) + 1 for x in own)])
        codes = _CODES[np.frombuffer(b"\0".join(own), np.uint8)]
        edges = np.diff(np.concatenate([[0], (codes != INVALID).view(np.int8), [0]]).astype(np.int8))
        start = np.flatnonzero(edges == 1)
        size = np.flatnonzero(edges == -1) - start
        row = np.searchsorted(begins, start, "right") - 1
        number = np.arange(len(row)) - np.searchsorted(row, row)
        kept = size >= min_length
        start, size, row, number = start[kept], size[kept], row[kept] + first, number[kept]
        for i, j in slices(size):
            yield row[i:j], number[i:j], size[i:j], packed(codes, start[i:j], size[i:j])
