"""K-mers as 2-bit numbers, for k up to 31: vectorised inside tasks, 2^18 bases at a time.

Sequences are taken as bytes, each other character than a base as one invalid letter. A long sequence is worked
through in pieces that overlap by k - 1 bases, so memory does not grow with its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import POLICIES, check_order

MOST_K = 31
#: Bases that are worked on at once.
CHUNK = 1 << 18
#: K-mers that a task sorts before it hands counts on.
HELD = 1 << 18
#: Possible k-mers up to which a task keeps one count for each instead of k-mers to sort.
CELLS = 1 << 18
INVALID = 4
U = np.uint64


def as_bytes(seq: str | None) -> bytes:
    """One byte per character; NUL is kept free as a separator."""
    return (seq or "").replace("\0", "?").encode("ascii", "replace")


def joined_texts(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as bytes, as many at a time as have CHUNK characters in all or a longer one alone, with the row of the first."""
    upto = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + CHUNK, "right")) - 1)
        yield at, [as_bytes(t) for t in texts.slice(at, to - at).to_pylist()]
        at = to


def base_table(order: str, policy: str) -> np.ndarray:
    """The code of each byte under an order of the bases; other letters are invalid, or A under ``replace_a``. NUL is always invalid."""
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}, not {policy!r}")
    table = np.full(256, order.index("A") if policy == "replace_a" else INVALID, np.uint8)
    table[0] = INVALID
    for i, base in enumerate(check_order(order)):
        table[[ord(base), ord(base.lower())]] = i
    return table


def complement(codes: np.ndarray, order: str) -> np.ndarray:
    return (codes ^ 2 if order == "ACTG" else 3 - codes) & 3


def _spelled(codes: np.ndarray, k: int, rising: bool) -> np.ndarray:
    """The numbers of k digits that begin at each place, by doubling; rising: the first digit is the lowest."""
    part, out, width, have = codes.astype(U), None, 1, 0
    while True:
        if k & width:
            if out is None:
                out = part
            else:
                n = len(part) - have
                out = out[:n] | part[have:] << U(2 * have) if rising else out[:n] << U(2 * width) | part[have:]
            have += width
        if have == k:
            return out
        part = part[:-width] | part[width:] << U(2 * width) if rising else part[:-width] << U(2 * width) | part[width:]
        width *= 2


def both_strands(codes: np.ndarray, k: int, order: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all k-mers, of their reverse complements, and which are valid."""
    if len(codes) < k:
        none = np.empty(0, U)
        return none, none, np.empty(0, bool)
    bad = np.concatenate([[0], np.cumsum(codes == INVALID)])
    return _spelled(codes & 3, k, False), _spelled(complement(codes, order), k, True), bad[k:] == bad[:-k]


def letters_of(numbers: np.ndarray, k: int, order: str) -> np.ndarray:
    """The spelling of each number, as rows of bytes."""
    shifts = np.arange(2 * (k - 1), -1, -2, dtype=U)
    return np.frombuffer(order.encode(), np.uint8)[(numbers[:, None] >> shifts & U(3)).astype(np.uint8)]


def strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Strings of the given lengths, laid end to end."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def check_k(k: int, most: int = MOST_K) -> int:
    if not 1 <= k <= most:
        raise ValueError(f"k must be between 1 and {most}")
    return k


def code_counts(seqs: DataFrame, k: int, policy: str = "skip", order: str | None = "ACGT", by: list[str] | None = None) -> DataFrame:
    """The columns ``by``, code and n: k-mers counted inside tasks, to be summed. order None: as read, numbered in ACGT order."""
    by, spelling = by or [], order or "ACGT"
    table = base_table(spelling, policy)
    check_k(k)

    def numbers(data: bytes) -> Iterator[np.ndarray]:
        codes = table[np.frombuffer(data, np.uint8)]
        for at in range(0, max(1, len(codes) - k + 1), CHUNK):
            forward, back, ok = both_strands(codes[at : at + CHUNK + k - 1], k, spelling)
            yield (forward if order is None else np.minimum(forward, back))[ok]

    def rows_of(key: tuple, codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        rows = pa.array(np.zeros(len(codes), np.int64))
        return pa.RecordBatch.from_arrays([*(x.take(rows) for x in key_rows[key]), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], [*by, "code", "n"])

    def counted(group: dict[tuple, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for key, parts in group.items():
            codes = np.concatenate(parts)
            parts.clear()
            codes.sort()
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, np.int64)
            if len(first):
                yield rows_of(key, codes[first], np.diff(first, append=len(codes)))

    key_rows: dict[tuple, list[pa.Array]] = {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict[tuple, list[np.ndarray]] = {}
        held = 0
        cells = np.zeros(4**k, np.int64) if not by and 4**k <= CELLS else None
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in by), strict=True)) if by else [()] * b.num_rows
            for first, texts in joined_texts(b.column("seq")):  # short sequences together, a separator between them
                lines: dict[tuple, list[bytes]] = {}
                for i, text in enumerate(texts, first):
                    if text:
                        lines.setdefault(keys[i], []).append(text)
                        if keys[i] not in key_rows:
                            key_rows[keys[i]] = [b.column(c).slice(i, 1) for c in by]
                for key, own in lines.items():
                    for codes in numbers(b"\0".join(own)):
                        if cells is not None:
                            cells += np.bincount(codes.view(np.int64), minlength=len(cells))
                            continue
                        group.setdefault(key, []).append(codes)
                        held += len(codes)
                        if held >= HELD:
                            yield from counted(group)
                            group, held = {}, 0
        yield from counted(group)
        if cells is not None and cells.any():
            codes = np.flatnonzero(cells)
            key_rows[()] = []
            yield rows_of((), codes, cells[codes])

    schema = ", ".join([*(f"`{c}` {seqs.schema[c].dataType.simpleString()}" for c in by), "code long", "n long"])
    return seqs.select(*by, "seq").mapInArrow(count, schema)


def spelled(code: str, k: int, order: str | None) -> F.Column:
    """The k-mer of a number in a column, as text."""
    from ..functions.alphabet import decode

    return decode(code, k, order or "ACGT")


class Minimizing:
    """Minimizers of one sequence after another: the smallest canonical m-mer of each k-mer, of equal ones the rightmost."""

    def __init__(self, k: int, m: int, order: str, policy: str, ban_aa: bool, ranks: np.ndarray | None, hashed: bool) -> None:
        self.k, self.m, self.order, self.ban_aa, self.ranks, self.hashed = k, m, order, ban_aa, ranks, hashed
        self.table = base_table(order, policy)
        self.upper = np.frombuffer(order.encode() + b"#", np.uint8)

    def codes(self, text: str | None) -> np.ndarray:
        return self.table[np.frombuffer(as_bytes(text), np.uint8)]

    def _values(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What m-mers are compared by, the number that is reported for each, and whether that is the reverse complement's."""
        from ..functions.hashing import mix64

        forward, back, _ = both_strands(codes, self.m, self.order)
        own = np.minimum(forward, back)
        shown = own
        banned = None
        if self.ban_aa:  # an m-mer with AA but at its start counts as the largest of all
            a = U(self.order.index("A"))
            digit = lambda j: own >> U(2 * (self.m - 1 - j)) & U(3)
            banned = np.zeros(len(own), bool)
            for j in range(1, self.m - 1):
                banned |= (digit(j) == a) & (digit(j + 1) == a)
            shown = np.where(banned, U((1 << 2 * self.m) - 1), own)
        value = shown
        if self.ranks is not None:
            value = self.ranks[own.astype(np.int64)].astype(U) << U(2 * self.m) | shown
        elif self.hashed:
            value = mix64(own) if banned is None else np.where(banned, ~U(0), mix64(own))
        return value, shown, back < forward

    def pieces(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """First place, reported m-mer, its place and validity of all k-mers, a piece of the sequence at a time."""
        for first, mini, place, ok, _, _ in self.flagged(codes):
            yield first, mini, place, ok

    def flagged(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """``pieces``, with whether the m-mer is the reverse complement of what stands there, and whether another m-mer of the k-mer compares equal."""
        width = self.k - self.m + 1
        for first in range(0, max(0, len(codes) - self.k + 1), CHUNK):
            part = codes[first : first + CHUNK + self.k - 1]
            value, shown, turned = self._values(part)
            n = len(part) - self.k + 1
            best, at, tied = value[width - 1 : width - 1 + n].copy(), np.full(n, width - 1, np.int32), np.zeros(n, bool)
            for j in range(width - 2, -1, -1):
                here = value[j : j + n]
                tied |= here == best
                less = here < best
                tied &= ~less
                at[less] = j
                np.minimum(best, here, out=best)
            bad = np.concatenate([[0], np.cumsum(part == INVALID)])
            place = at + np.arange(n)
            yield first, shown[place], place + first, bad[self.k :] == bad[: -self.k], turned[place], tied

    def runs(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First place, minimizer and number of k-mers of the runs of valid k-mers with one minimizer; they go on from one piece to the next."""
        starts, minis, valid, last = [], [], [], None
        for first, mini, _, ok in self.pieces(codes):
            turn = np.concatenate([[last is None or last[0] != mini[0] or last[1] != ok[0]], (mini[1:] != mini[:-1]) | (ok[1:] != ok[:-1])])
            x = np.flatnonzero(turn)
            starts.append(x + first)
            minis.append(mini[x])
            valid.append(ok[x])
            last = mini[-1], ok[-1]
        if not starts:
            return np.empty(0, np.int64), np.empty(0, U), np.empty(0, np.int64)
        start, mini, ok = (np.concatenate(a) for a in (starts, minis, valid))
        size = np.diff(np.concatenate([start, [len(codes) - self.k + 1]]))
        return start[ok], mini[ok], size[ok]
