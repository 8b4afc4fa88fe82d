"""Fuzzy repeated passages by collinear chaining of shared k-mer seeds.

Every document is cut into words (ASCII white space), compared in lower case without outer
punctuation. Of each ``window`` consecutive k-mers of words the one with the smallest hash is a seed,
so any shared run of window + k - 1 words shares a seed. Seeds are joined to the first place, in order
of (doc_id, position), where their k-mer occurs in the corpus: one match per seed, never all pairs
of a group. Per pair of documents the matches are chained in order with gap costs through a Fenwick
tree; the words along each chain are then aligned, and what scores as a passage of at least
``min_words`` words with a similarity of at least ``min_similarity`` is returned.

A repeat is thus linked to the first document that has it, which stands for the class of all its
copies. Where its parts first occur in different documents, spans of several seeds are joined, too, each to
the first document with the whole span, so that a run of words is found though its parts are older.
A chain ends where more than ``min_words`` words of either text hold no seed of it; what follows is a passage of its own.

Defined cases: null, empty and blank texts have no words and no passages; so have texts shorter than
``min_words``. What repeats inside one document only is no passage. Each row is judged by itself, whether its doc_id
is null or repeated or not; such tables are numbered by (doc_id, nulls last) first, in any order within an id. An empty table gives no rows. Other columns, whatever their names, pass through ``cut_passages``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import all_columns, free, named, partitions_for, released, staged, words

K = 5
WINDOW = 6
MIN_WORDS = 50
MIN_SIMILARITY = 0.8
#: Cost of a word skipped between two seeds of a chain; a seed earns 1.
GAP_COST = 1 / 64
#: Ids of documents with chains up to which they are broadcast to filter texts before the shuffle.
BROADCAST_IDS = 1_000_000
#: Slices of reference texts begin and end at multiples of so many words, so that hot passages ask for few different slices.
GRID = 64
#: Bytes of text that are hashed at once.
CHUNK = 1 << 18

PUNCTUATION = b".,;:!?\"'()[]"
SPACES = b"\t\n\x0b\x0c\r"
_LOWER = np.frombuffer(bytes(range(256)).lower().translate(bytes.maketrans(SPACES, b" " * len(SPACES))), np.uint8)
_OUTER = np.isin(np.arange(256), np.frombuffer(PUNCTUATION, np.uint8))
_BASE = 0x9E3779B97F4A7C15


def split_words(text: str | None) -> list[bytes]:
    """Words as compared: lower case (A-Z), outer punctuation off."""
    return [w.strip(PUNCTUATION) for w in (text or "").encode().lower().split()]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse, modulo 2**64."""

    def of(x: int) -> np.ndarray:
        factors = np.full(n + 1, x, np.uint64)
        factors[0] = 1
        return np.cumprod(factors)

    return of(_BASE), of(pow(_BASE, -1, 1 << 64))


def _hashed(data: np.ndarray, cuts: np.ndarray, powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of several texts laid end to end, and the number of words before each of ``cuts``, where texts begin."""
    low, n = _LOWER[data], len(data)
    solid = low != 32
    begins = np.zeros(n + 1, bool)
    begins[cuts] = True
    open_ = solid & np.concatenate([[True], ~solid[:-1]]) | solid & begins[:n]
    starts = np.flatnonzero(open_)
    ends = np.flatnonzero(solid & (np.concatenate([~solid[1:], [True]]) | begins[1:])) + 1
    at = np.arange(n)
    outer = _OUTER[low]
    behind = np.minimum.accumulate(np.where(outer, n, at)[::-1])[::-1]  # the next byte that is no outer punctuation
    before = np.maximum.accumulate(np.where(outer, -1, at))
    s = np.minimum(behind[starts], ends)
    e = np.maximum(before[ends - 1] + 1, s)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers[0][:n])])
    return _mix((sums[e] - sums[s]) * powers[1][s] + (e - s).astype(np.uint64)), np.searchsorted(starts, cuts)


def word_hashes(texts: pa.Array, chunk: int = CHUNK) -> Iterator[np.ndarray]:
    """The hashes of the words of each text (null: none), from the bytes of the column, some at a time."""
    powers = _powers(2 * chunk)
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    null = texts.is_null().to_numpy(zero_copy_only=False)

    def of(lo: int, hi: int, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _hashed(data[lo:hi], cuts - lo, powers if hi - lo <= 2 * chunk else _powers(hi - lo))

    k = 0
    while k < len(texts):
        lo = offsets[k]
        m = max(k + 1, int(np.searchsorted(offsets, lo + chunk, side="right")) - 1)
        hi = offsets[m]
        if m == k + 1 and hi - lo > 2 * chunk:  # a long text by itself, cut between words
            parts, at = [], int(lo)
            while at < hi:
                stop = min(at + chunk, int(hi))
                while stop < hi:
                    gap = np.flatnonzero(_LOWER[data[stop : stop + chunk]] == 32)
                    stop = stop + int(gap[0]) if len(gap) else min(stop + chunk, int(hi))
                    if len(gap):
                        break
                parts.append(of(at, stop, np.array([at]))[0])
                at = stop
            yield np.concatenate(parts) if not null[k] else np.empty(0, np.uint64)
        else:
            h, first = of(int(lo), int(hi), offsets[k:m]) if hi > lo else (np.empty(0, np.uint64), np.zeros(m - k, np.int64))
            for i, (x, y) in enumerate(zip(first, [*first[1:], len(h)], strict=True)):
                yield h[x:y] if not null[k + i] else np.empty(0, np.uint64)
        k = m


def seeds(h: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the minimizing k-mers of a text, from the hashes of its words; a text of fewer than ``window`` k-mers has one."""
    if len(h) < k:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    n = len(h) - k + 1
    grams = np.zeros(n, np.uint64)
    for i in range(k):
        grams = grams * np.uint64(_BASE) + h[i : i + n]
    grams = _mix(grams)
    w = min(window, n)
    m = n - w + 1
    # the lowest bits hold a k-mer's place in the window, so that one minimum gives both; the first of equal ones wins
    low = np.uint64((1 << (window - 1).bit_length()) - 1)
    upper = grams & ~low
    alike = np.concatenate([[False], grams[1:] == grams[:-1]])
    if alike.any():  # one word over and over: one seed to a window of it
        at = np.arange(n)
        upper[alike & ((at - np.maximum.accumulate(np.where(alike, 0, at))) % window != 0)] = ~low
    least = upper[:m]
    for i in range(1, w):
        least = np.minimum(least, upper[i : i + m] | np.uint64(i))
    at = np.arange(m) + (least & low).astype(np.int64)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    return at.astype(np.int32), grams[at].view(np.int64)


def seed_table(docs: DataFrame, k: int = K, window: int = WINDOW, firsts_only: bool = False) -> DataFrame:
    """doc_id, pos and hash of all seeds; firsts_only leaves out k-mers that the document has had before."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, pos, hashes, rows, held = b.column("doc_id"), [], [], [], 0
            for i, h in enumerate(word_hashes(b.column("text"))):
                p, s = seeds(h, k, window)
                if firsts_only and len(s):
                    own = np.sort(np.unique(s, return_index=True)[1])
                    p, s = p[own], s[own]
                pos.append(p)
                hashes.append(s)
                rows.append(np.full(len(p), i))
                held += len(p)
                if held > 100_000 or i == b.num_rows - 1:
                    if held:
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(pos)), pa.array(np.concatenate(hashes))], ["doc_id", "pos", "hash"])
                    pos, hashes, rows, held = [], [], [], 0

    return docs.select("doc_id", "text").mapInArrow(released(cut), f"doc_id {kind}, pos int, hash long")


def matches(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """b, b_pos, a, a_pos, hash: each seed that two documents have, with the first place of its k-mer (its own, in the first document)."""
    lead = seed_table(docs, k, window, firsts_only=True)
    first = lead.groupBy(F.col("hash").alias("_hash")).agg(F.min("doc_id").alias("a"), F.min_by("pos", "doc_id").alias("a_pos"), F.count("*").alias("n"))
    # a written table: adaptive execution cannot split a frequent k-mer on the other side of an aggregate
    first = staged(first.where("n > 1").drop("n"), "first-places")
    return seed_table(docs, k, window).join(first, F.col("hash") == F.col("_hash")).select(F.col("doc_id").alias("b"), F.col("pos").alias("b_pos"), "a", "a_pos", "hash")


def span_matches(spans: DataFrame, found: DataFrame, k: int = K) -> DataFrame:
    """b, b_pos, a, a_pos, lane: the outer seeds of each span with those of the span's first place, where that is in another document.

    Spans that lie inside a passage ``found`` (doc_id, from_word, to_word) before have their place already; they count as places for others.
    """
    first = spans.groupBy(F.col("span").alias("_span")).agg(F.min(F.struct("b", "start", "stop")).alias("first"), F.max("b").alias("high"))
    first = staged(first.where("first.b != high").select("_span", "first"), "first-spans")
    done = found.groupBy(F.col("doc_id").alias("_b")).agg(F.collect_list(F.struct("from_word", "to_word")).alias("done"))
    both = spans.join(first, F.col("span") == F.col("_span")).where(F.col("b") != F.col("first.b")).join(done, F.col("b") == F.col("_b"), "left")
    both = both.where(~F.coalesce(F.exists("done", lambda p: (p["from_word"] <= F.col("start")) & (F.col("stop") + k <= p["to_word"])), F.lit(False)))
    ends = F.explode(F.array(*(F.struct(F.col(c).alias("b_pos"), F.col(f"first.{c}").alias("a_pos")) for c in ("start", "stop"))))
    return both.select("b", F.col("first.b").alias("a"), "lane", ends.alias("e")).select("b", "e.b_pos", "a", "e.a_pos", "lane").distinct()


def scattered_spans(b: np.ndarray, pos: np.ndarray, a: np.ndarray, a_pos: np.ndarray, h: np.ndarray, length: int, k: int = K, window: int = WINDOW, share: float = 0.7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last seed (as indexes) and hash of the spans of ``length`` words whose seeds first occur in different places.

    The rows are the seeds of whole documents that two documents have, by (b, pos); b and a are numbers. A span
    begins at a seed and holds seeds without a gap. One of whose seeds a ``share`` lies where its first, middle or
    last seed first occurs is left out: the chain to that document has it. As that depends on the seeds alone,
    all documents with the span leave it out.
    """
    n = len(pos)
    at = (b.astype(np.int64) << 32) + pos
    gaps = np.concatenate([[0], np.cumsum(np.diff(at) > window)])
    code = np.unique((a.astype(np.int64) << 32) + (a_pos.astype(np.int64) - pos), return_inverse=True)[1].astype(np.int64)
    places, i = np.sort(code * n + np.arange(n)), np.arange(n)
    power, inverse = _powers(int(pos.max()) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(h.view(np.uint64)) * power[pos])])
    j = np.searchsorted(at, at + (length - k), side="right") - 1
    whole = (gaps[i] == gaps[j]) & (pos[j] > pos + length - k - window) & (j > i)
    for one in (i, (i + j) // 2, j):
        alike = np.searchsorted(places, code[one] * n + j, side="right") - np.searchsorted(places, code[one] * n + i)
        whole &= alike < share * (j - i + 1)
    x = np.flatnonzero(whole)
    return x, j[x], _mix((sums[j[x] + 1] - sums[x]) * inverse[pos[x]] + np.uint64(length)).view(np.int64)


def _lanes(docs: np.ndarray, code: np.ndarray, start: np.ndarray, stop: np.ndarray, most: int, k: int = K) -> np.ndarray:
    """For each span of some documents a lane, or -1 where it is left out.

    Where a span overlaps its own repeats (a few words over and over), all of these have one first place. So many are
    kept that their words are those of all: the first, then the last that begins inside the one before, and, so that a passage up to the end is found, the last
    with ``most`` words up to it. Spans of such a run that overlap are in different lanes, which are chained by themselves. All other spans are in lane 0.
    """
    by, lane = np.lexsort((start, code, docs)), np.zeros(len(start), np.int8)
    docs, code, start, end = docs[by], code[by], start[by].astype(np.int64), stop[by].astype(np.int64) + k
    new = np.concatenate([[True], (docs[1:] != docs[:-1]) | (code[1:] != code[:-1]) | (start[1:] > end[:-1]), [True]])
    bounds = np.flatnonzero(new)
    for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if y - x > 1:
            i, picks, at = x, {x, y - 1}, start[x:y]
            while i < y - 1:
                i = max(i + 1, x + int(np.searchsorted(at, end[i], side="right")) - 1)
                picks.add(i)
            picks.add(max(x, x + int(np.searchsorted(at, end[y - 1] - most, side="right")) - 1))
            lane[by[x:y]] = -1
            for n, i in enumerate(sorted(picks)):
                lane[by[i]] = 1 + n % 3
    return lane


def chain(b_pos: np.ndarray, a_pos: np.ndarray, gap: float = GAP_COST) -> list[list[int]]:
    """Chains of matches, rising in both texts, as lists of indexes; the best first, each match in one chain at most.

    A match earns 1; the words between two matches, in either text, cost ``gap`` each. The cost is a
    difference of positions, so the best predecessor is a prefix maximum over a_pos, kept in a Fenwick tree.
    """
    order = np.lexsort((-a_pos, b_pos))  # of equal b_pos the later a_pos first: they cannot follow each other
    ranks = np.unique(a_pos, return_inverse=True)[1] + 1
    size = int(ranks.max())
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (size + 1)
    score, before = [0.0] * len(order), [-1] * len(order)
    b, a, r = b_pos.tolist(), a_pos.tolist(), ranks.tolist()
    for i in order.tolist():
        best, k = (-np.inf, -1), r[i] - 1
        while k > 0:
            best = max(best, tree[k])
            k &= k - 1
        value = best[0] - gap * (a[i] + b[i])
        if value > 0:
            score[i], before[i] = 1 + value, best[1]
        else:
            score[i] = 1.0
        mine, k = (score[i] + gap * (a[i] + b[i]), i), r[i]
        while k <= size:
            if mine > tree[k]:
                tree[k] = mine
            k += k & -k
    used, chains = [False] * len(b), []
    for i in sorted(range(len(b)), key=lambda i: -score[i]):
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = before[i]
        if path:
            chains.append(path[::-1])
    return chains


def _cut_chains(b_pos: np.ndarray, a_pos: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """The chains of a pair's matches, as indexes, cut where a gap of more than ``most`` words lies between two seeds."""
    if len(b_pos) > 1 and (np.diff(a_pos - b_pos) == 0).all() and (np.diff(b_pos) > 0).all():
        paths = [np.arange(len(b_pos))]  # matches in one line are one chain
    else:
        paths = map(np.array, chain(b_pos, a_pos))
    for path in paths:
        far = np.flatnonzero((np.diff(b_pos[path]) > most) | (np.diff(a_pos[path]) > most)) + 1
        yield from np.split(path, far)


def _cover(rows: list[tuple], k: int) -> list[tuple]:
    """Of one document's chains so many that their words are those of all: longer ones first, those of repeats last, and first those of which half is new."""
    rows = sorted(rows, key=lambda r: (r[7] > 0, r[2][0] - r[2][-1], r[2][0]))
    seen, kept = np.zeros(max(r[2][-1] for r in rows) + k, bool), []
    for half in (True, False):
        rest = []
        for r in rows:
            own = seen[r[2][0] : r[2][-1] + k]
            new = len(own) - int(own.sum())
            if 2 * new >= len(own) if half else new:
                own[:] = True
                kept.append(r)
            else:
                rest.append(r)
        rows = rest
    return kept


def chains(found: DataFrame, most: int, min_seeds: int = 2, span: int | None = None, k: int = K, window: int = WINDOW, cover: bool = False) -> DataFrame:
    """b, a and the seeds (b_at, a_at) of each chain. Matches are dealt by b, so a task sees all of a document.

    With ``cover``, of overlapping chains of a document only so many that their words are those of all. With ``span`` (a length), further rows hold the scattered spans of each b: span (hash), start and stop (outer seeds) and lane.
    """
    kind = found.schema["b"].dataType.simpleString()
    columns = ["b", "a", "b_at", "a_at", "span", "start", "stop", "lane"]
    order = ["b", "a", "lane"] if "lane" in found.columns else ["b", "a"]

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []  # a document's matches until the next document begins
        for frame in frames:
            b = frame["b"].to_numpy()
            if held and held[-1]["b"].iloc[-1] != b[0]:
                yield from linked(pd.concat(held, ignore_index=True))
                held = []
            last = int(np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))[-1])
            if last:
                yield from linked(pd.concat([*held, frame.iloc[:last]], ignore_index=True))
                held = []
            held.append(frame.iloc[last:])
        if held:
            yield from linked(pd.concat(held, ignore_index=True))

    def linked(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        b_pos, a_pos = frame["b_pos"].to_numpy(), frame["a_pos"].to_numpy()
        b, a, rows = frame["b"].to_numpy(), frame["a"].to_numpy(), []
        lane = frame["lane"].to_numpy() if "lane" in order else np.zeros(len(b), np.int8)
        starts = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (a[1:] != a[:-1]) | (lane[1:] != lane[:-1]), [True]]))
        for x, y in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if y - x >= min_seeds and a[x] != b[x]:
                for path in _cut_chains(b_pos[x:y], a_pos[x:y], most):
                    if len(path) >= min_seeds:
                        at = x + path
                        rows.append((b[x], a[x], b_pos[at].tolist(), a_pos[at].tolist(), None, None, None, int(lane[x])))
        if cover:
            rows = [r for _, own in groupby(rows, key=lambda r: r[0]) for r in _cover(list(own), k)]
        if rows:
            yield pd.DataFrame(rows, columns=columns)
        if span:
            docs, firsts = np.cumsum(np.concatenate([[0], b[1:] != b[:-1]])), pd.factorize(a)[0]
            by = np.lexsort((b_pos, docs))
            first, last, code = scattered_spans(docs[by], b_pos[by], firsts[by], a_pos[by], frame["hash"].to_numpy()[by], span, k, window)
            if len(first):
                start, stop = b_pos[by][first], b_pos[by][last]
                lane = _lanes(docs[by][first], code, start, stop, most, k)
                some = lane >= 0
                yield pd.DataFrame({"b": b[by][first][some], "a": None, "b_at": None, "a_at": None, "span": code[some], "start": start[some], "stop": stop[some], "lane": lane[some]})

    dealt = found.repartition("b").sortWithinPartitions(*order, "b_pos", "a_pos")
    return dealt.mapInPandas(released(link), f"b {kind}, a {kind}, b_at array<int>, a_at array<int>, span long, start int, stop int, lane byte")


Step = tuple[int, int, bool]


def edit_path(x: list[bytes], y: list[bytes], most: int | None = None, spare: float = 0.0) -> list[Step]:
    """A cheapest alignment of two word lists as steps (words of x, words of y, equal), by furthest-reaching diagonals.

    With ``most``, of the beginnings of x and y: at most so many edits, and the path that reaches furthest while
    an equal word gains 1 and an edit costs 4, up to a loss of ``spare`` (0: the path that gains most).
    """
    n, m = len(x), len(y)
    levels: list[dict[int, int]] = []
    best = 0.0  # the most that a path has gained
    while True:
        d, row = len(levels), {}
        get = levels[-1].get if levels else None
        for k in range(-min(d, m), min(d, n) + 1):
            i = 0
            if get:  # as _reach does
                i = -1
                if (at := get(k, n)) < n and at - k < m:
                    i = at + 1
                if (at := get(k - 1, n)) < n and at >= i:
                    i = at + 1
                at = get(k + 1, -1)
                if at > i and at - k <= m:
                    i = at
                if i < 0:
                    continue
            j = i - k
            while i < n and j < m and x[i] == y[j]:
                i, j = i + 1, j + 1
            row[k] = i
        levels.append(row)
        if most is None:
            if row.get(n - m) == n:
                d, k = len(levels) - 1, n - m
                break
            continue
        if spare > 0:  # both ends reached: no later path reaches further
            done = row.get(n - m) == n and (n + m) / 2 - 5 * d >= -spare
        else:  # no later path can gain more
            best = max([best, *(i - k / 2 - 5 * d for k, i in row.items())])
            done = min((n + m) / 2, min(n, m) + (d + 1) / 2) - 5 * (d + 1) <= best
        if done or d == most or not row:
            value = lambda d, k: (2 * levels[d][k] - k) / 2 - 5 * d
            ends = [(d, k) for d, r in enumerate(levels) for k in r]
            d, k = max(ends, key=lambda e: (value(*e), -e[0]))
            if spare > 0:
                d, k = max((e for e in ends if value(*e) >= min(-spare, value(d, k))), key=lambda e: (2 * levels[e[0]][e[1]] - e[1], value(*e)))
            break
    steps, i = [], levels[d][k]
    while d >= 0:
        start = _reach(levels[d - 1], k, n, m) if d else 0
        steps += [(1, 1, True)] * (i - start)
        if not d:
            break
        before, i = levels[d - 1], start
        if k in before and before[k] + 1 == start and start <= n and start - k <= m:
            steps.append((1, 1, False))
        elif k - 1 in before and before[k - 1] + 1 == start and start <= n:
            steps.append((1, 0, False))
            k -= 1
        else:
            steps.append((0, 1, False))
            k += 1
        i, d = before[k], d - 1
    return steps[::-1]


def _reach(before: dict[int, int], k: int, n: int, m: int) -> int:
    """How far in x one more edit leads onto diagonal k; -1 if none does."""
    best = -1
    if (i := before.get(k, n)) < n and i - k < m:
        best = i + 1
    if (i := before.get(k - 1, n)) < n and i + 1 > best:
        best = i + 1
    i = before.get(k + 1, -1)
    if i > best and i - k <= m:
        best = i
    return best


def align(x: list[bytes], y: list[bytes], x_at: list[int], y_at: list[int], k: int = K, min_words: int = MIN_WORDS, min_similarity: float = MIN_SIMILARITY) -> list[tuple[int, int, int, int, float]]:
    """Passages (x from, x to, y from, y to, similarity) along a chain of seeds at x_at and y_at.

    Words are aligned between seeds and beyond the outer seeds, there with at most as many edits as a passage of ``min_words`` may have, or 4 if the chain is as long. An equal
    word scores 1 and any other step costs s / (1 - s), for a similarity s: segments of a score of 0 or more have it. The best segments are
    returned; one that is too short is first widened to ``min_words``, up to an equal word, if its score then is still not negative.
    """
    if (Counter(x) & Counter(y)).total() < min_words * min_similarity:
        return []
    middle: list[Step] = []
    i, j = x_at[0], y_at[0]
    for nx, ny in zip([*x_at[1:], x_at[-1] + k], [*y_at[1:], y_at[-1] + k], strict=True):
        middle += [(1, 1, True)] * (nx - i) if x[i:nx] == y[j:ny] else edit_path(x[i:nx], y[j:ny])
        i, j = nx, ny
    edits = sum(not s[2] for s in middle)
    spare = max(0, len(middle) - 5 * edits) if len(middle) < min_words + edits else 0
    most = int((1 - min_similarity) * min_words) + 1 if spare else 4
    left = edit_path(x[: x_at[0]][::-1], y[: y_at[0]][::-1], most, spare)[::-1]
    steps = left + middle + edit_path(x[i:], y[j:], most, spare)
    from_x, from_y = x_at[0] - sum(s[0] for s in left), y_at[0] - sum(s[1] for s in left)
    dx, dy, same = (np.array(c) for c in zip(*steps, strict=True))
    cx, cy = (np.concatenate([[0], np.cumsum(d)]) + at for d, at in ((dx, from_x), (dy, from_y)))
    gain = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0, -min_similarity / (1 - min_similarity)))])
    found, todo = [], [(0, len(steps))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < min_words:
            continue
        part = gain[lo : hi + 1]
        rise = part - np.minimum.accumulate(part)
        e = lo + int(rise.argmax())
        s = lo + int(part[: e - lo + 1].argmin())
        if gain[e] - gain[s] <= 0:
            continue
        if min(cx[e] - cx[s], cy[e] - cy[s]) < min_words:
            s, e = _widened(cx, cy, gain, same, s, e, lo, hi, min_words)
        if min(cx[e] - cx[s], cy[e] - cy[s]) >= min_words:
            found.append((int(cx[s]), int(cx[e]), int(cy[s]), int(cy[e]), float(same[s:e].sum() / max(cx[e] - cx[s], cy[e] - cy[s]))))
        todo += [(lo, s), (e, hi)]
    return sorted(found)


def _widened(cx: np.ndarray, cy: np.ndarray, gain: np.ndarray, same: np.ndarray, s: int, e: int, lo: int, hi: int, min_words: int) -> tuple[int, int]:
    """The best segment around s..e, inside lo..hi, that begins and ends with an equal word and just has ``min_words`` words in both texts; s..e if all score below 0."""
    starts = np.arange(max(lo, s - min_words), s + 1)
    starts = starts[same[starts]]
    ends = np.maximum(np.maximum(np.searchsorted(cx, cx[starts] + min_words), np.searchsorted(cy, cy[starts] + min_words)), e)
    stops = np.flatnonzero(same) + 1
    at = np.searchsorted(stops, ends)
    starts, ends = starts[at < len(stops)], stops[at[at < len(stops)]]
    starts, ends = starts[ends <= hi], ends[ends <= hi]
    if not len(starts):
        return s, e
    scores = gain[ends] - gain[starts]
    best = int(scores.argmax())
    return (int(starts[best]), int(ends[best])) if scores[best] > -1e-6 else (s, e)


def _ranked(docs: DataFrame, key: str) -> DataFrame | None:
    """``docs`` with a number for each row in ``key``, by doc_id and nulls last, written once; None if the doc_ids are such numbers themselves."""
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        return None
    number, rank = free("row_number", docs), free("rank_number", docs)
    rows = staged(docs.withColumn(number, F.monotonically_increasing_id()), "numbered-documents")
    # range partitions of slim rows: their numbers rise with the order
    ranks = rows.select(F.col("doc_id").alias("id"), named(number).alias(rank)).orderBy(F.asc_nulls_last("id"), rank).select(rank, F.monotonically_increasing_id().alias(key))
    return staged(rows.join(staged(ranks, "ranks"), named(number) == named(rank)).select(*all_columns(docs), named(key)), "ranked-documents")


def find_passages(docs: DataFrame, k: int = K, window: int = WINDOW, min_words: int = MIN_WORDS, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """doc_id, from_word, to_word, ref_id, ref_from, ref_to, n_words and similarity of every repeated passage.

    Words are numbered from 0 by ASCII white space; the to-columns are exclusive. A passage's reference
    is the earlier row, by doc_id. Passages of a document may overlap, most often where references differ.
    """
    docs = docs.select("doc_id", "text")
    rows = _ranked(docs, "rank")
    if rows is None:
        return _passages(docs, k, window, min_words, min_similarity)
    found = _passages(rows.select(F.col("rank").alias("doc_id"), "text"), k, window, min_words, min_similarity)
    columns = found.columns
    for side in ("doc_id", "ref_id"):
        found = found.join(rows.select(F.col("rank").alias("_rank"), F.col("doc_id").alias("_id")), F.col(side) == F.col("_rank")).drop(side, "_rank").withColumnRenamed("_id", side)
    return found.select(*columns)


def _passages(known: DataFrame, k: int = K, window: int = WINDOW, min_words: int = MIN_WORDS, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    # a run of min_words words has a span that begins at a seed and whose seeds do not depend on the words around the run
    span = max(k + window, min_words - 3 * (window - 1))
    linked = staged(chains(matches(known, k, window), min_words, span=span, k=k, window=window), "chains")
    found = staged(aligned(linked.where("span is null"), known, k, min_words, min_similarity), "passages")
    more = chains(span_matches(linked.where("span is not null").select("b", "span", "start", "stop", "lane"), found, k), min_words, k=k, cover=True)
    return found.unionByName(aligned(more, known, k, min_words, min_similarity)).distinct()


def aligned(chains: DataFrame, known: DataFrame, k: int, min_words: int, min_similarity: float) -> DataFrame:
    """The passages along chains (b, a, b_at, a_at), from the texts."""
    kind = known.schema["doc_id"].dataType.simpleString()
    # two seeds anywhere in a passage reach its ends
    grid = {}
    for side in "ba":
        grid[f"{side}_lo"] = F.greatest(F.floor((F.element_at(f"{side}_at", 1) - min_words) / GRID) * GRID, F.lit(0)).cast("int")
        grid[f"{side}_hi"] = (F.ceil((F.element_at(f"{side}_at", -1) + (k + min_words)) / GRID) * GRID).cast("int")
    links = staged(chains.select("b", "a", "b_at", "a_at").withColumns(grid), "all-chains")
    # many chains meet in a frequent passage's first document: each slice of a text is cut once
    asked = F.explode(F.array(*(F.struct(F.col(s).alias("id"), F.col(f"{s}_lo").alias("lo"), F.col(f"{s}_hi").alias("hi")) for s in "ba"))).alias("s")
    asked = staged(links.select(asked).select("s.*").distinct(), "asked-slices")
    ids = asked.select(F.col("id").alias("_id")).distinct()
    ids = F.broadcast(ids) if asked.count() <= BROADCAST_IDS else ids
    texts = known.join(ids, F.col("doc_id") == F.col("_id"), "left_semi")
    cut = F.array_join(F.slice(words(F.col("text")), F.col("lo") + 1, F.col("hi") - F.col("lo")), " ")
    slices = staged(asked.join(texts, F.col("id") == F.col("doc_id")).select("id", "lo", "hi", cut.alias("words")), "slices")
    both = links
    for side in "ba":
        both = both.join(slices.select(F.col("id").alias(side), F.col("lo").alias(f"{side}_lo"), F.col("hi").alias(f"{side}_hi"), F.col("words").alias(f"{side}_words")), [side, f"{side}_lo", f"{side}_hi"])
    # few, heavy rows: dealt out one by one
    both = both.repartition(partitions_for(known.sparkSession), F.xxhash64("b", "a", "b_at", "a_at"))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                x, y = split_words(r.b_words), split_words(r.a_words)
                for p in align(x, y, [i - r.b_lo for i in r.b_at], [i - r.a_lo for i in r.a_at], k, min_words, min_similarity):
                    rows.append((r.b, p[0] + r.b_lo, p[1] + r.b_lo, r.a, p[2] + r.a_lo, p[3] + r.a_lo, p[1] - p[0], p[4]))
            yield pd.DataFrame(rows, columns=["doc_id", "from_word", "to_word", "ref_id", "ref_from", "ref_to", "n_words", "similarity"])

    return both.mapInPandas(released(compare), f"doc_id {kind}, from_word int, to_word int, ref_id {kind}, ref_from int, ref_to int, n_words int, similarity double")


def cut_passages(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` without the passages that an earlier document has; documents without a word left go.

    White space around what stays is kept. n_chars, where there is such a column, follows the text.
    """
    key, spans, cut, rank = (free(n, docs) for n in ("passage_id", "passage_spans", "passage_cut", "passage_rank"))
    ranked = _ranked(docs, rank)
    known = docs.select("doc_id", "text") if ranked is None else ranked.select(named(rank).alias("doc_id"), "text")
    found = staged(_passages(known, **settings).groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("from_word", "to_word")).alias(spans)), "spans")
    rows = docs.join(found, F.col("doc_id") == named(key), "left") if ranked is None else ranked.join(found, named(rank) == named(key), "left")

    @F.pandas_udf("string")
    def without(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        return pd.Series([_without(t, c) for t, c in zip(texts, cuts, strict=True)], dtype=object)

    some = named(spans).isNotNull()
    out = rows.withColumn(cut, F.when(some, without("text", F.when(some, named(spans)))).otherwise(F.col("text"))).where(~some | named(cut).rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(some, F.length(named(cut)).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.withColumn("text", named(cut)).select(*all_columns(docs))


def _without(text: str | None, spans) -> str | None:
    """The text without the words in the given spans and the white space behind each span."""
    import re

    if text is None or spans is None or not len(spans):
        return text
    places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    gone = np.zeros(len(places) + 1, bool)
    for s in spans:
        gone[s["from_word"] : s["to_word"]] = True
    gone[-1] = False
    out, at, i = [], 0, 0
    while i < len(places):
        if gone[i]:
            j = i + int(np.argmin(gone[i:]))
            out.append(text[at : places[i][0]])
            at = places[j][0] if j < len(places) else len(text)
            i = j
        else:
            i += 1
    return "".join([*out, text[at:]])
