"""SimHash near-duplicates by a binary trie self-join.

A document's fingerprint has, for each of 64 bits, the majority over the XXH64 values of its 3-word
shingles. Distinct fingerprints are the leaves of a binary trie. Pairs of trie nodes are walked down
together from (root, root), adding up the bits in which their prefixes differ; a pair goes as soon as
more than ``max_bits`` differ. Of two halves of the bits one holds at most half of the differing ones, so two tries are walked, the second over fingerprints
whose halves are exchanged, and in the upper half of each a pair goes as soon as more than ``max_bits`` // 2 differ: at depth d a node is in d + 1 pairs instead of some d**3 / 6.
The upper levels are walked as DataFrames of node pairs, until a pair's two nodes hold no more leaves than a task takes at once; from there on a task walks the two
subtries as intervals of sorted arrays. A task returns a spanning forest of the links it
finds, so a dense cluster gives no more rows than it has members, and components lose no link.

Defined cases: a null, empty or blank text has the fingerprint 0 and is linked like any other. Rows
that repeat a doc_id give a row each. A null doc_id is kept and takes part; a component's id is the
smallest doc_id that is not null (null if there is none). ``keep_one`` leaves one row of each component, of repeated ids and null ids
alike. An empty table gives no rows. Columns but doc_id and text are ignored by ``near_duplicates`` and passed through by ``keep_one``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import all_columns, free, named, released, staged
from .components import connected_components

BITS, HALF = 64, 32
MAX_BITS = 3
SHINGLE = 3
SEED = 42
#: Leaves below a node from which on a task walks alone.
LEAVES = 8192
#: Node pairs or candidate pairs that a task holds at once.
CHUNK = 1 << 20
#: Keys of dropped rows up to which they are broadcast; a shuffle join beyond.
BROADCAST_KEYS = 1_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text as an unsigned integer."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: -shingle] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(released(add), f"doc_id {kind}, fp long")


def _split(sorted_fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where, in each interval that shares the bits above, the given bit turns to 1."""
    edge = (sorted_fps[lo] >> np.uint64(bit) | np.uint64(1)) << np.uint64(bit)
    return np.clip(np.searchsorted(sorted_fps, edge), lo, hi)


def budget(depth: int, max_bits: int) -> int:
    """How many of the first ``depth`` bits may differ: half of all that may, in the upper half."""
    return max_bits // 2 if depth <= HALF else max_bits


def _exchanged(fp: str) -> Column:
    """A fingerprint with its halves exchanged."""
    return F.shiftleft(fp, HALF).bitwiseOR(F.shiftrightunsigned(fp, HALF))


class _Forest:
    """A spanning forest of the links offered so far."""

    def __init__(self, n: int) -> None:
        self.root, self.links = np.arange(n), []

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:  # full compression: each points at its root
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up
        new = root[a] != root[b]
        for i, j in zip(a[new].tolist(), b[new].tolist(), strict=True):
            x, y = self.find(i), self.find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                self.links.append((i, j))


def trie_links(left: np.ndarray, right: np.ndarray | None, depth: int, differing: int, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links between two sorted uint64 arrays (right None: within left) whose prefixes of ``depth`` bits differ in ``differing``, as far as the upper halves are within their budget.

    The links are positions, those of the right array behind the left's, and form a spanning forest.
    """
    own = right is None
    right = left if own else right
    forest = _Forest(len(left) + (0 if own else len(right)))
    shift = 0 if own else len(left)
    one = np.array
    stack = [(one([0]), one([len(left)]), one([0]), one([len(right)]), one([differing]), BITS - depth - 1)]
    while stack:
        alo, ahi, blo, bhi, diff, bit = stack.pop()
        if len(alo) > CHUNK:
            half = len(alo) // 2
            stack += [tuple(x[:half] for x in (alo, ahi, blo, bhi, diff)) + (bit,), tuple(x[half:] for x in (alo, ahi, blo, bhi, diff)) + (bit,)]
            continue
        small = (ahi - alo) * (bhi - blo) <= 16
        if bit < 0:
            small[:] = True
        if small.any():
            _compare(left, right, own, shift, *(x[small] for x in (alo, ahi, blo, bhi)), forest, max_bits)
        alo, ahi, blo, bhi, diff = (x[~small] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo):
            continue
        am, bm = _split(left, alo, ahi, bit), _split(right, blo, bhi, bit)
        limit = budget(BITS - bit, max_bits)
        same = own & (alo == blo) & (ahi == bhi)
        children = [(alo, am, blo, bm, diff, None), (am, ahi, bm, bhi, diff, None), (alo, am, bm, bhi, diff + 1, None), (am, ahi, blo, bm, diff + 1, ~same)]
        kept = [[], [], [], [], []]
        for *parts, allowed in children:
            ok = (parts[0] < parts[1]) & (parts[2] < parts[3]) & (parts[4] <= limit)
            ok = ok if allowed is None else ok & allowed
            for to, x in zip(kept, parts, strict=True):
                to.append(x[ok])
        stack.append((*(np.concatenate(x) for x in kept), bit - 1))
    return forest.links


def _compare(left, right, own, shift, alo, ahi, blo, bhi, forest, max_bits) -> None:
    """Compare all leaves of small node pairs, some million at a time."""
    wide = bhi - blo
    counts = (ahi - alo) * wide
    upto = np.cumsum(counts)
    first = 0
    while first < len(counts):
        base = upto[first] - counts[first]
        last = max(first + 1, int(np.searchsorted(upto, base + 4 * CHUNK, "right")))
        n = counts[first:last]
        which = np.repeat(np.arange(first, last), n)
        k = np.arange(n.sum()) - np.repeat(upto[first:last] - n - base, n)
        i, j = alo[which] + k // wide[which], blo[which] + k % wide[which]
        near = np.bitwise_count(left[i] ^ right[j]) <= max_bits
        near &= (i < j) if own else True
        forest.add(i[near], j[near] + shift)
        first = last


def _children(pairs: DataFrame, nodes: DataFrame, step: int, max_bits: int) -> DataFrame:
    """Pairs of nodes ``step`` levels further down that exist and whose differing bits stay in the budget."""
    masks = [(m, m.bit_count()) for m in range(1 << step) if m.bit_count() <= max_bits]
    flips = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(c).alias("c")) for m, c in masks])
    wide = pairs.select("a", "b", "differing", F.explode(F.sequence(F.lit(0), F.lit((1 << step) - 1))).alias("low")).select("a", "b", "differing", F.col("low").cast("long").alias("low"), F.explode(flips).alias("f"))
    down = wide.select(
        (F.shiftleft("a", step).bitwiseOR(F.col("low"))).alias("a"), (F.shiftleft("b", step).bitwiseOR(F.col("low").bitwiseXOR(F.col("f.m")))).alias("b"), (F.col("differing") + F.col("f.c")).alias("differing")
    ).where((F.col("differing") <= max_bits) & (F.col("a") <= F.col("b")))
    na, nb = nodes.select(F.col("node").alias("a"), F.col("n").alias("na")), nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"))
    return down.join(na, "a").join(nb, "b").select("a", "b", "differing", "na", "nb")


def linked_fingerprints(fps: DataFrame, max_bits: int = MAX_BITS, leaves: int = LEAVES) -> DataFrame:
    """(a, b): a spanning set of the links between distinct fingerprints (column fp) at most ``max_bits`` apart."""
    straight = _walk_trie(fps, max_bits, leaves)
    turned = _walk_trie(fps.select(_exchanged("fp").alias("fp")), max_bits, leaves)
    return straight.unionByName(turned.select(_exchanged("a").alias("a"), _exchanged("b").alias("b")))


def _walk_trie(fps: DataFrame, max_bits: int, leaves: int) -> DataFrame:
    """Links of fingerprints whose upper halves differ in no more than half of ``max_bits``."""
    spark = fps.sparkSession
    n = fps.count()
    schema = "a long, b long, differing int, na long, nb long"
    pairs, depth, found = spark.createDataFrame([(0, 0, 0, n, n)], schema), 0, []
    while True:
        small = (F.greatest("na", "nb") <= leaves) if depth < BITS - 1 else F.lit(True)
        found.append(_walk(fps, pairs.where(small), depth, max_bits))
        pairs = pairs.where(~small)
        most = pairs.agg(F.max(F.greatest("na", "nb"))).first()[0]
        if not most:
            break
        # a step stays in one half, whose budget holds for it
        step = min(6, (HALF if depth < HALF else BITS - 1) - depth, max(1, (-(-most // leaves) - 1).bit_length()))
        depth += step
        nodes = fps.groupBy(_prefix(depth).alias("node")).agg(F.count("*").alias("n"))
        pairs = staged(_children(pairs, nodes, step, budget(depth, max_bits)), "node-pairs")
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def _prefix(depth: int):
    return F.shiftrightunsigned("fp", BITS - depth) if depth else F.lit(0).cast("long")


def _walk(fps: DataFrame, pairs: DataFrame, depth: int, max_bits: int) -> DataFrame:
    """Links below the given node pairs; a node's leaves travel as one array, at most as long as a task may hold."""
    # nodes beyond the bound are in no pair of this level
    used = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    leaves = fps.withColumn("node", _prefix(depth)).join(used, "node").groupBy("node").agg(F.collect_list("fp").alias("fps"))
    both = pairs.join(leaves.select(F.col("node").alias("a"), F.col("fps").alias("left")), "a").join(leaves.select(F.col("node").alias("b"), F.col("fps").alias("right")), "b")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b, differing = (batch.column(c)[k].as_py() for c in ("a", "b", "differing"))
                left = np.sort(batch.column("left")[k].values.to_numpy().view(np.uint64))
                right = np.sort(batch.column("right")[k].values.to_numpy().view(np.uint64)) if a != b else left
                links = np.array(trie_links(left, None if a == b else right, depth, differing, max_bits), np.int64).reshape(-1, 2)
                if len(links):
                    every = (left if a == b else np.concatenate([left, right])).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(every[links[:, 0]]), pa.array(every[links[:, 1]])], ["a", "b"])

    # few, heavy rows: dealt out one by one rather than by the hash of a node
    return both.select("a", "b", "differing", "left", F.when(F.col("a") != F.col("b"), F.col("right")).alias("right")).repartition(F.xxhash64("a", "b")).mapInArrow(released(walk), "a long, b long")


def _named(rows: DataFrame, max_bits: int) -> DataFrame:
    """_fp, component (of fingerprints) and component_id (the smallest doc_id in it) of every fingerprint in ``rows`` (doc_id, fp)."""
    classes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    links = staged(linked_fingerprints(classes.select("fp"), max_bits), "links")
    groups = connected_components(links).select(F.col("node").alias("fp"), "component")
    grouped = classes.join(groups, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    return staged(grouped.join(ids, "component").select(F.col("fp").alias("_fp"), "component", "component_id"), "named")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    rows = staged(fingerprints(docs, shingle), "fingerprints")
    # a hot fingerprint is a skewed key on the left, which adaptive execution splits
    return rows.join(_named(rows, max_bits), F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """One row of each component of ``docs``: that with the smallest doc_id, null ids last, and of several such rows one.

    Rows are told apart by a number that is written with them, so rows that share an id are judged each for itself.
    """
    key, fp, out = free("row_key", docs), free("row_fp", docs), free("row_gone", docs)

    @F.pandas_udf("long")
    def print_of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    rows = staged(docs.withColumn(key, F.monotonically_increasing_id()).withColumn(fp, print_of(F.coalesce("text", F.lit("")))), "keyed-documents")
    slim = rows.select("doc_id", named(fp).alias("fp"), named(key).alias("key"))
    placed = staged(slim.join(_named(slim, max_bits).select("_fp", "component"), F.col("fp") == F.col("_fp")).select("component", "key", "doc_id"), "placed")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    first = placed.groupBy(F.col("component").alias("_component")).agg(F.min(order)["key"].alias("_key"))
    first = staged(first, "first-rows")
    gone = placed.join(first, F.col("component") == F.col("_component")).where("key != _key").select(F.col("key").alias(out))
    gone = staged(gone, "later-rows")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
    return rows.join(gone, named(key) == named(out), "left_anti").select(*all_columns(docs))
