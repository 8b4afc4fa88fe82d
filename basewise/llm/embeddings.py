"""Near-duplicate embeddings by cross-polytope hashing.

A hash function rotates a vector at random (three rounds of random signs and a fast Hadamard transform) and takes the axis, with its sign, that the
result lies nearest to. A table joins ``functions`` such hashes; each vector stands in the ``probes`` buckets of each table that it comes nearest to, so
that two vectors meet if any of their buckets agree. Vectors that meet are compared by cosine in double precision, and pairs
of at least ``min_cosine`` are links. Only vectors of one label, and of one length, are compared.

How many functions a table has follows from the rows of the largest label, how many tables there are from the share of pairs of
exactly ``min_cosine`` that meet in one table (measured on random pairs, with a fixed seed), so that such a pair is missed with a probability of at most ``miss``;
pairs of a larger cosine are missed less. Every vector is indexed, and no bucket or partner list has a cap.

Equal vectors of a label are one class, compared once. A bucket of more than ``BLOCK`` vectors is dealt to tasks by pairs of blocks. Pairs never leave a
task: a pair counts in the first bucket that its two vectors share, known from their bucket lists, and a task returns a row per vector with
its number of links there and one spanning link. So a group of n near copies takes n * n / 2 comparisons, in blocks, but no more than some rows per vector.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link with nothing, not even with equal
ones. Vectors of different lengths do not link. A row is judged by itself: rows that repeat a vec_id are vectors of their own. A null vec_id takes part; a
component's id is the smallest vec_id that is not null (null if there is none). A cosine is invariant under scale, also of components whose squares
are beyond a double. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, LongType, StructField, StructType

from .common import staged
from .components import connected_components

MIN_COSINE = 0.93
#: Buckets of each table in which a vector stands.
PROBES = 2
#: Chance that a pair of exactly the least cosine is missed, at most.
MISS = 1e-4
#: Vectors of a label from which on a table joins one more function.
BUCKET_ROWS = 4096
#: Vectors of a bucket that are compared with each other, or with as many others, at once.
BLOCK = 1024
#: Large buckets up to which they are broadcast; a shuffle join beyond.
BROADCAST_BUCKETS = 100_000
SEED = 7


def _turned_width(n: int) -> int:
    """Components of a rotated vector: a power of two, and enough of them that rotations differ though a vector has few."""
    return max(32, 1 << (n - 1).bit_length())


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row, unscaled; rows are as long as a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x


def nearest_axes(x: np.ndarray, table: int, function: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``probes`` signed axes nearest to each rotated row, and how far along them it lies, nearest first."""
    width = _turned_width(x.shape[1])
    turned = np.zeros((len(x), width))
    turned[:, : x.shape[1]] = x
    signs = np.random.default_rng([SEED, width, table, function]).integers(0, 2, (3, width)) * 2 - 1
    for s in signs:
        turned = hadamard(turned * s) / math.sqrt(width)
    size = np.abs(turned)
    axes = np.argsort(-size, axis=1, kind="stable")[:, : min(probes, width)]
    return 2 * axes + (np.take_along_axis(turned, axes, 1) < 0), np.take_along_axis(size, axes, 1)


def buckets(x: np.ndarray, tables: int, functions: int, probes: int = PROBES) -> np.ndarray:
    """The bucket numbers of each row of ``x``: rows x tables x probes.

    With several functions the probes are the combinations of their nearest axes with the largest sum of lengths.
    """
    out = []
    for t in range(tables):
        codes, scores = nearest_axes(x, t, 0, probes)
        for f in range(1, functions):
            more, extra = nearest_axes(x, t, f, probes)
            codes = (codes[:, :, None] * (2 * _turned_width(x.shape[1])) + more[:, None, :]).reshape(len(x), -1)
            scores = (scores[:, :, None] + extra[:, None, :]).reshape(len(x), -1)
            best = np.argsort(-scores, axis=1, kind="stable")[:, :probes]
            codes, scores = np.take_along_axis(codes, best, 1), np.take_along_axis(scores, best, 1)
        out.append(codes)
    return np.stack(out, axis=1).astype(np.int64)


def meeting_share(width: int, functions: int, min_cosine: float, probes: int = PROBES, pairs: int = 4000) -> float:
    """The share of random pairs of exactly ``min_cosine`` that share a bucket of one table."""
    rng = np.random.default_rng(SEED)
    x, y = rng.normal(size=(2, pairs, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    norm = np.linalg.norm(y, axis=1, keepdims=True)
    y = min_cosine * x + math.sqrt(1 - min_cosine**2) * y / np.where(norm, norm, 1)
    a, b = (buckets(v, 1, functions, probes)[:, 0] for v in (x, y))
    return float((a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean())


def plan_tables(rows: int, width: int, min_cosine: float = MIN_COSINE, probes: int = PROBES, miss: float = MISS) -> tuple[int, int]:
    """(tables, functions) for a label of so many vectors of so many components."""
    functions = max(1, math.ceil(math.log(max(1, rows / BUCKET_ROWS)) / math.log(2 * _turned_width(width))))
    share = min(0.999, max(0.01, meeting_share(min(width, 2048), functions, min_cosine, probes) - 0.01))
    return max(1, math.ceil(math.log(miss) / math.log(1 - share))), functions


def _matrices(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix (doubles, nulls as NaN) of the rows of each length that occurs."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == n)
        flat = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield at, flat.astype(np.float64).reshape(len(at), n)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows scaled so that their largest component is 1 in size."""
    return x / np.abs(x).max(axis=1, keepdims=True)


def _digests(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding and digest: the SHA-256 of the components, null where a vector links with nothing."""
    schema = vectors.schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, found = b.column("embedding"), [None] * b.num_rows
            labelled = b.column("label").is_valid().to_numpy(zero_copy_only=False)
            for at, x in _matrices(lists):
                good = np.isfinite(x).all(axis=1) & x.any(axis=1) & labelled[at]
                for k, row in zip(at[good].tolist(), np.ascontiguousarray(x[good]), strict=True):
                    found[k] = hashlib.sha256(row.tobytes()).digest()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.binary())], [*b.schema.names, "digest"])

    return vectors.mapInArrow(add, StructType([*schema.fields, StructField("digest", BinaryType())]))


def _signed(classes: DataFrame, tables: int, functions: int, probes: int) -> DataFrame:
    """``classes`` with codes: the bucket numbers, table by table."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list = [None] * b.num_rows
            for at, x in _matrices(b.column("embedding")):
                for k, codes in zip(at.tolist(), buckets(_scaled(x), tables, functions, probes).tolist(), strict=True):
                    found[k] = codes
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.list_(pa.int64())))], [*b.schema.names, "codes"])

    return classes.mapInArrow(add, StructType([*classes.schema.fields, StructField("codes", ArrayType(ArrayType(LongType())))]))


def _shared_before(a: np.ndarray, b: np.ndarray, table: int, code: int) -> np.ndarray:
    """Whether the rows of a and b (pairs x tables x probes) share a bucket before the given one."""
    seen = np.zeros(len(a), bool)
    for t in range(table + 1):
        for p in range(a.shape[2]):
            for q in range(b.shape[2]):
                same = a[:, t, p] == b[:, t, q]
                seen |= same if t < table else same & (a[:, t, p] < code)
    return seen


def block_links(x: np.ndarray, y: np.ndarray, cx: np.ndarray, cy: np.ndarray, own: bool, table: int, code: int, min_cosine: float) -> np.ndarray:
    """Which rows of x and y (vectors of length 1, with their bucket lists) are linked and meet here first, as a matrix of booleans; own: y is x, no row is its own partner."""
    linked = x @ y.T >= min_cosine
    if own:
        np.fill_diagonal(linked, False)
    i, j = np.nonzero(linked)
    for at in range(0, len(i), 1 << 20):
        s = slice(at, at + (1 << 20))
        again = _shared_before(cx[i[s]], cy[j[s]], table, code)
        linked[i[s][again], j[s][again]] = False
    return linked


def _compare(min_cosine: float, block: int):
    """A function from the rows of a bucket, or of two blocks of it, to (class, links, peer): how many vectors each class links with there, and a class of its group."""

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        *_, table, code, one, two = (k.as_py() for k in key)
        n = rows.num_rows
        ids, copies = rows["class"].to_numpy(), rows["copies"].to_numpy().astype(np.float64)
        links, peers = np.zeros(n), np.arange(n)
        if n > 1:
            (_, x), = _matrices(rows["embedding"].combine_chunks())
            x = _scaled(x)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            flat = rows["codes"].combine_chunks().flatten().flatten().to_numpy()
            tables = len(rows["codes"][0])
            codes, part = flat.reshape(n, tables, -1), rows["block"].to_numpy()
            first, second = np.flatnonzero(part == one), np.flatnonzero(part == two)
            tiles = [(first[a : a + block], second[b : b + block]) for a in range(0, len(first), block) for b in range(0, len(second), block) if one != two or a <= b]
            kept = []
            for i, j in tiles:
                own = one == two and i[0] == j[0]
                linked = block_links(x[i], x[j], codes[i], codes[j], own, table, code, min_cosine)
                if linked.any():
                    links[i] += linked @ copies[j]
                    if not own:
                        links[j] += copies[i] @ linked
                    kept.append((i, j, np.packbits(linked, axis=1)))
            moved = True
            while moved:  # the smallest row of each group reaches all of it
                before = peers.copy()
                for i, j, bits in kept:
                    linked = np.unpackbits(bits, axis=1, count=len(j)).astype(bool)
                    peers[i] = np.minimum(peers[i], np.where(linked, peers[j], n).min(axis=1))
                    peers[j] = np.minimum(peers[j], np.where(linked, peers[i][:, None], n).min(axis=0))
                    peers[i] = np.minimum(peers[i], peers[peers[i]])
                moved = bool((peers != before).any())
        some = np.flatnonzero(links)
        return pa.table({"class": ids[some], "links": links[some].astype(np.int64), "peer": ids[peers[some]]})

    return compare


def near_duplicate_embeddings(vectors: DataFrame, min_cosine: float = MIN_COSINE, probes: int = PROBES, miss: float = MISS, bucket_rows: int | None = None, block: int = BLOCK) -> DataFrame:
    """vec_id, label, n_links (other vectors linked directly), component_id and kept (whether it is the one whose id the component has) of every row."""
    element = vectors.schema["embedding"].dataType.elementType
    vectors = vectors.select("vec_id", "label", F.col("embedding") if isinstance(element, FloatType) else F.col("embedding").cast("array<double>"))
    rows = staged(_digests(vectors), "vectors")
    key = ["label", "dim", "digest"]
    usable = rows.where("digest is not null").withColumn("dim", F.size("embedding"))
    # the vector is fixed by its digest; as a key it is no value that an aggregate has to carry
    distinct = usable.groupBy(*key, "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    classes = staged(distinct.withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    most, width = classes.groupBy("label", "dim").count().agg(F.max("count"), F.max("dim")).first()
    tables, functions = plan_tables((most or 0) * BUCKET_ROWS // (bucket_rows or BUCKET_ROWS), width or 2, min_cosine, probes, miss)
    signed = staged(_signed(classes.select("label", "dim", "class", "copies", "embedding"), tables, functions, probes), "signed-vectors")
    placed = signed.select("*", F.posexplode("codes").alias("table", "own")).withColumn("code", F.explode("own")).drop("own")
    bucket = ["label", "dim", "table", "code"]
    large = placed.select(*bucket).groupBy(*bucket).count().where(F.col("count") > block)
    large = staged(large.select(*(F.col(c).alias(f"_{c}") for c in bucket), F.ceil(F.col("count") / block).cast("int").alias("blocks")), "large-buckets")
    large = F.broadcast(large) if large.count() <= BROADCAST_BUCKETS else large
    dealt = placed.join(large, [F.col(c) == F.col(f"_{c}") for c in bucket], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*bucket, "class", "copies", "embedding", "codes", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    met = staged(dealt.groupBy(*bucket, "one", "two").applyInArrow(_compare(min_cosine, block), "class long, links long, peer long"), "bucket-links")
    counts = met.groupBy(F.col("class").alias("_class")).agg(F.sum("links").alias("links"))
    groups = connected_components(met.select(F.col("class").alias("a"), F.col("peer").alias("b")))
    named = classes.select(*key, "class", "copies", "least").join(groups, F.col("class") == F.col("node"), "left").withColumn("component", F.coalesce("component", "class"))
    named = staged(named.join(counts, F.col("class") == F.col("_class"), "left").select(*key, "copies", "least", "component", F.coalesce("links", F.lit(0)).alias("links")), "named-classes")
    ids = named.groupBy(F.col("component").alias("_component")).agg(F.min("least").alias("component_id"))
    named = named.join(ids, F.col("component") == F.col("_component")).select(F.col("label").alias("_label"), F.col("digest").alias("_digest"), (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    # a hot vector is a skewed key on the left, which adaptive execution splits
    found = rows.select("vec_id", "label", "digest").join(named, (F.col("digest") == F.col("_digest")) & F.col("label").eqNullSafe(F.col("_label")), "left")
    own = F.col("digest").isNotNull()
    found = found.select("vec_id", "label", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(own, F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
