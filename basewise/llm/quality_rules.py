"""Quality rules by a hashed n-gram log-likelihood ratio (native: DataFrame operations only).

Two multinomials over hashed word 1- and 2-grams are counted, one over the trusted target
documents and one over the whole raw corpus. A document's score is the mean, over its n-grams, of
ln(p_target / p_raw); documents under a fixed threshold are rejected. Counts cover every row.

A word is hashed once, to the 64 bits of XXH64; pairs of words and windows of three are hashes of these
numbers, so that no strings are put together. Equal 64-bit hashes are taken for equal windows.

With T and R the n-grams of target and corpus, a bucket's weight is
ln((target + A) / (raw * T / R + A)): both multinomials are smoothed by the same pseudo-count A per
bucket, in target units, so buckets with little evidence weigh nearly nothing. Weights are rounded
to multiples of 2**-20 and summed as integers, so that no order of addition changes a verdict.

Defined cases: a null, empty or blank text has no words and fails the base rules. Without any
trusted document (or with an empty table) all weights are 0 and only the base rules decide.
Repeated rows count and are judged each for itself. Other columns of the input, whatever their names, pass
through untouched; only ``quality`` is replaced by ``score_quality``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import all_columns, bind, free, named, staged

BUCKETS = 1 << 18
PSEUDO_COUNT = 10.0
THRESHOLD = -0.1
#: Target ids up to which they are broadcast; a shuffle join beyond.
BROADCAST_IDS = 200_000
SCALE = 1 << 20
MIN_WORDS = 50
#: One separator of words: space or an ASCII control from tab to carriage return.
SEPARATOR = r"[\x20\x09-\x0D]"


def _masked(h: Column, buckets: int) -> Column:
    if buckets & (buckets - 1):
        raise ValueError("the number of buckets must be a power of 2")
    return h.bitwiseAND(F.lit(buckets - 1))


def _pair(x: Column, y: Column) -> Column:
    """The hash of two words next to each other, from theirs."""
    return F.xxhash64(x, y)


def _from(a: Column, start: int) -> Column:
    """An array from its start-th element on."""
    return F.slice(a, start, F.greatest(F.size(a) - (start - 1), F.lit(0)))


def exploded_buckets(docs: DataFrame, text: Column, buckets: int = BUCKETS) -> DataFrame:
    """The columns of ``docs`` but its texts, with ``bucket``: one row for each 1-gram and each 2-gram."""
    parts, pair, both = (free(n, docs) for n in ("parts", "pair", "both"))
    w = docs.withColumn(parts, F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATOR), ""))
    others = [c for c in docs.columns if c != "text"]
    rows = w.select(*map(named, others), F.explode(F.arrays_zip(named(parts).alias("x"), _from(named(parts), 2).alias("y"))).alias(pair))
    x, y = F.xxhash64(f"{pair}.x"), F.xxhash64(f"{pair}.y")
    one, two = _masked(x, buckets), F.when(F.col(f"{pair}.y").isNotNull(), _masked(_pair(x, y), buckets))
    wide = rows.select(*map(named, others), F.explode(F.array(one, two)).alias("bucket"))
    return wide.where("bucket is not null").withColumn("bucket", F.col("bucket").cast("int"))


def _bits(a: Column) -> Column:
    """Bits that hold any position of an array."""
    return F.length(F.bin(F.size(a).cast("long")))


def _shift(x: Column, a: Column) -> Column:
    return F.call_function("shiftleft", x, _bits(a))


def windows(h: Column) -> Column:
    """Hashes of all 3-word windows, from the hashes of the words."""
    return bind(h, lambda h: F.transform(_from(h, 3), lambda z, i: F.xxhash64(F.get(h, i), F.get(h, i + 1), z)))


def packed(win: Column) -> Column:
    """The upper bits of each window's hash, with its position in the bits below, in order."""
    return F.sort_array(bind(win, lambda a: bind(_bits(a), lambda bits: F.transform(a, lambda x, i: F.call_function("shiftleft", x, bits).bitwiseOR(i.cast("long"))))))


def repeat_words(win: Column, ordered: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, from the windows' hashes and from these ``packed``."""

    def counted(s: Column, win: Column, bits: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        at = lambda p: p.bitwiseAND(mask).cast("int")
        # only position bits differ in numbers of one prefix
        alike = lambda p, q: p.bitwiseOR(mask) == q.bitwiseOR(mask)
        found = F.filter(s, lambda p, j: alike(p, F.coalesce(F.get(s, j - 1), F.bitwise_not(p))) | alike(p, F.coalesce(F.get(s, j + 1), F.bitwise_not(p))))

        def exact(f: Column) -> Column:
            """Positions of repeated windows; windows that share only the upper bits are told apart."""
            differ = F.exists(F.sequence(F.lit(1), F.size(f) - 1), lambda j: alike(F.get(f, j), F.get(f, j - 1)) & (F.get(win, at(F.get(f, j))) != F.get(win, at(F.get(f, j - 1)))))
            whole = F.transform(f, lambda p: F.struct(F.get(win, at(p)).alias("h"), at(p).alias("i")))
            same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
            told = bind(F.sort_array(whole), lambda o: F.transform(F.filter(o, lambda x, j: same(x, F.get(o, j - 1)) | same(x, F.get(o, j + 1))), lambda x: x["i"]))
            return F.when(differ, told).otherwise(F.transform(f, at))

        places = bind(found, lambda f: F.when(F.size(f) > 1, F.sort_array(exact(f))).otherwise(F.array().cast("array<int>")))
        # a window covers three words, or as many as there are until the next one begins
        return bind(
            places,
            lambda p: F.when(F.size(p) == 0, 0).otherwise(F.aggregate(F.transform(_from(p, 2), lambda b, j: F.least(b - F.get(p, j), F.lit(3)).cast("long")), F.lit(3).cast("long"), lambda acc, x: acc + x)),
        )

    some = bind(ordered, lambda s: bind(win, lambda w: bind(_bits(w), lambda bits: counted(s, w, bits))))
    return F.when(ordered.isNotNull(), some).otherwise(0).cast("long")


def with_base(docs: DataFrame, column: str) -> DataFrame:
    """``docs`` with a struct of the base counts of each text and the hashes ``h`` of its words.

    Arrays are columns of their own where a sort or a set is taken of them: inside lambdas those would run on boxed numbers.
    """
    w, h, win, ordered = (free(n, docs) for n in ("words", "hashes", "windows", "ordered"))
    t = F.coalesce("text", F.lit(""))
    rows = docs.withColumn(w, F.array_remove(F.split(t, SEPARATOR), ""))
    rows = rows.withColumn(h, F.transform(named(w), lambda x: F.xxhash64(x)))
    rows = rows.withColumn(win, windows(named(h)))
    rows = rows.withColumn(ordered, F.when(F.size(F.array_distinct(named(win))) < F.size(named(win)), packed(named(win))))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = F.struct(
        F.size(named(h)).cast("long").alias("n_words"),
        F.length(F.array_join(named(w), "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        repeat_words(named(win), named(ordered)).alias("n_repeat_words"),
        named(h).alias("h"),
    )
    return rows.withColumn(column, counts).drop(w, h, win, ordered)


def trusted_ids(labels: DataFrame, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """Ids of all target documents, to be broadcast if they number at most ``broadcast_ids``. Toxic ones are no target."""
    ids = labels.select(F.col("doc_id").alias("trusted_id")).where("trusted_id is not null").distinct()
    if "toxic" in labels.columns:
        toxic = labels.where("toxic = 1").select(F.col("doc_id").alias("_toxic"))
        ids = ids.join(toxic, F.col("trusted_id") == F.col("_toxic"), "left_anti")
    return F.broadcast(ids) if ids.count() <= broadcast_ids else ids.hint("shuffle_merge")


def bucket_weights(docs: DataFrame, trusted: DataFrame, buckets: int, pseudo_count: float) -> DataFrame:
    """(bucket, weight) for every bucket. trusted: ``trusted_id`` of the target documents.

    The target's and the corpus' counts come from one pass and one map-side combined aggregate.
    """
    marked = docs.select("doc_id", "text").join(trusted, F.col("doc_id") == F.col("trusted_id"), "left")
    grams = exploded_buckets(marked.select(F.col("trusted_id").isNotNull().cast("long").alias("t"), "text"), F.col("text"), buckets)
    counts = staged(grams.groupBy("bucket").agg(F.sum("t").alias("target"), F.count("*").alias("raw")), "ngram-counts")
    t, r = counts.agg(F.sum("target"), F.sum("raw")).first()
    if t:
        ratio = F.log((F.col("target") + pseudo_count) / (F.col("raw") * (t / r) + pseudo_count))
    else:
        ratio = F.lit(0.0)
    weighed = counts.select(F.col("bucket"), F.round(ratio * SCALE).cast("long").alias("weight"))
    return staged(every_bucket(weighed, buckets), "ngram-weights")


def every_bucket(weighed: DataFrame, buckets: int) -> DataFrame:
    """(bucket, weight) of all buckets, 0 where ``weighed`` has none."""
    every = weighed.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(weighed, "bucket", "left").select("bucket", F.coalesce("weight", F.lit(0)).cast("long").alias("weight"))


def weight_array(weights: DataFrame) -> Column:
    """The weights in the order of their buckets, one array of fixed size, as the value of a scalar subquery."""
    return weights.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "weight"))), lambda x: x["weight"]).alias("table")).scalar()


def total_weight(h: Column, table: Column, buckets: int) -> Column:
    """The sum of the weights of all 1-grams and 2-grams, from the hashes of the words."""

    def summed(h: Column, table: Column) -> Column:
        add = lambda acc, x: acc + F.get(table, _masked(x, buckets))
        ones = F.aggregate(h, F.lit(0).cast("long"), add)
        return F.aggregate(F.transform(_from(h, 2), lambda y, i: _pair(F.get(h, i), y)), ones, add)

    return bind(h, lambda h: bind(table, lambda t: summed(h, t)))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    buckets: int = BUCKETS,
    pseudo_count: float = PSEUDO_COUNT,
    threshold: float = THRESHOLD,
    broadcast_ids: int = BROADCAST_IDS,
    column: str = "quality",
) -> DataFrame:
    """Every row of ``docs`` with a struct ``quality``: the base counts, ``base_failed``, ``n_grams``, ``llr`` (mean weight) and ``kept``.

    labels: rows with the ``doc_id`` of trusted documents; where there is a column ``toxic``, ids with 1 in it are not trusted. The weights, one array of ``buckets``
    numbers whatever the corpus holds, reach the tasks as the value of a scalar subquery; documents
    are then scored where they are read, and no text is shuffled.
    """
    weights = weight_array(bucket_weights(docs, trusted_ids(labels, broadcast_ids), buckets, pseudo_count))
    limit = round(threshold * SCALE)
    base, table = free("base", docs), free("table", docs)

    def judged(q: Column) -> Column:
        n, rep = q["n_words"], q["n_repeat_words"]
        failed = (n < MIN_WORDS) | (100 * rep > 50 * n)
        n_grams = F.greatest(2 * n - 1, F.lit(0))
        return bind(
            total_weight(q["h"], named(table), buckets),
            lambda total: F.struct(
                n.alias("n_words"), q["word_chars"].alias("word_chars"), q["n_symbols"].alias("n_symbols"), q["n_dup_lines"].alias("n_dup_lines"),
                rep.alias("n_repeat_words"), failed.alias("base_failed"), n_grams.alias("n_grams"),
                (total / F.greatest(n_grams, F.lit(1)) / SCALE).alias("llr"), (~failed & (total >= n_grams * limit)).alias("kept"),
            ),
        )

    # named once, so that the optimizer folds the subquery's value into the sum and no row carries the table
    scored = with_base(docs, base).withColumn(table, weights)
    return scored.withColumn(column, bind(named(base), judged)).drop(base, table)


def filter_quality(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, all columns, that ``score_quality`` keeps."""
    column = free("quality", docs)
    return score_quality(docs, labels, column=column, **settings).where(named(column)["kept"]).select(*all_columns(docs))
