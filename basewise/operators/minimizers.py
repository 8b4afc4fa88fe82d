"""Minimizers, super-k-mers and buckets.

Everything about one sequence is computed from 2-bit numbers inside its row, a piece at a time: no shuffle and no window over
rows. Super-k-mers leave the row as one record per run, not one per k-mer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.alphabet import check_order, digits, encode
from .packed import CHUNK, MOST_K, Minimizing, as_bytes, base_table, both_strands, check_k, code_counts, joined_texts, letters_of, spelled, strings


def allowed(mmer: Column) -> Column:
    """Whether an m-mer may be a minimizer: it has no AA but at its start."""
    return F.instr(F.substr(mmer, F.lit(2)), F.lit("AA")) == 0


def _minimizing(seqs: DataFrame, k: int, m: int, order: str, policy: str, ban_aa: bool, ranks: DataFrame | None, hashed: bool) -> Minimizing:
    if not 1 <= m <= k or m > MOST_K:
        raise ValueError(f"m must be between 1 and k, {MOST_K} at most")
    check_order(order)
    table = None
    if ranks is not None:  # 4**m numbers whatever the data
        if m > 10:
            raise ValueError("frequency ranks are for m up to 10")
        known = ranks.select(encode(F.col("mmer"), order).alias("code"), F.col("rank").cast("long").alias("rank")).toPandas()
        table = np.full(4**m, 4**m, np.int64)
        table[known["code"].to_numpy()] = known["rank"].to_numpy()
    return Minimizing(k, m, order, policy, ban_aa, table, hashed)


def _mapped(seqs: DataFrame, others: list[str], added: str, rows_of) -> DataFrame:
    """Rows of the columns ``others`` and ``added`` (names and types). rows_of takes texts laid end to end, a separator between them, and where each begins; it yields the number of each row's text, and arrays."""
    names = [x.split()[0] for x in added.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in joined_texts(b.column("seq")):
                begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
                for text, *arrays in rows_of(b"\0".join(texts), begins):
                    own = pa.array(text + first)
                    if len(own):
                        yield pa.RecordBatch.from_arrays([*(b.column(c).take(own) for c in others), *arrays], [*others, *names])

    kinds = [f"`{c}` {seqs.schema[c].dataType.simpleString()}" for c in others]
    return seqs.select(*others, "seq").mapInArrow(cut, ", ".join([*kinds, added]))


def minimizers(seqs: DataFrame, k: int, m: int, order: str = "ACTG", policy: str = "skip", ban_aa: bool = False, ranks: DataFrame | None = None, hashed: bool = False, flags: bool = False) -> DataFrame:
    """One row per valid k-mer: the columns of ``seqs`` but seq, pos, kmer, minimizer and minimizer_at (both from 0).

    The smallest canonical m-mer by ``order``, by ``ranks`` and then ``order``, or, with ``hashed``, by the 64-bit mix of its number (unsigned);
    of equal ones the rightmost. With ban_aa, m-mers that ``allowed`` refuses count as the largest of all, hashed or not; with ``ranks`` they have the rank that the table gives them.
    flags adds minimizer_reversed (the sequence has its reverse complement there) and minimizer_tied (another m-mer of the k-mer compares equal).
    """
    of = _minimizing(seqs, k, m, order, policy, ban_aa, ranks, hashed)

    def rows(data: bytes, begins: np.ndarray):
        codes = of.table[np.frombuffer(data, np.uint8)]
        spelt = of.upper[codes]
        for first, mini, place, ok, turned, tied in of.flagged(codes):
            for at in range(0, len(ok), 1 << 15):  # spelled out some at a time
                x = np.flatnonzero(ok[at : at + (1 << 15)]) + at
                if len(x):
                    words = np.lib.stride_tricks.sliding_window_view(spelt, k)[x + first]
                    text = np.searchsorted(begins, x + first, "right") - 1
                    pos, mini_at = (x + first - begins[text]).astype(np.int32), (place[x] - begins[text]).astype(np.int32)
                    yield text, pa.array(pos), strings(words, np.full(len(x), k)), strings(letters_of(mini[x], m, order), np.full(len(x), m)), pa.array(mini_at), *((pa.array(turned[x]), pa.array(tied[x])) if flags else ())

    others = [c for c in seqs.columns if c != "seq"]
    return _mapped(seqs, others, "pos int, kmer string, minimizer string, minimizer_at int" + (", minimizer_reversed boolean, minimizer_tied boolean" if flags else ""), rows)


def super_kmers(seqs: DataFrame, k: int, m: int, order: str = "ACTG", policy: str = "skip", max_kmers: int | None = None, ban_aa: bool = False, ranks: DataFrame | None = None, hashed: bool = False) -> DataFrame:
    """Runs of consecutive k-mers with one minimizer: the other columns, run_id, minimizer, start, n_kmers and seq.

    A run ends where the minimizer changes, at an invalid k-mer, or after ``max_kmers`` k-mers.
    """
    of = _minimizing(seqs, k, m, order, policy, ban_aa, ranks, hashed)

    def rows(data: bytes, begins: np.ndarray):
        codes = of.table[np.frombuffer(data, np.uint8)]
        start, mini, size = of.runs(codes)
        if max_kmers and len(size):
            parts = -(-size // max_kmers)
            step = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * max_kmers
            start, mini, size = np.repeat(start, parts) + step, np.repeat(mini, parts), np.minimum(np.repeat(size, parts) - step, max_kmers)
        text = np.searchsorted(begins, start, "right") - 1
        ids = np.arange(len(start)) - np.searchsorted(text, text)
        spelt = of.upper[codes]
        for at in range(0, len(start), 20_000):
            s, z = start[at : at + 20_000], size[at : at + 20_000] + (k - 1)
            before = np.cumsum(z) - z
            data = spelt[np.repeat(s - before, z) + np.arange(z.sum())]
            own = text[at : at + 20_000]
            yield own, pa.array(ids[at : at + 20_000]), strings(letters_of(mini[at : at + 20_000], m, order), np.full(len(s), m)), pa.array((s - begins[own]).astype(np.int32)), pa.array((z - (k - 1)).astype(np.int32)), strings(data, z)

    others = [c for c in seqs.columns if c != "seq"]
    return _mapped(seqs, others, "run_id long, minimizer string, start int, n_kmers int, seq string", rows)


def minimizer_totals(seqs: DataFrame, k: int, m: int, order: str = "ACTG", policy: str = "skip", ban_aa: bool = False, ranks: DataFrame | None = None, hashed: bool = False) -> DataFrame:
    """minimizer, n_super_kmers and n_kmers: the sums over ``super_kmers``, whose runs are added up where they are found and never spelled."""
    of = _minimizing(seqs, k, m, order, policy, ban_aa, ranks, hashed)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in joined_texts(b.column("seq")):
                _, mini, size = of.runs(of.table[np.frombuffer(b"\0".join(texts), np.uint8)])
                if len(mini):
                    by = np.argsort(mini)
                    mini, size = mini[by], size[by]
                    first = np.flatnonzero(np.concatenate([[True], mini[1:] != mini[:-1]]))
                    yield pa.RecordBatch.from_arrays([pa.array(mini[first].astype(np.int64)), pa.array(np.diff(first, append=len(mini))), pa.array(np.add.reduceat(size, first))], ["code", "s", "n"])

    sums = seqs.select("seq").mapInArrow(add, "code long, s long, n long").groupBy("code").agg(F.sum("s").alias("n_super_kmers"), F.sum("n").alias("n_kmers"))
    return sums.select(spelled("code", m, order).alias("minimizer"), "n_super_kmers", "n_kmers")


def mmer_ranks(seqs: DataFrame, m: int, order: str = "ACTG", share: float = 1.0, seed: int = 0) -> DataFrame:
    """mmer, n and rank (from 0, by rising frequency, then by ``order``) of the canonical m-mers that occur.

    ``share`` below 1 counts a sample of the sequences. The window runs over at most 4**m rows.
    """
    some = seqs.sample(share, seed) if share < 1 else seqs
    counts = code_counts(some, m, order=order).groupBy("code").agg(F.sum("n").alias("n")).select(spelled("code", m, order).alias("mmer"), "n")
    return counts.withColumn("rank", (F.row_number().over(Window.orderBy("n", digits("mmer", order))) - 1).cast("long"))


def bucket_of(minimizer: Column | str, length: int = 12) -> Column:
    """A minimizer's bucket: its first bases."""
    c = F.col(minimizer) if isinstance(minimizer, str) else minimizer
    return F.substr(c, F.lit(1), F.lit(length))


def bucket_stats(supers: DataFrame, length: int) -> DataFrame:
    """bucket, n_super_kmers, n_kmers and largest (k-mers of its longest super-k-mer)."""
    return supers.groupBy(bucket_of("minimizer", length).alias("bucket")).agg(F.count("*").alias("n_super_kmers"), F.sum("n_kmers").cast("long").alias("n_kmers"), F.max("n_kmers").cast("long").alias("largest"))


def menu_stats(buckets: DataFrame, possible: int) -> DataFrame:
    """One row over all buckets: used, empty, totals, the largest, and means as thousandths."""
    n = F.count("*")
    return buckets.agg(
        n.alias("used"), (F.lit(possible) - n).cast("long").alias("empty"), F.sum("n_super_kmers").cast("long").alias("n_super_kmers"), F.sum("n_kmers").cast("long").alias("n_kmers"),
        F.max("n_kmers").alias("largest_bucket"), F.floor(F.sum("n_kmers") * 1000 / F.sum("n_super_kmers")).cast("long").alias("kmers_per_super_kmer_x1000"),
        F.floor(F.sum("n_super_kmers") * 1000 / n).cast("long").alias("super_kmers_per_bucket_x1000"),
    )


def run_lengths(supers: DataFrame) -> DataFrame:
    """n_kmers and how many super-k-mers have that many."""
    return supers.groupBy(F.col("n_kmers").cast("long").alias("n_kmers")).agg(F.count("*").alias("n_super_kmers"))


def strand_runs(seqs: DataFrame, k: int, order: str = "ACGT", policy: str = "skip") -> DataFrame:
    """run_length and n_runs of consecutive valid k-mers on the same strand (a palindrome counts as forward)."""
    table = base_table(order, policy)
    check_k(k)

    def lengths(text: str | None) -> np.ndarray:
        codes = table[np.frombuffer(as_bytes(text), np.uint8)]
        n, starts, kept, last = max(0, len(codes) - k + 1), [], [], None
        for first in range(0, n, CHUNK):
            forward, back, ok = both_strands(codes[first : first + CHUNK + k - 1], k, order)
            side = np.where(ok, (forward <= back).astype(np.int8), np.int8(2))
            x = np.flatnonzero(np.concatenate([[last is None or last != side[0]], side[1:] != side[:-1]]))
            starts.append(x + first)
            kept.append(side[x] < 2)
            last = side[-1]
        return np.diff(np.concatenate([*starts, [n]]))[np.concatenate(kept)] if n else np.empty(0, np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, n = np.unique(np.concatenate([np.empty(0, np.int64), *(lengths(t) for t in b.column("seq").to_pylist())]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(size.astype(np.int64)), pa.array(n.astype(np.int64))], ["run_length", "n_runs"])

    return seqs.select("seq").mapInArrow(count, "run_length long, n_runs long").groupBy("run_length").agg(F.sum("n_runs").alias("n_runs"))


def greedy_partitions(bins: DataFrame, n: int, most: int = 1 << 20) -> DataFrame:
    """bin, size and part: the largest bin always goes to the emptiest part. Bins are collected, at most ``most`` of them."""
    import heapq

    rows = bins.select("bin", "size").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} bins")
    heap, out = [(0, p) for p in range(n)], []
    for r in sorted(rows, key=lambda r: (-r["size"], r["bin"])):
        load, p = heapq.heappop(heap)
        out.append((r["bin"], r["size"], p))
        heapq.heappush(heap, (load + r["size"], p))
    return bins.sparkSession.createDataFrame(out, bins.select("bin", "size").schema.add("part", IntegerType()))


def grouped_partitions(bins: DataFrame, n: int, by: list[Column | str], rule: str = "share", most: int = 1 << 20) -> DataFrame:
    """bin, size and part: bins in the order ``by`` fill one part after another.

    Rule ``share`` cuts at shares of the total, by a window over one row per minimizer, 4**m at most. Rule ``refill`` fills a part until it has more than the
    mean and begins the next from nothing, the last one taking the rest; each cut depends on the one before, so bins are collected, at most ``most`` of them.
    """
    if rule == "share":
        before = F.sum("size").over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))
        total = F.sum("size").over(Window.partitionBy())
        part = F.floor(F.coalesce(before, F.lit(0)) * n / total)
        return bins.select("bin", "size", F.least(part, F.lit(n - 1)).cast("int").alias("part"))
    if rule != "refill":
        raise ValueError(f"rule must be share or refill, not {rule!r}")
    rows = bins.orderBy(*by).select("bin", "size").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} bins")
    mean, held, part, out = sum(r["size"] for r in rows) // n, 0, 0, []
    for r in rows:
        out.append((r["bin"], r["size"], part))
        held += r["size"]
        if held > mean:
            held, part = 0, min(part + 1, n - 1)
    return bins.sparkSession.createDataFrame(out, bins.select("bin", "size").schema.add("part", IntegerType()))


def sampled_bins(seqs: DataFrame, k: int, m: int, enough: int, key: str, by: str = "n_kmers", order: str = "ACTG", policy: str = "skip", first: float = 1 / 64) -> tuple[DataFrame, float]:
    """(bin and size, share): k-mers per minimizer, scaled up from a sample that grows until it has ``enough`` super-k-mers or is all there is.

    The sample is a share of the values of the column ``key`` by hash, so a larger one holds the smaller ones and a second attempt draws the same rows. It grows by four, so
    all attempts together read a third more sequences than the last. Minimizers that were not seen are not in the table: ``route`` sends them to a part of their own choice.
    """
    from ..plans.scratch import scratch

    spark, share = seqs.sparkSession, first
    while True:
        some = seqs if share >= 1 else seqs.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(share * (1 << 20)))
        path = scratch(spark, "sampled-bins")
        runs = super_kmers(some.select("seq"), k, m, order, policy)
        runs.groupBy(F.col("minimizer").alias("bin")).agg(F.count("*").alias("n_super_kmers"), F.sum("n_kmers").cast("long").alias("n_kmers")).write.parquet(path)
        bins = spark.read.parquet(path)
        seen = bins.agg(F.sum("n_super_kmers")).first()[0] or 0
        if seen >= enough or share >= 1:
            return bins.select("bin", F.greatest(F.round(F.col(by) / share), F.lit(1)).cast("long").alias("size")), min(share, 1.0)
        share *= 4


#: Minimizers up to which a table of parts is broadcast; a shuffle join beyond.
BROADCAST_BINS = 1 << 20


def route(supers: DataFrame, table: DataFrame, unseen: int | None = None, deal: bool = True) -> DataFrame:
    """Super-k-mers, or totals, with the part of their minimizer; those whose minimizer the table does not have go to part ``unseen``, or out if that is None.

    deal brings the rows of a part together, in as many tasks as there are parts at most; without it rows stay where they are, in as many tasks as the input has.
    """
    parts = table.select(F.col("bin").alias("minimizer"), "part")
    parts = F.broadcast(parts) if table.limit(BROADCAST_BINS + 1).count() <= BROADCAST_BINS else parts
    if unseen is None:
        found = supers.join(parts, "minimizer")
    else:
        found = supers.join(parts, "minimizer", "left").withColumn("part", F.coalesce("part", F.lit(unseen)))
    return found.repartition("part") if deal else found


def partition_stats(routed: DataFrame) -> DataFrame:
    """Per part: n_minimizers, n_super_kmers and n_kmers, of super-k-mers or of ``minimizer_totals``."""
    n = F.sum("n_super_kmers") if "n_super_kmers" in routed.columns else F.count("*")
    each = routed.groupBy("part", "minimizer").agg(n.alias("s"), F.sum("n_kmers").cast("long").alias("n"))  # sums leave tasks, not rows
    return each.groupBy("part").agg(F.count("*").alias("n_minimizers"), F.sum("s").alias("n_super_kmers"), F.sum("n").alias("n_kmers"))
