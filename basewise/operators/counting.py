"""Counting k-mers: exactly, over several banks, through super-k-mers, and for heavy hitters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import packed
from .kmers import valid_kmers
from .minimizers import super_kmers


def count_kmers(seqs: DataFrame, k: int, policy: str = "skip", order: str | None = "ACGT") -> DataFrame:
    """kmer and n: one shuffle of partial counts. order None counts k-mers as read. Up to k = 31 k-mers are counted and shuffled as numbers."""
    if k > packed.MOST_K:
        return valid_kmers(seqs.select("seq"), k, policy, order).groupBy("kmer").agg(F.count("*").alias("n"))
    counts = packed.code_counts(seqs, k, policy, order).groupBy("code").agg(F.sum("n").alias("n"))
    return counts.select(packed.spelled("code", k, order).alias("kmer"), "n")


def task_counts(seqs: DataFrame, k: int, policy: str = "skip", order: str | None = "ACGT") -> DataFrame:
    """kmer and n as tasks count them, a k-mer as often as tasks have it: what takes weighted k-mers, such as a sketch, needs no row for each occurrence."""
    return packed.code_counts(seqs, k, policy, order).select(packed.spelled("code", k, order).alias("kmer"), "n")


def count_through_super_kmers(seqs: DataFrame, k: int, m: int, order: str = "ACGT", policy: str = "skip") -> DataFrame:
    """The same counts, with super-k-mers shuffled and cut into k-mers behind the shuffle.

    Tasks first sum equal super-k-mers, so a repeat that makes up much of the input leaves a task as one row with its number. Rows are then dealt by minimizer and
    bases, so that a frequent minimizer is spread over tasks; their k-mers count as often as they stand there, and partial counts are summed once more.
    """
    packed.check_k(k)
    runs = super_kmers(seqs.select("seq"), k, m, policy=policy).groupBy("minimizer", "seq").agg(F.count("*").alias("times"))
    counts = packed.code_counts(runs.select("seq", "times"), k, order=order, by=["times"])
    return counts.groupBy("code").agg(F.sum(F.col("n") * F.col("times")).alias("n")).select(packed.spelled("code", k, order).alias("kmer"), "n")


def wrap_uint8(n: Column | str) -> Column:
    """A count as a counter of 8 bits that overflows shows it."""
    return F.pmod(F.col(n) if isinstance(n, str) else n, F.lit(256))


def saturate(n: Column | str, most: int = 255) -> Column:
    return F.least(F.col(n) if isinstance(n, str) else n, F.lit(most))


def heavy_hitters(seqs: DataFrame, k: int, at_least: int = 4, most: int | None = 255, policy: str = "skip", capacity: int | None = None) -> DataFrame:
    """kmer and n of the k-mers seen at_least times; counts stop at ``most``. capacity keeps the most frequent."""
    found = count_kmers(seqs, k, policy).where(F.col("n") >= at_least)
    found = found.withColumn("n", saturate("n", most).cast("long")) if most else found
    return found.orderBy(F.col("n").desc(), "kmer").limit(capacity) if capacity else found


#: Admitted k-mers up to which their list is broadcast; a shuffle join beyond.
BROADCAST_KMERS = 1 << 22


def count_admitted(seqs: DataFrame, admitted: DataFrame, k: int, most: int | None = 255, policy: str = "skip") -> DataFrame:
    """kmer and n of only those k-mers that ``admitted`` lists.

    Up to k = 31 the list is written once as numbers. While it may be broadcast, tasks drop other k-mers before the shuffle; beyond, sums are joined with it by number.
    """
    if k > packed.MOST_K:
        counts = count_kmers(seqs, k, policy).join(admitted.select("kmer"), "kmer", "left_semi")
    else:
        from ..functions.alphabet import encode
        from ..plans.scratch import scratch

        path = scratch(seqs.sparkSession, "admitted")
        admitted.select(encode(F.col("kmer"), "ACGT").alias("code")).distinct().write.parquet(path)
        listed = seqs.sparkSession.read.parquet(path)
        parts = packed.code_counts(seqs, k, policy)
        if listed.count() <= BROADCAST_KMERS:
            parts = parts.join(F.broadcast(listed), "code", "left_semi").groupBy("code").agg(F.sum("n").alias("n"))
        else:
            parts = parts.groupBy("code").agg(F.sum("n").alias("n")).join(listed, "code", "left_semi")
        counts = parts.select(packed.spelled("code", k, "ACGT").alias("kmer"), "n")
    return counts.withColumn("n", saturate("n", most).cast("long")) if most else counts


def count_banks(seqs: DataFrame, k: int, bank: str, policy: str = "skip", order: str = "ACGT") -> DataFrame:
    """kmer, bank and n in long form."""
    named = seqs.select(F.col(bank).alias("bank"), "seq")
    if k > packed.MOST_K:
        return valid_kmers(named, k, policy, order).groupBy("kmer", "bank").agg(F.count("*").alias("n"))
    counts = packed.code_counts(named, k, policy, order, ["bank"]).groupBy("code", "bank").agg(F.sum("n").alias("n"))
    return counts.select(packed.spelled("code", k, order).alias("kmer"), "bank", "n")


def count_vectors(long_counts: DataFrame, banks: list[str]) -> DataFrame:
    """kmer, counts (an array in the order of ``banks``) and total."""
    each = [F.sum(F.when(F.col("bank") == b, F.col("n")).otherwise(0)).cast("long") for b in banks]
    return long_counts.groupBy("kmer").agg(F.array(*each).alias("counts"), F.sum("n").cast("long").alias("total"))


def merge_counts(*tables: DataFrame) -> DataFrame:
    """The sum of several tables (kmer, n)."""
    every = tables[0].select("kmer", "n")
    for t in tables[1:]:
        every = every.unionByName(t.select("kmer", "n"))
    return every.groupBy("kmer").agg(F.sum("n").cast("long").alias("n"))


def top_kmers(counts: DataFrame, limit: int) -> DataFrame:
    """The most frequent k-mers; ties go by the k-mer."""
    return counts.orderBy(F.col("n").desc(), "kmer").limit(limit)
