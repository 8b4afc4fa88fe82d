"""Statistics of banks, counts and runs; ratios are whole thousandths or so, to compare exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import clean


def bank_stats(seqs: DataFrame, k: int, by: list[str], policy: str = "skip") -> DataFrame:
    """Per bank: sequences, their min, max, sum, mean and standard deviation of length, valid and invalid k-mers."""
    s = seqs.select(*by, clean(F.col("seq"), policy).alias("_s"))
    n = F.length("_s")
    # a run of n valid bases has n - k + 1 k-mers; no k-mer is spelled out
    runs = F.regexp_extract_all("_s", F.lit(f"[ACGT]{{{k},}}"), F.lit(0))
    valid = F.coalesce(F.aggregate(runs, F.lit(0).cast("long"), lambda total, x: total + F.length(x) - (k - 1)), F.lit(0).cast("long"))
    rows = s.select(*by, n.cast("long").alias("n"), F.greatest(n - (k - 1), F.lit(0)).cast("long").alias("all"), valid.alias("valid"))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_seqs"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.sum("n").alias("bases"), F.floor(F.avg("n") * 1000).cast("long").alias("mean_x1000"),
        F.floor(F.stddev_pop("n") + 1e-6).cast("long").alias("deviation"), F.sum("valid").alias("valid_kmers"), (F.sum("all") - F.sum("valid")).alias("invalid_kmers"),
    )


def estimate(seqs: DataFrame, share: float = 1.0, seed: int = 0) -> DataFrame:
    """n_seqs, bases and longest of a bank: exact, or from a share of its sequences."""
    some = seqs.sample(share, seed) if share < 1 else seqs
    up = lambda c: F.round(c / share).cast("long") if share < 1 else c
    return some.agg(up(F.count("*")).alias("n_seqs"), up(F.sum(F.length("seq").cast("long"))).alias("bases"), F.max(F.length("seq").cast("long")).alias("longest"))


def table_stats(counts: DataFrame, parts: int, key: Column | None = None) -> DataFrame:
    """How evenly k-mers fall into parts by a hash (``key``, or one of Spark's own): parts in use, items, biggest, smallest and mean."""
    each = counts.groupBy(F.pmod(F.xxhash64("kmer") if key is None else key, F.lit(parts)).alias("part")).agg(F.count("*").alias("n"))
    return each.agg(F.count("*").alias("parts"), F.sum("n").alias("items"), F.max("n").alias("biggest"), F.min("n").alias("smallest"), F.floor(F.avg("n")).cast("long").alias("mean"))


def run_summary(supers: DataFrame, k: int) -> DataFrame:
    """Super-k-mers, k-mers, their mean length and the bases stored per k-mer, in thousandths."""
    n, kmers = F.count("*"), F.sum("n_kmers").cast("long")
    bases = F.sum(F.length("seq").cast("long"))
    return supers.agg(n.alias("n_super_kmers"), kmers.alias("n_kmers"), bases.alias("bases"), F.floor(bases * 1000 / n).cast("long").alias("mean_length_x1000"), F.floor(bases * 1000 / kmers).cast("long").alias("bases_per_kmer_x1000"))


def approximate_distinct(kmers: DataFrame, error: float = 0.02) -> DataFrame:
    return kmers.agg(F.approx_count_distinct("kmer", error).alias("n_distinct"))


def distinct_from_share(seqs: DataFrame, k: int, key: str, share: float, bits: int, policy: str = "skip", order: str = "ACGT") -> DataFrame:
    """n_distinct, seen_distinct and seen_kmers: an upper estimate of the distinct k-mers, to size filters and tables by, from a share of the sequences.

    The sample is a share of the values of ``key`` by hash. Its distinct k-mers are counted by a bit map of ``bits`` places, and carried on in proportion to the bases; as a k-mer may
    occur in what was not read, too, the estimate is above the truth, by 1 / share at most. accurate says whether the bit map was large enough.
    """
    from . import packed
    from .sketches import linear_count

    drawn = F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(share * (1 << 20))
    size = seqs.agg(F.sum(F.length("seq").cast("long")).alias("all_bases"), F.sum(F.when(drawn, F.length("seq")).otherwise(0).cast("long")).alias("seen_bases"))
    codes = packed.code_counts(seqs.where(drawn).select("seq"), packed.check_k(k), policy, order).groupBy("code").agg(F.sum("n").alias("n"))
    seen = linear_count(codes, F.pmod(F.xxhash64("code"), F.lit(bits)), bits).select(F.col("n_distinct").alias("seen_distinct"), "accurate")
    up = F.ceil(F.col("seen_distinct") * (F.col("all_bases") / F.greatest("seen_bases", F.lit(1))))
    return seen.join(size).join(codes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("seen_kmers"))).select(up.cast("long").alias("n_distinct"), "seen_distinct", "seen_kmers", "accurate")  # one row each
