"""A whole counting run over one bank or several: counts, cutoff, solid k-mers, histogram and properties."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import counting, histogram, solidity
from .scratch import scratch

#: A step over the count vectors (kmer, counts, total): it returns what the next step sees.
Processor = Callable[[DataFrame], DataFrame]


@dataclass
class Run:
    vectors: DataFrame
    solid: DataFrame
    histogram: DataFrame
    cutoff: histogram.Cutoff
    properties: dict[str, object] = field(default_factory=dict)


def chain(vectors: DataFrame, *processors: Processor) -> DataFrame:
    """Each processor works on what the one before lets pass."""
    for p in processors:
        vectors = p(vectors)
    return vectors


def run(
    seqs: DataFrame,
    k: int = 31,
    bank: str | None = None,
    banks: list[str] | None = None,
    kind: solidity.Solidity | str = "sum",
    thresholds: list[int | tuple[int, int]] | str = "auto",
    custom: list[bool] | None = None,
    policy: str = "skip",
    order: str = "ACGT",
    max_bins: int = histogram.LENGTH,
    processors: tuple[Processor, ...] = (),
) -> Run:
    """Count, derive thresholds where they are ``auto``, and keep solid k-mers.

    bank names the column that tells samples apart; without one all sequences are one bank. The counts
    are written once to the shared folder and every later step reads them from there.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    named = seqs.withColumn("_bank", F.col(bank).cast("string") if bank else F.lit("all"))
    if banks is None:
        banks = sorted(r[0] for r in named.select("_bank").where("_bank is not null").distinct().collect()) if bank else ["all"]
    path = scratch(seqs.sparkSession, "counts")
    counting.count_banks(named.drop(*([bank] if bank else [])), k, "_bank", policy, order).write.parquet(path)
    long_counts = seqs.sparkSession.read.parquet(path)
    vectors = counting.count_vectors(long_counts.where(F.col("bank").isin(banks)), banks)
    bins = histogram.histogram(vectors.select("kmer", F.col("total").alias("n")), max_bins)
    cutoff = histogram.auto_cutoff(bins, max_bins)
    if thresholds == "auto":
        own = kind in ("one", "all", "custom") and len(banks) > 1
        thresholds = list(histogram.bank_cutoffs(long_counts, banks, max_bins).values()) if own else [max(cutoff.cutoff, 3)]
    rule = solidity.is_solid(kind, thresholds, len(banks), custom)
    solid = chain(vectors.where(rule), *processors)
    numbers = solidity.solidity_stats(vectors, rule).first().asDict()
    return Run(vectors, solid, bins, cutoff, {"k": k, "banks": banks, "kind": str(kind), "thresholds": thresholds, "cutoff": cutoff.cutoff, **numbers})

