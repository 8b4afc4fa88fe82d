"""Abundance histograms and the automatic cutoff."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 10_000
GENOME_LENGTH = 10


def histogram(counts: DataFrame, length: int = LENGTH) -> DataFrame:
    """count and n_kmers: how many k-mers have each count; the last bin holds all larger ones."""
    return counts.groupBy(F.least("n", F.lit(length)).alias("count")).agg(F.count("*").alias("n_kmers"))


def histogram_2d(vectors: DataFrame, length: int = LENGTH, genome_length: int = GENOME_LENGTH) -> DataFrame:
    """count_reads (all banks but the first), count_genome (the first) and n_kmers; both are capped."""
    first = F.get("counts", F.lit(0))
    return vectors.groupBy(F.least(F.col("total") - first, F.lit(length)).alias("count_reads"), F.least(first, F.lit(genome_length)).alias("count_genome")).agg(F.count("*").alias("n_kmers"))


def pivot_2d(table: DataFrame, genome_length: int = GENOME_LENGTH) -> DataFrame:
    """The 2-D histogram with one column per count_genome."""
    return table.groupBy("count_reads").pivot("count_genome", list(range(genome_length + 1))).sum("n_kmers").fillna(0)


@dataclass(frozen=True)
class Cutoff:
    cutoff: int
    first_peak: int | None
    n_solid: int | None
    weak_ratio: float


def auto_cutoff(table: DataFrame, length: int = LENGTH, floor: int = 2) -> Cutoff:
    """The abundance below which k-mers are taken for errors, from a histogram of at most ``length`` rows.

    The smoothed curve's first valley before its first peak, but no further than just past the count that a
    quarter of all occurrences stay below, and at least ``floor``. Without a rise the floor is the cutoff.
    """
    return cutoff_of({int(r["count"]): r["n_kmers"] for r in table.limit(length + 1).collect()}, length, floor)


def cutoff_of(bins: dict[int, int], length: int = LENGTH, floor: int = 2) -> Cutoff:
    """The same from the bins in memory."""
    h = [bins.get(i, 0) for i in range(length + 2)]
    smooth = [0] * (length + 1)
    smooth[1] = int(0.6 * h[1] + 0.4 * h[2])
    for i in range(2, length):
        smooth[i] = int(0.2 * h[i - 1] + 0.6 * h[i] + 0.2 * h[i + 1])
    occurrences = sum(i * h[i] for i in range(1, length + 1))
    rise = next((i for i in range(2, length) if smooth[i - 1] < smooth[i]), None)
    if rise is None:
        weak = sum(i * h[i] for i in range(1, floor)) / occurrences if occurrences else 0.0
        return Cutoff(floor, None, None, weak)
    peak = max(range(rise, length), key=lambda i: (smooth[i], -i))
    cutoff = min(range(rise - 1, peak + 1), key=lambda i: (smooth[i], i))
    seen, limit = 0, 0
    for i in range(1, length + 1):
        seen += i * h[i]
        if occurrences and seen / occurrences >= 0.25:
            limit = i + 1
            break
    cutoff = max(min(cutoff, limit), floor)
    weak = sum(i * h[i] for i in range(1, cutoff)) / occurrences if occurrences else 0.0
    return Cutoff(cutoff, peak, sum(h[cutoff : length + 1]), weak)


def bank_cutoff_table(long_counts: DataFrame, length: int = LENGTH, floor: int = 3) -> DataFrame:
    """bank and cutoff: the automatic cutoff of each bank, fitted bank by bank from at most ``length`` bins each."""
    bins = long_counts.groupBy("bank", F.least("n", F.lit(length)).alias("count")).agg(F.count("*").alias("n_kmers"))

    def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        h = dict(zip(frame["count"].astype(int).tolist(), frame["n_kmers"].tolist(), strict=True))
        return pd.DataFrame({"bank": [key[0]], "cutoff": [cutoff_of(h, length, floor).cutoff]})

    return bins.groupBy("bank").applyInPandas(fit, f"bank {long_counts.schema['bank'].dataType.simpleString()}, cutoff long")


def bank_cutoffs(long_counts: DataFrame, banks: list[str], length: int = LENGTH, floor: int = 3) -> dict[str, int]:
    """The automatic cutoff of each of the banks, as thresholds for solidity rules: one row a bank reaches the driver."""
    found = {r["bank"]: r["cutoff"] for r in bank_cutoff_table(long_counts.where(F.col("bank").isin(banks)), length, floor).collect()}
    return {b: found[b] if b in found else cutoff_of({}, length, floor).cutoff for b in banks}
