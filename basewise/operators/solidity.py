"""Solidity: which k-mers of a count vector are kept."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Solidity(str, Enum):
    SUM = "sum"
    MIN = "min"
    MAX = "max"
    ONE = "one"
    ALL = "all"
    CUSTOM = "custom"


#: A range of counts, both ends included; None as its upper end leaves it open.
Range = tuple[int, int | None]


def within(n: Column, bounds: Range) -> Column:
    low, high = bounds
    return n >= low if high is None else n.between(low, high)


def complete_thresholds(thresholds: list[int | Range], n_banks: int) -> list[Range]:
    """One inclusive range per bank: a bare number is a minimum without an upper end, and missing ones repeat the last."""
    if not thresholds:
        raise ValueError("at least one threshold is needed")
    if len(thresholds) > n_banks:
        raise ValueError(f"{len(thresholds)} thresholds for {n_banks} banks")
    ranges = [t if isinstance(t, tuple) else (t, None) for t in thresholds]
    return ranges + [ranges[-1]] * (n_banks - len(ranges))


def is_solid(kind: Solidity | str, thresholds: list[int | Range], n_banks: int, custom: list[bool] | None = None, counts: Column | None = None) -> Column:
    """Whether the vector ``counts`` is solid. One bank alone is always judged by its sum."""
    kind = Solidity.SUM if n_banks == 1 else Solidity(kind)
    counts = F.col("counts") if counts is None else counts
    ranges = complete_thresholds(thresholds, n_banks)
    inside = [within(F.get(counts, F.lit(i)), r) for i, r in enumerate(ranges)]
    if kind is Solidity.SUM:
        return within(F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x), ranges[0])
    if kind in (Solidity.MIN, Solidity.MAX):
        return within((F.array_min if kind is Solidity.MIN else F.array_max)(counts), ranges[0])
    if kind is Solidity.CUSTOM:
        if custom is None or len(custom) != n_banks:
            raise ValueError("custom solidity needs one flag per bank")
        inside = [x if want else ~x for x, want in zip(inside, custom, strict=True)]
    out = inside[0]
    for x in inside[1:]:
        out = out | x if kind is Solidity.ONE else out & x
    return out


def solid_kmers(vectors: DataFrame, kind: Solidity | str, thresholds: list[int | Range], n_banks: int, custom: list[bool] | None = None) -> DataFrame:
    return vectors.where(is_solid(kind, thresholds, n_banks, custom))


def abundance_filter(counts: DataFrame, low: int = 1, high: int | None = None) -> DataFrame:
    """Rows of (kmer, n) with n in the inclusive range, open above without ``high``."""
    return counts.where(within(F.col("n"), (low, high)))


def solidity_stats(vectors: DataFrame, solid: Column) -> DataFrame:
    """One row: n_distinct, n_solid, n_weak and weak_percent_x100."""
    n, s = F.count("*"), F.count(F.when(solid, 1))
    return vectors.agg(n.alias("n_distinct"), s.alias("n_solid"), (n - s).alias("n_weak"), F.floor((n - s) * 10000 / F.greatest(n, F.lit(1))).cast("long").alias("weak_percent_x100"))
