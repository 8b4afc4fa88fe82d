"""Comparing two count tables (kmer, n)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """kmer, status (extra, missing, changed or same), left_count and right_count; right is the truth."""
    joined = left.select("kmer", F.col("n").alias("left_count")).join(right.select("kmer", F.col("n").alias("right_count")), "kmer", "full_outer")
    status = F.when(F.col("right_count").isNull(), "extra").when(F.col("left_count").isNull(), "missing").when(F.col("left_count") != F.col("right_count"), "changed").otherwise("same")
    return joined.select("kmer", status.alias("status"), "left_count", "right_count")


def diff_totals(diff: DataFrame) -> DataFrame:
    return diff.groupBy("status").agg(F.count("*").alias("n_kmers"))


def diff_lines(diff: DataFrame) -> DataFrame:
    """The differences as lines: +kmer, -kmer, or kmer a->b."""
    text = F.when(F.col("status") == "extra", F.concat(F.lit("+"), "kmer")).when(F.col("status") == "missing", F.concat(F.lit("-"), "kmer"))
    changed = F.concat_ws("", F.lit("-"), F.col("kmer"), F.lit(" "), F.col("left_count").cast("string"), F.lit("->"), F.col("right_count").cast("string"))
    return diff.where("status != 'same'").select(text.otherwise(changed).alias("value"))


def evaluation(result: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: true and false positives, false negatives, equal, over- and undercounted, and rates per 10,000."""
    d = count_diff(result, truth)
    n = lambda cond: F.count(F.when(cond, 1))
    both = F.col("status").isin("changed", "same")
    tp, fp, fn = n(both), n(F.col("status") == "extra"), n(F.col("status") == "missing")
    return d.agg(
        tp.alias("true_positives"), fp.alias("false_positives"), fn.alias("false_negatives"), n(F.col("status") == "same").alias("equal"),
        n(F.col("left_count") > F.col("right_count")).alias("overcounted"), n(F.col("left_count") < F.col("right_count")).alias("undercounted"),
        F.floor(fp * 10000 / F.greatest(tp + fp, F.lit(1))).cast("long").alias("erroneous_x10000"), F.floor(fn * 10000 / F.greatest(tp + fn, F.lit(1))).cast("long").alias("missing_x10000"),
    )


def disagreements(counted: DataFrame, exact: DataFrame) -> DataFrame:
    """K-mers that a counter has wrong, forgot or invented; empty if it is right."""
    return count_diff(counted, exact).where("status != 'same'")


def zip_rows(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Rows of two tables paired by their rank in an order each; what one has more than the other is left out."""
    from .ranks import numbered

    a = numbered(left, left_order, name="_rank")
    b = numbered(right, right_order, name="_rank")
    return a.join(b, "_rank").drop("_rank")
