"""Enough tasks for a scan that has fewer splits than there are cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` as they are, or dealt out to one task per core where their scan gives fewer.

    A small file of one row group is one task up to the first shuffle, however costly the work on a row is. Large inputs have more splits than cores and are
    left alone: nothing moves.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
