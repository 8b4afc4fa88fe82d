"""Row numbers in an order, range by range, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, *by: Column | str, name: str = "rank") -> DataFrame:
    """``rows`` with ``name``: their numbers from 0 in the order ``by``; equal rows get different numbers, any way round.

    The ranges are written once, with numbers inside them, so that counts and numbers come from the same rows. Only one row per range meets in a window.
    """
    from ..plans.scratch import scratch

    number, part, before, size = (f"_{name}_{x}" for x in ("row", "part", "before", "n"))
    inside = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(number, F.monotonically_increasing_id())
    path = scratch(rows.sparkSession, "numbered")
    inside.write.parquet(path)
    written = rows.sparkSession.read.schema(inside.schema).parquet(path)
    of = F.shiftright(number, 33)  # a row number holds its range above 33 bits, and its rank in the range below
    starts = written.groupBy(of.alias(part)).agg(F.count("*").alias(size))
    upto = starts.select(part, (F.sum(size).over(Window.orderBy(part)) - F.col(size)).alias(before))
    rank = F.col(before) + F.col(number).bitwiseAND(F.lit((1 << 33) - 1))
    return written.withColumn(part, of).join(F.broadcast(upto), part).select(*rows.columns, rank.cast("long").alias(name))
