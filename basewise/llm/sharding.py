"""Sharding by minimax contiguous partition (native: DataFrame operations only).

Documents with equal texts form an atomic group. Groups stand in the order of their smallest
doc_id, with a running total of their sizes; the smallest shard capacity for which a greedy fill
needs no more than the given number of shards is found by search, and the order is cut there.

The greedy check needs, shard by shard, the last running total that is at most (start + capacity).
One Spark job answers that for many capacities at once: wanted totals lie less than one largest
group below their bound, so an equi-join on (total div largest group) with the few bounds finds
them, and range filters on the sorted table skip the rest of it. Each round so narrows the interval
of capacities; the driver holds only the bounds.

Defined cases: a null text has size 0 plus the overhead and counts as equal to other null texts,
not to the empty text; its CRC is 0. Rows that repeat a doc_id are rows of their own. A null doc_id
sorts before all others. An empty table gives no rows. More shards than groups leave shards empty.
Other columns of the input are not used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions_for, staged

SHARDS = 24
OVERHEAD = 8
#: Rows of one numbering block: slots are numbered block by block.
BLOCK_ROWS = 20_000
MAX_BLOCKS = 4096
#: Capacities tried in one round.
CANDIDATES = 64


def atomic_groups(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32 and ``grp``, the digest of its text."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD
    return docs.select(
        "doc_id",
        size.alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b"")).alias("grp"),
    )


def running_totals(groups: DataFrame) -> DataFrame:
    """``groups`` (grp, first, bytes) with ``upto``, the bytes of all groups in order up to and with this one.

    Ranges of ``first`` between approximate quantiles are summed on their own; the sums of the
    ranges, as many as there are shuffle partitions, are added on top.
    """
    spark = groups.sparkSession
    n = max(2, 2 * partitions_for(spark))
    cuts = groups.agg(F.percentile_approx("first", [i / n for i in range(1, n)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    place = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: F.col("first") > c)) if cuts else F.lit(0)
    placed = groups.withColumn("place", F.when(F.col("first").isNull(), -1).otherwise(place))
    sums = placed.groupBy("place").agg(F.sum("bytes").alias("s"))
    before = sums.select("place", (F.sum("s").over(Window.orderBy("place")) - F.col("s")).alias("before"))
    inside = Window.partitionBy("place").orderBy(F.col("first").asc_nulls_first(), "grp").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("inside", F.sum("bytes").over(inside)).join(F.broadcast(before), "place").select("grp", "bytes", (F.col("before") + F.col("inside")).alias("upto"))


def _nearest_totals(totals: DataFrame, bounds: list[int], widest: int, below: bool = True) -> list[int]:
    """For each bound the largest running total at most that bound (0: none), or the smallest not under it."""
    asked = ", ".join(f"({b}L, {b // widest + k}L)" for b in sorted(set(bounds)) for k in ((-1, 0) if below else (0, 1)))
    wanted = totals.sparkSession.sql(f"SELECT * FROM VALUES {asked} AS t(bound, bin)")
    near = totals.where(F.col("upto").between(min(bounds) - widest, max(bounds) + widest))
    found = near.join(F.broadcast(wanted), F.floor(F.col("upto") / widest) == F.col("bin"))
    found = found.where("upto <= bound" if below else "upto >= bound")
    last = {r[0]: r[1] for r in found.groupBy("bound").agg((F.max if below else F.min)("upto")).collect()}
    return [last.get(b, 0) for b in bounds]


def _greedy(totals: DataFrame, capacities: list[int], shards: int, widest: int) -> list[list[int]]:
    """The ends of the shards of a greedy fill, for each capacity."""
    ends: list[list[int]] = [[0] for _ in capacities]
    for _ in range(shards):
        last = _nearest_totals(totals, [e[-1] + c for e, c in zip(ends, capacities, strict=True)], widest)
        for e, x in zip(ends, last, strict=True):
            e.append(max(e[-1], x))
    return [e[1:] for e in ends]


def _even_cuts(totals: DataFrame, capacity: int, total: int, shards: int, widest: int) -> list[int]:
    """Cuts within ``capacity`` as near to equal shares as that allows.

    A greedy fill from the far end gives the earliest place of each cut; from there each cut goes to
    its equal share, or as far as the capacity reaches. The largest shard stays the smallest possible.
    """
    earliest = [total]
    for _ in range(shards - 1):
        at = earliest[-1] - capacity
        earliest.append(_nearest_totals(totals, [at], widest, below=False)[0] if at > 0 else 0)
    ends = [0]
    for k, least in enumerate(reversed(earliest), 1):
        bound = min(max(total * k // shards, least), ends[-1] + capacity)
        ends.append(max(ends[-1], _nearest_totals(totals, [bound], widest)[0]))
    return ends[1:]


def minimax_cuts(totals: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity and the running totals at which its greedy fill cuts."""
    total, widest = totals.agg(F.max("upto"), F.max("bytes")).first()
    if not total:
        return 0, [0] * shards
    low = max(widest, -(-total // shards))
    high = low + widest  # always feasible: each shard but the last is filled beyond total / shards
    tried = sorted({low, high, *(min(high, low + (1 << k)) for k in range(widest.bit_length()))})
    while True:
        fills = _greedy(totals, tried, shards, widest)
        k = next(i for i, e in enumerate(fills) if e[-1] == total)
        if k == 0 or tried[k] - tried[k - 1] == 1:
            return tried[k], _even_cuts(totals, tried[k], total, shards, widest)
        low, high = tried[k - 1] + 1, tried[k]
        step = max(1, (high - low) // (CANDIDATES - 1))
        tried = sorted({*range(low, high, step), high})


def assign_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row (law ``bytes``)."""
    rows = staged(atomic_groups(docs), "sized")
    groups = rows.groupBy("grp").agg(F.min("doc_id").alias("first"), F.sum("size").alias("bytes"))
    totals = staged(running_totals(groups).repartitionByRange(partitions_for(docs.sparkSession), "upto").sortWithinPartitions("upto"), "totals")
    _, ends = minimax_cuts(totals, shards)
    cuts = F.array(*[F.lit(e).cast("long") for e in ends])
    shard_of = totals.select(F.col("grp").alias("_grp"), F.size(F.filter(cuts, lambda e: F.col("upto") > e)).alias("shard"))
    # a hot text is one large key on the left of this join; adaptive execution splits it
    placed = staged(rows.join(shard_of, F.col("grp") == F.col("_grp")).select("doc_id", "size", "text_crc32", "shard").withColumn("row", F.monotonically_increasing_id()), "placed")
    n = placed.count()
    blocks = max(1, min(MAX_BLOCKS, n // (BLOCK_ROWS * shards) + 1))
    blocked = placed.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    sizes = blocked.groupBy("shard", "block").agg(F.count("*").alias("n"))
    starts = sizes.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32", "row")) - 1
    # at most shards * MAX_BLOCKS rows are broadcast
    return (
        blocked.withColumn("inside", inside)
        .join(F.broadcast(starts), ["shard", "block"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("inside")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
