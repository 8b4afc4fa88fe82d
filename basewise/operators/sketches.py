"""Sketches as tables of words and cells.

A distributed Bloom filter is a table (word, bits) built by one bit_or aggregate; membership is an equi-join
on the word. Its rows are bounded by its size, so it is broadcast up to a limit that is checked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_WORDS = 1 << 20


def _places(key: Column, hashes: int, bits: int) -> Column:
    """The bit positions of a key: double hashing of its 64-bit hash."""
    h = F.xxhash64(key)
    a, b = h.bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned(h, 33).bitwiseOR(F.lit(1))
    return F.array(*[F.pmod(a + b * i, F.lit(bits)) for i in range(hashes)])


def bloom_size(n: int, bits_per_key: float) -> tuple[int, int]:
    """(bits, hashes) for n keys; the bits are 1000 at least."""
    return max(1000, int(n * bits_per_key)), max(1, math.floor(0.7 * bits_per_key))


def bloom_table(keys: DataFrame, col: str, bits: int, hashes: int, by: list[str] | None = None) -> DataFrame:
    """(word, bits) of a filter that holds the keys; ``by`` makes one filter per group, such as a bank."""
    by = by or []
    place = keys.select(*by, F.explode(_places(F.col(col), hashes, bits)).alias("place"))
    return place.groupBy(*by, F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))


def bloom_contains(rows: DataFrame, col: str, table: DataFrame, bits: int, hashes: int) -> DataFrame:
    """Distinct keys of ``rows`` that the filter may hold; no key it holds is missing."""
    probes = rows.select(F.col(col).alias("key")).distinct().select("key", F.explode(_places(F.col("key"), hashes, bits)).alias("place"))
    table = F.broadcast(table) if bits <= 64 * BROADCAST_WORDS else table
    hit = probes.select("key", F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit")).join(table, "word").where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    # two places of a key may be one bit, and count twice here as among the probes
    return hit.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == hashes).select(F.col("key").alias(col))


def bloom_group_table(keys: DataFrame, col: str, group: str, groups: list[str], bits: int, hashes: int) -> DataFrame:
    """(place, groups): filters of several groups, such as banks, in one: each place has a bit for each group, in words of 64.

    One aggregate builds it; its rows are ``bits`` at most, whatever the groups hold.
    """
    words = -(-len(groups) // 64)
    number = F.element_at(F.create_map(*(x for i, g in enumerate(groups) for x in (F.lit(g), F.lit(i)))), F.col(group))
    rows = keys.where(F.col(group).isin(groups)).select(number.alias("g"), F.explode(F.array_distinct(_places(F.col(col), hashes, bits))).alias("place"))
    bit = F.expr("shiftleft(1L, g & 63)")
    masks = [F.bit_or(F.when(F.shiftright("g", 6) == w, bit).otherwise(F.lit(0).cast("long"))) for w in range(words)]
    return rows.groupBy("place").agg(F.array(*masks).alias("groups"))


def bloom_groups_of(rows: DataFrame, col: str, table: DataFrame, groups: list[str], bits: int, hashes: int) -> DataFrame:
    """key and groups: for each distinct key of ``rows`` the groups that may hold it, from one probe of all filters; none that holds it is missing, and keys without one are left out."""
    words = -(-len(groups) // 64)
    probes = rows.select(F.col(col).alias("key")).distinct().select("key", F.array_distinct(_places(F.col("key"), hashes, bits)).alias("places"))
    probes = probes.select("key", F.size("places").alias("many"), F.explode("places").alias("place"))
    held = table.select(F.col("place"), F.col("groups").alias("masks"))
    held = F.broadcast(held) if bits * words <= 16 * BROADCAST_WORDS else held
    # the groups of a key are those that all its places have
    both = probes.join(held, "place").groupBy("key").agg(F.count("*").alias("hits"), F.max("many").alias("many"), *(F.bit_and(F.get("masks", F.lit(w))).alias(f"mask_{w}") for w in range(words))).where("hits = many")
    named = F.array_compact(F.array(*(F.when(F.col(f"mask_{i // 64}").bitwiseAND(F.lit((1 << i % 64) - (1 << 64 if i % 64 == 63 else 0))) != 0, F.lit(g)) for i, g in enumerate(groups))))
    return both.select(F.col("key").alias(col), named.alias("groups")).where(F.size("groups") > 0)


def passed(counts: DataFrame, levels: int) -> DataFrame:
    """What a cascade of ``levels`` filters without errors lets pass, as counts: each occurrence after the first ``levels``."""
    return counts.where(F.col("n") > levels).withColumn("n", F.col("n") - levels)


def count_min_table(keys: DataFrame, col: str, depth: int, width: int, n: str | None = None) -> DataFrame:
    """(row, cell, n) of a count-min sketch; each row of ``keys`` is one occurrence, or as many as its column ``n`` says."""
    weight = F.lit(1).cast("long") if n is None else F.col(n)
    cells = keys.select(weight.alias("_n"), F.posexplode(_places(F.col(col), depth, width)).alias("row", "cell"))
    return cells.groupBy("row", "cell").agg(F.sum("_n").alias("n"))


def count_min_estimate(keys: DataFrame, col: str, table: DataFrame, depth: int, width: int) -> DataFrame:
    """key and estimate, never below the count."""
    probes = keys.select(F.col(col).alias("key")).distinct().select("key", F.posexplode(_places(F.col("key"), depth, width)).alias("row", "cell"))
    table = F.broadcast(table) if depth * width <= BROADCAST_WORDS else table
    return probes.join(table, ["row", "cell"]).groupBy(F.col("key").alias(col)).agg(F.min("n").alias("estimate"))


def linear_count(keys: DataFrame, place: Column, bits: int) -> DataFrame:
    """n_distinct by linear counting over a bit map of ``bits`` places, its weight, and whether the load allows it (under 0.99)."""
    # a full map gives no estimate: its row says so
    used = keys.select(place.alias("p")).groupBy("p").agg(F.count("*").alias("n")).agg(F.count("*").alias("weight"))
    free = (F.lit(bits) - F.col("weight")) / bits
    return used.select("weight", F.when(free > 0, F.floor(-bits * F.log(free))).cast("long").alias("n_distinct"), (F.col("weight") < 0.99 * bits).alias("accurate"))


# Fixed values: (buckets, step) of the 8-bit abundance scale.
ABUNDANCE_STEPS = ((70, 1), (15, 2), (40, 10), (25, 20), (40, 100), (25, 200), (40, 1000))


def abundance_code(n: Column) -> Column:
    """The bucket of a count on the 8-bit scale; counts beyond it get the last bucket."""
    code, start, base = None, 0, 0
    for buckets, step in ABUNDANCE_STEPS:
        here = F.floor((n - start) / step) + base
        code = F.when(n < start + buckets * step, here) if code is None else code.when(n < start + buckets * step, here)
        start, base = start + buckets * step, base + buckets
    return code.otherwise(F.lit(base)).cast("int")


def abundance_of(code: Column) -> Column:
    """The count that a bucket stands for: the middle of its range, rounded down."""
    value, start, base = None, 0, 0
    for buckets, step in ABUNDANCE_STEPS:
        low = (code - base) * step + start
        here = F.floor(low + step / 2)
        value = F.when(code < base + buckets, here) if value is None else value.when(code < base + buckets, here)
        start, base = start + buckets * step, base + buckets
    return value.otherwise(F.lit(start)).cast("long")


def dense_ids(keys: DataFrame, col: str) -> DataFrame:
    """key and id: distinct keys numbered from 0 in order, range by range without a global window."""
    from .ranks import numbered

    return numbered(keys.select(col).distinct(), col, name="id")
