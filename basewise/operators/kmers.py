"""K-mers of sequences.

All overlapping k-mers come from one pass of a look-ahead pattern over pieces of the sequence that overlap by k - 1, linear in its
length in time and bounded in memory; a sequence shorter than k gives none. Rows of k-mers are exploded right before they are
aggregated and never cached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import canonical, clean, digits, revcomp


def kmer_array(seq: Column, k: int, valid_only: bool = False) -> Column:
    """All k-mers of a sequence in order; valid_only leaves out those with other characters than ACGT."""
    if k < 1:
        raise ValueError("k must be at least 1")
    letter = "[ACGT]" if valid_only else "."
    return F.regexp_extract_all(seq, F.lit(f"(?s)(?=({letter}{{{k}}}))"), F.lit(1))


#: Characters of the pieces that a sequence is cut into before its k-mers are taken.
PIECE = 1 << 14


def _pieces(s: DataFrame, others: list[str], k: int, piece: int | None = None) -> DataFrame:
    """The column _s of ``s`` in pieces that overlap by k - 1 characters, and _at, the place of each."""
    size = max(piece or PIECE, k)
    parts = F.regexp_extract_all("_s", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    lapped = lambda p: F.transform(p, lambda x, i: F.concat(x, F.coalesce(F.substr(F.get(p, i + 1), F.lit(1), F.lit(k - 1)), F.lit(""))))
    whole = s.withColumn("_parts", F.when(F.length("_s") > size, F.element_at(F.transform(F.array(parts), lapped), 1)).otherwise(F.array("_s")))
    return whole.select(*others, F.posexplode("_parts").alias("_i", "_s")).select(*others, "_s", (F.col("_i") * size).alias("_at"))


def kmers(seqs: DataFrame, k: int, policy: str = "skip", order: str = "ACGT", both_strands: bool = True) -> DataFrame:
    """The columns of ``seqs`` but seq, with pos (from 0), kmer and, with both_strands, rc and canonical.

    Complements are taken once per sequence: the k-mers of the reversed complement, read backwards,
    are the reverse complements in order. Under ``skip`` k-mers with invalid characters are left out.
    """
    others = [c for c in seqs.columns if c != "seq"]
    s = _pieces(seqs.select(*others, clean(F.col("seq"), policy).alias("_s")), others, k)
    forward, pos = kmer_array(F.col("_s"), k), (F.col("_pos") + F.col("_at")).alias("pos")
    if both_strands:
        pairs = F.arrays_zip(forward.alias("kmer"), F.reverse(kmer_array(revcomp("_s"), k)).alias("rc"))
        out = s.select(*others, "_at", F.posexplode(pairs).alias("_pos", "_p")).select(*others, pos, F.col("_p.kmer").alias("kmer"), F.col("_p.rc").alias("rc"))
    else:
        out = s.select(*others, "_at", F.posexplode(forward).alias("_pos", "kmer")).select(*others, pos, "kmer")
    if policy == "skip":
        out = out.where(~F.col("kmer").rlike("[^ACGT]"))
    return out.withColumn("canonical", canonical("kmer", order, F.col("rc"))) if both_strands else out


def valid_kmers(seqs: DataFrame, k: int, policy: str = "skip", order: str | None = "ACGT") -> DataFrame:
    """One column kmer (canonical under ``order``; order None: as read) beside the other columns, invalid ones skipped.

    This is the lean form for counting: no positions, and validity is part of the pattern.
    """
    others = [c for c in seqs.columns if c != "seq"]
    s = _pieces(seqs.select(*others, clean(F.col("seq"), policy).alias("_s")), others, k)
    forward = kmer_array(F.col("_s"), k, valid_only=True)
    if order is None:
        return s.select(*others, F.explode(forward).alias("kmer"))
    pairs = F.arrays_zip(forward.alias("f"), F.reverse(kmer_array(revcomp("_s"), k, valid_only=True)).alias("r"))
    exploded = s.select(*others, F.explode(pairs).alias("_p"))
    return exploded.select(*others, canonical(F.col("_p.f"), order, F.col("_p.r")).alias("kmer"))


def drop_poly_a(table: DataFrame, k: int, col: str = "kmer") -> DataFrame:
    """Without the k-mer of k times A."""
    return table.where(F.col(col) != "A" * k)


def all_kmers(spark, k: int, order: str = "ACTG") -> DataFrame:
    """seq_id, comment and seq of all 4**k k-mers."""
    ids = spark.range(4**k)
    place = lambda i: F.substr(F.lit(order), (F.shiftrightunsigned("id", 2 * (k - 1 - i)).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1))
    return ids.select(F.col("id").alias("seq_id"), F.concat(F.lit("seq_"), F.col("id").cast("string")).alias("comment"), F.concat(*[place(i) for i in range(k)]).alias("seq"))


def tile(seqs: DataFrame, size: int, overlap: int, coverage: int = 1) -> DataFrame:
    """Sequences cut into tiles of ``size`` that overlap; the last is the rest. ``copy`` numbers repeats."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    others = [c for c in seqs.columns if c != "seq"]
    starts = F.sequence(F.lit(0), F.greatest(F.length("seq") - 1 - overlap, F.lit(0)), F.lit(size - overlap))
    tiles = seqs.where(F.length("seq") > 0).select(*others, "seq", F.explode(starts).alias("start"))
    cut = tiles.select(*others, "start", F.substr("seq", F.col("start") + 1, F.lit(size)).alias("seq"))
    return cut.select(*others, F.explode(F.sequence(F.lit(1), F.lit(coverage))).alias("copy"), "start", "seq")


def random_reads(spark, n: int, length: int, seed: int = 0) -> DataFrame:
    """n random sequences, the same for the same seed: a quadratic and a linear step modulo a prime from id, place and seed."""
    prime = F.lit((1 << 31) - 1).cast("long")

    def letter(i):
        x = (F.col("id") % prime * 7919 + i * 104729 + seed * 15485863) % prime
        y = x * x % prime * 48271 % prime
        return F.substr(F.lit("ACTG"), (F.shiftright(y, 16) % 4).cast("int") + 1, F.lit(1))

    draws = F.transform(F.sequence(F.lit(1).cast("long"), F.lit(length).cast("long")), letter)
    return spark.range(n).select(F.col("id").alias("seq_id"), F.concat_ws("", draws).alias("seq"))


def neighbours(table: DataFrame, order: str = "ACGT") -> DataFrame:
    """Per k-mer its up to eight neighbours: kmer, side (out, in), base and the canonical neighbour."""
    from ..functions.alphabet import incoming, outgoing

    def side(name: str, near):
        return F.transform(near("kmer"), lambda n, i: F.struct(F.lit(name).alias("side"), F.substr(F.lit("ACTG"), i + 1, F.lit(1)).alias("base"), n.alias("n")))

    sides = [side("out", outgoing), side("in", incoming)]
    wide = table.select("kmer", F.explode(F.concat(*sides)).alias("x"))
    return wide.select("kmer", "x.side", "x.base", canonical(F.col("x.n"), order).alias("neighbour"))


def neighbour_masks(table: DataFrame, order: str = "ACGT") -> DataFrame:
    """kmer, n_out, n_in and mask (bits 0-3 outgoing, 4-7 incoming in ACTG order) of neighbours that the table holds."""
    near = neighbours(table.select("kmer").distinct(), order)
    present = near.join(table.select(F.col("kmer").alias("neighbour")).distinct(), "neighbour", "left_semi")
    bit = F.expr("shiftleft(1, instr('ACTG', base) - 1 + if(side = 'in', 4, 0))")
    found = present.groupBy("kmer").agg(F.count(F.when(F.col("side") == "out", 1)).alias("n_out"), F.count(F.when(F.col("side") == "in", 1)).alias("n_in"), F.sum(bit).cast("long").alias("mask"))
    zero = F.lit(0).cast("long")
    return table.select("kmer").distinct().join(found, "kmer", "left").select("kmer", *[F.coalesce(c, zero).alias(c) for c in ("n_out", "n_in", "mask")])


def order_key(kmer: Column, order: str) -> Column:
    """What sorts k-mers under an order."""
    return kmer if order == "ACGT" else digits(kmer, order)
