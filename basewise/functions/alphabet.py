"""Nucleotide alphabets, codes, complements and canonical forms, as column expressions.

Two orders of the bases are in use. ``ACGT`` is that of plain strings; ``ACTG`` is that of the code
(ascii >> 1) & 3, under which A, C, T, G are 0, 1, 2, 3 and the complement is XOR 2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ORDERS = ("ACGT", "ACTG")
POLICIES = ("skip", "replace_a")


def check_order(order: str) -> str:
    if order not in ORDERS:
        raise ValueError(f"order must be one of {ORDERS}, not {order!r}")
    return order


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def base_code(base: Column | str, order: str = "ACTG") -> Column:
    """0 to 3 for a base of either case, -1 for anything else."""
    return (F.instr(F.lit(check_order(order)), F.upper(_c(base))) - 1).cast("int")


def complement_code(code: Column | str) -> Column:
    """Code of the complement, in ACTG order."""
    return _c(code).bitwiseXOR(F.lit(2))


def revcomp(seq: Column | str) -> Column:
    """Reverse complement of an upper-case sequence; other characters stay as they are."""
    return F.reverse(F.translate(_c(seq), "ACGT", "TGCA"))


def revcomp_lenient(seq: Column | str) -> Column:
    """Reverse complement in which every other character becomes A."""
    return F.reverse(F.translate(F.regexp_replace(_c(seq), "[^ACGT]", "T"), "ACGT", "TGCA"))


def revcomp_cased(seq: Column | str) -> Column:
    """Reverse complement that keeps case; every other character becomes X."""
    return F.reverse(F.translate(F.regexp_replace(_c(seq), "[^ACGTacgt]", "X"), "ACGTacgt", "TGCAtgca"))


def digits(seq: Column | str, order: str = "ACTG") -> Column:
    """The sequence as base-4 digits: equal lengths compare as the numbers do."""
    return F.translate(_c(seq), check_order(order), "0123")


def undigits(col: Column | str, order: str = "ACTG") -> Column:
    return F.translate(_c(col), "0123", check_order(order))


def canonical(kmer: Column | str, order: str = "ACGT", rc: Column | None = None) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    kmer = _c(kmer)
    rc = revcomp(kmer) if rc is None else rc
    if check_order(order) == "ACGT":
        return F.least(kmer, rc)
    return F.when(digits(kmer, order) <= digits(rc, order), kmer).otherwise(rc)


def is_forward(kmer: Column | str, order: str = "ACGT") -> Column:
    return canonical(kmer, order) == _c(kmer)


def is_palindrome(kmer: Column | str) -> Column:
    return _c(kmer) == revcomp(kmer)


def encode(kmer: Column | str, order: str = "ACTG") -> Column:
    """A k-mer of at most 31 bases as a number base 4."""
    return F.conv(digits(kmer, order), 4, 10).cast("long")


def decode(code: Column | str, k: int, order: str = "ACTG") -> Column:
    """The k-mer of a number base 4."""
    return undigits(F.lpad(F.conv(_c(code).cast("string"), 10, 4), k, "0"), order)


def clean(seq: Column | str, policy: str = "skip") -> Column:
    """Upper case; under ``replace_a`` every other letter becomes A, under ``skip`` it stays and is invalid."""
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}, not {policy!r}")
    upper = F.translate(_c(seq), "acgt", "ACGT")
    return F.regexp_replace(upper, "[^ACGT]", "A") if policy == "replace_a" else upper


def outgoing(kmer: Column | str) -> Column:
    """The four successors of a k-mer, in ACTG order of the new base."""
    return F.transform(F.array(*map(F.lit, "ACTG")), lambda c: F.concat(F.substr(_c(kmer), F.lit(2)), c))


def incoming(kmer: Column | str) -> Column:
    """The four predecessors of a k-mer, in ACTG order of the new base."""
    k = _c(kmer)
    return F.transform(F.array(*map(F.lit, "ACTG")), lambda c: F.concat(c, F.substr(k, F.lit(1), F.length(k) - 1)))


def extend_right(kmer: Column | str, base: Column | str) -> Column:
    """The next k-mer once a base is read."""
    return F.concat(F.substr(_c(kmer), F.lit(2)), _c(base))


def compacted(kmer: Column | str, position: Column, m: int) -> Column:
    """A k-mer without its minimizer, which begins at ``position`` (from 0): prefix and suffix together."""
    k = _c(kmer)
    return F.concat(F.substr(k, F.lit(1), position), F.substr(k, position + (m + 1)))


def short_comment(comment: Column | str) -> Column:
    """A header's text up to its first space."""
    return F.split_part(_c(comment), F.lit(" "), F.lit(1))


def grouped_number(n: Column | str) -> Column:
    """A whole number with thousands separators."""
    return F.format_number(_c(n), 0)


def reverse_byte(b: Column | str) -> Column:
    """The bits of a byte in reverse order."""
    return F.conv(F.reverse(F.lpad(F.bin(_c(b)), 8, "0")), 2, 10).cast("int")
