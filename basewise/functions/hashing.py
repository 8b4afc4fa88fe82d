"""Integer hashes that wrap at 64 (or 32) bits, as vectorised functions on unsigned numpy arrays.

The shift amounts and multipliers are fixed values of published integer mixers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

U = np.uint64


def mix64(key: np.ndarray) -> np.ndarray:
    """A 64-bit mix by shifts and additions."""
    key = key.astype(U)
    key = ~key + (key << U(21))
    key ^= key >> U(24)
    key = key + (key << U(3)) + (key << U(8))
    key ^= key >> U(14)
    key = key + (key << U(2)) + (key << U(4))
    key ^= key >> U(28)
    return key + (key << U(31))


def seeded64(key: np.ndarray, seed: int = 0) -> np.ndarray:
    """The mix of a seed that the key has stirred first."""
    key, seed = key.astype(U), U(seed)
    stirred = (seed << U(7)) ^ key * (seed >> U(3)) ^ ~((seed << U(11)) + (key ^ (seed >> U(5))))
    return mix64(seed ^ stirred)


# Fixed values: (operation, shift or factor) of the steps of the mix for hash tables.
TABLE_STEPS = (("shift", 14), ("spread", 18), ("shift", 31), ("times", 21), ("shift", 11), ("times", 65), ("shift", 22))


def table64(key: np.ndarray) -> np.ndarray:
    """The mix that open tables place keys by."""
    key = key.astype(U)
    for what, n in TABLE_STEPS:
        if what == "shift":
            key = key ^ (key >> U(n))
        elif what == "times":
            key = key * U(n)
        else:
            key = ~key + (key << U(n))
    return key


def bytes16(key: np.ndarray, shift: int, table: np.ndarray) -> np.ndarray:
    """A hash of two bytes of the key, ``shift`` bits up, and its lowest: the xor of their values in ``table``, of 256 numbers that the caller draws."""
    key, table = key.astype(U), table.astype(U)
    byte = lambda at: table[(key >> U(at) & U(255)).astype(np.int64)]
    return byte(shift) ^ byte(shift + 8) ^ byte(0)


# Fixed values: (shift, multiplier) of the rounds of the invertible mixes, and their last shifts.
ROUNDS_32 = ((16, 0x2C1B3C6D), (16, 0x297A2D39))
LAST_32 = 16
ROUNDS_64 = ((32, 0xD6E8FEB86659FD93), (32, 0xD6E8FEB86659FD93))
LAST_64 = 32


def invertible64(x: np.ndarray) -> np.ndarray:
    """An invertible 64-bit mix: xor-shift, multiply, twice, and a last xor-shift."""
    x = x.astype(U)
    for shift, factor in ROUNDS_64:
        x = (x ^ (x >> U(shift))) * U(factor)
    return x ^ (x >> U(LAST_64))


def inverse64(x: np.ndarray) -> np.ndarray:
    """Undoes ``invertible64``; shifts of half the width undo themselves."""
    x = x.astype(U)
    x = x ^ (x >> U(LAST_64))
    for shift, factor in reversed(ROUNDS_64):
        x = x * U(pow(factor, -1, 1 << 64))
        x = x ^ (x >> U(shift))
    return x


def invertible32(x: np.ndarray) -> np.ndarray:
    """The same in 32 bits."""
    x = x.astype(np.uint32)
    for shift, factor in ROUNDS_32:
        x = (x ^ (x >> np.uint32(shift))) * np.uint32(factor)
    return x ^ (x >> np.uint32(LAST_32))


def inverse32(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint32)
    x = x ^ (x >> np.uint32(LAST_32))
    for shift, factor in reversed(ROUNDS_32):
        x = x * np.uint32(pow(factor, -1, 1 << 32))
        x = x ^ (x >> np.uint32(shift))
    return x


def _column(fn, name: str):
    @F.pandas_udf(LongType())
    def apply(s: pd.Series) -> pd.Series:
        return pd.Series(fn(s.to_numpy(np.int64, na_value=0).view(U)).view(np.int64)).where(s.notna())

    def column(col: Column | str) -> Column:
        return apply(col)

    column.__name__ = name
    column.__doc__ = f"{name} of a long column; the unsigned result is returned as the long with the same bits."
    return column


mix64_column = _column(mix64, "mix64_column")
table64_column = _column(table64, "table64_column")
invertible64_column = _column(invertible64, "invertible64_column")
inverse64_column = _column(inverse64, "inverse64_column")


def seeded64_column(col: Column | str, seed: int) -> Column:
    """seeded64 of a long column; the unsigned result is returned as the long with the same bits."""
    return _column(lambda x: seeded64(x, seed), "seeded64_column")(col)


def unsigned_key(col: Column | str) -> Column:
    """A long whose signed order is the unsigned order of its argument."""
    c = F.col(col) if isinstance(col, str) else col
    return c.bitwiseXOR(F.lit(-(1 << 63)))


def nth_hash(a: Column, b: Column, n: int, size: int) -> Column:
    """Double hashing: the n-th place (a + n * b) mod size of a key with hashes a and b below 2**31."""
    return F.pmod(a + F.lit(n) * b, F.lit(size))
