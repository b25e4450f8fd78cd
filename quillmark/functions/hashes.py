"""64-bit fingerprints as signed longs with the same bits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quillmark.functions.arrays import sign_bits


def hex_to_long(text: Column) -> Column:
    """16 hex digits; by halves, for `conv` has no signed 64 bits."""
    half = lambda at: F.conv(F.substring(text, at, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def long_to_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def difference_hash(rising: bool) -> Callable[[str | Column], Column]:
    """A function of 72 grey values (9 wide, 8 high): a bit for each neighbour pair, row by row, first one highest; null for null.

    The two directions are different fingerprints; never compare one with the other.
    """

    def run(grey: str | Column) -> Column:
        g = F.col(grey) if isinstance(grey, str) else grey
        at = lambda k: F.get(g, F.floor(k / 8).cast("int") * 9 + k % 8)
        after = lambda k: F.get(g, F.floor(k / 8).cast("int") * 9 + k % 8 + 1)
        bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: (after(k) > at(k) if rising else at(k) > after(k)).cast("int"))
        return F.when(g.isNotNull(), sign_bits(bits))

    return run


def _cosines(n: int) -> np.ndarray:
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    out = np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * np.sqrt(2 / n)
    out[0] /= np.sqrt(2)
    return out


@F.pandas_udf(ArrayType(DoubleType()))
def block_dct(grey: pd.Series) -> pd.Series:
    """Mean of two maps of log absolute orthonormal DCT-II coefficients, over blocks of 8 and of 16. Side a multiple of 16.

    A batch's images of one size are stacked and transformed in one product.
    """
    sizes = grey.map(len, na_action="ignore")
    out = pd.Series([None] * len(grey), index=grey.index, dtype=object)
    for size in sizes.dropna().unique():
        rows = sizes.index[sizes == size]
        side = int(round(size**0.5))
        g, maps = np.stack([np.asarray(v, float) for v in grey[rows]]).reshape(-1, side, side), []
        for n in (8, 16):
            tiles = g.reshape(len(g), side // n, n, side // n, n).transpose(0, 1, 3, 2, 4)
            b = _cosines(n)
            maps.append(np.log(np.abs(b @ tiles @ b.T) + 1e-8).transpose(0, 1, 3, 2, 4).reshape(len(g), -1))
        out[rows] = pd.Series(list(np.mean(maps, axis=0)), index=rows)
    return out
