"""CRC-32 of data that is read in pieces: each piece's checksum is moved to its place, and all are combined by exclusive or."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The polynomial of CRC-32, reflected.
POLYNOMIAL = 0xEDB88320


@cache
def zeros(k: int) -> tuple[int, ...]:
    """What 2 ** k bytes of zeros do to a checksum: the image of each of its bits."""
    if not k:
        step = (POLYNOMIAL, *(1 << b for b in range(31)))  # one bit of zero
        for _ in range(3):
            step = tuple(moved_by(step, x) for x in step)
        return step
    half = zeros(k - 1)
    return tuple(moved_by(half, x) for x in half)


def moved_by(step: tuple[int, ...], crc: int) -> int:
    out = 0
    for image in step:
        if crc & 1:
            out ^= image
        crc >>= 1
    return out


def moved(crc: int, after: int) -> int:
    """A piece's checksum as it enters that of the whole, ``after`` bytes before its end."""
    k = 0
    while after:
        if after & 1:
            crc = moved_by(zeros(k), crc)
        after, k = after >> 1, k + 1
    return crc


def _moved(crc: pd.Series, after: pd.Series) -> pd.Series:
    out, left, k = crc.to_numpy(np.int64).copy(), after.to_numpy(np.int64).copy(), 0
    while left.any():
        rows = np.flatnonzero(left & 1)
        own, image = out[rows], np.zeros(len(rows), np.int64)
        for b, x in enumerate(zeros(k)):
            image ^= np.where(own >> b & 1, x, 0)
        out[rows] = image
        left, k = left >> 1, k + 1
    return pd.Series(out)


def joined_crc(crc: Column, after: Column) -> Column:
    """Aggregate: the CRC-32 of pieces laid end to end, from each one's own and the bytes that follow it in the whole. Null without pieces."""
    return F.bit_xor(F.pandas_udf(_moved, "long")(crc, after))
