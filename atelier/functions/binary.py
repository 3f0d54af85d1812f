"""Numbers in binary columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unsigned_be(data: Column, offset: Column | int, size: int) -> Column:
    """Big-endian unsigned number of up to 8 bytes at a 0-based offset; null where the bytes aren't all there, or where it leaves 63 bits."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    if size > 7:
        high = unsigned_be(data, at, size - 4)
        return F.when(high < F.lit(1 << 31), F.shiftleft(high, 32) + unsigned_be(data, at + (size - 4), 4))
    part = F.substring(data, at + 1, F.lit(size))
    return F.when(F.octet_length(part) == size, F.conv(F.hex(part), 16, 10).cast("long"))


def signed_be(data: Column, offset: Column | int) -> Column:
    """Big-endian signed number of 4 bytes."""
    n = unsigned_be(data, offset, 4)
    return F.when(n >= F.lit(1 << 31), n - F.lit(1 << 32)).otherwise(n)


def unsigned_be_array(data: Column, offset: int, size: int, step: int, count: Column) -> Column:
    """``count`` such numbers, ``step`` bytes apart; null where they aren't all there, whatever the count says."""
    held = F.octet_length(data) - (offset + size - step)
    places = F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when((count == 0) | (count * step <= held), F.transform(places, lambda i: unsigned_be(data, F.lit(offset) + i * step, size)))


def is_fourcc(code: Column) -> Column:
    """Whether a string is four printable ASCII characters."""
    return code.rlike(r"\A[ -~]{4}\z")


def is_lz4_block(raw: Column) -> Column:
    """Whether bytes begin as a tile's compressed, stored or ending block does; false for null."""
    return F.coalesce(F.substring(raw, 1, 4).isin(*(F.unhex(F.lit(m.encode().hex())) for m in ("bv41", "bv4-", "bv4$"))), F.lit(False))
