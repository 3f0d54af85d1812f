"""Text functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def human_bytes(n: Column) -> Column:
    """Sizes such as ``3.4 MiB``: one decimal below 100, rounded half to even on the exact quotient."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, letter in enumerate("KMGTPE", start=1):
        unit = 1 << (10 * k)
        whole = F.floor(n / unit) if k == 1 else F.shiftright(n, 10 * k)
        rest = n.bitwiseAND(F.lit(unit - 1))
        # tenths of the rest, without leaving 64 bits
        scaled = F.shiftright(rest, max(0, 10 * k - 50)).cast("long") * 10
        base = min(unit, 1 << 50)
        tenth = (scaled - F.pmod(scaled, F.lit(base))) / base
        left = 2 * F.pmod(scaled, F.lit(base))
        up = (left > base) | ((left == base) & (F.pmod(tenth, F.lit(2)) == 1))
        tenths = whole * 10 + tenth.cast("long") + F.when(up, 1).otherwise(0)
        small = F.format_string("%d.%d " + letter + "iB", F.floor(tenths / 10).cast("long"), F.pmod(tenths, F.lit(10)).cast("long"))
        large = F.format_string("%d " + letter + "iB", whole.cast("long"))
        out = F.when(n >= unit, F.when(whole < 100, small).otherwise(large)).otherwise(out)
    return out


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def size_of(value: Column) -> tuple[Column, Column]:
    """The two numbers of a size such as ``{1536, 2048.5}``, cut to whole ones; null where it can't be read."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(value), r"^\{", ""), r"\}$", "")
    parts = F.split(inner, ",", 2)
    number = lambda k: F.trim(F.get(parts, F.lit(k))).try_cast("double")
    whole = lambda v: F.when(v.isNotNull(), F.when(v < 0, F.ceil(v)).otherwise(F.floor(v))).cast("long")
    both = number(0).isNotNull() & number(1).isNotNull()
    return F.when(both, whole(number(0))), F.when(both, whole(number(1)))
