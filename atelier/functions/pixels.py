"""Pixels, blends and canvas geometry on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layer blend numbers and the keys that layered files use for them.
BLEND_KEYS = {
    0: "norm", 1: "mul ", 2: "scrn", 3: "lddg", 4: "lite", 5: "smud", 6: "diff", 7: "fsub",
    8: "lbrn", 9: "div ", 10: "idiv", 11: "over", 12: "hLit", 13: "vLit", 14: "lLit", 15: "pLit",
    16: "lgCl", 17: "dkCl", 18: "sLit", 19: "hue ", 20: "sat ", 21: "colr", 22: "lum ", 23: "dark",
}
#: Quarter turns by stored orientation; others have none.
TURNS = {1: 3, 2: 1, 3: 2}


def blend_key(blend: Column) -> tuple[Column, Column]:
    """Key of a blend number, and whether it is known; unknown ones are normal."""
    keys = F.create_map(*[F.lit(x) for pair in BLEND_KEYS.items() for x in pair])
    found = F.try_element_at(keys, blend.cast("int"))
    return F.coalesce(found, F.lit(BLEND_KEYS[0])), found.isNotNull()


def straight(value: Column, alpha: Column) -> Column:
    """Colour without its alpha: rounded, at most 255; alpha 0 and 255 leave it."""
    return F.when(alpha.isin(0, 255), value).otherwise(F.least(F.lit(255), F.floor((value * 255 + F.floor(alpha / 2)) / alpha)).cast("int"))


def unit_float(v: Column) -> Column:
    """Clamped to 0..1; NaN is 0."""
    return F.when(F.isnan(v) | (v < 0), 0.0).when(v > 1, 1.0).otherwise(v)


def to_byte(v: Column) -> Column:
    return F.floor(unit_float(v) * 255 + 0.5).cast("int")


def over(below: Column, above: Column, alpha: Column) -> Column:
    """8-bit normal compositing of one channel on an opaque ground, rounded after each layer."""
    return F.floor((above * alpha + below * (255 - alpha) + 127) / 255).cast("int")


def turns(orientation: Column) -> Column:
    return F.when(orientation == 1, TURNS[1]).when(orientation == 2, TURNS[2]).when(orientation == 3, TURNS[3]).otherwise(0)


def rotate(x: Column, y: Column, w: Column, h: Column, quarter: Column) -> tuple[Column, Column]:
    """A point of a w by h canvas after quarter turns."""
    nx = F.when(quarter == 1, h - 1 - y).when(quarter == 2, w - 1 - x).when(quarter == 3, y).otherwise(x)
    ny = F.when(quarter == 1, x).when(quarter == 2, h - 1 - y).when(quarter == 3, w - 1 - x).otherwise(y)
    return nx, ny


def to_display(x: Column, y: Column, w: Column, h: Column, orientation: Column, flip_h: Column, flip_v: Column) -> tuple[Column, Column]:
    """Where a canvas point is shown: turned, then mirrored."""
    q = turns(orientation)
    nx, ny = rotate(x, y, w, h, q)
    dw, dh = F.when(q % 2 == 1, h).otherwise(w), F.when(q % 2 == 1, w).otherwise(h)
    return F.when(flip_h, dw - 1 - nx).otherwise(nx), F.when(flip_v, dh - 1 - ny).otherwise(ny)


def to_canvas(x: Column, y: Column, w: Column, h: Column, orientation: Column, flip_h: Column, flip_v: Column) -> tuple[Column, Column]:
    """The canvas point that is shown at a place: mirrored back, then turned back."""
    q = turns(orientation)
    dw, dh = F.when(q % 2 == 1, h).otherwise(w), F.when(q % 2 == 1, w).otherwise(h)
    mx, my = F.when(flip_h, dw - 1 - x).otherwise(x), F.when(flip_v, dh - 1 - y).otherwise(y)
    return rotate(mx, my, dw, dh, (4 - q) % 4)


def _rect(move, rect: tuple[Column, Column, Column, Column], *how) -> tuple[Column, Column, Column, Column]:
    """A half-open rectangle whose extreme points are moved; an empty one is all zeros."""
    x0, y0, x1, y1 = rect
    ax, ay = move(x0, y0, *how)
    bx, by = move(x1 - 1, y1 - 1, *how)
    some = (x1 > x0) & (y1 > y0)
    out = (F.least(ax, bx), F.least(ay, by), F.greatest(ax, bx) + 1, F.greatest(ay, by) + 1)
    return tuple(F.when(some, v).otherwise(0) for v in out)


def rect_to_display(rect: tuple[Column, Column, Column, Column], w: Column, h: Column, orientation: Column, flip_h: Column, flip_v: Column) -> tuple[Column, Column, Column, Column]:
    """Where a rectangle of the canvas is shown: x0, y0, x1, y1."""
    return _rect(to_display, rect, w, h, orientation, flip_h, flip_v)


def rect_to_canvas(rect: tuple[Column, Column, Column, Column], w: Column, h: Column, orientation: Column, flip_h: Column, flip_v: Column) -> tuple[Column, Column, Column, Column]:
    """The rectangle of the canvas that is shown at a place."""
    return _rect(to_canvas, rect, w, h, orientation, flip_h, flip_v)
