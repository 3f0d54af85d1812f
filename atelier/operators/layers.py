"""Layers and tiles of artworks as rows: filters, references, grids and rectangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atelier.functions import pixels

#: Extensions of tile members, the preferred first.
TILE_KINDS = ("chunk", "lz4", "lz4c")
TILE = r"^(.+)/([0-9]+)~([0-9]+)\.(chunk|lz4|lz4c)$"


def kept_nodes(nodes: DataFrame) -> DataFrame:
    """Groups, and layers of type 0; composites, masks and anything else aren't layers. nodes: class, type."""
    return nodes.where((F.col("class") == "SilicaGroup") | ((F.col("class") == "SilicaLayer") & (F.coalesce("type", F.lit(0)) == 0)))


def composited(nodes: DataFrame) -> DataFrame:
    """Layers that take part in a composite: not hidden themselves and with a raster; what their groups say doesn't count."""
    return nodes.where(~F.coalesce("hidden", F.lit(False)) & F.col("raster").isNotNull())


def record_name(section: Column, name: Column) -> Column:
    """Name of a layer record: fixed for the divider of a group, ``Layer`` where there is none."""
    return F.when(section == 3, "</Layer group>").when(name != "", name).otherwise("Layer")


def unmapped_blends(nodes: DataFrame, group: list[str]) -> DataFrame:
    """Blend numbers without a key, each once and in order: group, blends. Groups without any are left out."""
    unknown = nodes.where(~pixels.blend_key(F.col("blend"))[1])
    return unknown.groupBy(*group).agg(F.array_sort(F.collect_set("blend")).alias("blends"))


def resolved(refs: DataFrame, objects: DataFrame, group: list[str], ref: str, key: str) -> DataFrame:
    """Rows with the object that ``ref`` names in their group; nulls where it is 0 or names none. Groups' columns have the same names on both sides."""
    known = objects.where(F.col(key) > 0)
    joined = refs.alias("r").join(known.alias("o"), [F.col(f"r.{g}") == F.col(f"o.{g}") for g in group] + [F.col(f"r.{ref}") == F.col(f"o.{key}")], "left")
    return joined.select("r.*", *[F.col(f"o.{c}") for c in objects.columns if c not in group])


def tile_members(members: DataFrame) -> DataFrame:
    """Tiles of an archive's rasters, one a place: path, raster, row, col, name. Of several kinds the preferred one is taken."""
    part = lambda k: F.regexp_extract("name", TILE, k)
    kind = F.array_position(F.lit(list(TILE_KINDS)), part(4))
    rows = members.where(F.col("name").rlike(TILE)).select("path", part(1).alias("raster"), part(2).try_cast("int").alias("row"), part(3).try_cast("int").alias("col"), kind.alias("kind"), "name")
    return rows.groupBy("path", "raster", "row", "col").agg(F.min_by("name", F.struct("kind", "name")).alias("name"))


def tile_grid(canvases: DataFrame, tiles: DataFrame, key: list[str]) -> DataFrame:
    """Every place of each canvas's grid with its tile: key, row, col, x0, y0, x1, y1 and the tiles' other columns, null where there is none.

    canvases: key, width, height, tile_size; tiles: key, row, col and more. Tiles at the edges are cut
    to the canvas; tiles outside the grid are left out.
    """
    last = lambda c: F.floor((F.col(c) - 1) / F.col("tile_size")).cast("int")
    some = canvases.where((F.col("width") > 0) & (F.col("height") > 0))
    rows = some.select("*", F.explode(F.sequence(F.lit(0), last("height"))).alias("row"))
    cells = rows.select("*", F.explode(F.sequence(F.lit(0), last("width"))).alias("col"))
    x0, y0 = F.col("col") * F.col("tile_size"), F.col("row") * F.col("tile_size")
    cut = cells.select(*key, "row", "col", x0.alias("x0"), y0.alias("y0"), F.least(x0 + F.col("tile_size"), "width").alias("x1"), F.least(y0 + F.col("tile_size"), "height").alias("y1"))
    return cut.join(tiles, [*key, "row", "col"], "left")


def tiles_of_rects(rects: DataFrame) -> DataFrame:
    """The places of the grid that each rectangle touches, cut to the canvas: the columns of rects, row, col.

    rects: x0, y0, x1, y1 (half open), width, height and tile_size. Empty rectangles touch none.
    """
    size = F.col("tile_size")
    first = lambda c: F.greatest(F.lit(0), F.floor(F.col(c) / size)).cast("int")
    last = lambda c, side: F.least(F.floor((F.col(side) - 1) / size), F.floor((F.col(c) - 1) / size)).cast("int")
    bounds = rects.where("x1 > x0 AND y1 > y0").select("*", first("x0").alias("_c0"), last("x1", "width").alias("_c1"), first("y0").alias("_r0"), last("y1", "height").alias("_r1"))
    touched = bounds.where("_c1 >= _c0 AND _r1 >= _r0")
    rows = touched.select(*rects.columns, "_c0", "_c1", F.explode(F.sequence("_r0", "_r1")).alias("row"))
    return rows.select(*rects.columns, "row", F.explode(F.sequence("_c0", "_c1")).alias("col"))


def tile_index(x: Column, y: Column, height: Column) -> Column:
    """Byte offset of a pixel in a tile, whose pixels of 4 bytes are stored column by column."""
    return (x * height + y) * 4


def merged_image(stored: Column, folded: Column) -> Column:
    """The stored composite's pixel, or that of the layers' fold where there is no composite."""
    return F.coalesce(stored, folded)
