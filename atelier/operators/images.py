"""Images as rows of tiles and pixels: layers composited tile by tile, means of areas from summed tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def laid_over(ground: np.ndarray, layer: np.ndarray, opacity: float) -> np.ndarray:
    """A layer's pixels (rows of red, green, blue, alpha) over those below, rounded to 8 bits."""
    source = layer[:, 3].astype(np.float64) / 255 * opacity
    below = ground[:, 3].astype(np.float64) / 255
    alpha = source + below * (1 - source)
    seen = (source > 0) & (alpha > 0)
    out = ground.copy()
    s, d, a = source[seen], below[seen], alpha[seen]
    for c in range(3):
        mixed = (layer[seen, c].astype(np.float64) * s + ground[seen, c].astype(np.float64) * d * (1 - s)) / a
        out[seen, c] = (mixed + 0.5).astype(np.uint8)
    out[seen, 3] = (a * 255 + 0.5).astype(np.uint8)
    return out


def bad_layers(tiles: DataFrame, size: int) -> DataFrame:
    """Layers with a tile that isn't as long as its pixels: path, layer, problem. A missing tile is transparent and no problem."""
    wrong = F.coalesce(F.octet_length("data") != size * size * 4, F.lit(True))
    return tiles.where(wrong).groupBy("path", "layer").agg(F.format_string("layer has %d damaged tiles", F.count(F.lit(1))).alias("problem"))


def composited(grid: DataFrame, layers: DataFrame, tiles: DataFrame, size: int) -> DataFrame:
    """Visible layers over their artwork's ground, tile by tile: path, row, col, data (red, green, blue, alpha of each pixel).

    grid: path, row, col and ground (four numbers, or null for a transparent one); every row of it is in the
    result. layers: path, layer, z (ascending from the bottom), hidden, opacity. tiles: path, layer, row,
    col, data. A layer with a damaged tile is left out as a whole, see ``bad_layers``. The layers of a tile come to
    a task in their order and are laid over each other as they come, so that it holds two tiles,
    however many layers there are. Each step is rounded, so the order can't be changed or cut.
    """
    at = ["path", "row", "col"]
    shown = layers.where(~F.coalesce("hidden", F.lit(False))).select("path", "layer", "z", F.col("opacity").cast("double").alias("opacity"))
    sound = tiles.join(shown, ["path", "layer"]).join(bad_layers(tiles, size).select("path", "layer"), ["path", "layer"], "left_anti")
    base = grid.select(*at, F.lit(None).cast(dict(shown.dtypes)["z"]).alias("z"), F.lit(None).cast("double").alias("opacity"), F.lit(None).cast("binary").alias("data"), F.col("ground").cast("array<int>").alias("ground"), F.lit(0).alias("kind"))
    rows = base.unionByName(sound.select(*at, "z", "opacity", "data", F.lit(None).cast("array<int>").alias("ground"), F.lit(1).alias("kind")))
    tasks = int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(tasks, *at).sortWithinPartitions(*at, "kind", "z")
    kinds = dict(grid.dtypes)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, canvas = None, None
        done: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                own = (row["path"], row["row"], row["col"])
                if not row["kind"]:
                    if canvas is not None:
                        done.append((*key, canvas.tobytes()))
                    key, canvas = own, np.tile(np.array(row["ground"] or (0, 0, 0, 0), np.uint8), (size * size, 1))
                elif own == key:  # tiles beyond the grid have no ground
                    canvas = laid_over(canvas, np.frombuffer(row["data"], np.uint8).reshape(-1, 4), row["opacity"])
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip([*at, "data"], d, strict=True)) for d in done], schema=schema)
                done = []
        if canvas is not None:
            yield pa.RecordBatch.from_pylist([dict(zip([*at, "data"], (*key, canvas.tobytes()), strict=True))], schema=schema)

    arrow = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    schema = pa.schema([*((c, arrow[kinds[c]]) for c in at), ("data", pa.binary())])
    return ordered.mapInArrow(fold, ", ".join(f"{c} {kinds[c]}" for c in at) + ", data binary")


def summed(pixels: DataFrame, group: list[str], channels: list[str]) -> DataFrame:
    """The summed-area table of images: group, x, y and for each channel the sum over all pixels left of x and above y.

    pixels: group, x, y and channels, every pixel once. Sums run along each line and then down each column,
    so a task orders no more than one of these.
    """
    line = Window.partitionBy(*group, "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    column = Window.partitionBy(*group, "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    along = pixels.select(*group, "x", "y", *[F.sum(F.col(c).cast("long")).over(line).alias(c) for c in channels])
    return along.select(*group, (F.col("x") + 1).alias("x"), (F.col("y") + 1).alias("y"), *[F.sum(c).over(column).alias(c) for c in channels])


def area_means(table: DataFrame, images: DataFrame, group: list[str], channels: list[str], cells: tuple[int, int]) -> DataFrame:
    """Integer means of the channels over the cells of a grid of any size: group, cx, cy, n, channels.

    table: of ``summed``. images: group, width, height. Point p of s belongs to cell ((p + 1) * c - 1) div s of
    c, so cell k begins at k * s div c. Each cell's sum comes from the four corners of its area; cells without
    points, as there are where a grid is finer than the image, are left out.
    """
    edge = lambda k, s, c: F.floor(k * F.col(s) / c).cast("long")
    each = images.withColumn("cx", F.explode(F.sequence(F.lit(0), F.lit(cells[0] - 1)))).withColumn("cy", F.explode(F.sequence(F.lit(0), F.lit(cells[1] - 1))))
    x, y = [edge(F.col("cx") + k, "width", cells[0]) for k in (0, 1)], [edge(F.col("cy") + k, "height", cells[1]) for k in (0, 1)]
    sized = each.withColumn("n", (x[1] - x[0]) * (y[1] - y[0])).where("n > 0")
    corners = F.array(*[F.struct(x[i].alias("x"), y[j].alias("y"), F.lit(1 if i == j else -1).alias("sign")) for i in (0, 1) for j in (0, 1)])
    asked = sized.select(*group, F.col("cx").cast("long").alias("cx"), F.col("cy").cast("long").alias("cy"), "n", F.explode(corners).alias("c")).select(*group, "cx", "cy", "n", "c.*")
    met = asked.where("x > 0 AND y > 0").join(table, [*group, "x", "y"])
    sums = met.groupBy(*group, "cx", "cy", "n").agg(*[F.sum(F.col("sign") * F.col(c)).alias(c) for c in channels])
    return sums.select(*group, "cx", "cy", "n", *[F.expr(f"{c} div n").alias(c) for c in channels])
