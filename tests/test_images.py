"""Compositing of tiles and means of areas against plain loops."""

from __future__ import annotations

import random

from atelier.operators import images

LAYERS, TILES, GRID = "path string, layer int, z int, hidden boolean, opacity double", "path string, layer int, row int, col int, data binary", "path string, row int, col int, ground array<int>"


def over(d, s, opacity):
    sa = s[3] / 255 * opacity
    if sa <= 0:
        return d
    da = d[3] / 255
    ra = sa + da * (1 - sa)
    return (*(int((s[c] * sa + d[c] * da * (1 - sa)) / ra + 0.5) for c in range(3)), int(ra * 255 + 0.5))


def test_many_layers_over_a_transparent_ground(spark):
    r = random.Random(1)
    layers = [("a", k, 60 - k, r.random() < 0.1, r.choice([0.0, 0.3, 1.0])) for k in range(60)] + [("a", 99, 100, None, 1.0)]
    tiles = [("a", k, row, 0, bytearray(r.choices([0, 1, 128, 254, 255], k=16))) for k in range(60) for row in range(2) if r.random() < 0.8]
    tiles += [("a", 99, 0, 0, bytearray(b"short")), ("a", 99, 1, 0, None), ("a", 5, 7, 7, bytearray(16))]
    grid = [("a", 0, 0, None), ("a", 1, 0, [9, 8, 7, 200]), ("b", 0, 0, [1, 2, 3, 4])]
    tile_rows = spark.createDataFrame(tiles, TILES)
    out = images.composited(spark.createDataFrame(grid, GRID), spark.createDataFrame(layers, LAYERS), tile_rows, 2)
    got = {(x.path, x.row, x.col): bytes(x.data) for x in out.collect()}
    expected = {}
    for path, row, col, ground in grid:
        canvas = [tuple(ground or (0, 0, 0, 0))] * 4
        for _, k, z, hidden, opacity in sorted(layers, key=lambda x: x[2]):
            for p, t, tr, tc, data in tiles:
                if (p, t, tr, tc) == (path, k, row, col) and not hidden and k != 99:
                    canvas = [over(d, data[4 * i : 4 * i + 4], opacity) for i, d in enumerate(canvas)]
        expected[path, row, col] = bytes(v for px in canvas for v in px)
    assert got == expected
    assert [tuple(x) for x in images.bad_layers(tile_rows, 2).collect()] == [("a", 99, "layer has 2 damaged tiles")]


def test_means_of_every_grid(spark):
    r = random.Random(2)
    width, height = 13, 9
    pixels = [("a", x, y, r.randrange(256), r.randrange(256)) for x in range(width) for y in range(height)]
    table = images.summed(spark.createDataFrame(pixels, "f string, x long, y long, r int, g int"), ["f"], ["r", "g"])
    sizes = spark.createDataFrame([("a", width, height)], "f string, width int, height int")
    for w, h in ((1, 1), (4, 5), (13, 9), (20, 3)):
        cells = {}
        for _, x, y, red, green in pixels:
            cells.setdefault((((x + 1) * w - 1) // width, ((y + 1) * h - 1) // height), []).append((red, green))
        expected = {k: (len(v), sum(a for a, _ in v) // len(v), sum(b for _, b in v) // len(v)) for k, v in cells.items()}
        assert {(c.cx, c.cy): (c.n, c.r, c.g) for c in images.area_means(table, sizes, ["f"], ["r", "g"], (w, h)).collect()} == expected
