"""Queries over the driver tables for segments, layers, folder runs and coverage, with the SQL that checks them.

The driver has no archives, so rows of its tables stand for members, tracks, layers and profile lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atelier.functions import binary, codecs, pixels, text
from atelier.operators import aggregates, layers
from atelier.plans import batch, checks, timelapse
from atelier.plans.catalog import query
from atelier.session import table
from atelier.sources import archive, coverage

FOURCCS = ["avc1", "avc3", "hvc1", "hev1", "vp09", "av01", "mp4a", "ac-3", "ac-4", "alac", "Opus", "flac", "xyz1"]


def _pick(values: list[str], index: Column) -> Column:
    return F.get(F.lit(values), F.pmod(index, F.lit(len(values))).cast("int"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


@query("""
    SELECT p_partkey, f AS fourcc, CASE WHEN f LIKE 'avc_' THEN 'h264' WHEN f IN ('hvc1', 'hev1') THEN 'hevc' WHEN f = 'vp09' THEN 'vp9' WHEN f = 'av01' THEN 'av1'
        WHEN f = 'mp4a' THEN 'aac' WHEN f = 'ac-3' THEN 'ac3' WHEN f = 'ac-4' THEN 'ec3' WHEN f IN ('alac', 'flac') THEN f WHEN f = 'Opus' THEN 'opus' ELSE f END AS codec
    FROM (SELECT p_partkey, ['avc1', 'avc3', 'hvc1', 'hev1', 'vp09', 'av01', 'mp4a', 'ac-3', 'ac-4', 'alac', 'Opus', 'flac', 'xyz1'][(p_partkey % 13 + 1)::INT] AS f FROM part)
""")
def codec_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _parts(spark, sf_dir).select("p_partkey", _pick(FOURCCS, F.col("p_partkey")).alias("fourcc"))
    return named.withColumn("codec", codecs.codec_name(F.col("fourcc")))


@query("""
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN 'unknown'
        ELSE CASE p_size % 5 WHEN 0 THEN 'gray' WHEN 1 THEN 'yuv420p' WHEN 2 THEN 'yuv422p' WHEN 3 THEN 'yuv444p' ELSE 'unknown' END END AS pixel_format
    FROM part
""")
def pixel_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    handler, box = F.when(key % 3 == 0, "soun").otherwise("vide"), F.when(key % 2 == 0, "hvcC").otherwise("avcC")
    return _parts(spark, sf_dir).select("p_partkey", codecs.pixel_format(handler, box, F.col("p_size") % 5).alias("pixel_format"))


@query("""
    SELECT p_partkey, CASE p WHEN 66 THEN 'baseline' WHEN 77 THEN 'main' WHEN 88 THEN 'extended' WHEN 100 THEN 'high' WHEN 110 THEN 'high 10' WHEN 122 THEN 'high 4:2:2'
        WHEN 244 THEN 'high 4:4:4 predictive' ELSE 'profile ' || p END AS profile
    FROM (SELECT p_partkey, (p_partkey * 11) % 256 AS p FROM part)
""")
def profile_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", codecs.profile_name((F.col("p_partkey") * 11) % 256).alias("profile"))


@query("""
    SELECT p_partkey, CASE WHEN p_partkey % 7 > 0 THEN trunc(p_retailprice)::BIGINT END AS first, CASE WHEN p_partkey % 7 > 0 THEN p_size::BIGINT END AS second FROM part
""")
def size_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes written as ``{retail price, size.5}``, some of them without a second number."""
    written = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("{"), "p_retailprice", F.lit("}"))).otherwise(F.concat(F.lit(" {"), "p_retailprice", F.lit(" , "), "p_size", F.lit(".5} ")))
    first, second = text.size_of(written)
    return _parts(spark, sf_dir).select("p_partkey", first.alias("first"), second.alias("second"))


@query("SELECT doc_id, split_part(text, chr(10), 1) AS line FROM documents")
def first_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.first_line(F.col("text")).alias("line"))


@query("SELECT p_partkey, p_partkey % 4 IN (0, 1, 2) AS is_block FROM part")
def tile_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.encode(F.concat(_pick(["bv41", "bv4-", "bv4$", "bv4x"], F.col("p_partkey")), "p_name"), "UTF-8")
    return _parts(spark, sf_dir).select("p_partkey", binary.is_lz4_block(raw).alias("is_block"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as layers of the brands' artworks."""
    key = F.col("p_partkey")
    return _parts(spark, sf_dir).select(
        F.col("p_brand").alias("path"), key.alias("id"), _pick(["SilicaLayer", "SilicaGroup", "SilicaMask"], key).alias("class"), F.when(key % 5 > 0, key % 4).alias("type"),
        F.when(key % 11 > 0, key % 2 == 0).alias("hidden"), F.when(key % 3 > 0, F.col("p_name")).alias("raster"), (key % 4).cast("int").alias("section"),
        F.when(key % 6 == 0, "").when(key % 6 > 1, F.col("p_name")).alias("name"), F.col("p_size").alias("blend"), (key % 2500).alias("ref"),
    )


@query("""
    SELECT p_brand AS path, p_partkey AS id FROM part
    WHERE p_partkey % 3 = 1 OR (p_partkey % 3 = 0 AND (p_partkey % 5 = 0 OR p_partkey % 4 = 0))
""")
def layer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.kept_nodes(_nodes(spark, sf_dir)).select("path", "id")


@query("SELECT p_brand AS path, p_partkey AS id FROM part WHERE p_partkey % 3 > 0 AND (p_partkey % 11 = 0 OR p_partkey % 2 = 1)")
def visible_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.composited(_nodes(spark, sf_dir)).select("path", "id")


@query("""
    SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 3 THEN '</Layer group>' WHEN p_partkey % 6 > 1 THEN p_name ELSE 'Layer' END AS record FROM part
""")
def record_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("id", layers.record_name(F.col("section"), F.col("name")).alias("record"))


@query("SELECT p_brand AS path, array_to_string(list_sort(list(DISTINCT p_size)), ',') AS blends FROM part WHERE p_size NOT BETWEEN 0 AND 23 GROUP BY p_brand")
def unmapped_blends(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layers.unmapped_blends(_nodes(spark, sf_dir), ["path"])
    return found.select("path", F.array_join(F.transform("blends", lambda b: b.cast("string")), ",").alias("blends"))


@query("""
    SELECT a.p_brand AS path, a.p_partkey AS id, b.p_name AS target
    FROM part a LEFT JOIN part b ON a.p_brand = b.p_brand AND b.p_partkey = a.p_partkey % 2500 AND b.p_partkey > 0
""")
def resolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _nodes(spark, sf_dir).select("path", "id", "ref")
    objects = _parts(spark, sf_dir).select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("oid"), F.col("p_name").alias("target"))
    return layers.resolved(refs, objects, ["path"], "ref", "oid").select("path", "id", "target")


def _canvases(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(key.alias("canvas"), (key % 300 + 1).alias("width"), (key % 210 + 1).alias("height"), F.lit(64).alias("tile_size"))


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    at = lines.select(F.col("l_suppkey").alias("canvas"), F.pmod("l_orderkey", F.lit(4)).cast("int").alias("row"), F.pmod("l_partkey", F.lit(5)).cast("int").alias("col"), "l_quantity")
    return at.groupBy("canvas", "row", "col").agg(F.max("l_quantity").cast("long").alias("tile"))


_TILES_SQL = """
    WITH c AS (SELECT s_suppkey AS canvas, s_suppkey % 300 + 1 AS width, s_suppkey % 210 + 1 AS height FROM supplier),
    t AS (SELECT l_suppkey AS canvas, l_orderkey % 4 AS row, l_partkey % 5 AS col, max(l_quantity)::BIGINT AS tile FROM lineitem GROUP BY ALL),
"""


@query(_TILES_SQL + """
    r AS (SELECT *, unnest(generate_series(0, (height - 1) // 64)) AS row FROM c), g AS (SELECT *, unnest(generate_series(0, (width - 1) // 64)) AS col FROM r)
    SELECT g.canvas, g.row::INT AS row, g.col::INT AS col, least(g.col * 64 + 64, width) AS x1, least(g.row * 64 + 64, height) AS y1, t.tile
    FROM g LEFT JOIN t USING (canvas, row, col)
""")
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = layers.tile_grid(_canvases(spark, sf_dir), _tiles(spark, sf_dir), ["canvas"])
    return grid.select("canvas", "row", "col", F.col("x1").cast("long").alias("x1"), F.col("y1").cast("long").alias("y1"), "tile")


_RECTS_SQL = """
    WITH r AS (SELECT l_orderkey AS id, l_linenumber AS line, l_partkey % 320 - 20 AS x0, l_suppkey % 240 - 20 AS y0, l_partkey % 320 - 20 + l_quantity::BIGINT * 3 - 9 AS x1,
                      l_suppkey % 240 - 20 + l_quantity::BIGINT AS y1 FROM lineitem)
"""


def _rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_quantity").cast("long")
    x0, y0 = F.pmod("l_partkey", F.lit(320)) - 20, F.pmod("l_suppkey", F.lit(240)) - 20
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), x0.alias("x0"), y0.alias("y0"), (x0 + n * 3 - 9).alias("x1"), (y0 + n).alias("y1"),
        F.lit(300).alias("width"), F.lit(210).alias("height"), F.lit(64).alias("tile_size"),
    )


@query(_RECTS_SQL + """,
    b AS (SELECT *, greatest(0, floor(x0 / 64)) AS c0, least(299 // 64, floor((x1 - 1) / 64)) AS c1, greatest(0, floor(y0 / 64)) AS r0, least(209 // 64, floor((y1 - 1) / 64)) AS r1
          FROM r WHERE x1 > x0 AND y1 > y0),
    e AS (SELECT *, unnest(generate_series(r0::BIGINT, r1::BIGINT)) AS row FROM b WHERE c1 >= c0 AND r1 >= r0)
    SELECT row::INT AS row, col::INT AS col, count(*) AS n FROM (SELECT row, unnest(generate_series(c0::BIGINT, c1::BIGINT)) AS col FROM e) GROUP BY ALL
""")
def tiles_of_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rectangles touch each tile of a grid."""
    return layers.tiles_of_rects(_rects(spark, sf_dir)).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))


@query(_RECTS_SQL + """,
    d AS (SELECT DISTINCT x0, y0, x1, y1 FROM r WHERE x1 > x0 AND y1 > y0)
    SELECT x0, y0, x1, y1, 210 - y1 AS shown_x0, x0 AS shown_y0, 210 - y0 AS shown_x1, x1 AS shown_y1, x0 AS back_x0, y0 AS back_y0, x1 AS back_x1, y1 AS back_y1 FROM d
""")
def rect_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles turned by a quarter, and back."""
    names = ("x0", "y0", "x1", "y1")
    rects = _rects(spark, sf_dir).where("x1 > x0 AND y1 > y0").select(*names).distinct()
    how = (F.lit(300), F.lit(210), F.lit(2), F.lit(False), F.lit(False))
    shown = rects.select(*names, *[v.cast("long").alias(f"shown_{n}") for n, v in zip(names, pixels.rect_to_display(tuple(map(F.col, names)), *how), strict=True)])
    back = pixels.rect_to_canvas(tuple(F.col(f"shown_{n}") for n in names), *how)
    return shown.select("*", *[v.cast("long").alias(f"back_{n}") for n, v in zip(names, back, strict=True)])


@query("SELECT DISTINCT l_partkey % 64 AS x, l_suppkey % 64 AS y, ((l_partkey % 64) * 64 + l_suppkey % 64) * 4 AS at FROM lineitem")
def tile_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.pmod("l_partkey", F.lit(64)), F.pmod("l_suppkey", F.lit(64))
    return table(spark, sf_dir, "lineitem").select(x.alias("x"), y.alias("y"), layers.tile_index(x, y, F.lit(64)).alias("at")).distinct()


@query("""
    WITH f AS (SELECT user_id, list_reduce(list_prepend(255, list((event_id % 256) * 1000 + event_id % 200 ORDER BY event_id)),
               lambda s, v: ((v // 1000) * (v % 1000) + s * (255 - v % 1000) + 127) // 255) AS folded FROM events WHERE event_type <> 'error' GROUP BY user_id)
    SELECT DISTINCT e.user_id, CASE WHEN e.user_id % 3 = 0 THEN e.user_id % 256 ELSE coalesce(f.folded, 255) END::BIGINT AS shade FROM events e LEFT JOIN f USING (user_id)
""")
def merged_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored shade where an artwork has one, else its layers over white; layers that can't be read are left out."""
    from atelier.operators import sequences

    events = table(spark, sf_dir, "events")
    sound = events.where("event_type <> 'error'").select("user_id", "event_id", F.struct(F.pmod("event_id", F.lit(256)).alias("c"), F.pmod("event_id", F.lit(200)).alias("a")).alias("v"))
    folded = sequences.fold(sound, ["user_id"], "event_id", "v", F.lit(255), lambda s, v: pixels.over(s, v["c"], v["a"]), states=256)
    stored = F.when(F.col("user_id") % 3 == 0, F.pmod("user_id", F.lit(256)))
    users = events.select("user_id").distinct().join(folded, "user_id", "left")
    return users.select("user_id", layers.merged_image(stored, F.coalesce("folded", F.lit(255))).cast("long").alias("shade"))


_STACK_SQL = """
    WITH t AS (SELECT l_suppkey % 10 AS k, l_linenumber AS z, l_orderkey % 4 AS row, l_partkey % 5 AS col, max(l_partkey) AS v FROM lineitem GROUP BY ALL),
    good AS (SELECT * FROM t WHERE z % 4 <> 3 AND NOT (k = 3 AND z = 2)),
    g AS (SELECT k, row, col, p, k % 3 AS ground FROM range(10) a(k), range(4) b(row), range(5) c(col), range(4) d(p)),
    f AS (SELECT g.k, g.row, g.col, g.p, any_value(ground) AS ground, list({'r': (v * 31 + g.p * 17) % 256.0::DOUBLE, 'g': (v * 31 + g.p * 17 + 7) % 256.0::DOUBLE, 'b': (v * 31 + g.p * 17 + 14) % 256.0::DOUBLE, 'a': (v * 31 + g.p * 17 + 21) % 256.0::DOUBLE, 'o': (z % 3 + 1) / 4.0::DOUBLE} ORDER BY z) FILTER (v IS NOT NULL) AS layers
          FROM g LEFT JOIN good t ON t.k = g.k AND t.row = g.row AND t.col = g.col GROUP BY g.k, g.row, g.col, g.p),
    c AS (SELECT k, row, col, p, list_reduce(list_prepend(CASE ground WHEN 0 THEN {'r': 0.0::DOUBLE, 'g': 0.0::DOUBLE, 'b': 0.0::DOUBLE, 'a': 0.0::DOUBLE, 'o': 0.0::DOUBLE} ELSE {'r': 250.0::DOUBLE, 'g': 240.0::DOUBLE, 'b': 10.0::DOUBLE, 'a': ground * 100.0::DOUBLE, 'o': 0.0::DOUBLE} END, coalesce(layers, [])),
        lambda d, s: CASE WHEN s.a / 255 * s.o <= 0 THEN d ELSE {
            'r': floor((s.r * (s.a / 255 * s.o) + d.r * (d.a / 255) * (1 - s.a / 255 * s.o)) / (s.a / 255 * s.o + d.a / 255 * (1 - s.a / 255 * s.o)) + 0.5::DOUBLE), 'g': floor((s.g * (s.a / 255 * s.o) + d.g * (d.a / 255) * (1 - s.a / 255 * s.o)) / (s.a / 255 * s.o + d.a / 255 * (1 - s.a / 255 * s.o)) + 0.5::DOUBLE),
            'b': floor((s.b * (s.a / 255 * s.o) + d.b * (d.a / 255) * (1 - s.a / 255 * s.o)) / (s.a / 255 * s.o + d.a / 255 * (1 - s.a / 255 * s.o)) + 0.5::DOUBLE), 'a': floor((s.a / 255 * s.o + d.a / 255 * (1 - s.a / 255 * s.o)) * 255 + 0.5::DOUBLE), 'o': 0.0::DOUBLE} END) AS m FROM f)
"""


@query(_STACK_SQL + "SELECT k::INT AS k, row::INT AS row, col::INT AS col, p::INT AS p, m.r::INT AS r, m.g::INT AS g, m.b::INT AS b, m.a::INT AS a FROM c")
def tile_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of ten artworks, some of them hidden and one damaged, over grounds of several opacities, as tiles of four pixels."""
    from atelier.operators import images

    lines = table(spark, sf_dir, "lineitem")
    keys = [F.pmod("l_suppkey", F.lit(10)).cast("int").alias("k"), F.col("l_linenumber").alias("z"), F.pmod("l_orderkey", F.lit(4)).cast("int").alias("row"), F.pmod("l_partkey", F.lit(5)).cast("int").alias("col")]
    made = lines.select(*keys, "l_partkey").groupBy("k", "z", "row", "col").agg(F.max("l_partkey").alias("v"))
    byte = lambda i: F.lpad(F.hex(F.pmod(F.col("v") * 31 + F.floor(i / 4) * 17 + i % 4 * 7, F.lit(256)).cast("long")), 2, "0")
    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), byte), ""))
    short = (F.col("k") == 3) & (F.col("z") == 2) & (F.col("row") == 0)
    tiles = made.select(F.col("k").cast("string").alias("path"), F.col("z").alias("layer"), "row", "col", F.when(short, F.unhex(F.lit("00"))).otherwise(data).alias("data"))
    layers_ = made.select(F.col("k").cast("string").alias("path"), F.col("z").alias("layer"), "z", (F.col("z") % 4 == 3).alias("hidden"), ((F.col("z") % 3 + 1) / 4.0).alias("opacity")).distinct()
    grid = spark.range(200).select(F.floor(F.col("id") / 20).cast("int").alias("k"), (F.col("id") % 20 % 4).cast("int").alias("row"), F.floor(F.col("id") % 20 / 4).cast("int").alias("col"))
    shade = F.when(F.col("k") % 3 > 0, F.array(F.lit(250), F.lit(240), F.lit(10), F.col("k") % 3 * 100))
    out = images.composited(grid.select(F.col("k").cast("string").alias("path"), "row", "col", shade.alias("ground")), layers_, tiles, 2)
    each = out.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(3))))
    value = lambda c: F.conv(F.hex(F.substring("data", F.col("p") * 4 + c + 1, F.lit(1))), 16, 10).cast("int")
    return each.select(F.col("path").cast("int").alias("k"), "row", "col", "p", *[value(i).alias(n) for i, n in enumerate("rgba")])


@query("""
    WITH i AS (SELECT f, 60 AS width, CASE WHEN f = 'N' THEN 40 ELSE 41 END AS height FROM (SELECT DISTINCT l_returnflag AS f FROM lineitem)),
    v AS (SELECT l_returnflag AS f, l_partkey % 60 AS x, l_suppkey % 40 AS y, max(l_quantity)::BIGINT AS r, min(l_partkey) AS g, max(l_suppkey) AS b, count(*) AS a FROM lineitem GROUP BY ALL),
    p AS (SELECT i.f, i.width, i.height, x.x, y.y, coalesce(v.r, 0) AS r, coalesce(v.g, 0) AS g, coalesce(v.b, 0) AS b, coalesce(v.a, 0) AS a FROM i, range(60) x(x), range(41) y(y) LEFT JOIN v ON v.f = i.f AND v.x = x.x AND v.y = y.y WHERE y.y < i.height),
    t(w, h) AS (VALUES (16, 16), (7, 5), (60, 41))
    SELECT f, w::INT AS w, h::INT AS h, ((x + 1) * w - 1) // width AS cx, ((y + 1) * h - 1) // height AS cy, count(*) AS n, (sum(r) // count(*))::BIGINT AS r, (sum(g) // count(*))::BIGINT AS g, (sum(b) // count(*))::BIGINT AS b, (sum(a) // count(*))::BIGINT AS a FROM p, t GROUP BY ALL
""")
def area_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three images reduced to grids of three sizes, from one summed-area table."""
    from atelier.operators import images

    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("f"), F.pmod("l_partkey", F.lit(60)).alias("x"), F.pmod("l_suppkey", F.lit(40)).alias("y"), "l_quantity", "l_partkey", "l_suppkey")
    seen = lines.groupBy("f", "x", "y").agg(F.max("l_quantity").cast("long").alias("r"), F.min("l_partkey").alias("g"), F.max("l_suppkey").alias("b"), F.count(F.lit(1)).alias("a"))
    sizes = lines.select("f").distinct().select("f", F.lit(60).alias("width"), F.when(F.col("f") == "N", 40).otherwise(41).alias("height"))
    grid = sizes.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width").cast("long") - 1))).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height").cast("long") - 1)))
    pixels_ = grid.join(seen, ["f", "x", "y"], "left").fillna(0, list("rgba"))
    sums, out = images.summed(pixels_, ["f"], list("rgba")), None
    for w, h in ((16, 16), (7, 5), (60, 41)):
        one = images.area_means(sums, sizes, ["f"], list("rgba"), (w, h)).select("f", F.lit(w).alias("w"), F.lit(h).alias("h"), "cx", "cy", "n", *"rgba")
        out = one if out is None else out.unionByName(one)
    return out


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as members of archives, many of each supplier."""
    kind, n = F.pmod("l_orderkey", F.lit(5)), F.pmod("l_partkey", F.lit(40)).cast("string")
    name = F.when(kind < 2, F.concat(F.lit("video/segments/segment-"), n, F.lit(".mp4"))).when(kind == 2, F.concat(F.lit("VIDEO/Segments/SEGMENT-0"), n, F.lit(".MP4"))).when(
        kind == 3, F.concat(F.lit("video/segments/take"), n, F.lit(".mp4"))
    ).otherwise(F.concat(F.lit("Document/"), n, F.lit(".lz4")))
    path = F.concat(F.lit("s"), "l_suppkey", F.lit("-"), F.pmod("l_orderkey", F.lit(37)))
    return table(spark, sf_dir, "lineitem").select(path.alias("path"), name.alias("name"), F.lit(False).alias("is_dir"), F.lit(None).cast("string").alias("error"), F.col("l_quantity").cast("long").alias("packed")).distinct()


_MEMBERS_SQL = """
    WITH m AS (SELECT DISTINCT 's' || l_suppkey || '-' || l_orderkey % 37 AS path, l_orderkey % 5 AS kind, l_partkey % 40 AS n, l_quantity::BIGINT AS packed FROM lineitem),
    k AS (SELECT DISTINCT path, packed, CASE WHEN kind < 2 THEN 'a' WHEN kind = 2 THEN 'b' WHEN kind = 3 THEN 'c' ELSE 'd' END AS kind, n FROM m),
    s AS (SELECT path, n, count(*) AS c FROM k WHERE kind IN ('a', 'b') GROUP BY ALL),
    g AS (SELECT path, n + 1 AS lo, lead(n) OVER (PARTITION BY path ORDER BY n) - 1 AS hi FROM s),
    gaps AS (SELECT path, string_agg(CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || '-' || hi END, ', ' ORDER BY lo) AS missing FROM g WHERE hi >= lo GROUP BY path),
    clash AS (SELECT path, min(n) AS clash FROM s WHERE c > 1 GROUP BY path)
"""


@query(_MEMBERS_SQL + """
    SELECT path, count(*) FILTER (kind IN ('a', 'b')) AS n_segments, min(n) FILTER (kind IN ('a', 'b')) AS first, max(n) FILTER (kind IN ('a', 'b')) AS last,
           count(*) FILTER (kind = 'c') AS n_ignored, any_value(missing) AS missing, any_value(clash) AS clash,
           CASE WHEN any_value(clash) IS NOT NULL THEN 5 WHEN count(*) FILTER (kind IN ('a', 'b')) > 0 THEN 0 ELSE 4 END AS code
    FROM k LEFT JOIN gaps USING (path) LEFT JOIN clash USING (path) GROUP BY path
""")
def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timelapse.listing(_members(spark, sf_dir), to_convert=False).drop("problem", "error")


@query(_MEMBERS_SQL + """
    SELECT path, count(*) FILTER (kind IN ('c', 'd')) AS kept, count(*) FILTER (kind IN ('a', 'b')) AS removed, coalesce(sum(packed) FILTER (kind IN ('a', 'b')), 0)::BIGINT AS removed_bytes
    FROM k GROUP BY path
""")
def slim_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timelapse.slim_totals(_members(spark, sf_dir))


@query(_MEMBERS_SQL + """
    SELECT path, row_number() OVER (PARTITION BY path ORDER BY n, kind, packed) AS place, n AS number, packed FROM k WHERE kind IN ('a', 'b')
""")
def segment_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments in the order of their numbers, not of their names."""
    from pyspark.sql import Window

    held = timelapse.classified(_members(spark, sf_dir)).where("number IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("path").orderBy("number", F.col("name").startswith("V"), "packed")).cast("long")
    return held.select("path", place.alias("place"), "number", "packed")


@query("""
    SELECT page_id, row_number() OVER (ORDER BY list_transform(range(1, len(p) + 1), lambda i: {'deeper': i < len(p), 'name': p[i]}), page_id) AS place
    FROM (SELECT page_id, string_split(substr(url, strpos(url, '://') + 3), '/') AS p FROM pages)
""")
def walk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files of one tree in the order of a walk: a folder's files first, then its folders."""
    from atelier.operators import sequences

    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/"), F.substr("url", F.locate("://", "url") + 3)).alias("path"))
    keyed = pages.select("page_id", archive.walk_key(F.col("path"), F.lit("")).alias("key"))
    return sequences.numbered(keyed, ["key", "page_id"]).select("page_id", "place")


@query("""
    WITH f AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS below, regexp_replace(split_part(url, '/', -1), '(?i)(.)\\.html$', '\\1') AS stem FROM pages),
    n AS (SELECT *, 'd/' || below || '/x' || page_id % 7 || '.procreate' AS path FROM f),
    r AS (SELECT DISTINCT path, below, page_id % 7 AS k FROM n)
    SELECT path, 'out/mp4/' || below || '/x' || k || '.mp4' AS timelapse, 'out/procreate/' || below || '/x' || k || '.slim.procreate' AS project FROM r
""")
def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    files = table(spark, sf_dir, "pages").select(F.concat(F.lit("d/"), host, F.lit("/x"), F.col("page_id") % 7, F.lit(".procreate")).alias("path")).distinct()
    return batch.planned(files, "d", "out", recursive=True)


_RUN_SQL = """
    WITH items AS (SELECT c_custkey AS k, 'c' || c_custkey AS path, c_custkey % 9 AS r, c_custkey % 4 AS t, c_custkey % 5 > 0 AS has, c_custkey % 13 = 0 AS bad FROM customer),
    acted AS (SELECT *, CASE WHEN t = 3 OR (t = 2 AND r <> 1 AND NOT has) THEN 'skip' WHEN t IN (1, 2) THEN 'regenerate' ELSE 'convert' END AS action FROM items),
    ended AS (SELECT *, CASE WHEN action = 'skip' THEN 'existed' WHEN r = 1 OR (has AND bad) THEN 'failed' WHEN has THEN 'converted' ELSE 'no_video' END AS status FROM acted)
"""


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as archives of a folder, of which a quarter each have no results, only a video, only a project, or both."""
    k = F.col("c_custkey")
    items = table(spark, sf_dir, "customer").select(k, F.concat(F.lit("c"), k).alias("path"))
    plan = items.select("path", F.concat(F.lit("t"), k).alias("timelapse"), F.concat(F.lit("p"), k).alias("project"))
    done = items.where(k % 4 % 2 == 1).select(F.concat(F.lit("t"), k).alias("path")).union(items.where(k % 4 >= 2).select(F.concat(F.lit("p"), k)))
    n = F.when((k % 9 != 1) & (k % 5 > 0), 3).otherwise(0).cast("long")
    error = F.when(k % 9 == 1, "not a ZIP archive")
    listed = items.select("path", n.alias("n_segments"), F.when(error.isNotNull(), 3).when(n > 0, 0).otherwise(4).alias("code"), error.alias("error"), F.lit(None).cast("string").alias("problem"))
    problems = items.where(k % 13 == 0).select("path", F.explode(F.array(F.lit(2), F.lit(1))).alias("number")).withColumn("problem", F.concat(F.lit("segment "), "number"))
    return batch.results(batch.to_do(plan, done, listed), listed, problems)


@query(_RUN_SQL + "SELECT path, status, CASE WHEN status = 'failed' THEN CASE WHEN r = 1 THEN 'not a ZIP archive' ELSE 'segment 1' END END AS problem FROM ended")
def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)


@query(_RUN_SQL + """
    SELECT count(*) FILTER (status = 'converted') AS converted, count(*) FILTER (status = 'existed') AS existed, count(*) FILTER (status = 'no_video') AS no_video,
           count(*) FILTER (status = 'failed') AS failed, CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 1 ELSE 0 END AS exit_code, count(*) FILTER (status = 'failed') = 0 AS pack FROM ended
""")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.counters(_run(spark, sf_dir))


@query("SELECT DISTINCT 'out/procreate/' || substr(n, 11) AS path FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'other/' ELSE 'procreate/' END || p_name || CASE WHEN p_partkey % 5 = 0 THEN '/' ELSE '' END AS n FROM part) WHERE n LIKE 'procreate/%' AND n NOT LIKE '%/'")
def packed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    name = F.concat(F.when(key % 3 == 0, "other/").otherwise("procreate/"), "p_name", F.when(key % 5 == 0, "/").otherwise(""))
    return batch.packed_paths(_parts(spark, sf_dir).select(name.alias("name")), "out")


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as lines of coverage profiles, as text."""
    at = F.pmod("l_orderkey", F.lit(2000)) + 1
    file = F.concat(F.lit("m/p"), F.pmod("l_suppkey", F.lit(9)), F.lit("/f"), F.pmod("l_partkey", F.lit(12)), F.lit(".go"))
    pos = F.concat(file, F.lit(":"), at, F.lit(".2,"), at + F.col("l_linenumber") - 2, F.lit(".9"))
    line = F.concat_ws(" ", pos, "l_linenumber", (F.col("l_quantity").cast("long") - 25))
    lines = table(spark, sf_dir, "lineitem").select(F.lit("a").alias("profile"), line.alias("text"))
    return lines.union(spark.createDataFrame([("a", "mode: set"), ("a", "  ")], "profile string, text string"))


_PROFILE_SQL = """
    WITH b AS (SELECT 'p' || l_suppkey % 9 AS package, 'p' || l_suppkey % 9 || '/f' || l_partkey % 12 || '.go' AS file, l_orderkey % 2000 + 1 AS lo,
                      greatest(l_orderkey % 2000 + 1, l_orderkey % 2000 + l_linenumber - 1) AS hi, l_orderkey % 2000 + l_linenumber - 1 AS written, l_linenumber::BIGINT AS statements, l_quantity::BIGINT - 25 AS n FROM lineitem),
    l AS (SELECT package, file, line, max(n) AS hits FROM (SELECT *, unnest(generate_series(lo, hi)) AS line FROM b) GROUP BY ALL)
"""


@query(_PROFILE_SQL + """
    SELECT 'm/' || file || ':' || lo || '.2,' || written || '.9' AS pos, max({'n': n, 's': statements}).s AS statements, max(n) AS count FROM b GROUP BY ALL
""")
def coverage_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.merged(coverage.blocks(_profile(spark, sf_dir))).select("pos", "statements", "count")


@query(_PROFILE_SQL + "SELECT package, file, line, hits FROM l")
def coverage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.line_hits(coverage.blocks(_profile(spark, sf_dir)), "m/")


@query(_PROFILE_SQL + """
    SELECT package, file, count(*) AS valid, count(*) FILTER (hits > 0) AS covered, round(count(*) FILTER (hits > 0) / count(*), 4) AS rate FROM l GROUP BY ROLLUP (package, file)
""")
def coverage_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.rolled(coverage.swept(coverage.blocks(_profile(spark, sf_dir)), "m/"))


@query("""
    WITH b AS (SELECT 'f' || l_suppkey % 9 || '.go' AS file, l_orderkey * 1000 + 1 AS lo, l_orderkey * 1000 + l_partkey * l_linenumber * 50 + 1 AS hi, l_quantity > 25 AS hit FROM lineitem),
    twice AS (SELECT *, true AS every FROM b UNION ALL SELECT *, false FROM b WHERE hit),
    w AS (SELECT file, every, lo, hi, max(hi) OVER (PARTITION BY file, every ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM twice),
    s AS (SELECT file, every, sum(greatest(0, hi - greatest(lo - 1, coalesce(reached, lo - 1))))::BIGINT AS n FROM w GROUP BY ALL),
    f AS (SELECT file, max(n) FILTER (every) AS valid, coalesce(max(n) FILTER (NOT every), 0) AS covered FROM s GROUP BY file)
    SELECT CASE WHEN grouping(file) = 1 THEN NULL ELSE '.' END AS package, file, sum(valid)::BIGINT AS valid, sum(covered)::BIGINT AS covered, round(sum(covered) / sum(valid), 4) AS rate FROM f GROUP BY ROLLUP (file)
    UNION ALL SELECT '.', NULL, sum(valid)::BIGINT, sum(covered)::BIGINT, round(sum(covered) / sum(valid), 4) FROM f
""")
def coverage_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of blocks of up to millions of lines, none of which becomes a row."""
    first = F.col("l_orderkey") * 1000 + 1
    blocks = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("f"), F.pmod("l_suppkey", F.lit(9)), F.lit(".go")).alias("file"), first.alias("first"), (first + F.col("l_partkey") * F.col("l_linenumber") * 50).alias("last"), (F.col("l_quantity").cast("long") - 25).alias("count")
    )
    return coverage.rolled(coverage.swept(blocks))


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' lines as tracks: a supplier is an archive, twenty numbers its segments; a line is a chunk of two samples."""
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("path"), F.pmod("l_orderkey", F.lit(20)).alias("number"), F.pmod("l_partkey", F.lit(100)).alias("v"))
    vs = lines.groupBy("path", "number").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    one = lambda **fields: F.struct(*[(F.lit(v) if isinstance(v, int) else v).cast("long").alias(k) for k, v in fields.items()])
    n = F.size("vs")
    sync = F.when(F.col("number") % 3 == 0, F.transform(F.filter(F.sequence(F.lit(1), 2 * n), lambda i: i % 4 == 1), lambda i: i.cast("long")))
    return vs.select(
        "path", F.concat(F.lit("segment-"), "number").alias("name"), "number", F.lit(0).alias("track"), F.lit("vide").alias("handler"), F.lit("avc1").alias("fourcc"), F.lit(1).alias("track_id"), F.lit(30).alias("timescale"),
        F.flatten(F.transform("vs", lambda v: F.array(v, v + 1))).alias("sizes"),
        F.transform("vs", lambda v, i: (i * 200 + 8).cast("long")).alias("chunks"),
        F.array(one(count=2 * n, delta=F.col("number") % 2 + 30)).alias("stts"),
        F.array(one(first_chunk=1, per_chunk=2, description=1)).alias("stsc"), sync.alias("sync"),
        F.when(F.col("number") % 2 == 0, F.array(one(count=n, offset=0), one(count=n, offset=F.col("number") % 4))).alias("ctts"),
    )


_TRACKS_SQL = """
    WITH v AS (SELECT 's' || l_suppkey AS path, l_orderkey % 20 AS number, l_partkey % 100 AS v, row_number() OVER (PARTITION BY l_suppkey, l_orderkey % 20 ORDER BY l_partkey % 100) AS i FROM lineitem),
    s AS (SELECT path, number, count(*) AS n FROM v GROUP BY ALL),
    sh AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY path ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS shift FROM s),
    anysync AS (SELECT path FROM s GROUP BY path HAVING bool_or(number % 3 = 0)), anyctts AS (SELECT path FROM s GROUP BY path HAVING bool_or(number % 2 = 0))
"""
_RLE_SQL = """
    , f AS (SELECT *, coalesce(lag(x) OVER (PARTITION BY path ORDER BY number, pos) <> x, true)::INT AS begins FROM e WHERE n > 0),
    r AS (SELECT *, sum(begins) OVER (PARTITION BY path ORDER BY number, pos ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM f)
"""


@query(_TRACKS_SQL + ", e AS (SELECT path, number, 0 AS pos, 2 * n AS n, number % 2 + 30 AS x FROM s)" + _RLE_SQL + "SELECT path, run, x AS delta, sum(n)::BIGINT AS count FROM r GROUP BY path, run, x")
def joined_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timelapse.merged_durations(_tracks(spark, sf_dir)).drop("track")


@query(_TRACKS_SQL + """, e AS (
        SELECT path, number, 0 AS pos, n, 0 AS x FROM s JOIN anyctts USING (path) WHERE number % 2 = 0 UNION ALL SELECT path, number, 1, n, number % 4 FROM s WHERE number % 2 = 0
        UNION ALL SELECT path, number, 0, 2 * n, 0 FROM s JOIN anyctts USING (path) WHERE number % 2 = 1)""" + _RLE_SQL + "SELECT path, run, x AS offset, sum(n)::BIGINT AS count FROM r GROUP BY path, run, x")
def joined_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timelapse.merged_composition(_tracks(spark, sf_dir)).drop("track")


@query(_TRACKS_SQL + """
    SELECT path, 2 * shift + k AS sample FROM (SELECT path, number, shift, unnest(generate_series(1, 2 * n)) AS k FROM sh JOIN anysync USING (path)) WHERE number % 3 > 0 OR k % 4 = 1
""")
def joined_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timelapse.merged_sync(_tracks(spark, sf_dir)).drop("track")


@query(_TRACKS_SQL + """,
    e AS (SELECT path, shift + 1 AS first_chunk, CASE WHEN number % 3 = 0 THEN 2 ELSE 1 END AS per_chunk FROM sh UNION ALL SELECT path, shift + 2, number % 4 FROM sh WHERE number % 3 > 0 AND n > 1)
    SELECT path, first_chunk::BIGINT AS first_chunk, per_chunk::BIGINT AS per_chunk FROM (SELECT *, lag(per_chunk) OVER (PARTITION BY path ORDER BY first_chunk) AS before FROM e) WHERE before IS DISTINCT FROM per_chunk
""")
def joined_chunk_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments have two samples a chunk throughout, or one in their first chunk and up to three in the others."""
    one = lambda first, per: F.struct(F.lit(first).cast("long").alias("first_chunk"), F.lit(per).cast("long").alias("per_chunk"), F.lit(1).cast("long").alias("description"))
    later = F.when(F.size("chunks") > 1, F.array(one(1, 1), one(2, F.col("number") % 4))).otherwise(F.array(one(1, 1)))
    tracks = _tracks(spark, sf_dir).withColumn("stsc", F.when(F.col("number") % 3 == 0, F.array(one(1, 2))).otherwise(later))
    return timelapse.merged_chunk_runs(tracks).drop("track", "description")


@query(_TRACKS_SQL + "SELECT path, number, i AS chunk, 2 * i - 1 AS first_sample, 2::BIGINT AS n_samples, 2 * v + 1 AS bytes FROM v")
def chunk_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timelapse.chunk_bytes(_tracks(spark, sf_dir)).drop("track")


def _movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media boxes of the tracks' segments; every eleventh is too small for its chunks."""
    size = F.when(F.col("number") % 11 == 10, 150).otherwise(F.size("chunks") * 200 + 8).cast("long")
    at = F.lit(0).cast("long")
    return _tracks(spark, sf_dir).select(
        "path", "name", "number", F.lit(30).cast("long").alias("movie_timescale"), (F.size("sizes") * 30).cast("long").alias("movie_duration"), at.alias("mdat_start"), size.alias("mdat_size"),
        F.lit(1).cast("long").alias("n_mdat"), F.array(F.struct(at.alias("start"), size.alias("size"))).alias("mdats"), F.lit(None).cast("string").alias("error"),
    )


_BASE_SQL = """, m AS (SELECT *, CASE WHEN number % 11 = 10 THEN 150 ELSE n * 200 + 8 END AS box FROM sh),
    base AS (SELECT *, coalesce(sum(box) OVER (PARTITION BY path ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 8 AS base FROM m)
"""


@query(_TRACKS_SQL + _BASE_SQL + "SELECT path, shift + i AS chunk, (i - 1) * 200 + 8 - 8 + base AS offset, true AS fits FROM v JOIN base USING (path, number)")
def joined_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timelapse.merged_offsets(_tracks(spark, sf_dir), _movies(spark, sf_dir)).drop("track")


@query(_TRACKS_SQL + _BASE_SQL + """
    , o AS (SELECT path, count(*) AS n_chunks, max((i - 1) * 200 + base) AS last FROM v JOIN base USING (path, number) GROUP BY path)
    SELECT path, n_chunks, 4294900000 + n_chunks * CASE WHEN last + 4294900000 + 4 * n_chunks >= 4294967296 THEN 8 ELSE 4 END AS header, last + 4294900000 + 4 * n_chunks >= 4294967296 AS wide FROM o
""")
def offset_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose tables begin just below 4 GiB: some need the wide form of offsets."""
    return timelapse.offset_form(_tracks(spark, sf_dir), _movies(spark, sf_dir), header=4_294_900_000)


@query(_TRACKS_SQL + """
    SELECT path, 2 * sum(n)::BIGINT AS n_samples, CASE WHEN substr(path, 2)::INT % 3 = 0 THEN 5 ELSE 0 END::BIGINT AS uniform FROM s GROUP BY path
""")
def joined_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third archive has samples of one size only."""
    same = F.substr("path", F.lit(2)).cast("int") % 3 == 0
    tracks = _tracks(spark, sf_dir).withColumn("sizes", F.when(same, F.transform("sizes", lambda _: F.lit(5).cast("long"))).otherwise(F.col("sizes")))
    return timelapse.merged_sizes(tracks).select("path", F.col("n_samples").cast("long").alias("n_samples"), F.col("uniform").cast("long").alias("uniform"))


@query(_TRACKS_SQL + "SELECT path, number, 2 * n * (number % 2 + 30) AS duration FROM s")
def total_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tracks(spark, sf_dir).select("path", "number", timelapse.total_duration(F.col("stts")).alias("duration"))


_SAMPLES_SQL = """
    WITH s AS (SELECT l_suppkey % 3 AS k, row_number() OVER (PARTITION BY l_suppkey % 3 ORDER BY l_orderkey, l_linenumber, l_partkey) AS pos, l_partkey AS size FROM lineitem),
    t AS (SELECT k, count(*) AS n FROM s GROUP BY k),
    r AS (SELECT k, n, 1 + 40 * n_nationkey AS lo, n_nationkey % 5 + 1 + k AS per, coalesce(lead(40 * n_nationkey) OVER (PARTITION BY k ORDER BY n_nationkey), 961 + n // 6) AS hi FROM t, nation),
    f AS (SELECT *, coalesce(sum((hi - lo + 1) * per) OVER (PARTITION BY k ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r),
    c AS (SELECT k, n, per, chunk, (before + (chunk - lo) * per)::BIGINT AS skipped FROM (SELECT *, unnest(generate_series(lo, hi)) AS chunk FROM f)),
    p AS (SELECT k, pos, sum(size) OVER (PARTITION BY k ORDER BY pos) AS reached FROM s)
"""


@query(_SAMPLES_SQL + """
    SELECT c.k, chunk, skipped + 1 AS first_sample, per AS n_samples, CASE WHEN c.k = 2 THEN 7 * greatest(0, least(skipped + per, n) - skipped) ELSE coalesce(b.reached, 0) - coalesce(a.reached, 0) END::BIGINT AS bytes
    FROM c LEFT JOIN p a ON a.k = c.k AND a.pos = least(skipped, n) LEFT JOIN p b ON b.k = c.k AND b.pos = least(skipped + per, n)
""")
def sample_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the chunks of three tracks with a third of the lines each as samples, from blocks of sizes; the last track has one size."""
    from atelier.operators.stretches import Stretches
    from atelier.sources import samples

    lines = table(spark, sf_dir, "lineitem").select(F.pmod("l_suppkey", F.lit(3)).alias("k"), "l_orderkey", "l_linenumber", "l_partkey")
    cut = Stretches(lines, ["k"], ["l_orderkey", "l_linenumber", "l_partkey"])
    placed = cut.before(cut.rows, F.lit(1), "pos").select("k", (F.coalesce("pos", F.lit(0)) + 1).alias("pos"), "l_partkey")
    heads = lines.groupBy("k").agg(F.count(F.lit(1)).alias("n_samples"), F.first(F.when(F.col("k") == 2, 7).otherwise(0)).alias("uniform"))
    nation = table(spark, sf_dir, "nation").select((F.lit(1) + 40 * F.col("n_nationkey")).alias("first_chunk"), (F.col("n_nationkey") % 5 + 1).alias("per"))
    runs = heads.join(F.broadcast(nation)).select("k", "first_chunk", (F.col("per") + F.col("k")).alias("per_chunk"))  # 25 rows
    ends = heads.select("k", (F.lit(961) + F.floor(F.col("n_samples") / 6)).cast("long").alias("n_chunks"))
    return samples.chunk_bytes(samples.chunks(runs, ends, ["k"]), heads, samples.blocked(placed.where("k < 2"), ["k"], "pos", "l_partkey"), ["k"])


_LAYOUT_SQL = """, sized AS (SELECT *, CASE WHEN substr(path, 2)::INT % 2 = 0 THEN number % 5 * 134217728 WHEN number = 13 AND substr(path, 2)::INT % 3 = 0 THEN 4294967290 ELSE 0 END + n * 200 AS bytes FROM sh),
    heads AS (SELECT *, CASE WHEN bytes + 8 >= 4294967296 THEN 16 ELSE 8 END AS head FROM sized),
    places AS (SELECT *, (coalesce(sum(bytes + head) OVER (PARTITION BY path ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + head)::BIGINT AS base FROM heads),
    behind AS (SELECT v.path, p.shift + v.i AS chunk, (v.i - 1) * 200 + p.base AS spot FROM v JOIN places p USING (path, number)),
    last AS (SELECT path, max(spot) AS last FROM behind GROUP BY path),
    d AS (SELECT path, sum(CASE WHEN number = first_value THEN 0 ELSE 1 END)::BIGINT AS n FROM (SELECT path, number % 2 AS number, lag(number % 2, 1, 9) OVER (PARTITION BY path ORDER BY number) AS first_value FROM s) GROUP BY path),
    co AS (SELECT path, number, 0 AS pos, n, 0 AS x FROM s WHERE number % 2 = 0 UNION ALL SELECT path, number, 1, n, number % 4 FROM s WHERE number % 2 = 0 UNION ALL SELECT path, number, 0, 2 * n, 0 FROM s WHERE number % 2 = 1),
    cr AS (SELECT path, count(*) FILTER (begins) AS n FROM (SELECT path, coalesce(lag(x) OVER (PARTITION BY path ORDER BY number, pos) <> x, true) AS begins FROM co JOIN anyctts USING (path)) GROUP BY path),
    sy AS (SELECT path, sum(CASE WHEN number % 3 = 0 THEN (2 * n + 3) // 4 ELSE 2 * n END)::BIGINT AS n FROM s JOIN anysync USING (path) GROUP BY path),
    form AS (
        SELECT s.path, sum(s.n)::BIGINT AS n_chunks, sum(2 * s.n * CASE WHEN s.number = 7 THEN 1000000000 ELSE 1 END) AS time, sum(bytes)::BIGINT AS media_bytes FROM s JOIN sized USING (path, number) GROUP BY s.path),
    h AS (
        SELECT f.*, 24 + 8 + CASE WHEN time >= 4294967296 THEN 120 + 104 + 44 ELSE 108 + 92 + 32 END + 32 + 45 + 36 + 20 + 108 + 16 + 8 * d.n + 28
               + CASE WHEN sy.n IS NULL THEN 0 ELSE 16 + 4 * sy.n END + CASE WHEN cr.n IS NULL THEN 0 ELSE 16 + 8 * cr.n END + 20 + 4 * 2 * n_chunks + 16 AS fixed, l.last
        FROM form f JOIN d USING (path) LEFT JOIN sy USING (path) LEFT JOIN cr USING (path) JOIN last l USING (path)),
    decided AS (SELECT path, n_chunks, media_bytes, fixed + 4 * n_chunks + last >= 4294967296 AS wide, fixed + n_chunks * CASE WHEN fixed + 4 * n_chunks + last >= 4294967296 THEN 8 ELSE 4 END AS header FROM h)
"""


def _layout(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Segments with media of up to half a GiB, one of over 4 or little, as their archive has it; the seventh lasts so long that headers need their long form."""
    from atelier.plans import layout

    long = F.when(F.col("number") == 7, 1_000_000_000).otherwise(1).cast("long")
    tracks = _tracks(spark, sf_dir).withColumns({"description": F.lit("00" * 100), "media_duration": F.size("sizes") * long, "track_duration": F.size("sizes") * long, "config_box": F.lit("avcC"), "references": F.lit(1)})
    supplier = F.substr("path", F.lit(2)).cast("int")
    media = F.when(supplier % 2 == 0, F.col("number") % 5 * F.lit(1 << 27).cast("long")).when((F.col("number") == 13) & (supplier % 3 == 0), (1 << 32) - 6).otherwise(0)
    size = media + F.size("chunks") * 200 + 8
    movies = tracks.select("path", "number", F.lit(0).cast("long").alias("mdat_start"), size.cast("long").alias("mdat_size"), F.lit(8).alias("mdat_head"), F.col("media_duration").alias("movie_duration"))
    return layout.joined_layout(tracks, movies)


@query(_TRACKS_SQL + _LAYOUT_SQL + "SELECT path, n_chunks, header::BIGINT AS header, wide, media_bytes FROM decided")
def file_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    form, _ = _layout(spark, sf_dir)
    return form.select("path", "n_chunks", F.col("header").cast("long").alias("header"), "wide", "media_bytes")


@query(_TRACKS_SQL + _LAYOUT_SQL + "SELECT path, b.chunk, (header + b.spot)::BIGINT AS offset FROM behind b JOIN decided USING (path)")
def file_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layout(spark, sf_dir)[1].drop("track")


_CHECK_SQL = """, sums AS (SELECT path, number, sum(2 * v + 1) AS bytes FROM v GROUP BY ALL), bad AS (
        SELECT path, number, n, CASE WHEN n > 1 THEN 'track 1 (avc1): chunk offset 208 outside mdat [8,150)' WHEN bytes > 142 THEN 'track 1 (avc1): sample data larger than mdat' END AS problem
        FROM s JOIN sums USING (path, number) WHERE number % 11 = 10)
"""


@query(_TRACKS_SQL + _CHECK_SQL + "SELECT path, 'segment-' || number AS name, problem FROM bad WHERE problem IS NOT NULL")
def segment_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.segment_problems(_tracks(spark, sf_dir), _movies(spark, sf_dir), to_convert=True)


@query(_TRACKS_SQL + _CHECK_SQL + """
    SELECT path, count(*) - count(problem) AS n_good, count(problem) AS n_failed, sum(2 * s.n) FILTER (problem IS NULL)::DOUBLE AS seconds, arg_min(problem, number) FILTER (problem IS NOT NULL) AS first_problem
    FROM s LEFT JOIN bad USING (path, number) GROUP BY path
""")
def verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.verify(_tracks(spark, sf_dir), _movies(spark, sf_dir))


def _reported(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Archives of which a quarter have a segment for each rule that is broken, and another quarter one that can't be joined."""
    supplier, n = F.substr("path", F.lit(2)).cast("int"), F.col("number")
    broken = lambda k: (supplier % 4 == 1) & (n == k)
    one = lambda first, per: F.array(F.struct(F.lit(first).cast("long").alias("first_chunk"), F.lit(per).cast("long").alias("per_chunk"), F.lit(1).cast("long").alias("description")))
    none = F.lit(None)
    change = {
        "handler": {1: F.lit("text")}, "timescale": {2: F.lit(0)}, "track_id": {3: F.lit(0)}, "sizes": {4: none}, "stsc": {5: F.slice("stsc", 1, 0), 6: one(2, 2), 7: one(1, 0), 8: one(1, 3)},
        "stts": {9: F.transform("stts", lambda e: F.struct((e["count"] + 1).alias("count"), e["delta"].alias("delta")))}, "sync": {10: F.array(F.lit(1).cast("long"), F.lit(1).cast("long"))}, "chunks": {11: F.reverse("chunks")},
    }
    rows = _tracks(spark, sf_dir)
    own = {}
    for c, cases in change.items():
        own[c] = F.col(c)
        for k, v in cases.items():
            own[c] = F.when(broken(k), v).otherwise(own[c])
    shown = {"width": F.lit(320), "height": F.lit(240), "rate": none.cast("int"), "channels": none.cast("int"), "matrix": F.lit("m"), "config_box": F.lit("avcC"), "chroma": F.lit(1), "config_key": F.when((supplier % 4 == 2) & (n == 5), "b").otherwise("a")}
    tracks = rows.withColumns(own | shown)
    at, size = F.lit(0).cast("long"), (F.size("chunks") * 200 + 8).cast("long")
    box = lambda start: F.struct(start.cast("long").alias("start"), size.alias("size"))
    movies = rows.select(
        "path", "name", "number", F.when(broken(13), 0).otherwise(30).cast("long").alias("movie_timescale"), (F.size("sizes") * 30).cast("long").alias("movie_duration"), at.alias("mdat_start"), size.alias("mdat_size"),
        F.when(broken(14), 0).otherwise(1).cast("long").alias("n_mdat"), F.when(broken(16), F.array(box(at), box(at + 4))).otherwise(F.array(box(at))).alias("mdats"), F.when(broken(15), "no moov box").alias("error"),
    )
    return tracks, movies, rows.select("path", F.concat("path", F.lit(".procreate")).alias("label")).distinct()


_REPORT_SQL = """, judged AS (
        SELECT path, number, n, 'segment-' || number AS name, CASE WHEN substr(path, 2)::INT % 4 = 1 THEN CASE number
            WHEN 1 THEN 'track 1 (avc1): handler "text"' WHEN 2 THEN 'track 1 (avc1): mdhd timescale is zero' WHEN 3 THEN 'track 1 (avc1): tkhd track id is zero' WHEN 4 THEN 'track 1 (avc1): truncated sample tables'
            WHEN 5 THEN 'track 1 (avc1): no chunk structure (stsc)' WHEN 6 THEN 'track 1 (avc1): stsc does not start at chunk 1' WHEN 7 THEN 'track 1 (avc1): stsc entry with zero samples'
            WHEN 8 THEN 'track 1 (avc1): stsc covers ' || 3 * n || ' samples, stsz has ' || 2 * n WHEN 9 THEN 'track 1 (avc1): stts covers ' || 2 * n + 1 || ' samples, stsz has ' || 2 * n
            WHEN 10 THEN 'track 1 (avc1): bad sync sample table' WHEN 11 THEN CASE WHEN n > 1 THEN 'track 1 (avc1): chunk offsets not ascending' END WHEN 13 THEN 'mvhd timescale is zero'
            WHEN 14 THEN 'no media data (mdat)' WHEN 15 THEN 'no moov box' WHEN 16 THEN 'overlapping mdat boxes' END END AS problem FROM s),
    first AS (SELECT path, min(number) AS lowest, max(number) AS widest, count(*) AS n_all, count(problem) AS n_failed, 2.0::DOUBLE * sum(n) FILTER (problem IS NULL) AS seconds, bool_or(number = 5) AS has5 FROM judged GROUP BY path),
    odd AS (SELECT path, CASE WHEN n_failed = 0 AND substr(path, 2)::INT % 4 = 2 AND has5 AND n_all > 1 THEN CASE WHEN lowest = 5 THEN 'others' ELSE '5: field "avcC" differs' END END AS incompatible FROM first)
"""


@query(_TRACKS_SQL + _REPORT_SQL + """
    SELECT path, 0 AS section, 0::BIGINT AS number, 'input: ' || path || '.procreate' AS line FROM first
    UNION ALL SELECT path, 0, 1, 'segments: ' || n_all FROM first UNION ALL SELECT path, 0, 2, '' FROM first
    UNION ALL SELECT path, 1, number, rpad(number::VARCHAR, length(widest::VARCHAR)::INT, ' ') || CASE WHEN problem IS NULL THEN ' ok    video h264 320x240 yuv420p  ' || 2 * n || '.00s  ' || name ELSE ' FAIL  ' || problem END FROM judged JOIN first USING (path)
    UNION ALL SELECT path, 2, 0, '' FROM first JOIN odd USING (path) WHERE n_failed = 0 AND incompatible IS NULL
    UNION ALL SELECT path, 2, 1, 'verify: ok, ' || n_all || ' segment(s), ~' || seconds::BIGINT || '.0 s of video' FROM first JOIN odd USING (path) WHERE n_failed = 0 AND incompatible IS NULL
""")
def verify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.verify_report(*_reported(spark, sf_dir))


@query(_TRACKS_SQL + _REPORT_SQL + """
    SELECT path, n_all - n_failed AS n_good, n_failed, seconds, incompatible, CASE WHEN n_failed > 0 OR incompatible IS NOT NULL THEN 5 ELSE 0 END AS code FROM first JOIN odd USING (path)
""")
def verify_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks, movies, _ = _reported(spark, sf_dir)
    return checks.verified(tracks, movies).drop("first_problem")


@query(_TRACKS_SQL + """
    , w AS (SELECT path, count(*) AS n_all, max(number) AS widest FROM s GROUP BY path)
    SELECT path, 0 AS section, 0::BIGINT AS number, 'input: ' || path || '.procreate' AS line FROM w
    UNION ALL SELECT path, 0, 1, 'segments: ' || n_all FROM w UNION ALL SELECT path, 0, 2, '' FROM w
    UNION ALL SELECT path, 1, number, rpad(number::VARCHAR, length(widest::VARCHAR)::INT, ' ') || ' segment-' || number FROM s JOIN w USING (path)
""")
def listing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, movies, archives = _reported(spark, sf_dir)
    return checks.listing_report(movies.select("path", "name", "number"), archives)


@query("""
    SELECT user_id, arg_max(event_id, (r, -event_id)) AS event_id FROM (SELECT user_id, event_id, CASE WHEN event_id % 3 > 0 THEN event_id % 17 ELSE -1 END AS r FROM events) GROUP BY user_id
""")
def joined_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the rows with the most reference frames, or the first of all."""
    tracks = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("path"), F.lit(0).alias("track"), F.col("event_id").alias("number"), F.lit("").alias("description"), F.lit("avcC").alias("config_box"),
        F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 17).alias("references"),
    )
    return timelapse.joined_description(tracks).select(F.col("path").alias("user_id"), F.col("number").alias("event_id"))


_FIELD_SQL = ["handler", "codec fourcc", "width", "height", "sample rate", "channels", "timescale", "avcC", "color matrix", "mvhd timescale"]


@query(f"""
    WITH c AS (SELECT conv_id, turn, CASE WHEN length(text) % 23 = 0 THEN 2 ELSE 1 END AS streams,
                      [role, (length(text) % 29 = 0)::VARCHAR, {", ".join(f"(length(text) % {k} = 0)::VARCHAR" for k in (5, 7, 11, 13, 17))}, (length(text) % 3)::VARCHAR, (length(text) % 19 = 0)::VARCHAR, (turn % 4 = 3)::VARCHAR] AS v FROM conversations),
    f AS (SELECT conv_id, arg_min(v, turn) AS v0, arg_min(streams, turn) AS streams0 FROM c GROUP BY conv_id),
    m AS (SELECT conv_id, arg_min(v, turn) AS vm FROM c JOIN f USING (conv_id) WHERE streams = streams0 GROUP BY conv_id),
    d AS (SELECT conv_id, turn, CASE WHEN streams <> streams0 THEN ['stream count'] ELSE list_filter(list_transform(range(1, 11), lambda i: CASE WHEN v[i] <> v0[i] THEN {_FIELD_SQL}[i] END), lambda x: x IS NOT NULL) END AS fields
          FROM c JOIN f USING (conv_id) JOIN m USING (conv_id))
    SELECT conv_id, turn, CASE len(fields) WHEN 1 THEN 'field "' || fields[1] || '" differs' ELSE 'fields "' || array_to_string(fields, '", "') || '" differ' END AS problem FROM d WHERE len(fields) > 0
""")
def compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as segments of one or two tracks: the role is the handler, the length of the text decides all other fields."""
    n, has = F.length("text"), lambda k: (F.length("text") % k == 0).cast("int")
    fields = {"fourcc": F.when(n % 29 == 0, "avc3").otherwise("avc1"), "width": has(5), "height": has(7), "rate": has(11), "channels": has(13), "timescale": has(17), "config_key": n % 3, "matrix": has(19)}
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("path"), F.col("turn").alias("number"), F.col("role").alias("handler"), F.lit("avcC").alias("config_box"), F.when(n % 23 == 0, 2).otherwise(1).alias("streams"), *[v.alias(c) for c, v in fields.items()]
    )
    tracks = turns.withColumn("track", F.explode(F.sequence(F.lit(0), F.col("streams") - 1)))
    movies = turns.select("path", "number", (F.col("number") % 4 == 3).cast("int").alias("movie_timescale"))
    return timelapse.compatibility(tracks, movies).select(F.col("path").alias("conv_id"), F.col("number").alias("turn"), "problem")


@query("SELECT user_id, bool_or(event_type = 'click') AS has_video FROM events GROUP BY user_id")
def has_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "click", "vide").otherwise("soun").alias("handler"))
    return aggregates.has_video(kinds, ["user_id"])


@query(_MEMBERS_SQL + """
    , c AS (SELECT path, CASE WHEN any_value(clash) IS NOT NULL THEN 5 WHEN count(*) FILTER (kind IN ('a', 'b')) > 0 THEN 0 ELSE 4 END AS code
            FROM k LEFT JOIN clash USING (path) GROUP BY path)
    SELECT count(*) FILTER (code = 0) AS fine, count(*) FILTER (code = 4) AS no_video, count(*) FILTER (code = 5) AS failed, CASE WHEN count(*) FILTER (code = 5) > 0 THEN 1 ELSE 0 END AS exit_code FROM c
""")
def diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.diagnosed(timelapse.listing(_members(spark, sf_dir), to_convert=False))


@query(_MEMBERS_SQL + "SELECT path, bool_or(kind IN ('a', 'b')) AS has_timelapse FROM k GROUP BY path")
def has_timelapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.has_timelapse(_members(spark, sf_dir), timelapse.SEGMENT)


@query(_MEMBERS_SQL + "SELECT path, count(*) AS n_ignored FROM k WHERE kind = 'c' GROUP BY path")
def ignored_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timelapse.classified(_members(spark, sf_dir)).where("ignored").groupBy("path").agg(F.count(F.lit(1)).alias("n_ignored"))


@query("""
    SELECT p_brand AS path, 'u/' || p_size || '~1.' || ['chunk', 'lz4', 'lz4c'][min(p_partkey % 3 + 1)::INT] AS name, p_size AS row, 1 AS col FROM part GROUP BY p_brand, p_size
""")
def tile_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tiles of three kinds, of which the preferred one is taken."""
    kind = _pick(["chunk", "lz4", "lz4c"], F.col("p_partkey"))
    named = _parts(spark, sf_dir).select(F.col("p_brand").alias("path"), F.concat(F.lit("u/"), "p_size", F.lit("~1."), kind).alias("name"))
    return layers.tile_members(named).select("path", "name", "row", "col")


@query("""
    WITH f AS (SELECT l_orderkey, bit_xor(hash_x) AS x FROM (SELECT l_orderkey, (l_partkey * 2654435761) % 4294967296 AS hash_x FROM lineitem) GROUP BY l_orderkey)
    SELECT l_orderkey, x AS number, CASE WHEN x >= 2147483648 THEN x - 4294967296 ELSE x END AS signed FROM f
""")
def big_endian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written as four bytes and read again, unsigned and signed."""
    mixed = table(spark, sf_dir, "lineitem").select("l_orderkey", F.pmod(F.col("l_partkey") * F.lit(2654435761), F.lit(1 << 32)).alias("x")).groupBy("l_orderkey").agg(F.bit_xor("x").alias("x"))
    raw = mixed.select("l_orderkey", F.unhex(F.lpad(F.hex("x"), 8, "0")).alias("raw"))
    return raw.select("l_orderkey", binary.unsigned_be(F.col("raw"), 0, 4).alias("number"), binary.signed_be(F.col("raw"), 0).alias("signed"))


@query("SELECT p_partkey, regexp_full_match(f, '[ -~]{4}') AS is_fourcc FROM (SELECT p_partkey, substr(p_name, 1, (p_partkey % 3 + 3)::INT) AS f FROM part)")
def fourcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.expr("substr(p_name, 1, cast(p_partkey % 3 + 3 as int))")
    return _parts(spark, sf_dir).select("p_partkey", binary.is_fourcc(code).alias("is_fourcc"))


@query("SELECT DISTINCT l_discount AS v, floor(least(1, l_discount * 11) * 255 + 0.5)::INT AS byte FROM lineitem")
def colour_byte(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("v")).distinct().select("v", pixels.to_byte(F.col("v") * 11).alias("byte"))


@query("""
    WITH whole AS (SELECT p_brand, string_agg(p_name, '' ORDER BY p_partkey) AS text FROM part GROUP BY p_brand)
    SELECT p_brand, octet_length(encode(text)) AS n_bytes, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(text, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
               lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) AS crc FROM whole
""")
def joined_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checksum of each brand's names laid end to end, from the names' own checksums and the bytes behind them."""
    from atelier.functions import checksums
    from atelier.operators import sequences

    names = _parts(spark, sf_dir).select("p_brand", (-F.col("p_partkey")).alias("back"), F.octet_length("p_name").cast("long").alias("n"), F.crc32("p_name").alias("crc"))
    placed = sequences.prefix_sum(names, ["p_brand"], "back", "n", out="after")
    return placed.groupBy("p_brand").agg(F.sum("n").alias("n_bytes"), checksums.joined_crc(F.col("crc"), F.col("after")).alias("crc"))


@query("SELECT c_custkey, c_custkey / (c_custkey % 600 + 1) AS seconds FROM customer")
def seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A movie's duration over its time scale."""
    key = F.col("c_custkey")
    one = table(spark, sf_dir, "customer").select(key.alias("path"), F.lit(1).alias("number"), key.alias("movie_duration"), (key % 600 + 1).alias("movie_timescale"))
    return timelapse.durations(one).select(F.col("path").alias("c_custkey"), "seconds")
