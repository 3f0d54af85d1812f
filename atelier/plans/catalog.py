"""Queries over the driver tables, one or more for each operator, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atelier.functions import pixels, text
from atelier.operators import aggregates, compare, gaps, names, sequences, trees
from atelier.session import table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Those of this module and of the one on media, which registers its own when it is imported."""
    from atelier.plans import media_catalog  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", F.pmod("event_id", F.lit(50)).alias("number"))


@query("""
    WITH n AS (SELECT DISTINCT user_id, event_id % 50 AS number FROM events),
    g AS (SELECT user_id, number + 1 AS lo, lead(number) OVER (PARTITION BY user_id ORDER BY number) - 1 AS hi FROM n)
    SELECT user_id, lo, hi FROM g WHERE hi >= lo
""")
def interior_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.gap_ranges(_numbered(spark, sf_dir), ["user_id"], "number")


@query("""
    WITH n AS (SELECT DISTINCT user_id, event_id % 50 AS number FROM events),
    g AS (SELECT user_id, number + 1 AS lo, lead(number) OVER (PARTITION BY user_id ORDER BY number) - 1 AS hi FROM n)
    SELECT user_id, count(*) AS n_gaps,
           string_agg(CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || '-' || hi END, ', ' ORDER BY lo) AS missing
    FROM g WHERE hi >= lo GROUP BY user_id
""")
def gap_ranges_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.ranges_text(gaps.gap_ranges(_numbered(spark, sf_dir), ["user_id"], "number"), ["user_id"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def key_clash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.clashes(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""
    WITH a AS (SELECT *, lag(event_type) OVER w IS DISTINCT FROM event_type AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    b AS (SELECT *, sum(begins::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a)
    SELECT user_id, run::BIGINT AS run, event_type, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM b GROUP BY user_id, run, event_type
""")
def rle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type"])


@query("""
    SELECT user_id, event_id, event_type FROM (
        SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
    WHERE n = 1 OR before IS DISTINCT FROM event_type
""")
def run_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = sequences.changes(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type"])
    return kept.select("user_id", "event_id", "event_type")


@query("""
    SELECT source, doc_id, n_chars,
           coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
    FROM documents
""")
def layout_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return sequences.prefix_sum(docs, ["source"], "doc_id", "n_chars")


@query("""
    WITH runs AS (SELECT l_orderkey AS k, sum(n) AS n FROM (SELECT l_orderkey, 1 AS n FROM lineitem) GROUP BY 1),
    offsets AS (SELECT k, n, coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM runs)
    SELECT max(CASE WHEN start + n > 20000 THEN 1 ELSE 0 END)::INT AS is_wide, sum(n)::BIGINT AS total, max(start)::BIGINT AS last_start FROM offsets
""")
def offset_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any offset needs the wide form: both layouts come from one prefix sum."""
    sizes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    laid = sequences.prefix_sum(sizes.withColumn("g", F.lit(0)), ["g"], "k", "n")
    wide = F.max(F.when(F.col("start") + F.col("n") > 20000, 1).otherwise(0))
    return laid.agg(wide.alias("is_wide"), F.sum("n").alias("total"), F.max("start").alias("last_start"))


@query("""
    WITH k AS (SELECT DISTINCT l_returnflag, l_orderkey AS lo FROM lineitem),
    r AS (SELECT l_returnflag, lo, coalesce(lead(lo) OVER (PARTITION BY l_returnflag ORDER BY lo) - 1, (SELECT max(lo) FROM k)) AS hi FROM k)
    SELECT l_returnflag, lo, unnest(generate_series(lo, hi)) AS at FROM r
""")
def run_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_orderkey").alias("lo")).distinct()
    last = keys.agg(F.max("lo").alias("_last"))  # one row
    return sequences.expand_runs(keys.join(F.broadcast(last)), ["l_returnflag"], "lo", "_last").select("l_returnflag", "lo", "at")


@query("""
    WITH f AS (SELECT conv_id, arg_min(role, turn) AS role0, arg_min(length(text), turn) AS n0 FROM conversations GROUP BY conv_id)
    SELECT c.conv_id, c.turn,
           array_to_string(list_filter([CASE WHEN c.role <> f.role0 THEN 'role' END, CASE WHEN length(c.text) <> f.n0 THEN 'n_chars' END], lambda x: x IS NOT NULL), ',') AS differs
    FROM conversations c JOIN f USING (conv_id)
""")
def first_row_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n_chars"))
    out = compare.against_first(turns, ["conv_id"], "turn", ["role", "n_chars"])
    return out.select("conv_id", "turn", F.array_join("differs", ",").alias("differs"))


@query("""
    WITH f AS (SELECT conv_id, arg_min(role, turn) AS role0, arg_min(length(text), turn) AS n0 FROM conversations GROUP BY conv_id),
    d AS (SELECT conv_id, turn, unnest(['n_chars', 'role']) AS field, unnest([length(text) <> n0, role <> role0]) AS differs, unnest([1, 2]) AS pos FROM conversations JOIN f USING (conv_id)),
    o AS (SELECT conv_id, field, min(turn * 10 + pos) AS first_at FROM d WHERE differs GROUP BY ALL),
    g AS (SELECT conv_id, count(*) AS n, string_agg('"' || field || '"', ', ' ORDER BY first_at) AS fields FROM o GROUP BY conv_id)
    SELECT conv_id, CASE WHEN n = 1 THEN 'field ' || fields || ' differs' ELSE 'fields ' || fields || ' differ' END AS problem FROM g
""")
def differ_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields in which a group's rows differ from its first, in the order in which they first do."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n_chars"))
    out = compare.against_first(turns, ["conv_id"], "turn", ["n_chars", "role"])
    return compare.differing_fields(out, ["conv_id"], "turn").select("conv_id", compare.differ_text(F.col("fields")).alias("problem"))


@query("""
    SELECT user_id, event_type, r.event_id AS event_id, r.value AS value FROM (
        SELECT user_id, event_type, arg_max({'event_id': event_id, 'value': value}, (value, event_id)) AS r FROM events GROUP BY ALL)
""")
def argmax_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.best(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("value"), F.col("event_id")], ["event_id", "value"])


@query("""
    WITH p AS (SELECT l_partkey % 60 AS x, l_suppkey % 40 AS y, l_quantity::BIGINT AS v FROM lineitem)
    SELECT ((x + 1) * 16 - 1) // 60 AS cx, ((y + 1) * 16 - 1) // 40 AS cy, count(*) AS n, (sum(v) // count(*))::BIGINT AS mean FROM p GROUP BY ALL
""")
def grid_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return aggregates.cell_mean(lines, F.pmod("l_partkey", F.lit(60)), F.pmod("l_suppkey", F.lit(40)), F.col("l_quantity"), (60, 40), (16, 16))


@query("""
    SELECT l_returnflag, min(l_partkey) AS x0, min(l_suppkey) AS y0, max(l_partkey) + 1 AS x1, max(l_suppkey) + 1 AS y1
    FROM lineitem GROUP BY 1
""")
def bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.bounding_box(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_partkey", "l_suppkey")


@query("""
    SELECT l_returnflag, l_linestatus, count(*) AS valid, count(*) FILTER (l_quantity > 25) AS covered,
           round(count(*) FILTER (l_quantity > 25) / count(*), 4) AS rate
    FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)
""")
def coverage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.coverage(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_quantity") > 25)


@query("""
    SELECT page_id, regexp_replace(regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '^.*/', ''), '(?i)(.)\\.html$', '\\1') AS stem FROM pages
""")
def stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.substring_index(F.substring_index("url", "?", 1), "#", 1)
    return table(spark, sf_dir, "pages").select("page_id", names.stem(path, ".html").alias("stem"))


@query("""
    SELECT p_partkey, CASE WHEN r = 1 THEN p_name ELSE p_name || '-' || r END AS name FROM (
        SELECT p_partkey, p_name, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS r FROM part)
""")
def greedy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return names.collision_names(parts, F.lit(""), F.col("p_name"), "p_partkey").select("p_partkey", "name")


@query("""
    WITH RECURSIVE given AS (
        SELECT p_brand AS folder, p_partkey, lower(split_part(p_name, ' ', 1)) || CASE p_size % 4 WHEN 0 THEN '-' || (p_size % 9 + 1) WHEN 1 THEN '-2' ELSE '' END AS base,
               row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part),
    steps AS (
        SELECT DISTINCT folder, 0::BIGINT AS k, NULL::BIGINT AS p_partkey, NULL::VARCHAR AS name, []::VARCHAR[] AS used FROM given
        UNION ALL
        SELECT folder, k, p_partkey, name, list_append(used, name) FROM (
            SELECT s.folder, g.k, g.p_partkey, s.used, CASE WHEN NOT list_contains(s.used, g.base) THEN g.base
                   ELSE g.base || '-' || list_filter(range(2, len(s.used) + 3), lambda n: NOT list_contains(s.used, g.base || '-' || n))[1] END AS name
            FROM steps s JOIN given g ON g.folder = s.folder AND g.k = s.k + 1))
    SELECT folder, p_partkey, name FROM steps WHERE k > 0
""")
def mixed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files of the brands' folders, some of which are called what the numbering of others would call them."""
    end = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("-"), F.col("p_size") % 9 + 1)).when(F.col("p_size") % 4 == 1, "-2").otherwise("")
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("folder"), "p_partkey", F.concat(F.lower(F.substring_index("p_name", " ", 1)), end).alias("base"))
    return names.collision_names(parts, F.col("folder"), F.col("base"), "p_partkey").select("folder", "p_partkey", "name")


@query("""
    SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B'
        WHEN n < 1048576 AND n / 1024 < 100 THEN printf('%.1f KiB', n / 1024)
        WHEN n < 1048576 THEN (n // 1024) || ' KiB'
        WHEN n / 1048576 < 100 THEN printf('%.1f MiB', n / 1048576)
        ELSE (n // 1048576) || ' MiB' END AS size
    FROM (SELECT doc_id, n_chars * 37 AS n FROM documents)
""")
def human_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.human_bytes(F.col("n_chars") * 37).alias("size"))


@query("""
    WITH keys(i, k) AS (VALUES (0, 'norm'), (1, 'mul '), (2, 'scrn'), (3, 'lddg'), (4, 'lite'), (5, 'smud'), (6, 'diff'), (7, 'fsub'),
        (8, 'lbrn'), (9, 'div '), (10, 'idiv'), (11, 'over'), (12, 'hLit'), (13, 'vLit'), (14, 'lLit'), (15, 'pLit'),
        (16, 'lgCl'), (17, 'dkCl'), (18, 'sLit'), (19, 'hue '), (20, 'sat '), (21, 'colr'), (22, 'lum '), (23, 'dark'))
    SELECT p_partkey, coalesce(k, 'norm') AS blend, k IS NOT NULL AS known FROM part LEFT JOIN keys ON p_size = i
""")
def blend_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, known = pixels.blend_key(F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", key.alias("blend"), known.alias("known"))


@query("""
    WITH p AS (SELECT DISTINCT l_partkey % 256 AS v, l_suppkey % 256 AS a FROM lineitem)
    SELECT v, a, CASE WHEN a IN (0, 255) THEN v ELSE least(255, (v * 255 + a // 2) // a) END::INT AS straight FROM p
""")
def straight_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    pairs = lines.select(F.pmod("l_partkey", F.lit(256)).alias("v"), F.pmod("l_suppkey", F.lit(256)).alias("a")).distinct()
    return pairs.select("v", "a", pixels.straight(F.col("v"), F.col("a")).cast("int").alias("straight"))


@query("""
    WITH p AS (SELECT DISTINCT l_partkey % 100 AS x, l_suppkey % 140 AS y, l_linenumber % 5 AS o, l_linenumber % 2 = 1 AS f FROM lineitem),
    t AS (SELECT *, CASE o WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS q FROM p),
    r AS (SELECT *, CASE q WHEN 1 THEN 139 - y WHEN 2 THEN 99 - x WHEN 3 THEN y ELSE x END AS nx,
                 CASE q WHEN 1 THEN x WHEN 2 THEN 139 - y WHEN 3 THEN 99 - x ELSE y END AS ny, CASE WHEN q % 2 = 1 THEN 140 ELSE 100 END AS dw FROM t)
    SELECT x, y, o, f, CASE WHEN f THEN dw - 1 - nx ELSE nx END::BIGINT AS shown_x, ny::BIGINT AS shown_y, x AS back_x, y AS back_y FROM r
""")
def orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    points = table(spark, sf_dir, "lineitem").select(
        F.pmod("l_partkey", F.lit(100)).alias("x"), F.pmod("l_suppkey", F.lit(140)).alias("y"), (line % 5).alias("o"), (line % 2 == 1).alias("f")
    ).distinct()
    size, how = (F.lit(100), F.lit(140)), (F.col("o"), F.col("f"), F.lit(False))
    sx, sy = pixels.to_display(F.col("x"), F.col("y"), *size, *how)
    shown = points.withColumn("shown_x", sx.cast("long")).withColumn("shown_y", sy.cast("long"))
    bx, by = pixels.to_canvas(F.col("shown_x"), F.col("shown_y"), *size, *how)
    return shown.withColumn("back_x", bx.cast("long")).withColumn("back_y", by.cast("long"))


@query("""
    WITH d AS (SELECT doc_id % 400 AS g, doc_id FROM documents),
    m AS (SELECT g, count(*) AS n_wanted, count(l.doc_id) AS n_done FROM d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY g)
    SELECT *, CASE WHEN n_done = 0 THEN 'none' WHEN n_done = n_wanted THEN 'all' ELSE 'some' END AS state FROM m
""")
def presence_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "documents").select(F.pmod("doc_id", F.lit(400)).alias("g"), "doc_id")
    return compare.presence(wanted, table(spark, sf_dir, "labels"), ["g"], "doc_id")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.missing_from(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("""
    SELECT doc_id, 'new' AS origin FROM labels
    UNION ALL SELECT doc_id, 'old' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def union_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "labels").select("doc_id", F.lit("new").alias("origin"))
    old = table(spark, sf_dir, "documents").select("doc_id", F.lit("old").alias("origin"))
    return compare.override(new, old, ["doc_id"])


@query("SELECT doc_id FROM documents UNION SELECT doc_id FROM labels")
def done_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").union(table(spark, sf_dir, "labels").select("doc_id")).distinct()


@query("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE NOT regexp_full_match(l_returnflag || l_linestatus, '(?i)(a|r)f')")
def except_slim(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where(~F.concat("l_returnflag", "l_linestatus").rlike(r"(?iu)\A(a|r)f\z"))
    return lines.select("l_orderkey", "l_linenumber", "l_shipdate")


@query("""
    SELECT user_id, list_reduce(list_prepend(0, list(event_id % 97 ORDER BY event_id)), lambda s, v: (s * 7 + v) % 1000)::BIGINT AS folded
    FROM events GROUP BY user_id
""")
def ordered_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("v", F.pmod("event_id", F.lit(97)))
    return sequences.fold(events, ["user_id"], "event_id", "v", F.lit(0), lambda s, v: (s * 7 + v) % 1000, states=1000)


@query("""
    SELECT user_id, list_reduce(list_prepend(255, list((event_id % 256) * 1000 + event_id % 200 ORDER BY event_id)),
               lambda s, v: ((v // 1000) * (v % 1000) + s * (255 - v % 1000) + 127) // 255)::INT AS shade
    FROM events GROUP BY user_id
""")
def composite_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers over a white ground, bottom first, rounded to 8 bits after each."""
    layers = table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.struct(F.pmod("event_id", F.lit(256)).alias("c"), F.pmod("event_id", F.lit(200)).alias("a")).alias("v")
    )
    return sequences.fold(layers, ["user_id"], "event_id", "v", F.lit(255), lambda s, v: pixels.over(s, v["c"], v["a"]), states=256, out="shade").withColumn("shade", F.col("shade").cast("int"))


@query("""
    SELECT user_id, event_id FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE value <= before
""")
def not_increasing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.not_increasing(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], "value").select("user_id", "event_id")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and suppliers as one tree of folders and leaves."""
    id_ = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    ord_ = lambda c: F.col(c).cast("int").alias("ord")
    tree, none = F.lit(0).alias("tree"), F.lit(None).cast("string").alias("parent")
    region = table(spark, sf_dir, "region").select(tree, id_("r", "r_regionkey").alias("id"), none, ord_("r_regionkey"), F.lit(True).alias("is_folder"))
    nation = table(spark, sf_dir, "nation").select(tree, id_("n", "n_nationkey").alias("id"), id_("r", "n_regionkey").alias("parent"), ord_("n_nationkey"), F.lit(True).alias("is_folder"))
    leaf = table(spark, sf_dir, "supplier").select(tree, id_("s", "s_suppkey").alias("id"), id_("n", "s_nationkey").alias("parent"), ord_("s_suppkey"), F.lit(False).alias("is_folder"))
    return region.union(nation).union(leaf)


_PLACES_SQL = """
    WITH RECURSIVE t AS (
        SELECT 'r' || r_regionkey AS id, NULL AS parent, r_regionkey::INT AS ord, true AS is_folder FROM region
        UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey::INT, true FROM nation
        UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_suppkey::INT, false FROM supplier),
    walk AS (
        SELECT id, is_folder, 0 AS depth, [-ord] AS path FROM t WHERE parent IS NULL
        UNION ALL SELECT t.id, t.is_folder, w.depth + 1, list_append(w.path, -t.ord) FROM walk w JOIN t ON t.parent = w.id WHERE w.depth < 31)
"""


@query(_PLACES_SQL + "SELECT id, depth, array_to_string(path, '/') AS path FROM walk")
def tree_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = trees.flatten(_places(spark, sf_dir))
    return flat.select("id", "depth", F.array_join(F.transform("path", lambda p: p.cast("string")), "/").alias("path"))


@query(
    _PLACES_SQL
    + """, r AS (
        SELECT id, 0 AS section, path AS key FROM walk WHERE NOT is_folder
        UNION ALL SELECT id, 3, path FROM walk WHERE is_folder
        UNION ALL SELECT id, 1, list_append(path, 2147483647) FROM walk WHERE is_folder)
    SELECT id, section, row_number() OVER (ORDER BY key) AS place FROM r
"""
)
def tree_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = trees.records(trees.flatten(_places(spark, sf_dir)))
    return sequences.numbered(made, ["tree", "key"]).select("id", "section", "place")
