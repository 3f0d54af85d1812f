"""Layout of the joined file: the lengths of its boxes, the heads of its media boxes and the width of its chunk offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atelier.operators import sequences
from atelier.operators.stretches import ROWS, Stretches
from atelier.plans import timelapse
from atelier.session import kept

# Lengths in bytes of the boxes that are written, by the format.
FTYP = 24
MVHD, MVHD_LONG = 108, 120
TKHD, TKHD_LONG = 92, 104
MDHD, MDHD_LONG = 32, 44
HDLR, DINF = 45, 36
VMHD, SMHD = 20, 16
BOX, TABLE, SIZES = 8, 16, 20
STTS, CTTS, STSC, ENTRY = 8, 8, 12, 4
NARROW, WIDE = 4, 8
LIMIT = 1 << 32


def media_head(payload: Column) -> Column:
    """Bytes before the payload of a media box: 8, or 16 where the box doesn't fit 32 bits."""
    return F.when(payload + BOX >= F.lit(LIMIT), 16).otherwise(BOX)


def _long(value: Column, short: int, long: int) -> Column:
    return F.when(value >= F.lit(LIMIT), long).otherwise(short)


def table_rows(tracks: DataFrame) -> DataFrame:
    """How many entries each table of a joined track has: path, track, stts, stsc, ctts, sync (null without such a table), samples, uniform, chunks.

    Runs are counted by their first rows, and sync samples by the lengths of the segments' tables.
    """
    begun = lambda rows, same: sequences.changes(rows, ["path", "track"], ["number", "pos"], same)
    counts = {"stts": begun(timelapse.duration_rows(tracks), ["delta"]), "stsc": timelapse.merged_chunk_runs(tracks), "ctts": begun(timelapse.composition_rows(tracks), ["offset"])}
    names = [*counts, "sync", "samples", "uniform", "chunks"]
    n_sync = F.greatest(F.when(F.col("sync").isNotNull(), F.size("sync")).otherwise(F.size("sizes")), F.lit(0))
    sizes = timelapse.merged_sizes(tracks).select("path", "track", F.col("n_samples").alias("samples"), "uniform")
    chunks = tracks.groupBy("path", "track").agg(F.sum(F.size("chunks")).alias("chunks"), F.sum(n_sync).alias("sync"), F.max(F.col("sync").isNotNull()).alias("has_sync"), F.max(F.col("ctts").isNotNull()).alias("has_ctts"))
    parts = [df.groupBy("path", "track").agg(F.count(F.lit(1)).alias(k)) for k, df in counts.items()] + [sizes, chunks]
    full = [p.select("path", "track", *[(F.col(c) if c in p.columns else F.lit(None)).cast("long").alias(c) for c in [*names, "has_sync", "has_ctts"]]) for p in parts]
    union = full[0]
    for p in full[1:]:
        union = union.unionByName(p)
    one = union.groupBy("path", "track").agg(*[F.max(c).alias(c) for c in [*names, "has_sync", "has_ctts"]])
    there = lambda c: F.when(F.col(f"has_{c}") == 1, F.coalesce(c, F.lit(0)))
    return one.select("path", "track", "stts", "stsc", there("ctts").alias("ctts"), there("sync").alias("sync"), "samples", "uniform", "chunks")


def header_bytes(tracks: DataFrame, movies: DataFrame) -> DataFrame:
    """Bytes before the first media box with chunk offsets of 4 and of 8 bytes: path, n_chunks, narrow, wide.

    A header has its long form where the sum of the segments' durations leaves 32 bits; sizes that
    are all the same are one number. tracks: with description (hex of its payload), media_duration and track_duration.
    """
    headers = tracks.groupBy("path", "track").agg(
        F.first("handler").alias("handler"), F.sum("track_duration").alias("_track"), F.sum("media_duration").alias("_media"), F.min_by(F.length("description"), "number").alias("_first")
    )
    description = timelapse.joined_description(tracks).select("path", "track", (F.length("description") / 2 + BOX).cast("long").alias("_stsd"))
    rows = table_rows(tracks).join(headers, ["path", "track"]).join(description, ["path", "track"])
    kind = F.when(F.col("handler") == "soun", SMHD).otherwise(VMHD)
    optional = lambda c, entry: F.when(F.col(c).isNotNull(), TABLE + entry * F.col(c)).otherwise(0)
    boxes = (
        F.lit(4 * BOX + HDLR + DINF) + _long(F.col("_track"), TKHD, TKHD_LONG) + _long(F.col("_media"), MDHD, MDHD_LONG) + kind + F.col("_stsd")
        + TABLE + STTS * F.coalesce("stts", F.lit(0)) + TABLE + STSC * F.coalesce("stsc", F.lit(0)) + optional("sync", ENTRY) + optional("ctts", CTTS)
        + SIZES + F.when(F.col("uniform") > 0, 0).otherwise(ENTRY * F.col("samples")) + TABLE
    )
    sums = rows.groupBy("path").agg(F.sum(boxes).alias("_boxes"), F.sum("chunks").alias("n_chunks"))
    whole = movies.groupBy("path").agg(F.sum("movie_duration").alias("_movie"))
    fixed = F.lit(FTYP + BOX) + _long(F.col("_movie"), MVHD, MVHD_LONG) + F.col("_boxes")
    return sums.join(whole, "path").select("path", "n_chunks", *[(fixed + width * F.col("n_chunks")).alias(name) for name, width in (("narrow", NARROW), ("wide", WIDE))])


def media_places(movies: DataFrame, rows: int = ROWS) -> DataFrame:
    """Where each segment's media data begins, counted from the end of the header: path, number, base, bytes.

    movies: path, number, mdat_size and mdat_head (bytes before the payload in its segment). The head of
    each media box is as long as its own payload makes it.
    """
    body = movies.select("path", "number", (F.col("mdat_size") - F.col("mdat_head")).alias("bytes")).withColumn("_head", media_head(F.col("bytes")))
    cut = Stretches(body, ["path"], ["number"], rows)
    placed = cut.before(cut.rows, F.col("bytes") + F.col("_head"), "_before")
    return placed.select("path", "number", (F.coalesce("_before", F.lit(0)) + F.col("_head")).alias("base"), "bytes")


def joined_layout(tracks: DataFrame, movies: DataFrame, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """The joined file's header, and its chunks' offsets from the start of the file.

    The first: path, n_chunks, header (bytes before the first media box), wide, media_bytes. The second:
    path, track, chunk, offset. Media heads depend on their payloads only and one sum over segments
    gives all places behind the header; the header's length moves them all alike. So the narrow form is
    tried first; where an offset then leaves 32 bits the wide one holds, as it only moves offsets up.
    Both inputs are written once, and chunks are moved segment by segment: only the last step makes a row a chunk.
    """
    tracks, movies = kept(tracks), kept(movies)
    laid = media_places(movies, rows).join(movies.select("path", "number", "mdat_start", "mdat_head"), ["path", "number"])
    counts = tracks.select("path", "track", "number", F.size("chunks").cast("long").alias("_n"))
    cut = Stretches(counts, ["path", "track"], ["number"], rows)
    shifted = cut.before(cut.rows, F.col("_n"), "_shift").select("path", "track", "number", F.coalesce("_shift", F.lit(0)).alias("_shift"))
    each = tracks.select("path", "track", "number", "chunks").join(shifted, ["path", "track", "number"]).join(laid, ["path", "number"])
    behind = each.select("path", "track", "chunks", "_shift", (F.col("base") - F.col("mdat_start") - F.col("mdat_head")).alias("_move"))
    last = behind.groupBy("path").agg(F.max(F.array_max("chunks") + F.col("_move")).alias("_last"))
    media = laid.groupBy("path").agg(F.sum("bytes").alias("media_bytes"))
    form = header_bytes(tracks, movies).join(last, "path", "left").join(media, "path", "left")
    wide = F.coalesce(F.col("narrow") + F.col("_last") >= F.lit(LIMIT), F.lit(False))
    form = form.select("path", "n_chunks", F.when(wide, F.col("wide")).otherwise(F.col("narrow")).alias("header"), wide.alias("wide"), "media_bytes")
    moved = behind.join(form.select("path", "header"), "path").select("path", "track", "_shift", (F.col("_move") + F.col("header")).alias("_move"), F.posexplode("chunks").alias("_pos", "_at"))
    return form, moved.select("path", "track", (F.col("_pos") + 1 + F.col("_shift")).alias("chunk"), (F.col("_at") + F.col("_move")).alias("offset"))
