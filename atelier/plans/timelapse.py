"""Timelapse segments of artworks: listing, gaps, compatibility and the plan of their concatenation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atelier.functions import codecs
from atelier.operators import compare, gaps, sequences

SEGMENT = r"(?iu)\Avideo/segments/segment-([0-9]+)\.mp4\z"
#: Exit codes: fine, not readable, no segments, segments that can't be used.
OK, UNREADABLE, NONE, BAD = 0, 3, 4, 5


def segment_number(name: Column) -> Column:
    """Number of a segment member; null for others and where it leaves 64 bits."""
    return F.regexp_extract(name, SEGMENT, 1).try_cast("bigint")


def classified(members: DataFrame) -> DataFrame:
    """Adds number (null for what isn't a segment) and ignored (an .mp4 among the segments without a number)."""
    numbered = members.withColumn("number", F.when(~F.col("is_dir") & F.col("name").rlike(SEGMENT), segment_number(F.col("name"))))
    stray = ~F.col("is_dir") & F.lower("name").like("video/segments/%.mp4") & F.col("number").isNull()
    return numbered.withColumn("ignored", F.coalesce(stray, F.lit(False)))


def listing(members: DataFrame, to_convert: bool = True) -> DataFrame:
    """A row an archive: path, n_segments, first, last, n_ignored, missing (as ``1-3, 7``), clash (smallest number that two members have), code, problem.

    An archive that has only files without a number among its segments can't be converted; a report,
    without ``to_convert``, has it as one without segments.
    """
    own = F.col("number")
    keyed = classified(members).groupBy("path", "number").agg(F.count(F.lit(1)).alias("n"), F.count_if("ignored").alias("n_ignored"), F.max("error").alias("error"))
    following = F.lead("number").over(Window.partitionBy("path").orderBy("number"))
    placed = keyed.withColumn("hole", F.when(own.isNotNull() & (following > own + 1), F.struct((own + 1).alias("lo"), (following - 1).alias("hi"))))
    held = F.when(own.isNotNull(), F.col("n"))
    texts = F.transform(F.array_sort(F.collect_list("hole")), lambda h: gaps.range_text(h["lo"], h["hi"]))
    joined = placed.groupBy("path").agg(
        F.coalesce(F.sum(held), F.lit(0)).alias("n_segments"), F.min("number").alias("first"), F.max("number").alias("last"), F.sum("n_ignored").alias("n_ignored"),
        F.nullif(F.array_join(texts, ", "), F.lit("")).alias("missing"), F.min(F.when(held > 1, own)).alias("clash"), F.max("error").alias("error"),
    )
    code = F.when(F.col("error").isNotNull(), UNREADABLE).when(F.col("clash").isNotNull(), BAD).when(F.col("n_segments") > 0, OK).when((F.col("n_ignored") > 0) & F.lit(to_convert), BAD).otherwise(NONE)
    problem = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("clash").isNotNull(), F.concat(F.lit("several members are segment "), F.col("clash")))
        .when(F.col("missing").isNotNull(), F.concat(F.lit("segment numbers missing: "), "missing", F.lit(" (the video would have gaps)")))
    )
    return joined.select("path", "n_segments", "first", "last", "n_ignored", "missing", "clash", code.alias("code"), problem.alias("problem"), "error")


def slim_members(members: DataFrame) -> DataFrame:
    """Members that a slimmed copy keeps: all but the segments."""
    return classified(members).where(F.col("number").isNull()).select(members.columns)


def slim_totals(members: DataFrame) -> DataFrame:
    """path, kept, removed, removed_bytes."""
    gone = F.col("number").isNotNull()
    return classified(members).groupBy("path").agg(F.count_if(~gone).alias("kept"), F.count_if(gone).alias("removed"), F.sum(F.when(gone, F.col("packed")).otherwise(0)).alias("removed_bytes"))


# What two tracks must share, in the order of reports, by column; the names are those of reports.
FIELDS = {
    "kind": "stream type", "handler": "handler", "fourcc": "codec fourcc", "width": "width", "height": "height", "rate": "sample rate",
    "channels": "channels", "timescale": "timescale", "config_key": "codec configuration", "matrix": "color matrix",
}


def compatibility(tracks: DataFrame, movies: DataFrame | None = None) -> DataFrame:
    """Segments that can't be joined to their archive's first: path, number, problem. tracks, movies: with number.

    Tracks are compared by position, then the time scales of the movies. Configurations are compared by
    their key, so that those which differ in the number of reference frames only can be joined; one
    that differs is named by its box where both have the same.
    """
    kind = F.when(F.col("handler") == "vide", "video").otherwise("audio")
    tracks = tracks.withColumn("kind", kind)
    counts = tracks.groupBy("path", "number").agg(F.count(F.lit(1)).alias("stream count"))
    odd = compare.against_first(counts, ["path"], "number", ["stream count"]).where(F.size("differs") > 0).select("path", "number", "differs")
    same = tracks.join(odd.select("path", "number"), ["path", "number"], "left_anti")
    boxed = [*FIELDS, "config_box"]
    diff = compare.against_first(same.select("path", "track", "number", *boxed), ["path", "track"], "number", boxed)
    naming = F.create_map(*[F.lit(x) for pair in FIELDS.items() for x in pair])
    own_box = ~F.array_contains("differs", "config_box") & F.col("config_box").isNotNull()
    key = F.when(F.array_contains("differs", "config_box"), F.array_union(F.array_remove("differs", "config_box"), F.array(F.lit("config_key")))).otherwise(F.col("differs"))
    order = F.filter(F.array(*map(F.lit, FIELDS)), lambda f: F.array_contains(key, f))
    named = F.transform(order, lambda f: F.when((f == "config_key") & own_box, F.col("config_box")).otherwise(F.try_element_at(naming, f)))
    found = diff.where(F.size("differs") > 0).select("path", "number", F.col("track").cast("long").alias("at"), named.alias("differs"))
    if movies is not None:
        scales = compare.against_first(movies.select("path", "number", "movie_timescale"), ["path"], "number", ["movie_timescale"])
        scales = scales.join(odd.select("path", "number"), ["path", "number"], "left_anti").where(F.size("differs") > 0)
        found = found.unionByName(scales.select("path", "number", F.lit(1 << 40).alias("at"), F.array(F.lit("mvhd timescale")).alias("differs")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "differs"))), lambda r: r["differs"])
    merged = found.groupBy("path", "number").agg(F.array_distinct(F.flatten(listed)).alias("differs"))
    return odd.unionByName(merged).select("path", "number", compare.differ_text(F.col("differs")).alias("problem"))


def joined_description(tracks: DataFrame) -> DataFrame:
    """The sample description of each joined track: path, track, number, description.

    It is that of the segment with the most reference frames, the earliest of them; the first
    segment's where no configuration tells them.
    """
    rank = F.struct(F.coalesce(F.when(F.col("config_box") == "avcC", F.col("references")), F.lit(-1)), -F.col("number"))
    best = F.max_by(F.struct("number", "description"), rank)
    return tracks.groupBy("path", "track").agg(best.alias("b")).select("path", "track", "b.number", "b.description")


def described(tracks: DataFrame) -> DataFrame:
    """Adds codec, pixel_format and a text such as ``video h264 320x240 yuv420p`` to each track."""
    named = tracks.withColumn("codec", codecs.codec_name(F.col("fourcc"))).withColumn("pixel_format", codecs.pixel_format(F.col("handler"), F.col("config_box"), F.col("chroma")))
    video = F.format_string("video %s %dx%d %s", "codec", "width", "height", "pixel_format")
    audio = F.format_string("audio %s %dHz %dch", "codec", F.coalesce("rate", F.lit(0)), F.coalesce("channels", F.lit(0)))
    return named.withColumn("text", F.when(F.col("handler") == "vide", video).otherwise(audio))


def streams_summary(tracks: DataFrame) -> DataFrame:
    """path, number, streams: the texts of a segment's tracks in order."""
    rows = described(tracks).groupBy("path", "number").agg(F.array_sort(F.collect_list(F.struct("track", "text"))).alias("r"))
    return rows.select("path", "number", F.array_join(F.col("r.text"), ", ").alias("streams"))


def total_duration(stts: Column) -> Column:
    """Sum of all sample durations of a table."""
    return F.aggregate(stts, F.lit(0).cast("long"), lambda a, e: a + e["count"] * e["delta"])


def composition_rows(tracks: DataFrame) -> DataFrame:
    """Entries of composition offsets, in order of number and pos, of each joined track that has them in any segment: path, track, number, pos, n, offset."""
    plain = F.array(F.struct(F.size("sizes").cast("long").alias("count"), F.lit(0).cast("long").alias("offset")))
    # sizes are counted before rows are shuffled
    own = tracks.select("path", "track", "number", F.col("ctts").isNotNull().alias("_has"), F.coalesce("ctts", plain).alias("_own"))
    rows = own.withColumn("_any", F.max("_has").over(Window.partitionBy("path", "track"))).where("_any").select("path", "track", "number", F.posexplode("_own").alias("pos", "e"))
    return rows.select("path", "track", "number", "pos", F.col("e.count").alias("n"), "e.offset").where("n > 0")


def merged_composition(tracks: DataFrame) -> DataFrame:
    """Runs of equal composition offsets of each joined track that has them in any segment: path, track, run, offset, count. A segment without them counts as offset 0.

    Whether the first segment has a table makes no difference: offsets of later ones are never lost.
    """
    joined = sequences.runs(composition_rows(tracks), ["path", "track"], ["number", "pos"], ["offset"], total="n")
    return joined.select("path", "track", "run", "offset", F.col("n").alias("count"))


def merged_sizes(tracks: DataFrame) -> DataFrame:
    """Sizes of each joined track as its table holds them: path, track, n_samples, uniform (the one size of all samples, or 0)."""
    own = tracks.select("path", "track", F.size("sizes").alias("n"), F.array_min("sizes").alias("lo"), F.array_max("sizes").alias("hi"))
    low, high = F.min("lo"), F.max("hi")
    return own.groupBy("path", "track").agg(F.sum("n").alias("n_samples"), F.when(low == high, low).otherwise(0).alias("uniform"))


def joined_durations(tracks: DataFrame, movies: DataFrame) -> DataFrame:
    """Sums of the durations that headers state: path, track (null for the movie), duration, media_duration, samples_duration."""
    sums = tracks.groupBy("path", "track").agg(
        F.sum("track_duration").alias("duration"), F.sum("media_duration").alias("media_duration"), F.sum(total_duration(F.col("stts"))).alias("samples_duration")
    )
    whole = movies.groupBy("path").agg(F.sum("movie_duration").alias("duration"))
    none = F.lit(None)
    return sums.unionByName(whole.select("path", none.cast("int").alias("track"), "duration", none.cast("long").alias("media_duration"), none.cast("long").alias("samples_duration")))


def duration_rows(tracks: DataFrame) -> DataFrame:
    """Entries of sample durations, in order of number and pos: path, track, number, pos, n, delta."""
    return tracks.select("path", "track", "number", F.posexplode("stts").alias("pos", "e")).select("path", "track", "number", "pos", F.col("e.count").alias("n"), "e.delta")


def merged_durations(tracks: DataFrame) -> DataFrame:
    """Runs of equal sample durations of each joined track: path, track, run, delta, count."""
    joined = sequences.runs(duration_rows(tracks), ["path", "track"], ["number", "pos"], ["delta"], total="n")
    return joined.select("path", "track", "run", "delta", F.col("n").alias("count"))


def _shifts(tracks: DataFrame) -> DataFrame:
    """Samples and chunks of a track's earlier segments."""
    before = Window.partitionBy("path", "track").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda c: F.coalesce(F.sum(F.size(c)).over(before), F.lit(0))
    return tracks.withColumn("sample_shift", sums("sizes")).withColumn("chunk_shift", sums("chunks"))


def merged_sync(tracks: DataFrame) -> DataFrame:
    """Sync samples of each joined track that has a table in any segment: path, track, sample. A segment without one counts in full."""
    any_table = F.max(F.col("sync").isNotNull()).over(Window.partitionBy("path", "track"))
    every = F.when(F.size("sizes") > 0, F.sequence(F.lit(1).cast("long"), F.size("sizes").cast("long"))).otherwise(F.array().cast("array<long>"))
    rows = _shifts(tracks).withColumn("_any", any_table).where("_any")
    return rows.select("path", "track", F.explode(F.transform(F.coalesce("sync", every), lambda s: s + F.col("sample_shift"))).alias("sample"))


def merged_chunk_runs(tracks: DataFrame) -> DataFrame:
    """Where samples a chunk change in each joined track: path, track, first_chunk, per_chunk, description."""
    rows = _shifts(tracks).select("path", "track", "chunk_shift", F.explode("stsc").alias("e"))
    moved = rows.select("path", "track", (F.col("e.first_chunk") + F.col("chunk_shift")).alias("first_chunk"), "e.per_chunk", "e.description")
    return sequences.changes(moved, ["path", "track"], ["first_chunk"], ["per_chunk", "description"])


def chunk_bytes(tracks: DataFrame) -> DataFrame:
    """Bytes of every chunk of a segment's track: path, number, track, chunk, first_sample, n_samples, bytes."""
    key = ["path", "number", "track"]
    runs = tracks.select(*key, F.size("chunks").cast("long").alias("n_chunks"), "sizes", F.explode("stsc").alias("e"))
    flat = runs.select(*key, "n_chunks", "sizes", F.col("e.first_chunk").alias("first_chunk"), F.col("e.per_chunk").alias("n_samples"))
    each = sequences.expand_runs(flat, key, "first_chunk", "n_chunks", out="chunk")
    before = Window.partitionBy(*key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("first_sample", F.coalesce(F.sum("n_samples").over(before), F.lit(0)) + 1)
    own = F.slice("sizes", F.col("first_sample").cast("int"), F.col("n_samples").cast("int"))
    return placed.select(*key, "chunk", "first_sample", "n_samples", F.aggregate(own, F.lit(0).cast("long"), lambda a, v: a + v).alias("bytes"))


def media_layout(movies: DataFrame, head: int = 8) -> DataFrame:
    """Where each segment's media data begins in the joined file, counted from the first: path, number, base, bytes."""
    body = movies.select("path", "number", (F.col("mdat_size") - head).alias("bytes"))
    before = Window.partitionBy("path").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return body.withColumn("base", F.coalesce(F.sum(F.col("bytes") + head).over(before), F.lit(0)) + head)


def merged_offsets(tracks: DataFrame, movies: DataFrame, head: int = 8, header: int = 0) -> DataFrame:
    """Offsets of the joined track's chunks, and whether they fit 32 bits: path, track, chunk, offset, fits.

    Offsets count from the start of the first media box, ``header`` bytes (of the boxes before it) after
    that of the file; ``fits`` is about offsets in the file, for all tracks of it.
    """
    laid = media_layout(movies, head).join(movies.select("path", "number", "mdat_start"), ["path", "number"])
    rows = _shifts(tracks).join(laid, ["path", "number"]).select("path", "track", "chunk_shift", "base", "mdat_start", F.posexplode("chunks").alias("pos", "at"))
    moved = rows.select("path", "track", (F.col("pos") + 1 + F.col("chunk_shift")).alias("chunk"), (F.col("at") - F.col("mdat_start") - head + F.col("base")).alias("offset"))
    most = moved.groupBy("path").agg((F.max("offset") + header < F.lit(1 << 32)).alias("fits"))
    return moved.join(most, "path")


def offset_form(tracks: DataFrame, movies: DataFrame, head: int = 8, header: int = 0) -> DataFrame:
    """Whether the joined file's chunk tables need 8 bytes an offset: path, n_chunks, header (bytes before the media), wide.

    The header is as long as its tables make it: the narrow form is tried first, and if an offset leaves
    32 bits in it, the wide form adds 4 bytes a chunk, which never makes an offset fit again.
    """
    laid = merged_offsets(tracks, movies, head)
    whole = laid.groupBy("path").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("offset").alias("last"))
    wide = F.col("last") + F.lit(header) + 4 * F.col("n_chunks") >= F.lit(1 << 32)
    return whole.select("path", "n_chunks", (F.lit(header) + F.col("n_chunks") * F.when(wide, 8).otherwise(4)).alias("header"), wide.alias("wide"))


def durations(movies: DataFrame) -> DataFrame:
    """Seconds of each archive's video: as the joined file has them, and as the sum over segments. A time scale of zero gives none."""
    joined = F.try_divide(F.sum("movie_duration"), F.min_by("movie_timescale", "number"))
    return movies.groupBy("path").agg(joined.alias("seconds"), F.sum(F.try_divide("movie_duration", "movie_timescale")).alias("seconds_by_segment"))
