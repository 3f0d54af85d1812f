"""What has to hold for a segment before it is joined: each rule is a condition on a row, the first that fails is its error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atelier.plans import timelapse


def _sum(values: Column, of=lambda v: v) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + of(v))


def _first(problems: Column) -> Column:
    return F.get(F.array_compact(problems), F.lit(0))


def chunk_runs_problem(stsc: Column, n_chunks: Column, n_samples: Column) -> Column:
    """Rules of a table of samples a chunk: begins at chunk 1, ascends, no empty chunks, covers all samples, ends within the chunks."""
    ends = F.transform(stsc, lambda e, i: F.struct(e["first_chunk"].alias("lo"), F.coalesce(F.get(stsc, i + 1)["first_chunk"], n_chunks + 1).alias("hi"), e["per_chunk"].alias("n")))
    each = F.transform(ends, lambda e: F.when(e["hi"] <= e["lo"], "stsc entries out of order").when(e["n"] == 0, "stsc entry with zero samples"))
    covered = _sum(ends, lambda e: e["n"] * (e["hi"] - e["lo"]))
    inner = (
        F.when(F.coalesce(F.size(stsc), F.lit(0)) == 0, "no chunk structure (stsc)")
        .when(F.get(stsc, F.lit(0))["first_chunk"] != 1, "stsc does not start at chunk 1")
        .otherwise(F.coalesce(_first(each), F.when(covered != n_samples, F.format_string("stsc covers %d samples, stsz has %d", covered, n_samples))))
    )
    past = (n_chunks > 0) & (F.element_at(stsc, -1)["first_chunk"] > n_chunks)
    return F.coalesce(F.when(n_samples > 0, inner), F.when((F.size(stsc) > 0) & past, F.format_string("stsc extends past the %d chunks", n_chunks)))


def sync_problem(sync: Column, n_samples: Column) -> Column:
    """Sync samples ascend within 1 and the number of samples."""
    bad = F.transform(sync, lambda s, i: (s < 1) | (s > n_samples) | F.coalesce(s <= F.get(sync, i - 1), F.lit(False)))
    return F.when(F.exists(bad, lambda b: b), "bad sync sample table")


def chunk_places_problem(chunks: Column, start: Column, end: Column) -> Column:
    """Chunks ascend and lie in the media data; the first that doesn't is named."""
    each = F.transform(
        chunks,
        lambda at, i: F.when((i > 0) & (at < F.get(chunks, i - 1)), "chunk offsets not ascending").when(
            (at < start) | (at > end), F.format_string("chunk offset %d outside mdat [%d,%d)", at, start, end)
        ),
    )
    return _first(each)


def track_problems(tracks: DataFrame, movies: DataFrame) -> DataFrame:
    """Tracks that break a rule: path, name, track, problem (the first rule broken)."""
    media = movies.select("path", "name", F.get("mdats", F.lit(0))["start"].alias("_at"), F.element_at("mdats", -1).alias("_last"), F.size("mdats").alias("_n"))
    spans = media.where("_n > 0").select("path", "name", (F.col("_at") + 8).alias("_lo"), (F.col("_last.start") + F.col("_last.size")).alias("_hi"))
    n = F.coalesce(F.size("sizes"), F.lit(0)).cast("long")
    n_chunks = F.coalesce(F.size("chunks"), F.lit(0)).cast("long")
    timed = _sum(F.col("stts"), lambda e: e["count"])
    problem = F.coalesce(
        F.when(~F.col("handler").isin("vide", "soun") | F.col("handler").isNull(), F.concat(F.lit('handler "'), F.coalesce("handler", F.lit("")), F.lit('"'))),
        F.when(F.col("timescale") == 0, "mdhd timescale is zero"),
        F.when(F.col("track_id") == 0, "tkhd track id is zero"),
        F.when(F.col("sizes").isNull() | F.col("chunks").isNull() | F.col("stts").isNull(), "truncated sample tables"),
        F.when((n == 0) & (F.col("handler") == "vide"), "video track has no samples"),
        chunk_runs_problem(F.col("stsc"), n_chunks, n),
        F.when((n > 0) & (timed != n), F.format_string("stts covers %d samples, stsz has %d", timed, n)),
        sync_problem(F.col("sync"), n),
        chunk_places_problem(F.col("chunks"), F.col("_lo"), F.col("_hi")),
        F.when(_sum(F.col("sizes")) > F.col("_hi") - F.col("_lo"), "sample data larger than mdat"),
    )
    return tracks.join(spans, ["path", "name"]).select("path", "name", "track", problem.alias("problem")).where("problem IS NOT NULL")


def segment_problems(tracks: DataFrame, movies: DataFrame, to_convert: bool = False) -> DataFrame:
    """Segments that break a rule: path, name, problem.

    Boxes come first, then tracks in order. With ``to_convert`` a segment must also have video and
    one media box only, which reports don't ask for.
    """
    worst = track_problems(tracks, movies).groupBy("path", "name").agg(F.min_by(F.struct("track", "problem"), "track").alias("worst"))
    named = tracks.select("path", "name", "track", "fourcc")
    first = worst.select("path", "name", F.col("worst.track").alias("track"), F.col("worst.problem").alias("what")).join(named, ["path", "name", "track"])
    text = F.format_string("track %d (%s): %s", F.col("track") + 1, F.coalesce("fourcc", F.lit("")), "what")
    counts = tracks.groupBy("path", "name").agg(F.count(F.lit(1)).alias("n_tracks"), F.count_if(F.col("handler") == "vide").alias("n_video"))
    overlap = F.exists(F.transform("mdats", lambda m, i: m["start"] + 8 < F.get("mdats", i - 1)["start"] + F.get("mdats", i - 1)["size"]), lambda b: F.coalesce(b, F.lit(False)))
    rows = movies.join(counts, ["path", "name"], "left").join(first.select("path", "name", text.alias("text")), ["path", "name"], "left")
    found = F.coalesce(
        F.col("error"),
        F.when(F.col("movie_timescale") == 0, "mvhd timescale is zero"),
        F.when(F.coalesce("n_tracks", F.lit(0)) == 0, "no tracks"),
        F.when(F.col("n_mdat") == 0, "no media data (mdat)"),
        F.when(overlap, "overlapping mdat boxes"),
        F.col("text"),
        *([F.when(F.col("n_video") == 0, "no video track"), F.when(F.col("n_mdat") != 1, "not one media box")] if to_convert else []),
    )
    return rows.select("path", "name", found.alias("problem")).where("problem IS NOT NULL")


def verify(tracks: DataFrame, movies: DataFrame) -> DataFrame:
    """Totals of each archive: path, n_good, n_failed, seconds (of the good ones), first_problem (of the segment first by number).

    tracks, movies: with number. All problems count; a conversion stops at the first.
    """
    bad = segment_problems(tracks, movies)
    rows = movies.join(bad, ["path", "name"], "left")
    good = F.col("problem").isNull()
    return rows.groupBy("path").agg(
        F.count_if(good).alias("n_good"), F.count_if(~good).alias("n_failed"),
        F.sum(F.when(good, F.try_divide("movie_duration", "movie_timescale"))).alias("seconds"),
        F.min_by("problem", F.when(~good, F.col("number"))).alias("first_problem"),
    )


def verified(tracks: DataFrame, movies: DataFrame) -> DataFrame:
    """The totals of ``verify`` with its verdict: incompatible (the first segment by number that can't be joined to the first, as ``number: problem``), code.

    Segments are compared only where all of an archive's are good. The code is that of a report.
    """
    totals = verify(tracks, movies)
    fine = totals.where("n_failed = 0").select("path")
    odd = timelapse.compatibility(tracks.join(fine, "path", "left_semi"), movies.join(fine, "path", "left_semi"))
    first = odd.groupBy("path").agg(F.min(F.struct("number", "problem")).alias("f"))
    rows = totals.join(first.select("path", F.concat_ws(": ", F.col("f.number").cast("string"), "f.problem").alias("incompatible")), "path", "left")
    bad = (F.col("n_failed") > 0) | F.col("incompatible").isNotNull()
    return rows.withColumn("code", F.when(bad, timelapse.BAD).otherwise(timelapse.OK))


def _lines(head: DataFrame, body: DataFrame, tail: DataFrame) -> DataFrame:
    """Three parts of reports (path, number, line) as sections 0, 1 and 2."""
    first, second, third = (df.select("path", F.lit(k).alias("section"), "number", "line") for k, df in enumerate((head, body, tail)))
    return first.unionByName(second).unionByName(third)


def _numbered(number: Column, widest: Column) -> Column:
    """A segment's number, as wide as the largest of its archive."""
    return F.rpad(number.cast("string"), F.length(widest.cast("string")), F.lit(" "))


def _heads(counts: DataFrame, label: Column) -> DataFrame:
    said = F.array(F.concat(F.lit("input: "), label), F.concat(F.lit("segments: "), F.col("n").cast("string")), F.when(F.col("n") > 0, F.lit("")))
    return counts.select("path", F.posexplode(F.array_compact(said)).alias("at", "line")).select("path", F.col("at").cast("long").alias("number"), "line")


def listing_report(segments: DataFrame, archives: DataFrame) -> DataFrame:
    """The lines that list an archive's segments: path, section, number, line; in the order of section and number.

    segments: path, name, number. archives: path, label, one a row, those without segments too.
    """
    counts = segments.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("number").alias("widest"))
    known = archives.select("path", "label").join(counts, "path", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    body = segments.join(counts, "path").select("path", "number", F.concat_ws(" ", _numbered(F.col("number"), F.col("widest")), "name").alias("line"))
    none = known.where("false").select("path", F.lit(0).cast("long").alias("number"), F.lit("").alias("line"))
    return _lines(_heads(known, F.col("label")), body, none)


def verify_report(tracks: DataFrame, movies: DataFrame, archives: DataFrame) -> DataFrame:
    """The lines that report the health of an archive's segments: path, section, number, line; in the order of section and number.

    Each segment is a line of its own, and where all are good and can be joined there is one of the whole.
    movies: path, name, number and what ``segment_problems`` asks for. archives: path, label.
    """
    bad = segment_problems(tracks, movies)
    streams = timelapse.streams_summary(tracks)
    rows = movies.join(bad, ["path", "name"], "left").join(streams, ["path", "number"], "left")
    counts = movies.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("number").alias("widest"))
    seconds = F.try_divide("movie_duration", "movie_timescale")
    number = _numbered(F.col("number"), F.col("widest"))
    failed = F.concat(number, F.lit(" FAIL  "), F.substring_index("problem", "\n", 1))
    sound = F.concat(number, F.lit(" ok    "), F.coalesce("streams", F.lit("")), F.lit("  "), F.coalesce(F.format_string("%.2fs", seconds), F.lit("n/a")), F.lit("  "), "name")
    body = rows.join(counts, "path").select("path", "number", F.when(F.col("problem").isNotNull(), failed).otherwise(sound).alias("line"))
    fine = verified(tracks, movies).where(F.col("code") == timelapse.OK)
    said = F.format_string("verify: ok, %d segment(s), ~%.1f s of video", "n_good", F.coalesce("seconds", F.lit(0.0)))
    tail = fine.select("path", F.posexplode(F.array(F.lit(""), said)).alias("at", "line")).select("path", F.col("at").cast("long").alias("number"), "line")
    known = archives.select("path", "label").join(counts, "path")
    return _lines(_heads(known, F.col("label")), body, tail)
