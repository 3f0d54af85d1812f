"""MP4 segments as rows of boxes, and the boxes' fields and tables as columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atelier.functions.binary import signed_be, unsigned_be, unsigned_be_array
from atelier.functions.codecs import configuration

# Boxes that hold boxes, the bytes before the boxes of a sample entry by its kind, boxes with a configuration.
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl"))
VISUAL = ("avc1", "avc3", "hvc1", "hev1", "vp09", "av01", "mve1", "vvc1")
AUDIBLE = ("mp4a", "ac-3", "ac-4", "alac", "Opus")
ENTRY_HEAD = dict.fromkeys(VISUAL, 78) | dict.fromkeys(AUDIBLE, 28)
CONFIGS = ("avcC", "hvcC", "vpcC", "av1C")
#: Boxes may be nested so deep, and a track may have so many samples; beyond, the segment is in error.
DEPTH, MOST_SAMPLES = 32, 1 << 28
BOXES = "path string, name string, track int, type string, start long, size long, payload binary, error string"


def _heads(data: bytes, at: int, end: int) -> Iterator[tuple[bytes | None, int, int, int]]:
    """Type, start, bytes before the payload and size of the boxes between two offsets; a type of None where one leaves its parent."""
    while at < end:
        head, size = 8, int.from_bytes(data[at : at + 4], "big")
        kind = data[at + 4 : at + 8]
        if size == 1:
            head, size = 16, int.from_bytes(data[at + 8 : at + 16], "big")
        elif size == 0:
            size = end - at
        if size < head or at + size > end or len(kind) < 4:
            yield None, at, 0, end - at
            return
        yield kind, at, head, size
        at += size


def _described(data: bytes, at: int, end: int, track: int | None) -> Iterator[tuple]:
    """Rows ``entry`` and ``config`` of a sample description's first entry: its payload after four characters, and those of its boxes likewise."""
    for kind, start, head, size in _heads(data, at, end):
        if kind is None:
            return
        name, body, stop = kind.decode("latin-1"), start + head, start + size
        yield track, "entry", start, size, kind + data[body:stop], None
        inner = body + ENTRY_HEAD.get(name, stop - body)
        for own, place, before, length in _heads(data, inner, stop):
            if own is None:
                return
            yield track, "config", place, length, own + data[place + before : place + length], None
        return


def _walk(data: bytes) -> Iterator[tuple]:
    """Boxes in the order of their starts, containers opened; payloads of media data are left out."""
    open_, tracks = [(_heads(data, 0, len(data)), None)], 0
    while open_:
        boxes_, track = open_[-1]
        found = next(boxes_, None)
        if found is None:
            open_.pop()
            continue
        kind, at, head, size = found
        if kind is None:
            yield track, None, at, size, None, f"box at {at} leaves its parent"
            return
        if kind == b"trak":
            track, tracks = tracks, tracks + 1
        if kind in CONTAINERS:
            yield track, kind.decode(), at, size, None, None
            if len(open_) >= DEPTH:
                yield track, None, at, size, None, f"box at {at} is nested too deep"
                return
            open_.append((_heads(data, at + head, at + size), track))
            continue
        yield track, kind.decode("latin-1"), at, size, None if kind == b"mdat" else data[at + head : at + size], None
        if kind == b"stsd":
            yield from _described(data, at + head + 8, at + size, track)


def boxes(segments: DataFrame) -> DataFrame:
    """A row a box of every segment (path, name, data): the track it is in, type, start, size and payload."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, name, data in zip(pdf["path"], pdf["name"], pdf["data"], strict=True):
                rows = [(path, name, *r) for r in _walk(data or b"")]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in BOXES.split(", ")]).astype({"track": "Int32"})

    return segments.select("path", "name", "data").mapInPandas(parsed, BOXES)


def _version(p: Column) -> Column:
    return unsigned_be(p, 0, 1)


def _long(p: Column, short: int, wide: int) -> Column:
    """A number of 4 bytes, or of 8 in a box of version 1."""
    return F.when(_version(p) == 1, unsigned_be(p, wide, 8)).otherwise(unsigned_be(p, short, 4))


def _of(kind: str, value: Column) -> Column:
    """The value from the last box of that type in the group; each group is the boxes of one track."""
    return F.max_by(F.when(F.col("type") == kind, value), F.when(F.col("type") == kind, F.col("start")))


def _table(p: Column, *names: str) -> Column:
    """A table of rows with one number of 4 bytes a name."""
    n, step = unsigned_be(p, 4, 4), 4 * len(names)
    return F.arrays_zip(*[unsigned_be_array(p, 8 + 4 * k, 4, step, n).alias(name) for k, name in enumerate(names)])


def tracks(box_rows: DataFrame) -> DataFrame:
    """A row a track of every segment, with its header fields and sample tables as arrays.

    path, name, track, track_id, handler, fourcc, width, height, channels, rate, timescale, media_duration,
    track_duration, matrix, config_box, config (hex), config_key, references, chroma, profile, description
    (hex of the whole sample description), stts (count, delta), stsc (first_chunk, per_chunk, description), sizes,
    chunks (offsets), sync and ctts (count, offset), both null without such a table. A table that its box
    doesn't hold in full is null, and so are the sizes of over ``MOST_SAMPLES`` samples. A sample entry
    without dimensions has the track's.
    """
    p = F.col("payload")
    version = _version(p)
    late = F.when(version == 1, 8).otherwise(0)
    uniform, n = unsigned_be(p, 4, 4), unsigned_be(p, 8, 4)
    sizes = F.when(n <= MOST_SAMPLES, F.when(uniform > 0, F.array_repeat(uniform, n.cast("int"))).otherwise(unsigned_be_array(p, 12, 4, 4, n)))
    four = F.decode(F.substring(p, 1, 4), "ISO-8859-1")
    offsets = F.zip_with(
        unsigned_be_array(p, 8, 4, 8, unsigned_be(p, 4, 4)), unsigned_be_array(p, 12, 4, 8, unsigned_be(p, 4, 4)),
        lambda count, at: F.struct(count.alias("count"), F.when(at >= F.lit(1 << 31), at - F.lit(1 << 32)).otherwise(at).alias("offset")),
    )
    seen, heard = four.isin(*VISUAL), four.isin(*AUDIBLE)
    config = F.col("type") == "config"
    strong, audio = config & four.isin(*CONFIGS), config & (four == "esds")
    chosen = lambda which, pick: pick(F.when(which, F.struct("start", four.alias("box"), F.substring(p, F.lit(5), F.octet_length(p)).alias("data"))))
    rows = (
        box_rows.where(F.col("track").isNotNull() & F.col("error").isNull())
        .groupBy("path", "name", "track")
        .agg(
            _of("tkhd", F.when(version == 1, unsigned_be(p, 20, 4)).otherwise(unsigned_be(p, 12, 4))).alias("track_id"),
            _of("hdlr", F.decode(F.substring(p, 9, 4), "ISO-8859-1")).alias("handler"),
            _of("entry", four).alias("fourcc"),
            _of("entry", F.when(seen, unsigned_be(p, 28, 2))).alias("_width"),
            _of("entry", F.when(seen, unsigned_be(p, 30, 2))).alias("_height"),
            _of("tkhd", F.shiftright(unsigned_be(p, F.octet_length(p) - 8, 4), 16)).alias("_shown_width"),
            _of("tkhd", F.shiftright(unsigned_be(p, F.octet_length(p) - 4, 4), 16)).alias("_shown_height"),
            _of("entry", F.when(heard, unsigned_be(p, 20, 2).bitwiseAND(F.lit(255)))).alias("_channels"),
            _of("entry", F.when(heard, F.shiftright(unsigned_be(p, 28, 4), 16))).alias("_rate"),
            _of("mdhd", unsigned_be(p, late + 12, 4)).alias("timescale"),
            _of("mdhd", _long(p, 16, 24)).alias("media_duration"),
            _of("tkhd", _long(p, 20, 28)).alias("track_duration"),
            _of("tkhd", F.hex(F.substring(p, F.octet_length(p) - 43, F.lit(36)))).alias("matrix"),
            F.coalesce(chosen(strong, F.max), chosen(audio, F.min)).alias("_config"),
            _of("stsd", F.hex(p)).alias("description"),
            _of("stts", _table(p, "count", "delta")).alias("stts"),
            _of("stsc", _table(p, "first_chunk", "per_chunk", "description")).alias("stsc"),
            _of("stsz", sizes).alias("sizes"),
            F.coalesce(
                _of("co64", unsigned_be_array(p, 8, 8, 8, unsigned_be(p, 4, 4))), _of("stco", unsigned_be_array(p, 8, 4, 4, unsigned_be(p, 4, 4)))
            ).alias("chunks"),
            _of("stss", unsigned_be_array(p, 8, 4, 4, unsigned_be(p, 4, 4))).alias("sync"),
            _of("ctts", offsets).alias("ctts"),
        )
    )
    told = rows.withColumn("_told", configuration(F.col("_config.box"), F.col("_config.data")))
    size = lambda own, shown: F.coalesce(F.when(F.col(own) > 0, F.col(own)), F.when(F.col("handler") == "vide", F.col(shown)), F.col(own))
    return told.select(
        "path", "name", "track", "track_id", "handler", "fourcc", size("_width", "_shown_width").alias("width"), size("_height", "_shown_height").alias("height"),
        F.coalesce("_told.channels", "_channels").cast("long").alias("channels"), F.coalesce("_told.rate", "_rate").cast("long").alias("rate"),
        "timescale", "media_duration", "track_duration", "matrix", F.col("_config.box").alias("config_box"), F.hex("_config.data").alias("config"),
        F.col("_told.key").alias("config_key"), "_told.references", "_told.chroma", "_told.profile", "description", "stts", "stsc", "sizes", "chunks", "sync", "ctts",
    )


def movies(box_rows: DataFrame) -> DataFrame:
    """A row a segment: path, name, movie_timescale, movie_duration, n_mdat, mdat_start, mdat_size, mdats (start, size; by start), error.

    error is the first box that can't be read, else what is wrong with the boxes at the top: more than
    one ``ftyp`` or ``moov``, or none, or fragments.
    """
    p, of = F.col("payload"), lambda *kinds: F.count_if(F.col("type").isin(*kinds) & F.col("track").isNull())
    media = F.when(F.col("type") == "mdat", F.struct("start", "size"))
    top = (
        F.when(of("ftyp") > 1, "multiple ftyp boxes").when(of("moov") > 1, "multiple moov boxes")
        .when(of("moof", "traf", "mfra") > 0, "fragmented MP4 is not supported").when(of("moov") == 0, "no moov box").when(of("ftyp") == 0, "no ftyp box")
    )
    return box_rows.groupBy("path", "name").agg(
        _of("mvhd", F.when(_version(p) == 1, unsigned_be(p, 20, 4)).otherwise(unsigned_be(p, 12, 4))).alias("movie_timescale"),
        _of("mvhd", _long(p, 16, 24)).alias("movie_duration"),
        F.count_if(F.col("type") == "mdat").alias("n_mdat"),
        F.min(F.when(F.col("type") == "mdat", F.col("start"))).alias("mdat_start"),
        F.sum(F.when(F.col("type") == "mdat", F.col("size"))).alias("mdat_size"),
        F.array_sort(F.collect_list(media)).alias("mdats"),
        F.sum(F.when(F.col("type").isin("ftyp", "moov") & F.col("track").isNull(), F.col("size"))).alias("header_size"),
        F.coalesce(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("start"))), top).alias("error"),
    )
