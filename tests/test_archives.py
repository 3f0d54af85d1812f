"""Archives, segments and the plan of their concatenation, on files made here."""

from __future__ import annotations

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from atelier.plans import timelapse
from atelier.sources import archive, mp4
from atelier.streaming import folders


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind, *parts, version=0):
    return box(kind, bytes([version, 0, 0, 0]), *parts)


def u32(*values):
    return struct.pack(f">{len(values)}I", *values)


def track(i, handler, entry, timescale, delta, sizes, offset, sync):
    stbl = [
        full(b"stsd", u32(1), entry), full(b"stts", u32(1, len(sizes), delta)), full(b"stsc", u32(1, 1, len(sizes), 1)),
        full(b"stsz", u32(0, len(sizes), *sizes)), full(b"stco", u32(1, offset)),
    ]
    if sync:
        stbl.append(full(b"stss", u32(len(sync), *sync)))
    tkhd = full(b"tkhd", u32(0, 0, i, 0, 0), bytes(52), u32(320 << 16, 240 << 16))
    mdhd = full(b"mdhd", u32(0, 0, timescale, delta * len(sizes), 0))
    hdlr = full(b"hdlr", u32(0), handler, bytes(13))
    return box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, box(b"minf", box(b"stbl", *stbl))))


def segment(video=(10, 20), audio=(5,), sync=None, config=b"cfg1", fourcc=b"avc1"):
    avc = box(fourcc, bytes(78), box(b"avcC", config))
    aac = box(b"mp4a", bytes(16), struct.pack(">HHI", 2, 16, 0), struct.pack(">I", 44100 << 16), box(b"esds", b"e"))
    make = lambda at: box(
        b"moov", full(b"mvhd", u32(0, 0, 30, 30 * len(video)), bytes(80)), track(1, b"vide", avc, 30, 30, video, at, sync),
        *([track(2, b"soun", aac, 44100, 1024, audio, at + sum(video), None)] if audio else []),
    )
    ftyp = box(b"ftyp", b"isom")
    at = len(ftyp) + len(make(0)) + 8
    return ftyp + make(at) + box(b"mdat", bytes(sum(video) + sum(audio)))


def pack(names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in names:
            z.writestr(name, data)
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    seg = "video/segments/segment-{}.mp4".format
    files = {
        "good.procreate": [("Document/document.data", b"d"), ("video/segments/", b""), (seg(1), segment()), (seg(10), segment(sync=[1])), (seg(2), segment((1, 2, 3)))],
        "gap.Procreate": [(seg(n), b"x") for n in (1, 3, 7)] + [("video/segments/outtake.mp4", b"x")],
        "clash.procreate": [("video/segments/segment-1.mp4", b"x"), ("VIDEO/Segments/Segment-0001.MP4", b"x")],
        "stray.procreate": [("video/segments/outtake.mp4", b"x")],
        "none.procreate": [("video/active-0.mp4", b"x")],
        "odd.procreate": [(seg(1), segment()), (seg(2), segment(config=b"cfg2")), (seg(3), segment(audio=()))],
    }
    for name, members in files.items():
        (tmp_path / name).write_bytes(pack(members))
    (tmp_path / "bad.procreate").write_bytes(b"no zip")
    (tmp_path / "other.txt").write_bytes(b"t")
    return tmp_path


def name(path):
    return path.rsplit("/", 1)[-1].split(".")[0]


def test_listing(spark, folder):
    got = {name(r.path): r for r in timelapse.listing(archive.members(archive.artworks(spark, str(folder)))).collect()}
    assert {k: r.code for k, r in got.items()} == {"good": 0, "gap": 0, "clash": 5, "stray": 5, "none": 4, "odd": 0, "bad": 3}
    assert (got["gap"].missing, got["gap"].n_ignored, got["clash"].clash) == ("2, 4-6", 1, 1)
    assert got["gap"].problem == "segment numbers missing: 2, 4-6 (the video would have gaps)"
    assert (got["good"].n_segments, got["good"].first, got["good"].last, got["good"].missing) == (3, 1, 10, "3-9")


def test_slimming_keeps_all_but_segments(spark, folder):
    members = archive.members(archive.artworks(spark, str(folder)))
    kept = {(name(r.path), r.name) for r in timelapse.slim_members(members).where("name is not null").collect()}
    assert ("none", "video/active-0.mp4") in kept and ("good", "video/segments/") in kept and not any("segment-" in n for _, n in kept)
    totals = {name(r.path): (r.kept, r.removed, r.removed_bytes) for r in timelapse.slim_totals(members).collect()}
    assert totals["gap"] == (1, 3, 3)


def segments(spark, folder, which):
    files = archive.artworks(spark, str(folder)).where(F.col("path").contains(which))
    boxes = mp4.boxes(archive.contents(files, r"(?i)video/segments/segment-[0-9]+\.mp4"))
    number = timelapse.segment_number(F.col("name")).alias("number")
    return mp4.tracks(boxes).withColumn("number", number), mp4.movies(boxes).withColumn("number", number)


def test_tracks_and_movies(spark, folder):
    tracks, movies = segments(spark, folder, "good")
    rows = {(r.number, r.track): r for r in tracks.collect()}
    v, a = rows[2, 0], rows[2, 1]
    assert (v.handler, v.fourcc, v.width, v.height, v.timescale, v.media_duration) == ("vide", "avc1", 320, 240, 30, 90)
    assert (a.handler, a.fourcc, a.channels, a.rate, a.timescale) == ("soun", "mp4a", 2, 44100, 44100)
    assert [tuple(e) for e in v.stts] == [(3, 30)] and [tuple(e) for e in v.stsc] == [(1, 3, 1)] and v.sizes == [1, 2, 3] and v.sync is None
    assert rows[10, 0].sync == [1] and bytes.fromhex(v.config).endswith(b"cfg1")
    assert {(r.number, r.movie_timescale, r.movie_duration, r.n_mdat, r.mdat_size, r.error) for r in movies.collect()} == {
        (1, 30, 60, 1, 43, None), (2, 30, 90, 1, 19, None), (10, 30, 60, 1, 43, None)
    }


def test_plan_of_the_joined_file(spark, folder):
    tracks, movies = segments(spark, folder, "good")
    assert timelapse.compatibility(tracks).isEmpty()
    assert {(r.track, r.delta, r["count"]) for r in timelapse.merged_durations(tracks).collect()} == {(0, 30, 7), (1, 1024, 3)}
    assert sorted((r.track, r.sample) for r in timelapse.merged_sync(tracks).collect()) == [(0, s) for s in (1, 2, 3, 4, 5, 6)]
    runs = sorted((r.track, r.first_chunk, r.per_chunk) for r in timelapse.merged_chunk_runs(tracks).collect())
    assert runs == [(0, 1, 2), (0, 2, 3), (0, 3, 2), (1, 1, 1)]
    sizes = {(r.number, r.track): r.bytes for r in timelapse.chunk_bytes(tracks).collect()}
    assert sizes == {(1, 0): 30, (1, 1): 5, (2, 0): 6, (2, 1): 5, (10, 0): 30, (10, 1): 5}
    offsets = sorted((r.track, r.chunk, r.offset, r.fits) for r in timelapse.merged_offsets(tracks, movies).collect())
    assert offsets == [(0, 1, 8, True), (0, 2, 51, True), (0, 3, 70, True), (1, 1, 38, True), (1, 2, 57, True), (1, 3, 100, True)]
    d = timelapse.durations(movies).first()
    assert (d.seconds, d.seconds_by_segment) == (7.0, 7.0)


def test_what_does_not_match_the_first(spark, folder):
    tracks, _ = segments(spark, folder, "odd")
    got = {r.number: r.problem for r in timelapse.compatibility(tracks).collect()}
    assert got == {2: 'field "avcC" differs', 3: 'field "stream count" differs'}


def test_damaged_boxes_are_rows(spark):
    df = spark.createDataFrame([("p", "n", bytearray(segment()[:60])), ("p", "m", bytearray())], "path string, name string, data binary")
    assert [r.error is not None for r in mp4.movies(mp4.boxes(df)).collect()] == [True]


def test_stream_lists_each_archive_once(spark, folder, tmp_path_factory):
    out, done = str(tmp_path_factory.mktemp("out")), str(tmp_path_factory.mktemp("done"))
    folders.list_new(spark, str(folder), out, done)
    assert spark.read.parquet(out).count() == 7
    (folder / "new.procreate").write_bytes(pack([("video/segments/segment-5.mp4", b"x")]))
    folders.list_new(spark, str(folder), out, done)
    assert spark.read.parquet(out).count() == 8


def test_walk_order(spark):
    paths = ["r/b/x", "r/a", "r/c", "r/b/a/z", "r/b/y", "r/a2/q"]
    df = spark.createDataFrame([(p,) for p in paths], "path string").orderBy(archive.walk_key(F.col("path"), F.lit("r")))
    assert [r.path for r in df.collect()] == ["r/a", "r/c", "r/a2/q", "r/b/x", "r/b/y", "r/b/a/z"]
