"""Segment checks, codec configurations, coverage profiles and folder runs, on cases made here."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from atelier.functions import binary, codecs
from atelier.operators import names, sequences, trees
from atelier.plans import batch, checks, timelapse
from atelier.sources import archive, coverage, mp4
from tests.test_archives import box, full, pack, segment, u32

# Parameter sets of one recording's quiet and busy segments, and the picture set that they share.
QUIET = bytes.fromhex("27640020ac56c04402269a8080808 1".replace(" ", ""))
BUSY = bytes.fromhex("27640020ac56501100 89a6a0202020 40".replace(" ", ""))
PICTURE = bytes.fromhex("28ee3cb0")


def avc(sets, picture=PICTURE, profile=100, tail=b""):
    body = b"".join(struct.pack(">H", len(s)) + s for s in sets)
    return bytes([1, profile, 0x60, 32, 0xFF, 0xE0 | len(sets)]) + body + bytes([1]) + struct.pack(">H", len(picture)) + picture + tail


def golomb(n):
    return "0" * ((n + 1).bit_length() - 1) + f"{n + 1:b}"


def baseline(references, width=19, level=30):
    bits = "00100111" + f"{66:08b}" + "0" * 8 + f"{level:08b}" + golomb(0) * 4 + golomb(references) + "0" + golomb(width) + golomb(14) + "1111" + "1"
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


@pytest.mark.parametrize(
    "a,b,same",
    [
        (avc([QUIET]), avc([QUIET]), True), (avc([QUIET]), avc([BUSY]), True), (avc([BUSY]), avc([QUIET]), True),
        (avc([baseline(2)], profile=66), avc([baseline(4)], profile=66), True), (avc([baseline(2)]), avc([baseline(2)], b"\x27\x05\xec"), False),
        (avc([baseline(2)], profile=66), avc([baseline(2)]), False), (avc([QUIET]), avc([BUSY[:3] + b"\x1f" + BUSY[4:]]), False),
        (avc([baseline(2)]), avc([baseline(4, width=20)]), False), (avc([QUIET]), avc([QUIET, QUIET]), False),
        (avc([QUIET], tail=b"\xfd\xf8\xf8\0"), avc([QUIET], tail=b"\xfd\xf8\xf8\0"), True), (avc([QUIET], tail=b"\xfd\xf8\xf8\0"), avc([QUIET], tail=b"\xfe\xf8\xf8\0"), False),
        (avc([QUIET])[:5], avc([BUSY]), False), (avc([QUIET[:4]]), avc([QUIET]), False), (b"\1\2\3", avc([QUIET]), False),
    ],
)
def test_configurations_that_can_be_joined(a, b, same):
    assert (codecs.read_config("avcC", a)[0] == codecs.read_config("avcC", b)[0]) == same


def test_what_configurations_tell():
    assert codecs.read_config("avcC", avc([QUIET]))[1:4] == (2, 1, 100) and codecs.read_config("avcC", avc([BUSY]))[1] == 4
    audio = bytes(4) + b"\x04\x0f" + bytes(13) + bytes([2 << 3 | 4, 0x20])
    assert codecs.read_config("esds", audio)[4:] == (44100, 2)
    assert codecs.read_config("esds", audio[:-1])[4:] == (None, None) and codecs.read_config("esds", b"e")[4:] == (None, None)
    assert codecs.read_config("esds", bytes(4) + b"\x03\x80" * 5000)[4:] == (None, None)
    assert codecs.read_config(None, None) == ("", None, None, None, None, None)


def parsed(spark, *segments):
    rows = [("p", f"video/segments/segment-{i}.mp4", bytearray(s)) for i, s in enumerate(segments, 1)]
    boxes = mp4.boxes(spark.createDataFrame(rows, "path string, name string, data binary"))
    number = timelapse.segment_number(F.col("name")).alias("number")
    return mp4.tracks(boxes).withColumn("number", number), mp4.movies(boxes).withColumn("number", number)


def joined(*boxes_):
    return b"".join(boxes_)


def test_wide_numbers_and_hostile_boxes(spark):
    entry = box(b"avc1", bytes(24), struct.pack(">HH", 640, 480), bytes(50), box(b"avcC", avc([BUSY])))
    wide = struct.pack(">Q", (4 << 30) + 7)
    stbl = box(
        b"stbl", full(b"stsd", u32(1), entry), full(b"stts", u32(1, 2, 5)), full(b"stsc", u32(1, 1, 2, 1)), full(b"stsz", u32(9, 2)), full(b"co64", u32(1), wide),
        full(b"ctts", u32(2, 1, 3, 1, 2**32 - 4), version=1),
    )
    mdhd = full(b"mdhd", bytes(16), u32(30), struct.pack(">Q", (4 << 30) + 5), u32(0), version=1)
    trak = box(b"trak", full(b"tkhd", u32(0, 0, 1, 0, 6), bytes(52), u32(1 << 16, 1 << 16)), box(b"mdia", mdhd, full(b"hdlr", u32(0), b"vide", bytes(13)), box(b"minf", stbl)))
    mvhd = full(b"mvhd", bytes(16), u32(600), struct.pack(">Q", (4 << 30) + 3), bytes(80), version=1)
    good = joined(box(b"ftyp", b"isom"), box(b"moov", mvhd, trak), box(b"mdat", bytes(18)))
    huge = good.replace(full(b"stsz", u32(9, 2)), full(b"stsz", u32(9, 2**31))).replace(u32(1, 2, 5), u32(2**31, 2, 5))
    deep = b""
    for _ in range(1500):
        deep = box(b"moov", deep)
    tracks, movies = parsed(spark, good, huge, deep)
    t = {r.number: r for r in tracks.collect()}
    m = {r.number: r for r in movies.collect()}
    assert (t[1].chunks, t[1].media_duration, t[1].timescale, m[1].movie_duration, m[1].movie_timescale) == ([(4 << 30) + 7], (4 << 30) + 5, 30, (4 << 30) + 3, 600)
    assert (t[1].width, t[1].height, t[1].rate, t[1].channels, t[1].references) == (640, 480, None, None, 4)
    assert t[1].sizes == [9, 9] and [tuple(c) for c in t[1].ctts] == [(1, 3), (1, -4)]
    assert t[2].sizes is None and t[2].stts is None and "nested too deep" in m[3].error
    assert [r.streams for r in timelapse.streams_summary(tracks.where("number = 1")).collect()] == ["video h264 640x480 yuv420p"]


def test_every_rule_of_a_track(spark):
    fine = dict(handler="vide", fourcc="avc1", track_id=1, timescale=30, sizes=[5, 5, 5], chunks=[108, 120], stts=[(3, 1)], stsc=[(1, 2, 1), (2, 1, 1)], sync=[1, 3])
    cases = {
        None: {}, 'handler "text"': {"handler": "text"}, "mdhd timescale is zero": {"timescale": 0}, "tkhd track id is zero": {"track_id": 0}, "truncated sample tables": {"stts": None},
        "video track has no samples": {"sizes": []}, "no chunk structure (stsc)": {"stsc": []}, "stsc does not start at chunk 1": {"stsc": [(2, 3, 1)]},
        "stsc entries out of order": {"stsc": [(1, 2, 1), (1, 1, 1)]}, "stsc entry with zero samples": {"stsc": [(1, 0, 1), (2, 3, 1)]}, "stsc covers 4 samples, stsz has 3": {"stsc": [(1, 2, 1)]},
        "stsc extends past the 2 chunks": {"handler": "soun", "sizes": [], "stsc": [(1, 1, 1), (4, 1, 1)]}, "stts covers 2 samples, stsz has 3": {"stts": [(2, 1)]},
        "bad sync sample table": {"sync": [1, 1]}, "chunk offsets not ascending": {"chunks": [120, 108]}, "chunk offset 99 outside mdat [108,150)": {"chunks": [99, 120]},
        "sample data larger than mdat": {"sizes": [5, 5, 50]},
    }
    keys = "handler fourcc track_id timescale sizes chunks stts stsc sync".split()
    rows = [("p", str(i), 0, *(({**fine, **change})[k] for k in keys)) for i, change in enumerate(cases.values())]
    schema = "path string, name string, track int, handler string, fourcc string, track_id long, timescale long, sizes array<long>, chunks array<long>, stts array<struct<count:long,delta:long>>, stsc array<struct<first_chunk:long,per_chunk:long,description:long>>, sync array<long>"
    tracks = spark.createDataFrame(rows, schema)
    movies = spark.range(len(cases)).select(F.lit("p").alias("path"), F.col("id").cast("string").alias("name"), F.array(F.struct(F.lit(100).cast("long").alias("start"), F.lit(50).cast("long").alias("size"))).alias("mdats"))
    got = {int(r.name): r.problem for r in checks.track_problems(tracks, movies).collect()}
    assert got == {i: p for i, p in enumerate(cases) if p}


def test_boxes_of_a_segment(spark):
    good = segment()
    ftyp, moov, mdat = good[:12], good[12 : good.index(b"mdat") - 4], good[good.index(b"mdat") - 4 :]
    silent = segment(audio=())
    segments = [good, ftyp + ftyp + moov + mdat, ftyp + moov + moov + mdat, ftyp + moov + box(b"moof") + mdat, ftyp + mdat, moov + mdat, ftyp + moov, good + box(b"mdat", b"x"), silent.replace(b"vide", b"soun")]
    tracks, movies = parsed(spark, *segments)
    name = lambda r: int(r.name.rsplit("-")[-1].removesuffix(".mp4"))
    got = {name(r): r.problem for r in checks.segment_problems(tracks, movies).collect()}
    assert {k: v for k, v in got.items() if k not in (2, 3, 6)} == {4: "fragmented MP4 is not supported", 5: "no moov box", 7: "no media data (mdat)"}
    assert (got[2], got[3], got[6]) == ("multiple ftyp boxes", "multiple moov boxes", "no ftyp box")
    convert = {name(r): r.problem for r in checks.segment_problems(tracks, movies, to_convert=True).collect()}
    assert convert[8] == "not one media box" and convert[9] == "no video track" and 1 not in convert
    totals = checks.verify(tracks, movies).first()
    assert (totals.n_good, totals.n_failed, totals.first_problem, totals.seconds) == (3, 6, "multiple ftyp boxes", 6.0)


def test_a_time_scale_of_zero_is_a_problem_not_the_end_of_the_job(spark):
    zero = segment().replace(full(b"mvhd", u32(0, 0, 30))[:20], full(b"mvhd", u32(0, 0, 0))[:20])
    zero = zero if zero != segment() else segment().replace(u32(0, 0, 30, 60), u32(0, 0, 0, 60), 1)
    tracks, movies = parsed(spark, segment(), zero)
    assert sorted(r.movie_timescale for r in movies.collect()) == [0, 30]
    assert [(r.name[-5], r.problem) for r in checks.segment_problems(tracks, movies).collect()] == [("2", "mvhd timescale is zero")]
    totals = checks.verified(tracks, movies).first()
    assert (totals.n_good, totals.n_failed, totals.seconds, totals.code) == (1, 1, 2.0, 5)
    assert timelapse.durations(movies.where("number = 2")).first().seconds is None


def test_reports_have_a_line_a_segment(spark):
    tracks, movies = parsed(spark, segment(), segment(video=(1, 2, 3)))
    label = spark.createDataFrame([("p", "p.procreate"), ("q", "q.procreate")], "path string, label string")
    lines = [r.line for r in checks.verify_report(tracks, movies, label).orderBy("section", "number").collect()]
    assert lines[:3] == ["input: p.procreate", "segments: 2", ""] and lines[-2:] == ["", "verify: ok, 2 segment(s), ~5.0 s of video"]
    assert lines[3].startswith("1 ok    video h264 320x240 ") and lines[3].endswith(", audio aac 44100Hz 2ch  2.00s  video/segments/segment-1.mp4") and "  3.00s  " in lines[4]
    other = parsed(spark, segment(), segment(fourcc=b"avc3"))
    report = [r.line for r in checks.verify_report(*other, label).orderBy("section", "number").collect()]
    assert len(report) == 5 and checks.verified(*other).first().incompatible == '2: field "codec fourcc" differs'
    names = movies.select("path", "name", (F.col("number") * 50).alias("number"))
    listed = [(r.path, r.line) for r in checks.listing_report(names, label).orderBy("path", "section", "number").collect()]
    assert listed == [("p", "input: p.procreate"), ("p", "segments: 2"), ("p", ""), ("p", "50  video/segments/segment-1.mp4"), ("p", "100 video/segments/segment-2.mp4"), ("q", "input: q.procreate"), ("q", "segments: 0")]


def test_an_archive_of_strays_is_listed_as_one_without_video(spark):
    rows = [("a", "video/segments/take1.mp4", False, None), ("b", "Document.archive", False, None)]
    members = spark.createDataFrame(rows, "path string, name string, is_dir boolean, error string")
    assert {r.path: r.code for r in timelapse.listing(members).collect()} == {"a": 5, "b": 4}
    report = timelapse.listing(members, to_convert=False)
    assert {r.path: r.code for r in report.collect()} == {"a": 4, "b": 4} and tuple(batch.diagnosed(report).first()) == (0, 2, 0, 0)


def test_all_fields_are_compared_in_order(spark):
    one = segment(config=avc([QUIET]))
    tracks, movies = parsed(spark, one, segment(config=avc([BUSY])), one.replace(full(b"mvhd", u32(0, 0, 30)), full(b"mvhd", u32(0, 0, 60))), segment(config=avc([baseline(2)]), fourcc=b"avc3"))
    got = {r.number: r.problem for r in timelapse.compatibility(tracks, movies).collect()}
    assert got == {4: 'fields "codec fourcc", "avcC" differ'} or got == {3: 'field "mvhd timescale" differs', 4: 'fields "codec fourcc", "avcC" differ'}
    assert {r.track: r.number for r in timelapse.joined_description(tracks.where("number < 3")).collect()} == {0: 2, 1: 1}


PROFILES = (
    ["mode: set", "demo/m/lib/p.go:10.2,12.3 2 1", "demo/m/lib/p.go:14.2,15.1 1 0", "demo/m/lib/q.go:5.2,6.1 1 0", ""],
    ["mode: set", "demo/m/lib/q.go:5.2,6.1 1 1", "demo/m/r.go:1.1,3.2 3 7"],
)


def test_two_profiles(spark, tmp_path):
    for k, lines in enumerate(PROFILES):
        (tmp_path / f"{k}.out").write_text("\n".join(lines))
    union = coverage.merged(coverage.blocks(coverage.read_profiles(spark, str(tmp_path))))
    assert {r.pos: r["count"] for r in union.collect()} == {"demo/m/lib/p.go:10.2,12.3": 1, "demo/m/lib/p.go:14.2,15.1": 0, "demo/m/lib/q.go:5.2,6.1": 1, "demo/m/r.go:1.1,3.2": 7}
    lines = coverage.line_hits(union, "demo/m/")
    rates = {(r.package, r.file): (r.valid, r.covered, r.rate) for r in coverage.rates(lines).collect()}
    assert rates == {(None, None): (10, 8, 0.8), ("lib", None): (7, 5, 0.7143), (".", None): (3, 3, 1.0), ("lib", "lib/p.go"): (5, 3, 0.6), ("lib", "lib/q.go"): (2, 2, 1.0), (".", "r.go"): (3, 3, 1.0)}
    merged_path, report = str(tmp_path / "merged"), str(tmp_path / "report")
    coverage.write_text(coverage.profile_text(union), ["place", "value"], merged_path)
    assert coverage.blocks(coverage.read_profiles(spark, merged_path)).count() == 4
    coverage.write_text(coverage.cobertura(lines), ["key"], report)
    import xml.etree.ElementTree as ET

    text = "\n".join(r.value for r in coverage.cobertura(lines).orderBy("key").collect())
    root = ET.fromstring(text)
    assert (root.get("line-rate"), root.get("lines-covered"), root.get("lines-valid")) == ("0.8000", "8", "10")
    assert [(p.get("name"), [c.get("filename") for c in p.iter("class")]) for p in root.iter("package")] == [(".", ["r.go"]), ("lib", ["lib/p.go", "lib/q.go"])]
    assert [(x.get("number"), x.get("hits")) for x in root.iter("line")][:3] == [("1", "7"), ("2", "7"), ("3", "7")]


@pytest.mark.parametrize("line", ["a.go:1.2,3.4 1", "a.go:1,3.4 1 1", "a.go:1.2,3.4 x 1", "nonsense"])
def test_bad_profile_lines_end_the_job(spark, line):
    df = spark.createDataFrame([("f", line)], "profile string, text string")
    assert coverage.parsed(df).first().problem.startswith("malformed")
    with pytest.raises(Exception, match="malformed profile line"):
        coverage.blocks(df).collect()


def test_a_folder_with_failures(spark, tmp_path):
    seg = "video/segments/segment-{}.mp4".format
    source = tmp_path / "input"
    source.mkdir()
    three = pack([(seg(i), segment()) for i in (1, 2, 3)])
    (source / "a.procreate").write_bytes(three)
    (source / "b.procreate").write_bytes(pack([("Document/document.data", b"d")]))
    (source / "c.procreate").write_bytes(b"definitely not a zip")
    at = three.index(b"mdat") + 6
    (source / "d.procreate").write_bytes(three[:at] + bytes([three[at] ^ 1]) + three[at + 1 :])
    files = archive.artworks(spark, str(source))
    listing = timelapse.listing(archive.members(files))
    held = archive.contents(files, r"(?i)video/segments/segment-[0-9]+\.mp4")
    boxes = mp4.boxes(held.where("error IS NULL"))
    number = timelapse.segment_number(F.col("name")).alias("number")
    wrong = checks.segment_problems(mp4.tracks(boxes), mp4.movies(boxes), to_convert=True).select("path", number, "problem")
    damaged = held.where("error IS NOT NULL").select("path", number, F.concat(F.lit("segment "), "name", F.lit(" is corrupted inside the archive")).alias("problem"))
    folder = files.select("path").first().path.rsplit("/", 1)[0]
    plan = batch.planned(files, folder, "out")
    none = spark.createDataFrame([], "path string")
    ended = batch.results(batch.to_do(plan, none, listing), listing, wrong.union(damaged))
    assert {r.path[-11]: r.status for r in ended.collect()} == {"a": "converted", "b": "no_video", "c": "failed", "d": "failed"}
    assert tuple(batch.counters(ended).first()) == (1, 0, 1, 2, 1, False)
    done = spark.createDataFrame([("out/mp4/a.mp4",), ("out/procreate/a.slim.procreate",), ("out/procreate/b.slim.procreate",), ("out/mp4/d.mp4",)], "path string")
    actions = {r.path[-11]: r.action for r in batch.to_do(plan, done, listing).collect()}
    assert actions == {"a": "skip", "b": "skip", "c": "convert", "d": "regenerate"}
    assert {r.action for r in batch.to_do(plan, done, listing, force=True).collect()} == {"convert"}
    assert tuple(batch.diagnosed(listing).first()) == (2, 1, 1, 1)
    reports = {r.path[-11]: r.report for r in batch.listing_text(listing).collect()}
    assert reports["a"] == "3 segments, numbers 1-3" and reports["b"] == "no timelapse video inside" and "not a ZIP" in reports["c"]


def test_where_results_go():
    assert (batch.default_output("/x/y/Art/"), batch.default_output("/"), batch.default_output(".")) == ("Art_slim", "output", "output")
    assert batch.nesting_problem("/in", "/in/", False) and batch.nesting_problem("/in", "/in/out", True)
    assert not batch.nesting_problem("/in", "/input", True) and not batch.nesting_problem("/in", "/in/out", False)


def test_members_by_name_and_range(spark, tmp_path):
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # two members have one name
        (tmp_path / "x.procreate").write_bytes(pack([("a", b"first"), ("a", b"second"), ("b", b"0123456789")]))
    held = archive.contents(archive.artworks(spark, str(tmp_path)), "[ab]")
    assert {r.name: bytes(r.data) for r in archive.first_of_name(held).collect()} == {"a": b"first", "b": b"0123456789"}
    cut = {r.name: (r.data and bytes(r.data), r.error) for r in archive.ranged(archive.first_of_name(held), 2, 5).collect()}
    assert cut == {"a": (None, "range beyond the member"), "b": (b"23456", None)}


def test_numbers_of_eight_bytes(spark):
    df = spark.createDataFrame([(bytearray(bytes.fromhex("00000001000000078000000000000000")),)], "b binary")
    b = F.col("b")
    got = df.select(binary.unsigned_be(b, 0, 8), binary.unsigned_be(b, 8, 8), binary.unsigned_be(b, 9, 8), binary.signed_be(b, 8), binary.unsigned_be_array(b, 0, 8, 8, F.lit(2**31))).first()
    assert tuple(got) == ((1 << 32) + 7, None, None, -(1 << 31), None)


def test_folds_in_blocks_and_runs_over_stretches(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), "id", (F.col("id") * 7 % 11).alias("v"))
    got = {r.g: r.folded for r in sequences.fold(df, ["g"], "id", "v", F.lit(5), lambda s, v: (s * 3 + v) % 50, states=50, width=40).collect()}
    expected = {}
    for g in range(3):
        s = 5
        for i in range(g, 500, 3):
            s = (s * 3 + i * 7 % 11) % 50
        expected[g] = s
    assert got == expected
    keys = spark.createDataFrame([("a", 1), ("a", 4), ("a", 30), ("b", 2), (None, 3)], "g string, lo long")
    rows = [(r.g, r.lo, r["at"]) for r in sequences.expand_runs(keys, ["g"], "lo", F.lit(32), width=8).collect()]
    want = [("a", 1, i) for i in range(1, 4)] + [("a", 4, i) for i in range(4, 30)] + [("a", 30, i) for i in range(30, 33)] + [("b", 2, i) for i in range(2, 33)] + [(None, 3, i) for i in range(3, 33)]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    placed = sequences.numbered(df.select("id").orderBy(F.rand(3)), ["id"]).collect()
    assert all(r.place == r.id + 1 for r in placed) and len(placed) == 500


def test_many_equal_names_and_wide_trees(spark):
    given = spark.range(30_000).select("id", F.when(F.col("id") == 7, "a-3").otherwise("a").alias("base"))
    got = {r.id: r.name for r in names.collision_names(given, F.lit(""), F.col("base"), "id").collect()}
    assert len(set(got.values())) == 30_000 and (got[0], got[1], got[2], got[7]) == ("a", "a-2", "a-3", "a-3-2")
    nodes = spark.range(1, 20_001).select(F.lit(0).alias("tree"), "id", F.when(F.col("id") > 1, (F.col("id") / 10).cast("long") + 1 - (F.col("id") < 10).cast("long")).alias("parent"), F.col("id").cast("int").alias("ord"))
    nodes = nodes.withColumn("parent", F.when(F.col("id") > 1, F.greatest(F.lit(1), F.floor(F.col("id") / 10))).cast("long"))
    assert trees.flatten(nodes).count() == 20_000
