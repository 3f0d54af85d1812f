"""Sample tables in blocks, and the joined file's layout, against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from atelier.plans import layout, timelapse
from atelier.sources import mp4, samples
from tests.test_archives import box, full, u32

KEY = ["path", "name", "track"]


def segment(sizes, runs, uniform=0):
    stsz = full(b"stsz", u32(uniform, len(sizes)), b"" if uniform else u32(*sizes))
    stsc = full(b"stsc", u32(len(runs)), *(u32(first, per, 1) for first, per in runs))
    return box(b"moov", box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", stsz, stsc)))))


def brute(sizes, runs, n_chunks):
    out, at = [], 0
    for k, (first, per) in enumerate(runs):
        for chunk in range(first, runs[k + 1][0] if k + 1 < len(runs) else n_chunks + 1):
            out.append((chunk, at + 1, per, sum(sizes[at : at + per])))
            at += per
    return out


def check(spark, made, block, rows=10_000):
    """made: name -> sizes, runs, n_chunks, uniform."""
    data = [("p", name, bytearray(segment(s, r, u))) for name, (s, r, _, u) in made.items()]
    boxes = mp4.boxes(spark.createDataFrame(data, "path string, name string, data binary"))
    ends = spark.createDataFrame([("p", name, 0, n) for name, (_, _, n, _) in made.items()], "path string, name string, track int, n_chunks long")
    chunks = samples.chunks(samples.chunk_runs(boxes), ends, KEY, rows)
    got = samples.chunk_bytes(chunks, samples.size_tables(boxes), samples.size_blocks(boxes, block), KEY, block)
    expected = [(name, *x) for name, (s, r, n, _) in made.items() for x in brute(s, r, n)]
    assert sorted(map(tuple, got.select("name", "chunk", "first_sample", "n_samples", "bytes").collect())) == sorted(expected)


@pytest.mark.parametrize("block", [4, 512])
def test_bytes_of_chunks(spark, block):
    r = random.Random(block)
    sizes = [r.randrange(10_000) for _ in range(3000)]
    made = {
        "mixed": (sizes, [(1, 2), (5, 1), (9, 700), (12, 3)], 100, 0), "one chunk": (sizes, [(1, 3000)], 1, 0), "uniform": ([9] * 50, [(1, 7)], 9, 9),
        "beyond": (sizes[:10], [(1, 4)], 4, 0), "empty": ([], [], 0, 0),
    }
    check(spark, made, block)


def test_runs_of_a_long_track_are_cut(spark):
    r = random.Random(2)
    runs, chunk = [], 1
    for _ in range(300):
        runs.append((chunk, r.randrange(1, 9)))
        chunk += r.randrange(1, 4)
    sizes = [r.randrange(100) for _ in range(4000)]
    check(spark, {"a": (sizes, runs, chunk + 3, 0)}, 64, rows=20)


def test_a_long_table_is_many_rows(spark):
    n = 1 << 20
    data = [("p", "long", bytearray(segment(range(n), [(1, 1 << 10)])))]
    boxes = mp4.boxes(spark.createDataFrame(data, "path string, name string, data binary"))
    blocks = samples.size_blocks(boxes)
    assert blocks.agg(F.count(F.lit(1)), F.max(F.size("sizes"))).first() == (n // 512, 512)
    ends = spark.createDataFrame([("p", "long", 0, 1 << 10)], "path string, name string, track int, n_chunks long")
    out = samples.chunk_bytes(samples.chunks(samples.chunk_runs(boxes), ends, KEY), samples.size_tables(boxes), blocks, KEY)
    assert tuple(out.agg(F.count(F.lit(1)), F.sum("bytes")).first()) == (1 << 10, n * (n - 1) // 2)


def test_truncated_tables_have_no_rows(spark):
    short = box(b"moov", box(b"trak", full(b"stsz", u32(0, 9), u32(1, 2)), full(b"stsc", u32(5), u32(1, 1, 1)), box(b"stsz", b"\0\0")))
    boxes = mp4.boxes(spark.createDataFrame([("p", "s", bytearray(short))], "path string, name string, data binary"))
    assert not samples.size_blocks(boxes).collect() and not samples.chunk_runs(boxes).collect()


def track_row(number, chunks, kind="vide", duration=10):
    return ("p", 0, number, kind, [1] * len(chunks), chunks, [(len(chunks), 1)], [(1, 1, 1)], None, None, "00" * 10, duration, duration, None, None)


TRACKS = (
    "path string, track int, number long, handler string, sizes array<long>, chunks array<long>, stts array<struct<count: long, delta: long>>, stsc array<struct<first_chunk: long, per_chunk: long, description: long>>,"
    "sync array<long>, ctts array<struct<count: long, offset: long>>, description string, media_duration long, track_duration long, config_box string, references int"
)


@pytest.mark.parametrize("gap,wide", [(-400, False), (-36, False), (-35, True), (100, True)])
def test_an_offset_leaves_32_bits_only_with_the_header(spark, gap, wide):
    """Media before the last chunk ends about 4 GiB, so that the header, its chunk table and the second head of 16 bytes decide."""
    first = (1 << 32) + gap - 500
    tracks = spark.createDataFrame([track_row(1, [8]), track_row(2, [8])], TRACKS)
    movies = spark.createDataFrame([("p", 1, 0, first + 8, 8, 10), ("p", 2, 0, 1 << 33, 8, 10)], "path string, number long, mdat_start long, mdat_size long, mdat_head int, movie_duration long")
    form, offsets = layout.joined_layout(tracks, movies)
    fixed = 24 + 8 + 108 + (32 + 45 + 36 + 92 + 32 + 20 + 18 + 16 + 8 + 16 + 12 + 20 + 16)
    base = [8, first + 8 + 16]
    narrow = fixed + 4 * 2 + base[1] < 1 << 32
    header = fixed + (4 if narrow else 8) * 2
    assert tuple(form.first()) == ("p", 2, header, not narrow, first + (1 << 33) - 8) and wide is not narrow
    assert sorted(r.offset for r in offsets.collect()) == [header + b for b in base]


def test_a_layout_computes_its_segments_once_and_counts_their_tables(spark):
    """What the tracks are made of is costly at size, so neither result may compute them anew."""
    parts = [  # number of samples and chunks, stts, stsc, sync, ctts
        (4, [8, 30], [(2, 5), (2, 6)], [(1, 2, 1)], [1, 3], None), (6, [8, 20, 40], [(6, 6)], [(1, 2, 1)], None, [(6, 0)]),
        (3, [8], [(3, 6)], [(1, 3, 1)], [], [(0, 9), (1, 0), (2, 7)]), (0, [], [], [], None, None),
    ]
    rows = [("p", 0, k, "vide", list(range(n)), chunks, stts, stsc, sync, ctts, "00" * 10, 10, 10, None, None) for k, (n, chunks, stts, stsc, sync, ctts) in enumerate(parts)]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<long>")
    def costly(chunks):
        seen.add(1)
        return chunks

    plain = spark.createDataFrame(rows, TRACKS)
    movies = spark.createDataFrame([("p", k, 0, 108, 8, 10) for k in range(len(parts))], "path string, number long, mdat_start long, mdat_size long, mdat_head int, movie_duration long")
    form, offsets = layout.joined_layout(plain.withColumn("chunks", costly("chunks")), movies)
    merged = {"stts": timelapse.merged_durations(plain), "stsc": timelapse.merged_chunk_runs(plain), "ctts": timelapse.merged_composition(plain), "sync": timelapse.merged_sync(plain)}
    n = {k: df.count() for k, df in merged.items()}
    assert n == {"stts": 2, "stsc": 2, "ctts": 2, "sync": 8} and layout.table_rows(plain).select(*n).first().asDict() == n
    header = 24 + 8 + 108 + (32 + 45 + 36 + 92 + 32 + 20 + 18 + 16 + 8 * 2 + 16 + 12 * 2 + 16 + 4 * 8 + 16 + 8 * 2 + 20 + 4 * 13 + 16) + 4 * 6
    assert tuple(form.first()) == ("p", 6, header, False, 400)
    places = [at - 8 + 108 * k for k, (_, chunks, *_) in enumerate(parts) for at in chunks]
    assert sorted((r.chunk, r.offset) for r in offsets.collect()) == [(k + 1, header + 8 + x) for k, x in enumerate(places)]
    assert seen.value == len(parts)


def test_places_of_many_segments_are_stitched(spark):
    r = random.Random(4)
    sizes = [r.choice([10, 1 << 20, 1 << 32]) for _ in range(200)]
    movies = spark.createDataFrame([("p", k, s + 8, 8) for k, s in enumerate(sizes)], "path string, number long, mdat_size long, mdat_head int")
    got = {x.number: x.base for x in layout.media_places(movies, rows=15).collect()}
    at, expected = 0, {}
    for k, s in enumerate(sizes):
        head = 16 if s + 8 >= 1 << 32 else 8
        expected[k] = at + head
        at += head + s
    assert got == expected
