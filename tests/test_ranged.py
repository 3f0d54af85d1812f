"""The listing source, directories from the ends of files, and ranges of members with checksums of all of them."""

from __future__ import annotations

import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from atelier.functions import checksums
from atelier.plans import timelapse
from atelier.sources import archive, listing, ranged


@pytest.fixture
def tree(tmp_path):
    for name in ("b.procreate", "_a.procreate", ".hidden.procreate", "C.PROCREATE", "note.txt", "sub/_x.procreate", "sub/deep/y.procreate", ".dot/z.procreate", "_under/w.Procreate", "a/v.procreate", "sub.procreate/inner.procreate"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))
    (tmp_path / "link.procreate").symlink_to(tmp_path / "note.txt")
    return tmp_path


def test_a_folder_and_a_tree_in_the_order_of_a_walk(spark, tree):
    flat = listing.listed(spark, str(tree))
    assert [r.name for r in flat.orderBy("name").collect()] == ["C.PROCREATE", "_a.procreate", "b.procreate", "link.procreate"]
    assert {r.length for r in flat.where("name = 'b.procreate'").collect()} == {11}
    deep = listing.listed(spark, f"file://{tree}", recursive=True)
    walk = [r.path[len(f"file://{tree}/") :] for r in deep.orderBy(archive.walk_key(F.col("path"), F.lit(f"file://{tree}"))).collect()]
    assert walk == ["C.PROCREATE", "_a.procreate", "b.procreate", "link.procreate", "_under/w.Procreate", "a/v.procreate", "sub/_x.procreate", "sub/deep/y.procreate", "sub.procreate/inner.procreate"]
    assert deep.rdd.getNumPartitions() == 6
    with pytest.raises(Exception, match="no such folder"):
        listing.listed(spark, f"{tree}/none").collect()


def write(path, method, sizes, seed=1):
    r = random.Random(seed)
    data = {f"video/segments/segment-{k}.mp4": r.randbytes(n) for k, n in enumerate(sizes, 1)}
    with zipfile.ZipFile(path, "w", method) as z:
        for name, content in data.items():
            z.writestr(name, content)
    return data


def test_directories_read_the_end_only(spark, tmp_path):
    write(tmp_path / "small.procreate", zipfile.ZIP_STORED, [10, 20])
    write(tmp_path / "large.procreate", zipfile.ZIP_STORED, [10, 30_000_000])
    (tmp_path / "bad.procreate").write_bytes(b"no archive")
    found = ranged.directories(listing.listed(spark, str(tmp_path)))
    read = {r.path.rsplit("/")[-1]: r.n for r in found.groupBy("path").agg(F.max("read_bytes").alias("n")).collect()}
    assert read["large.procreate"] < 70_000 and read["small.procreate"] < 70_000 and read["bad.procreate"] is None
    has = {r.path.rsplit("/")[-1]: r.has_timelapse for r in archive.has_timelapse(found, timelapse.SEGMENT).collect()}
    assert has == {"small.procreate": True, "large.procreate": True, "bad.procreate": False}
    assert found.where("error IS NOT NULL").count() == 1


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_ranges_and_damage(spark, tmp_path, method):
    path = tmp_path / "x.procreate"
    data = write(path, method, [0, 5, 1000, 100_000])
    files = listing.listed(spark, str(tmp_path))
    get = lambda start, size: {r.name: (r.data and bytes(r.data), r.error) for r in ranged.members(ranged.directories(files), start, size, piece=999).collect()}
    for start, size in ((0, 5), (995, 5), (990, 3000)):
        expected = {n: (d[start : start + size], None) if len(d) >= start + size else (None, "range beyond the member") for n, d in data.items()}
        assert get(start, size) == {n: (d, e) for n, (d, e) in expected.items()}
    raw = bytearray(path.read_bytes())
    with zipfile.ZipFile(path) as z:
        last = z.infolist()[-1]
    raw[last.header_offset + 30 + len(last.filename) + last.compress_size - 1000] ^= 1
    path.write_bytes(raw)
    name = "video/segments/segment-4.mp4"
    got = get(0, 5)
    assert got[name][0] is None and got[name][1] and got["video/segments/segment-3.mp4"][0] == data["video/segments/segment-3.mp4"][:5]


def test_checksums_of_pieces_combine(spark):
    r = random.Random(2)
    pieces = [r.randbytes(r.choice([0, 1, 5, 1000, 70_000])) for _ in range(30)]
    after, rows = 0, []
    for p in reversed(pieces):
        rows.append((zlib.crc32(p), after))
        after += len(p)
    df = spark.createDataFrame(rows, "crc long, after long").repartition(4)
    assert df.agg(checksums.joined_crc(F.col("crc"), F.col("after"))).first()[0] == zlib.crc32(b"".join(pieces))
    assert checksums.moved(zlib.crc32(b"ab"), 3) ^ zlib.crc32(b"cde") == zlib.crc32(b"abcde")
