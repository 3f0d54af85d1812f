"""Resumable runs that are interrupted at every step."""

from __future__ import annotations

import pytest

from atelier.streaming import packing
from tests.test_archives import pack, segment

SEGMENT = "video/segments/segment-{}.mp4".format


def write(folder, name, text):
    (folder / name).write_bytes(pack([("Document.archive", text), (SEGMENT(1), segment()), ("QuickLook/Thumbnail.png", b"p")]))


def packed(spark, out):
    return sorted((r.path.rsplit("/")[-1], r.name, bytes(r.data)) for r in packing.current(spark, out).collect())


def expected(**texts):
    return sorted((f"{n}.procreate", *row) for n, t in texts.items() for row in (("Document.archive", t), ("QuickLook/Thumbnail.png", b"p")))


class Stopped(Exception):
    pass


def stop():
    raise Stopped("stopped on purpose")


@pytest.fixture
def places(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder, "a.procreate", b"one")
    write(folder, "b.procreate", b"two")
    return folder, str(tmp_path / "out"), str(tmp_path / "checkpoint")


def test_a_run_stopped_between_record_and_retirement_ends_the_same(spark, places):
    folder, out, checkpoint = places
    with pytest.raises(Exception, match="stopped on purpose"):
        packing.convert_new(spark, str(folder), out, checkpoint, between=stop)
    log = packing.Log(spark, out)
    assert log.numbers() == [0] and log.exists(f"{out}/projects/batch=0") and packed(spark, out) == expected(a=b"one", b=b"two")
    packing.convert_new(spark, str(folder), out, checkpoint)
    assert log.numbers() == [0] and not log.exists(f"{out}/projects/batch=0") and packed(spark, out) == expected(a=b"one", b=b"two")
    write(folder, "c.procreate", b"three")
    packing.convert_new(spark, str(folder), out, checkpoint)
    assert log.numbers() == [0, 1] and packed(spark, out) == expected(a=b"one", b=b"two", c=b"three")
    packing.convert_new(spark, str(folder), out, checkpoint)
    assert log.numbers() == [0, 1]


def test_a_run_stopped_before_the_record(spark, places, monkeypatch):
    folder, out, checkpoint = places
    with monkeypatch.context() as m:
        m.setattr(packing.Log, "commit", lambda *_: stop())
        with pytest.raises(Exception, match="stopped on purpose"):
            packing.convert_new(spark, str(folder), out, checkpoint)
    log = packing.Log(spark, out)
    assert log.numbers() == [] and packed(spark, out) == expected(a=b"one", b=b"two")  # loose rows count until they are packed
    packing.convert_new(spark, str(folder), out, checkpoint)
    assert log.numbers() == [0] and packed(spark, out) == expected(a=b"one", b=b"two")


def test_records_are_written_once(spark, places):
    _, out, _ = places
    log = packing.Log(spark, out)
    assert log.commit(7, {"part": "x"}) and not log.commit(7, {"part": "y"}) and log.numbers() == [7]
