"""Codec configurations: what two segments must share to be joined without re-encoding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Profiles whose parameter sets name their chroma format, and the sampling rates of audio configurations.
WITH_CHROMA = frozenset((44, 83, 86, 100, 110, 118, 122, 128, 134, 135, 138, 139, 244))
RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 11025, 8000, 7350)
CODECS = {
    "avc1": "h264", "avc3": "h264", "hvc1": "hevc", "hev1": "hevc", "vp09": "vp9", "av01": "av1",
    "mp4a": "aac", "ac-3": "ac3", "ac-4": "ec3", "alac": "alac", "Opus": "opus", "flac": "flac",
}
PROFILES = {66: "baseline", 77: "main", 88: "extended", 100: "high", 110: "high 10", 122: "high 4:2:2", 244: "high 4:4:4 predictive"}
PIXELS = {0: "gray", 1: "yuv420p", 2: "yuv422p", 3: "yuv444p"}
#: Descriptors of an audio configuration may be nested so deep.
DEPTH = 64
CONFIG = "key string, references int, chroma int, profile int, rate int, channels int"


def _named(names: dict, value: Column, other: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, value), other)


def codec_name(fourcc: Column) -> Column:
    """Name of a codec as reports have it; an unknown one is its four characters."""
    return _named(CODECS, fourcc, fourcc)


def profile_name(profile: Column) -> Column:
    return _named(PROFILES, profile.cast("int"), F.concat(F.lit("profile "), profile.cast("string")))


def pixel_format(handler: Column, config_box: Column, chroma: Column) -> Column:
    """Empty for other tracks than video; unknown where the configuration doesn't tell."""
    known = F.when(config_box == "avcC", _named(PIXELS, chroma.cast("int"), F.lit("unknown"))).otherwise("unknown")
    return F.when(handler == "vide", known).otherwise("")


class Bits:
    """A string of bits, read from the front. Reading beyond its end is an IndexError."""

    def __init__(self, data: bytes, at: int = 0):
        self.bits, self.at = "".join(f"{b:08b}" for b in data), at

    def unsigned(self, n: int = 1) -> int:
        if self.at + n > len(self.bits):
            raise IndexError("out of bits")
        self.at += n
        return int(self.bits[self.at - n : self.at], 2)

    def golomb(self) -> int:
        """An unsigned exponential Golomb code of up to 31 leading zeros."""
        one = self.bits.find("1", self.at)
        zeros = one - self.at
        if one < 0 or zeros > 31:
            raise IndexError("no code")
        self.at = one
        return self.unsigned(zeros + 1) - 1


def parameter_set(nal: bytes) -> tuple[str, int, int]:
    """Of an H.264 sequence parameter set: what must agree, the number of reference frames, the chroma format.

    Two sets with the same first part differ in the number of reference frames only. Sets with scaling
    lists or without colour are a ValueError, as their later fields aren't read.
    """
    if len(nal) < 4:
        raise ValueError("too short")
    bits, chroma = Bits(nal, 32), 1
    bits.golomb()
    if nal[1] in WITH_CHROMA:
        chroma = bits.golomb()
        if not 1 <= chroma <= 3:
            raise ValueError("chroma format")
        if chroma == 3:
            bits.unsigned()
        bits.golomb()
        bits.golomb()
        bits.unsigned()
        if bits.unsigned():
            raise ValueError("scaling lists")
    bits.golomb()
    order = bits.golomb()
    if order > 2:
        raise ValueError("order type")
    if order == 0:
        bits.golomb()
    if order == 1:
        for _ in range(3):
            bits.golomb()
        for _ in range(bits.golomb()):
            bits.golomb()
    before = bits.at
    references = bits.golomb()
    return f"{nal[1]}.{nal[3]}.{bits.bits[32:before]}.{bits.bits[bits.at :].rstrip('0')}", references, chroma


def _chroma(nal: bytes) -> int | None:
    if len(nal) < 4:
        return None
    try:
        bits = Bits(nal, 32)
        bits.golomb()
        return bits.golomb() if nal[1] in WITH_CHROMA else 1
    except IndexError:
        return None


def _sets(data: bytes, at: int, n: int) -> tuple[list[bytes], int]:
    """n byte strings with two bytes of length before each, and where they end."""
    out = []
    for _ in range(n):
        size = int.from_bytes(data[at : at + 2], "big")
        if at + 2 > len(data) or not size or at + 2 + size > len(data):
            raise ValueError("sets leave the box")
        out.append(data[at + 2 : at + 2 + size])
        at += 2 + size
    return out, at


def _video(data: bytes) -> tuple:
    """Key, reference frames of the first set, chroma format and profile; the whole box is the key where it can't be read."""
    whole = ("=" + data.hex(), None, None, None)
    if len(data) < 6:
        return whole
    chroma = None
    try:
        sequence, at = _sets(data, 6, data[5] & 31)
        chroma = next((c for nal in sequence if (c := _chroma(nal)) is not None), None)
        if not sequence or at >= len(data):
            raise ValueError("no sets")
        pictures, at = _sets(data, at + 1, data[at])
        read = [parameter_set(nal) for nal in sequence]
    except (ValueError, IndexError):
        return (whole[0], None, chroma, data[1])
    key = "/".join((data[:6].hex(), *(r[0] for r in read), *(p.hex() for p in pictures), data[at:].hex()))
    return key, read[0][1], chroma, data[1]


def _audio(data: bytes) -> tuple[int | None, int | None]:
    """Sampling rate and channels of the first decoder configuration, where it names a kind of audio and a known rate."""
    spans = [(4, len(data), 0)]
    while spans:
        at, end, depth = spans.pop()
        if at + 2 > end or depth > DEPTH:
            continue
        tag, size, k = data[at], 0, at + 1
        for k in range(at + 1, min(at + 5, len(data))):
            size = size << 7 | data[k] & 127
            if not data[k] & 128:
                break
        else:
            if k < at + 4:
                continue
        body, stop = k + 1, k + 1 + size
        if stop > end:
            continue
        if tag == 4:
            own = data[body + 13 : stop]
            if len(own) < 2 or own[0] >> 3 == 0 or own[0] & 15 >= len(RATES):
                return None, None
            return RATES[own[0] & 15], own[1] >> 4 or None
        spans.append((stop, end, depth))
        if tag == 3:
            spans.append((body, stop, depth + 1))
    return None, None


def read_config(box: str | None, data: bytes | None) -> tuple:
    """key (equal where two configurations can be joined), references, chroma, profile, rate, channels; null what isn't told."""
    if data is None:
        return ("", None, None, None, None, None)
    data = bytes(data)
    if box == "avcC":
        return (*_video(data), None, None)
    rate = _audio(data) if box == "esds" else (None, None)
    return ("=" + data.hex(), None, None, None, *rate)


def configuration(box: Column, data: Column) -> Column:
    """The configuration of a track as a struct of the fields of ``CONFIG``."""

    @F.pandas_udf(CONFIG)
    def read(boxes: pd.Series, datas: pd.Series) -> pd.DataFrame:
        columns = [c.split()[0] for c in CONFIG.split(", ")]
        rows = [read_config(b, d) for b, d in zip(boxes, datas, strict=True)]
        return pd.DataFrame(rows, columns=columns).astype({c: "Int32" for c in columns[1:]})

    return read(box, data)
