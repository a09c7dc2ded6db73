"""MP4 containers: a walk over atoms that reads only what describes the samples, and conversion of their NAL units."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Atoms that hold other atoms, and sample entries with their codecs.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex"}
ENTRIES = {b"avc1": "h264", b"avc3": "h264", b"hvc1": "hevc", b"hev1": "hevc"}
START_CODE = b"\x00\x00\x01"


class Bits:
    """Reads bits, most significant first."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def unsigned(self, n: int) -> int:
        first, last = self.at // 8, (self.at + n + 7) // 8
        if last > len(self.data):
            raise EOFError("not so many bits")
        value = int.from_bytes(self.data[first:last], "big") >> (8 * last - self.at - n)
        self.at += n
        return value & (1 << n) - 1

    def skip(self, n: int) -> None:
        self.at += n

    def align(self) -> None:
        self.at += -self.at % 8

    def golomb(self) -> int:
        """An unsigned Exp-Golomb number."""
        zeros = 0
        while not self.unsigned(1):
            zeros += 1
        return (1 << zeros) - 1 + (self.unsigned(zeros) if zeros else 0)

    def signed_golomb(self) -> int:
        n = self.golomb()
        return (n + 1) // 2 if n % 2 else -(n // 2)

    def text(self, n: int) -> str:
        return bytes(self.unsigned(8) for _ in range(n)).decode("latin-1")


@dataclass
class Track:
    """What the atoms of a video say."""

    codec: str = "hevc"
    width: int = 0
    height: int = 0
    headers: list[bytes] = field(default_factory=list)
    keyframes: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    timescale: int = 0
    durations: list[tuple[int, int]] = field(default_factory=list)
    mdat_offset: int = -1
    mdat_size: int = 0

    @property
    def gop_size(self) -> int | None:
        """Samples from one keyframe to the next where that is constant, else None; all samples where there is one keyframe or none is named."""
        if len(self.keyframes) < 2:
            return len(self.sizes) or None
        gaps = {b - a for a, b in zip(self.keyframes[:-1], self.keyframes[1:], strict=True)}
        return gaps.pop() if len(gaps) == 1 else None

    @property
    def fps(self) -> float:
        """From the sample durations; 30 where the container does not tell."""
        samples, ticks = sum(n for n, _ in self.durations), sum(n * d for n, d in self.durations)
        return samples * self.timescale / ticks if ticks and self.timescale else 30.0


def atoms(data: bytes, start: int = 0, end: int | None = None, depth: int = 0) -> Iterator[tuple[bytes, int, int, int]]:
    """Kind, first byte of the content, end, and depth of each atom; containers before what they hold."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head:
            raise ValueError(f"atom {kind!r} at {start} has a size of {size}")
        stop = min(start + size, end)
        yield kind, start + head, stop, depth
        if kind in CONTAINERS:
            yield from atoms(data, start + head, stop, depth + 1)
        start += size


def parse(data: bytes) -> Track:
    """The video track. Stops as soon as samples, keyframes and media data are known."""
    track = Track()
    for kind, at, end, _ in atoms(data):
        if kind == b"stsd":
            _sample_entry(data, at + 8, end, track)
        elif kind == b"stss":
            n = struct.unpack_from(">I", data, at + 4)[0]
            track.keyframes = [x - 1 for x in struct.unpack_from(f">{n}I", data, at + 8)]
        elif kind == b"stsz":
            same, n = struct.unpack_from(">II", data, at + 4)
            track.sizes = [same] * n if same else list(struct.unpack_from(f">{n}I", data, at + 12))
        elif kind == b"stts":
            n = struct.unpack_from(">I", data, at + 4)[0]
            track.durations = [struct.unpack_from(">II", data, at + 8 + 8 * k) for k in range(n)]
        elif kind == b"mdhd":
            track.timescale = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))[0]
        elif kind == b"mdat":
            track.mdat_offset, track.mdat_size = at, end - at
            if track.sizes:
                break
    return track


def _sample_entry(data: bytes, at: int, end: int, track: Track) -> None:
    size, kind = struct.unpack_from(">I4s", data, at)
    if kind not in ENTRIES:
        return
    track.codec = ENTRIES[kind]
    track.width, track.height = struct.unpack_from(">HH", data, at + 32)
    for inner, low, high, _ in atoms(data, at + 86, min(at + size, end)):
        if inner == b"avcC":
            track.headers = _parameter_sets(data[low:high])


def _parameter_sets(config: bytes) -> list[bytes]:
    """Sequence and picture parameter sets of a decoder configuration."""
    out, at = [], 5
    for mask in (31, 255):
        n = config[at] & mask
        at += 1
        for _ in range(n):
            size = struct.unpack_from(">H", config, at)[0]
            out.append(config[at + 2 : at + 2 + size])
            at += 2 + size
    return out


def to_annexb(samples: bytes, headers: list[bytes] = ()) -> bytes:
    """Length-prefixed NAL units as units with start codes, after ``headers``."""
    out, at = [START_CODE + x for x in headers], 0
    while at < len(samples):
        if at + 4 > len(samples):
            raise ValueError("the last unit is cut")
        size = struct.unpack_from(">I", samples, at)[0]
        if at + 4 + size > len(samples):
            raise ValueError("the last unit is cut")
        out.append(START_CODE + samples[at + 4 : at + 4 + size])
        at += 4 + size
    return b"".join(out)


def container_rows(spark: SparkSession, path: str) -> DataFrame:
    """A row for each sample of the MP4 files at ``path``: path, codec, height, width, fps, gop_size, mdat_offset, sample, size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                t = parse(row.content)
                yield pd.DataFrame({"path": row.path, "codec": t.codec, "height": t.height, "width": t.width, "fps": t.fps, "gop_size": t.gop_size, "mdat_offset": t.mdat_offset, "sample": range(len(t.sizes)), "size": t.sizes})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, codec string, height int, width int, fps double, gop_size int, mdat_offset long, sample long, size long")


def gop_rows(spark: SparkSession, path: str, gop_size: int | None = None) -> DataFrame:
    """A row for each group of pictures of the MP4 file at ``path``: codec, height, width, fps, gop, n_frames, content (units with start
    codes, parameter sets first). Groups start at keyframes, or every ``gop_size`` samples where that is given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                t = parse(data)
                starts = list(range(0, len(t.sizes), gop_size)) if gop_size else sorted({0, *t.keyframes})
                ends = [*starts[1:], len(t.sizes)]
                offsets = [t.mdat_offset]
                for size in t.sizes:
                    offsets.append(offsets[-1] + size)
                for k, (low, high) in enumerate(zip(starts, ends, strict=True)):
                    yield pd.DataFrame({"codec": [t.codec], "height": [t.height], "width": [t.width], "fps": [t.fps], "gop": [k], "first": [low], "n_frames": [high - low], "content": [to_annexb(data[offsets[low] : offsets[high]], t.headers)]})

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, "codec string, height int, width int, fps double, gop long, first long, n_frames long, content binary")


def annexb(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the samples in ``column`` converted."""
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{column: [None if x is None else to_annexb(bytes(x)) for x in batch[column]]})[names]

    return rows.mapInPandas(run, rows.schema)
