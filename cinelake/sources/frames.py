"""Frames as rows: video_id, frame_no, t (seconds), height, width, channels, pixels. Readers, writers and pixel operators on bytes.

Pixels are never shuffled: operators that look at one frame are maps over Arrow batches, and times and ids select rows before
pixels are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.sources.codecs import codec

SCHEMA = "video_id long, frame_no long, t double, height int, width int, channels int, pixels binary"


def frame_table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds)], names=["video_id", "frame_no", "t", "height", "width", "channels", "pixels"])


def decoded(files: DataFrame) -> DataFrame:
    """Frames of stored pieces: video_id, codec, height, width, fps, first_frame, zstandard (level or null), content. A row of frames at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                data = zstandard.decompress(row["content"]) if row["zstandard"] is not None else row["content"]
                for n, frame in enumerate(codec(row["codec"]).decode(data, row["height"], row["width"])):
                    at = row["first_frame"] + n
                    yield frame_table([(row["video_id"], at, at / row["fps"], *frame.shape[:2], frame.shape[2], frame.tobytes())])

    return files.select("video_id", "codec", "height", "width", "fps", "first_frame", "zstandard", "content").mapInArrow(run, SCHEMA)


def read_raw(spark: SparkSession, path: str, height: int, width: int, fps: float = 30, video_id: int = 0) -> DataFrame:
    """Frames of raw RGB files, each a video piece of its own."""
    files = spark.read.format("binaryFile").load(path).select(F.lit(video_id).cast("long").alias("video_id"), F.lit("rgb").alias("codec"), F.lit(height).alias("height"), F.lit(width).alias("width"), F.lit(float(fps)).alias("fps"), F.lit(0).cast("long").alias("first_frame"), F.lit(None).cast("int").alias("zstandard"), "content")
    return decoded(files)


def encoded(frames: DataFrame, name: str, fps: float, gop_size: int) -> DataFrame:
    """Frames put together to pieces of ``gop_size``: video_id, gop, n_frames, content. A task holds one piece at a time."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["frame_no", "height", "width", "channels", "pixels"]).to_pylist(), key=lambda x: x["frame_no"])
        pixels = (np.frombuffer(x["pixels"], np.uint8).reshape(x["height"], x["width"], x["channels"]) for x in rows)
        return pa.table({"video_id": [table.column("video_id")[0].as_py()], "gop": [rows[0]["frame_no"] // gop_size], "n_frames": [len(rows)], "content": pa.array([codec(name).encode(pixels, fps)], pa.binary())})

    return frames.groupBy("video_id", F.floor(F.col("frame_no") / gop_size).alias("g")).applyInArrow(run, "video_id long, gop long, n_frames long, content binary")


def each_frame(frames: DataFrame, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Frames with ``change`` applied to each picture (height, width, channel)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                new = np.ascontiguousarray(change(np.frombuffer(x["pixels"], np.uint8).reshape(x["height"], x["width"], x["channels"])))
                yield frame_table([(x["video_id"], x["frame_no"], x["t"], *new.shape, new.tobytes())])

    return frames.select("video_id", "frame_no", "t", "height", "width", "channels", "pixels").mapInArrow(run, SCHEMA)


def crop(frames: DataFrame, y0: int, x0: int, y1: int, x1: int) -> DataFrame:
    return each_frame(frames, lambda p: p[y0:y1, x0:x1])


def scaled(picture: np.ndarray, height: int, width: int, mode: str = "nearest") -> np.ndarray:
    """The picture at another size: the nearest pixel above and to the left, or bilinear between pixel centres."""
    h, w = picture.shape[:2]
    if mode == "nearest":
        return picture[np.arange(height) * h // height][:, np.arange(width) * w // width]
    y, x = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1), np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1, fy, fx = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1), (y - y0)[:, None, None], (x - x0)[None, :, None]
    p = picture.astype(np.float64)
    top, low = p[y0][:, x0] * (1 - fx) + p[y0][:, x1] * fx, p[y1][:, x0] * (1 - fx) + p[y1][:, x1] * fx
    return np.clip(np.rint(top * (1 - fy) + low * fy), 0, 255).astype(np.uint8)


def scale(frames: DataFrame, height: int, width: int, mode: str = "nearest") -> DataFrame:
    return each_frame(frames, lambda p: scaled(p, height, width, mode))


def scale_error(frames: DataFrame, height: int, width: int, mode: str = "nearest") -> DataFrame:
    """What scaling costs: frame_no and the mean squared error of each frame scaled there and back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, errors = [], []
            for x in batch.to_pylist():
                picture = np.frombuffer(x["pixels"], np.uint8).reshape(x["height"], x["width"], x["channels"])
                back = scaled(scaled(picture, height, width, mode), x["height"], x["width"], mode)
                numbers.append(x["frame_no"])
                errors.append(float(((picture.astype(np.float64) - back) ** 2).mean()))
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(errors, pa.float64())], names=["frame_no", "mse"])

    return frames.select("frame_no", "height", "width", "channels", "pixels").mapInArrow(run, "frame_no long, mse double")


def trim(frames: DataFrame, t0: float, t1: float) -> DataFrame:
    return frames.where((F.col("t") >= t0) & (F.col("t") < t1))


def change_rate(frames: DataFrame, fps: float, to_fps: float) -> DataFrame:
    """Frame k of the result is frame floor(k * fps / to_fps) of the source."""
    low, high = F.ceil(F.col("frame_no") * to_fps / fps).cast("long"), (F.ceil((F.col("frame_no") + 1) * to_fps / fps) - 1).cast("long")
    rows = frames.where(high >= low).withColumn("k", F.explode(F.sequence(low, high)))
    return rows.select("video_id", F.col("k").alias("frame_no"), (F.col("k") / to_fps).alias("t"), "height", "width", "channels", "pixels")


def psnr(a: np.ndarray, b: np.ndarray) -> float:
    """In dB; infinite for equal pictures, not a number for different shapes."""
    if a.shape != b.shape:
        return math.nan
    error = float(((a.astype(np.float64) - b) ** 2).mean())
    return math.inf if error == 0 else 10 * math.log10(255**2 / error)


def ssim(a: np.ndarray, b: np.ndarray, window: int = 8) -> float:
    """Mean structural similarity over windows that do not overlap."""
    a, b = (x.astype(np.float64).mean(axis=2) if x.ndim == 3 else x.astype(np.float64) for x in (a, b))
    h, w = a.shape[0] // window * window, a.shape[1] // window * window
    if not h or not w:
        return float((a == b).all())
    a, b = (x[:h, :w].reshape(h // window, window, w // window, window).swapaxes(1, 2).reshape(-1, window * window) for x in (a, b))
    ma, mb = a.mean(1), b.mean(1)
    va, vb, cov = a.var(1), b.var(1), ((a - ma[:, None]) * (b - mb[:, None])).mean(1)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return float(((2 * ma * mb + c1) * (2 * cov + c2) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean())


def quality(left: DataFrame, right: DataFrame) -> DataFrame:
    """PSNR and SSIM of frames with the same number: frame_no, psnr, ssim."""
    one = left.select("frame_no", "height", "width", "channels", F.col("pixels").alias("a"))
    two = right.select("frame_no", F.col("height").alias("h2"), F.col("width").alias("w2"), F.col("pixels").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                a = np.frombuffer(x["a"], np.uint8).reshape(x["height"], x["width"], x["channels"])
                b = np.frombuffer(x["b"], np.uint8).reshape(x["h2"], x["w2"], -1)
                rows.append((x["frame_no"], psnr(a, b), ssim(a, b) if a.shape == b.shape else math.nan))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.float64())], names=["frame_no", "psnr", "ssim"])

    return one.join(two, "frame_no").mapInArrow(run, "frame_no long, psnr double, ssim double")


def histogram(picture: np.ndarray) -> np.ndarray:
    """Two ranges for each of three channels: eight counts."""
    high = (picture.reshape(-1, picture.shape[2])[:, :3] // 128).astype(int)
    return np.bincount(high @ np.array([1, 2, 4]), minlength=8)[:8]


def compress(rows: DataFrame, column: str, level: int) -> DataFrame:
    return _mapped(rows, column, lambda x: zstandard.ZstdCompressor(level=level).compress(x))


def compress_by(rows: DataFrame, column: str, level: str) -> DataFrame:
    """``rows`` with the contents of ``column`` compressed by the level in another column; null leaves them as they are."""
    at, by = rows.columns.index(column), rows.columns.index(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [x if n is None else zstandard.ZstdCompressor(level=n).compress(x) for x, n in zip(batch.column(at).to_pylist(), batch.column(by).to_pylist(), strict=True)]
            yield batch.set_column(at, column, pa.array(new, pa.binary()))

    return rows.mapInArrow(run, rows.schema)


def decompress(rows: DataFrame, column: str) -> DataFrame:
    return _mapped(rows, column, zstandard.decompress)


def _mapped(rows: DataFrame, column: str, change: Callable[[bytes], bytes]) -> DataFrame:
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([None if x is None else change(bytes(x)) for x in batch.column(at).to_pylist()], pa.binary())
            yield batch.set_column(at, column, new)

    return rows.mapInArrow(run, rows.schema)
