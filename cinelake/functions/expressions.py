"""Column expressions of the store."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
HEVC_FACTOR = 1.1
INTER_FACTOR = 1.1
BITS_PER_PIXEL = {"rgb": 24, "yuv": 12}
MAX_COMPRESSION = 20
PERFECT_MSE = 100.0
PIXEL_MAX = 255.0


def strict_greatest(a: Column, b: Column) -> Column:
    """The greater of two values; null where either is null."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def to_frames(us: Column, fps: int = 30) -> Column:
    """Frame index of a time in microseconds; halves go to the even index."""
    return F.bround(us.cast("double") / 1e6 * fps).cast("long")


def round_even(x: Column) -> Column:
    """Rounded half to even, then up to an even number."""
    whole = F.bround(x).cast("long")
    return whole + F.pmod(whole, F.lit(2))


def compression_level(pressure: Column) -> Column:
    """Compression level for storage pressure: 1 to 20."""
    return F.greatest(F.lit(1), F.bround(F.least(pressure, F.lit(1.0)) * MAX_COMPRESSION).cast("int"))


def psnr(mse: Column) -> Column:
    """Peak signal-to-noise ratio in dB; null for equal frames."""
    return F.when(mse > 0, 10 * F.log10(F.lit(PIXEL_MAX * PIXEL_MAX) / mse))


def mse_of_psnr(db: Column) -> Column:
    return F.lit(PIXEL_MAX * PIXEL_MAX) / F.pow(F.lit(10.0), db / 10)


def error_bound(parent: Column, new: Column) -> Column:
    """Bound on the error of a copy of a copy."""
    return 2 * (parent + new)


def frame_bytes(codec: Column, height: Column, width: Column) -> Column:
    """Bytes of an uncompressed frame; null for compressed codecs."""
    bits = F.when(codec == "rgb", F.lit(BITS_PER_PIXEL["rgb"])).when(codec == "yuv", F.lit(BITS_PER_PIXEL["yuv"]))
    return F.floor(bits * height.cast("long") * width / 8)


def _codec_factor(codec: Column) -> Column:
    return F.when(codec == "hevc", F.lit(HEVC_FACTOR)).otherwise(F.lit(1.0))


def keyframe_cost(codec: Column, height: Column, width: Column) -> Column:
    return height * width * _codec_factor(codec)


def inter_frame_cost(codec: Column, height: Column, width: Column) -> Column:
    return F.floor(height * width * F.lit(INTER_FACTOR)) * _codec_factor(codec)


def encode_cost(codec: Column, height: Column, width: Column) -> Column:
    return height * width * F.lit(INTER_FACTOR) * _codec_factor(codec)


def file_name(name: Column, physical: Column, codec: Column) -> Column:
    """Name of an ingested file: raw files end in their codec, encoded ones in a container."""
    return F.concat(name, F.lit("-"), physical.cast("string"), F.lit("."), codec, F.when(codec == "rgb", F.lit("")).otherwise(F.lit(".mp4")))


def compressed_name(name: Column) -> Column:
    return F.concat(name, F.lit(".zst"))


def is_compressed(name: Column) -> Column:
    return name.endswith(".zst")


def intersects(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Whether two intervals with inclusive ends meet."""
    return (start <= other_end) & (other_start <= end)


def interval_length(start: Column, end: Column) -> Column:
    return end - start + 1


#: Grammar of a projection path: size, optional crop in percent, optional times, codec.
PATH = r"^(\d+)x(\d+)(?:c(\d+)-(\d+)-(\d+)-(\d+))?(?:t(\d+)-(\d+))?\.(hevc|h264|rgb|yuv)$"


def parse_path(path: Column) -> Column:
    """Struct of width, height, crop (left, top, width, height as shares), time and codec; null fields where absent."""
    part = lambda k: F.nullif(F.regexp_extract(path, PATH, k), F.lit(""))
    whole = lambda k: part(k).cast("int")
    share = lambda k: part(k).cast("int") / 100.0
    return F.struct(
        whole(1).alias("width"), whole(2).alias("height"), share(3).alias("left"), share(4).alias("top"), share(5).alias("crop_width"), share(6).alias("crop_height"),
        whole(7).alias("start"), whole(8).alias("end"), part(9).alias("codec"),
    )
