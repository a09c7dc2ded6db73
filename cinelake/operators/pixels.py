"""Frame operators on pixel arrays, in SQL expressions only. Frames have frame_no and px, the rows of a height x width channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinelake.functions.expressions import psnr


def crop(px: Column, width: int, y0: int, x0: int, y1: int, x1: int) -> Column:
    """The pixels of rows y0..y1 and columns x0..x1, ends exclusive."""
    return F.flatten(F.transform(F.sequence(F.lit(y0), F.lit(y1 - 1)), lambda y: F.slice(px, y * width + x0 + 1, F.lit(x1 - x0))))


def scale_nearest(px: Column, height: int, width: int, to_height: int, to_width: int) -> Column:
    """Each pixel of the result is the nearest one above and to the left."""
    row = lambda y: F.transform(F.sequence(F.lit(0), F.lit(to_width - 1)), lambda x: F.element_at(px, (F.floor(y * height / to_height) * width + F.floor(x * width / to_width) + 1).cast("int")))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(to_height - 1)), row))


def resample(frames: DataFrame, rate: int, to_rate: int) -> DataFrame:
    """Frames at another rate: frame k of the result is frame floor(k * rate / to_rate). Each source frame gives those that fall on it."""
    first = lambda n: F.ceil(n * F.lit(to_rate) / F.lit(rate))
    low, high = first(F.col("frame_no")).cast("long"), (first(F.col("frame_no") + 1) - 1).cast("long")
    return frames.where(high >= low).select(F.explode(F.sequence(low, high)).alias("k"), "frame_no")


def mse(a: Column, b: Column) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return total.cast("double") / F.size(a)


def neighbours(frames: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Each frame with the next one: frame_no and the two arrays."""
    following = frames.select((F.col("frame_no") - 1).alias("frame_no"), F.col("px").alias(right))
    return frames.select("frame_no", F.col("px").alias(left)).join(following, "frame_no")


def frame_quality(frames: DataFrame) -> DataFrame:
    rows = neighbours(frames).select("frame_no", mse(F.col("a"), F.col("b")).alias("mse"))
    return rows.select("frame_no", "mse", psnr(F.col("mse")).alias("psnr"))


def bucket_histogram(px: Column, buckets: int = 8) -> Column:
    """Counts of pixels by equal ranges of value."""
    place = F.transform(px, lambda x: F.floor(x * buckets / 256))
    return F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda k: F.size(F.filter(place, lambda p: p == k)))


def color_histogram(frames: DataFrame) -> DataFrame:
    """2 x 2 x 2 histogram of packed colour pixels (frame_no, rgb): eight counts, bucket 4 * (b div 128) + 2 * (g div 128) + r div 128."""
    bucket = lambda c: 4 * F.floor(c % 256 / 128) + 2 * F.floor(F.floor(c / 256) % 256 / 128) + F.floor(F.floor(c / 65536) / 128)
    place = F.transform("rgb", bucket)
    return frames.select("frame_no", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.size(F.filter(place, lambda p: p == k))).alias("histogram"))


def dominant_value(frames: DataFrame) -> DataFrame:
    """The most frequent pixel of each frame; of equally frequent ones the smallest."""
    counts = frames.select("frame_no", F.explode("px").alias("value")).groupBy("frame_no", "value").count()
    best = counts.groupBy("frame_no").agg(F.max(F.struct("count", (-F.col("value")).alias("v"))).alias("x"))
    return best.select("frame_no", (-F.col("x.v")).cast("int").alias("value"), F.col("x.count").alias("n"))


def colour_distance(packed: Column, target: tuple[int, int, int]) -> Column:
    """Euclidean distance of packed RGB values to a colour."""
    parts = (F.floor(packed / 65536), F.floor(packed / 256) % 256, packed % 256)
    return F.sqrt(sum(((p - t) * (p - t) for p, t in zip(parts, target, strict=True)), F.lit(0)).cast("double"))


def first_frames(frames: DataFrame) -> DataFrame:
    """The first frame of each cluster."""
    return frames.groupBy("cluster_id").agg(F.min_by("px", "frame_no").alias("px"), F.min("frame_no").alias("frame_no"))


def interleave(left: DataFrame, right: DataFrame) -> DataFrame:
    """Frames of two videos in turn, as one video."""
    return left.select((F.col("frame_no") * 2).alias("frame_no"), "px").unionByName(right.select((F.col("frame_no") * 2 + 1).alias("frame_no"), "px"))


def uninterleave(frames: DataFrame, side: int) -> DataFrame:
    return frames.where(F.col("frame_no") % 2 == side).select(F.floor(F.col("frame_no") / 2).alias("frame_no"), "px")


def aligned(left: DataFrame, right: DataFrame, size: int) -> DataFrame:
    """Frames of two videos side by side; a missing frame is black."""
    black = F.array_repeat(F.lit(0), size)
    rows = left.select("frame_no", F.col("px").alias("a")).join(right.select("frame_no", F.col("px").alias("b")), "frame_no", "full")
    return rows.select("frame_no", F.coalesce("a", black).alias("a"), F.coalesce("b", black).alias("b"))


#: Ways of joining the overlapping region of two frames.
def join_left(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.when(x != 0, x).otherwise(y))


def join_right(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.when(y != 0, y).otherwise(x))


def join_mean(a: Column, b: Column, least: int = 9, channels: int = 1) -> Column:
    """The mean where the right pixel, the sum of its ``channels``, is bright enough to be part of the picture."""
    if channels == 1:
        return F.zip_with(a, b, lambda x, y: F.when(y >= least, F.floor((x + y) / 2).cast("int")).otherwise(x))
    first = lambda k: (F.floor(k / channels) * channels).cast("int")
    sums = F.transform(b, lambda y, k: F.aggregate(F.slice(b, first(k) + 1, F.lit(channels)), F.lit(0), lambda s, x: s + x))
    return F.zip_with(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), sums, lambda p, s: F.when(s >= least, F.floor((p["x"] + p["y"]) / 2).cast("int")).otherwise(p["x"]))


def join_interlace(a: Column, b: Column, width: int) -> Column:
    """Even rows of the one, odd rows of the other."""
    return F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p, k: F.when(F.floor(k / width) % 2 == 0, p["x"]).otherwise(p["y"]))


def join_delta(a: Column, b: Column, quant: int = 2) -> Column:
    """The difference, quantised around 127."""
    return F.zip_with(a, b, lambda x, y: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((y - x) / quant).cast("int") + 127)))


def recover_delta(a: Column, delta: Column, quant: int = 2) -> Column:
    return F.zip_with(a, delta, lambda x, d: F.greatest(F.lit(0), F.least(F.lit(255), (d - 127) * quant + x)))


def split_interlace(joined: Column, width: int, side: int) -> Column:
    """One side of an interlaced region: each row that it lacks is the one before (or, for the first, after)."""
    return F.transform(joined, lambda x, k: F.when(F.floor(k / width) % 2 == side, x).otherwise(F.element_at(joined, (F.when(F.floor(k / width) >= 1, k - width).otherwise(k + width) + 1).cast("int"))))


def deduplicated(rows: DataFrame, id_column: str, content_column: str) -> DataFrame:
    """For each row the least id with the same content."""
    digest = rows.select(F.col(id_column).alias("id"), F.sha2(content_column, 256).alias("digest"))
    first = digest.groupBy("digest").agg(F.min("id").alias("keeper"))
    return digest.join(first, "digest").select("id", "keeper")


def smallest_cluster(frames: DataFrame) -> DataFrame:
    """The cluster with the fewest frames and its first frame."""
    return frames.groupBy("cluster_id").agg(F.count("*").alias("n"), F.min("frame_no").alias("first")).orderBy("n", "cluster_id").limit(1)


def best_share(matches: DataFrame, share: int = 20) -> DataFrame:
    """Of matches (group, score, id) the best one in ``share`` of each group, and one more."""
    own = Window.partitionBy("group")
    rows = matches.withColumn("n", F.row_number().over(own.orderBy(F.desc("score"), "id"))).withColumn("all", F.count("*").over(own))
    return rows.where(F.col("n") <= F.floor(F.col("all") / share) + 1).select("group", "id", "n")


def numbered_by(rows: DataFrame, key: str, offset: int = 0, width: int = 4096) -> DataFrame:
    """``rows`` numbered in order of a unique ``key`` (long) from ``offset``, as ``n``: within ranges of ``width`` keys, after the sums of
    the ranges before. Only the ranges' counts are brought to one task."""
    ranged = rows.withColumn("__range", F.floor(F.col(key) / width))
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__count"))
    before = counts.select("__range", (F.sum("__count").over(Window.orderBy("__range")) - F.col("__count")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(key)) - 1
    return ranged.withColumn("__own", own).join(before, "__range").withColumn("n", F.col("__before") + F.col("__own") + offset).drop("__range", "__own", "__before")


def concatenated(frames: DataFrame, segment: str) -> DataFrame:
    """Frames of segments one after the other, in order of ``segment``: ``number`` is a frame's place in the whole."""
    sizes = frames.groupBy(segment).agg(F.count("*").alias("__count"))
    before = sizes.select(segment, (F.sum("__count").over(Window.orderBy(segment)) - F.col("__count")).alias("__before"))  # a row for each segment
    own = F.row_number().over(Window.partitionBy(segment).orderBy("frame_no")) - 1
    return frames.withColumn("__own", own).join(before, segment).withColumn("number", F.col("__before") + F.col("__own")).drop("__own", "__before")


def joint_benefit(rows: DataFrame, group: str) -> DataFrame:
    """Of pairs (mse, whole, stored: values before and after) by group: count, mean PSNR of the changed ones, values saved, their share."""
    saved = F.sum(F.col("whole") - F.col("stored"))
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.avg(psnr(F.col("mse"))).alias("psnr"), saved.cast("long").alias("saved"), (saved.cast("double") / F.sum("whole")).alias("benefit"))
