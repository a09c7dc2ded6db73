"""Operators that cut time: transition points, fragments, decode dependencies and costs, byte windows, sessions of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinelake.functions.expressions import encode_cost, inter_frame_cost, keyframe_cost, to_frames
from cinelake.operators.views import located


def frame_spans(gops: DataFrame, physicals: DataFrame) -> DataFrame:
    """First and last frame (inclusive) of each physical video."""
    spans = located(gops, physicals).groupBy("logical_id", "physical_id", "codec", "height", "width").agg(F.min("start_us").alias("s"), F.max("end_us").alias("e"))
    return spans.withColumn("start", to_frames(F.col("s"))).withColumn("end", to_frames(F.col("e")) - 1).where("end >= start").drop("s", "e")


def transition_points(spans: DataFrame) -> DataFrame:
    """The frames of a logical video where any of its physical videos starts or has just ended."""
    points = spans.select("logical_id", F.explode(F.array("start", F.col("end") + 1)).alias("place"))
    return points.distinct()


def split_fragments(spans: DataFrame) -> DataFrame:
    """Physical videos cut at all transition points within them: inclusive frame intervals."""
    points = transition_points(spans).groupBy("logical_id").agg(F.array_sort(F.collect_list("place")).alias("points"))
    inside = F.filter("points", lambda p: (p > F.col("start")) & (p <= F.col("end")))
    starts = F.concat(F.array("start"), inside)
    rows = spans.join(points, "logical_id").withColumn("starts", starts).withColumn("ends", F.concat(F.transform(F.col("starts"), lambda p: p - 1), F.array("end")))
    cut = F.posexplode(F.transform("starts", lambda p, k: F.struct(p.alias("s"), F.element_at("ends", k + 2).alias("e"))))
    return rows.select("logical_id", "physical_id", "codec", "height", "width", cut.alias("fragment", "x")).select("logical_id", "physical_id", "codec", "height", "width", F.col("fragment").alias("fragment"), F.col("x.s").alias("start"), F.col("x.e").alias("end"))


def goal_matches(fragments: DataFrame) -> DataFrame:
    """How many fragments can serve each goal interval of a logical video, and the lowest physical video among them."""
    return fragments.groupBy("logical_id", "start", "end").agg(F.count("*").alias("n"), F.min("physical_id").alias("physical_id"))


def fragments_for(fragments: DataFrame, goals: DataFrame) -> DataFrame:
    """The fragments of the very intervals of ``goals`` (logical_id, start, end)."""
    return fragments.join(goals, ["logical_id", "start", "end"])


def decode_dependencies(fragments: DataFrame, gops: DataFrame) -> DataFrame:
    """For each fragment the GOPs that it contains (a keyframe and the other frames) and those that it covers in part."""
    g = gops.select("physical_id", F.col("id").alias("gop_id"), to_frames(F.col("start_us")).alias("g_start"), (to_frames(F.col("end_us")) - 1).alias("g_end")).where("g_end >= g_start")
    rows = fragments.join(g, "physical_id").where("start <= g_end and g_start <= end")
    whole = (F.col("g_start") >= F.col("start")) & (F.col("g_end") <= F.col("end"))
    out = rows.groupBy("logical_id", "physical_id", "codec", "height", "width", "fragment", "start", "end")
    return out.agg(F.sum(whole.cast("long")).alias("keyframes"), F.sum(F.when(whole, F.col("g_end") - F.col("g_start")).otherwise(0)).alias("p_frames"), F.sum((~whole).cast("long")).alias("partial"))


def fragment_costs(dependencies: DataFrame, codec: str, height: int, width: int) -> DataFrame:
    """What encoding and decoding each fragment costs for a target format."""
    want, h, w = F.lit(codec), F.lit(height), F.lit(width)
    same = (F.col("codec") == want) & (F.col("height") == h) & (F.col("width") == w)
    encode = F.when(same, 0.0).otherwise((F.col("end") - F.col("start") + 1) * encode_cost(want, h, w))
    decode = F.when(same | (F.col("codec") == "rgb"), 0.0).otherwise(F.col("p_frames") * inter_frame_cost(want, h, w) + F.col("keyframes") * keyframe_cost(want, h, w))
    return dependencies.select("logical_id", "physical_id", "fragment", encode.alias("encode_cost"), decode.alias("decode_cost"))


def byte_windows(samples: DataFrame, gop_size: int) -> DataFrame:
    """From samples (video, sample, size) the byte windows of GOPs of ``gop_size`` samples: offsets by prefix sums, ends by the next."""
    order = Window.partitionBy("video").orderBy("sample")
    rows = samples.withColumn("offset", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))).withColumn("n", F.row_number().over(order) - 1)
    rows = rows.withColumn("total", F.sum("size").over(Window.partitionBy("video"))).where(F.col("n") % gop_size == 0)
    return rows.select("video", F.expr(f"n div {gop_size}").alias("gop"), F.col("offset").alias("start_byte"), F.coalesce(F.lead("offset").over(order), F.col("total")).alias("end_byte"))


def sessions(hits: DataFrame, gap_us: int) -> DataFrame:
    """Groups of hits (video, t_us): a new one starts where a hit is more than ``gap_us`` after the group's start.

    A group ends where the next one starts, the last one ``gap_us`` after its last hit. The fold runs over each video's hits in order.
    """
    rows = hits.groupBy("video").agg(F.array_sort(F.collect_list("t_us")).alias("ts"))
    kind = "struct<starts:array<bigint>,n:array<bigint>>"

    def step(state, t):
        fresh = (F.size(state["starts"]) == 0) | (t - F.element_at(state["starts"], -1) > gap_us)
        size = F.size(state["n"])
        more = F.concat(F.slice(state["n"], 1, F.greatest(size - 1, F.lit(0))), F.array((F.element_at(state["n"], -1) + 1).cast("bigint")))
        grown = F.struct(F.concat(state["starts"], F.array(t)).alias("starts"), F.concat(state["n"], F.array(F.lit(1).cast("bigint"))).alias("n"))
        return F.when(fresh, grown).otherwise(F.struct(state["starts"].alias("starts"), more.alias("n"))).cast(kind)

    folded = rows.withColumn("x", F.aggregate("ts", F.struct(F.array().cast("array<bigint>").alias("starts"), F.array().cast("array<bigint>").alias("n")).cast(kind), step))
    ends = F.concat(F.slice("x.starts", F.lit(2), F.size("x.starts")), F.array(F.element_at("ts", -1) + gap_us))
    return folded.withColumn("ends", ends).select("video", F.posexplode(F.arrays_zip(F.col("x.starts").alias("s"), F.col("x.n").alias("n"), F.col("ends").alias("e"))).alias("session", "y")).select("video", "session", F.col("y.s").alias("start_us"), F.col("y.e").alias("end_us"), F.col("y.n").alias("n_hits"))
