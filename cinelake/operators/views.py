"""Catalog operators. GOPs have id, physical_id, start_us, end_us, size, estimated_mse, clock, fps; physical videos id, logical_id,
height, width, codec; logical videos id, name, budget; read requests logical_id, t0, t1, h, w, want."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinelake.functions.expressions import PERFECT_MSE, compression_level, error_bound, file_name, strict_greatest
from cinelake.session import checkpointed

TEMPORAL_WEIGHT, QUALITY_WEIGHT = 4.0, 2.0
LEAST_PRESSURE = 0.25


def located(gops: DataFrame, physicals: DataFrame) -> DataFrame:
    """GOPs with the logical video, shape and codec of their physical video."""
    return gops.join(physicals.select(F.col("id").alias("physical_id"), "logical_id", "height", "width", "codec"), "physical_id")


def overlapping(gops: DataFrame, physicals: DataFrame, requests: DataFrame) -> DataFrame:
    """GOPs that overlap the time of a request (its end inclusive) and are no smaller than it."""
    return located(gops, physicals).join(requests, "logical_id").where((F.col("start_us") < F.col("t1")) & (F.col("end_us") >= F.col("t0")) & (F.col("height") >= F.col("h")) & (F.col("width") >= F.col("w")))


def candidates(gops: DataFrame, physicals: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request the physical videos that can serve it, with the span, size, rate and frames of what overlaps."""
    found = overlapping(gops, physicals, requests).groupBy("logical_id", "physical_id", "codec", "height", "width")
    found = found.agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("size").alias("size"), F.max("fps").alias("fps"))
    return found.withColumn("frames", F.expr("(end_us - start_us) * fps div 1000000"))


def fragments(gops: DataFrame, physicals: DataFrame, requests: DataFrame) -> DataFrame:
    """GOPs that contain, straddle or lie within the time of a request (all of them without a time), in order of start."""
    t0, t1, start, end = F.col("t0"), F.col("t1"), F.col("start_us"), F.col("end_us")
    contains, from_left = (start <= t0) & (end >= t1), (start <= t0) & (end > t0)
    from_right, inside = (start < t1) & (end >= t1), (start >= t0) & (end <= t1)
    rows = located(gops, physicals).join(requests, "logical_id").where(t0.isNull() | contains | from_left | from_right | inside)
    place = F.row_number().over(Window.partitionBy("logical_id", "physical_id").orderBy("start_us", "id"))
    return rows.select("logical_id", "physical_id", "id", "start_us", "end_us", place.alias("position"))


def single_candidate(gops: DataFrame, physicals: DataFrame, requests: DataFrame) -> DataFrame:
    """The plan of a request that one physical video alone can serve: its GOPs with end >= t0 and start < t1, by start."""
    rows = candidates(gops, physicals, requests)
    alone = rows.groupBy("logical_id").agg(F.count("*").alias("n"), F.min("physical_id").alias("physical_id")).where("n = 1").drop("n")
    chosen = overlapping(gops, physicals, requests).join(alone, ["logical_id", "physical_id"])
    return chosen.select("logical_id", "physical_id", "id", F.row_number().over(Window.partitionBy("logical_id").orderBy("start_us", "id")).alias("position"))


def exact_match(gops: DataFrame, physicals: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request one GOP of its very shape and codec that covers its time: that with the least id."""
    same = (F.col("height") == F.col("h")) & (F.col("width") == F.col("w")) & (F.col("codec") == F.col("want"))
    covers = (F.col("start_us") <= F.col("t0")) & (F.col("end_us") >= F.col("t1"))
    return located(gops, physicals).join(requests, "logical_id").where(same & covers).groupBy("logical_id").agg(F.min("id").alias("gop_id"))


def requires_transcode(gops: DataFrame, physicals: DataFrame, requests: DataFrame) -> DataFrame:
    """For each GOP that a request overlaps, whether it must be transcoded: another shape or codec, or the request cuts it."""
    rows = overlapping(gops, physicals, requests)
    cut = ((F.col("t0") > F.col("start_us")) & (F.col("t0") < F.col("end_us"))) | ((F.col("t1") > F.col("start_us")) & (F.col("t1") < F.col("end_us")))
    other = (F.col("height") != F.col("h")) | (F.col("width") != F.col("w")) | (F.col("codec") != F.col("want"))
    return rows.select("logical_id", "id", (other | cut).alias("transcode"))


def durations(gops: DataFrame, physicals: DataFrame) -> DataFrame:
    return located(gops, physicals).groupBy("logical_id").agg(F.max("end_us").alias("duration_us"))


def physical_times(gops: DataFrame, physicals: DataFrame) -> DataFrame:
    """Physical videos with their first start, last end, span, size and GOPs; nulls and 0 GOPs for those without any."""
    times = gops.groupBy(F.col("physical_id").alias("id")).agg(F.min("start_us").alias("min_us"), F.max("end_us").alias("max_us"), F.sum("size").alias("size"), F.count("*").alias("n_gops"))
    return physicals.join(times, "id", "left").select(*physicals.columns, "min_us", "max_us", (F.col("max_us") - F.col("min_us")).alias("duration_us"), "size", F.coalesce("n_gops", F.lit(0)).cast("long").alias("n_gops"))


def storage_pressure(gops: DataFrame, physicals: DataFrame, logicals: DataFrame) -> DataFrame:
    """Size over budget of each logical video."""
    sizes = located(gops, physicals).groupBy("logical_id").agg(F.sum("size").alias("size"))
    rows = sizes.join(logicals.select(F.col("id").alias("logical_id"), "budget"), "logical_id")
    return rows.withColumn("pressure", F.col("size") / (F.col("budget") + 1.0))


def most_over_budget(gops: DataFrame, physicals: DataFrame, logicals: DataFrame) -> DataFrame:
    """The logical video with the greatest pressure above 1, if any."""
    return storage_pressure(gops, physicals, logicals).where("pressure > 1").orderBy(F.desc("pressure"), "logical_id").limit(1)


def quality_ranks(gops: DataFrame) -> DataFrame:
    """For each GOP how many of its physical video have a lower error, and which share that is; 0 where its error is unknown."""
    own = Window.partitionBy("physical_id")
    lower = F.when(F.col("estimated_mse").isNull(), 0).otherwise(F.rank().over(own.orderBy(F.asc_nulls_last("estimated_mse"))) - 1).cast("long")
    return gops.withColumn("lower_count", lower).withColumn("n_gops", F.count("*").over(own)).withColumn("quality_pct", F.col("lower_count") / F.col("n_gops"))


def time_percentiles(gops: DataFrame) -> DataFrame:
    """Where in its physical video each GOP starts, 0 to 1; null where the video has no duration."""
    own = Window.partitionBy("physical_id")
    low, high = F.min("start_us").over(own), F.max("end_us").over(own)
    return gops.withColumn("min_us", low).withColumn("max_us", high).withColumn("time_pct", F.try_divide((F.col("start_us") - F.col("min_us")).cast("double"), (F.col("max_us") - F.col("min_us")).cast("double")))


def covers(gops: DataFrame, physicals: DataFrame, perfect: float = PERFECT_MSE) -> DataFrame:
    """For each GOP that another one of its logical video makes redundant, the least id of those.

    A cover spans the GOP's time at its resolution or more, with an error of at most the larger of the GOP's own and that of perfect
    quality: a smaller copy never stands for a larger one. Covers can start any time before, so they are not found by neighbouring times. A GOP's start is cut into buckets of the longest power of two of time that
    a cover spans whole, so that rows meet by equality: each GOP looks once at each length of covers.
    """
    rows = located(gops, physicals).select("logical_id", "id", "start_us", "end_us", "estimated_mse", "height", "width")
    length = F.greatest(F.col("end_us") - F.col("start_us"), F.lit(1).cast("long"))
    level = F.floor(F.log2(length.cast("double"))).cast("int")
    c = rows.select(F.col("logical_id"), F.col("id").alias("cover_id"), F.col("start_us").alias("c_start"), F.col("end_us").alias("c_end"), F.col("estimated_mse").alias("c_mse"), F.col("height").alias("c_height"), F.col("width").alias("c_width"), level.alias("level"))
    width = F.pow(F.lit(2.0), F.col("level")).cast("long")
    # a cover is shorter than two buckets of its level, so it touches at most three
    c = c.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("c_start") / width), F.floor(F.col("c_end") / width))))
    levels = c.select("logical_id", "level").distinct()
    g = rows.join(levels, "logical_id").withColumn("bucket", F.floor(F.col("start_us") / width))
    bound = strict_greatest(F.col("estimated_mse"), F.lit(perfect))
    found = g.join(c, ["logical_id", "level", "bucket"]).where((F.col("c_start") <= F.col("start_us")) & (F.col("c_end") >= F.col("end_us")) & (F.col("cover_id") != F.col("id")) & (F.col("c_mse") <= bound) & (F.col("c_height") >= F.col("height")) & (F.col("c_width") >= F.col("width")))
    return found.groupBy("id").agg(F.min("cover_id").alias("cover_id"))


def covered(gops: DataFrame, physicals: DataFrame, perfect: float = PERFECT_MSE) -> DataFrame:
    """GOPs that have a cover."""
    return gops.join(covers(gops, physicals, perfect).select("id"), "id", "left_semi")


def gop_ranks(gops: DataFrame, physicals: DataFrame, perfect: float = PERFECT_MSE) -> DataFrame:
    """Covered GOPs with what eviction needs: rank of quality, percentiles, and whether removing one cuts its physical video."""
    rows = time_percentiles(quality_ranks(gops)).join(physicals.select(F.col("id").alias("physical_id"), "logical_id"), "physical_id")
    rows = rows.join(covers(gops, physicals, perfect), "id")
    cut = (F.col("start_us") != F.col("min_us")) & (F.col("end_us") != F.col("max_us"))
    return rows.select("logical_id", "physical_id", "id", "cover_id", "clock", "start_us", cut.alias("requires_cut"), (F.col("end_us") - F.col("start_us")).alias("gop_duration"), "lower_count", "n_gops", "time_pct", "quality_pct")


def eviction_score(temporal: float = TEMPORAL_WEIGHT, quality: float = QUALITY_WEIGHT) -> Column:
    return F.col("clock") + temporal * (1 - F.abs(0.5 - F.col("time_pct"))) + quality * (1 - F.col("quality_pct"))


def evict_candidates(ranks: DataFrame, temporal: float = TEMPORAL_WEIGHT, quality: float = QUALITY_WEIGHT) -> DataFrame:
    """For each logical video the GOP with the least score; an unknown score comes first, ties go to the lower id."""
    rows = ranks.withColumn("score", eviction_score(temporal, quality))
    return rows.groupBy("logical_id").agg(F.min(F.struct(F.col("score"), F.col("id"), F.col("requires_cut"))).alias("x")).select("logical_id", F.col("x.id").alias("id"), F.col("x.requires_cut").alias("requires_cut"), F.col("x.score").alias("score"))


def evict_lru(ranks: DataFrame) -> DataFrame:
    """For each logical video the covered GOP that was used longest ago."""
    return ranks.groupBy("logical_id").agg(F.min(F.struct("clock", "id", "physical_id", "requires_cut", "cover_id", "n_gops")).alias("x")).select("logical_id", "x.*")


def compaction_pairs(gops: DataFrame, physicals: DataFrame) -> DataFrame:
    """Pairs of physical videos of one logical video with the same format where one ends when the other starts."""
    times = physical_times(gops, physicals).where("n_gops > 0")
    same = ["logical_id", "codec", "height", "width"]
    left = times.select(*same, F.col("id").alias("left_id"), F.col("max_us").alias("at_us"))
    right = times.select(*same, F.col("id").alias("right_id"), F.col("min_us").alias("at_us"))
    return left.join(right, [*same, "at_us"]).where("left_id != right_id").select("logical_id", "left_id", "right_id", "at_us")


def compression_candidates(gops: DataFrame, physicals: DataFrame, logicals: DataFrame) -> DataFrame:
    """Raw GOPs of physical videos whose size is over a quarter of the budget, least recently used first, with a level."""
    own = Window.partitionBy("physical_id")
    rows = located(gops, physicals).where("codec = 'rgb'").withColumn("pressure", F.sum("size").over(own))
    rows = rows.join(logicals.select(F.col("id").alias("logical_id"), "budget"), "logical_id").withColumn("pressure", F.col("pressure") / (F.col("budget") + 1.0)).where(F.col("pressure") > LEAST_PRESSURE)
    order = Window.partitionBy("logical_id").orderBy("clock", "id")
    return rows.select("logical_id", "id", F.row_number().over(order).alias("position"), compression_level(F.col("pressure")).alias("level"))


def empty_physicals(gops: DataFrame, physicals: DataFrame) -> DataFrame:
    return physicals.join(gops.select(F.col("physical_id").alias("id")), "id", "left_anti")


def file_references(gops: DataFrame, physicals: DataFrame, logicals: DataFrame) -> DataFrame:
    """For each file how many GOPs refer to it."""
    rows = located(gops, physicals).join(logicals.select(F.col("id").alias("logical_id"), "name"), "logical_id")
    return rows.groupBy(file_name(F.col("name"), F.col("physical_id"), F.col("codec")).alias("filename")).agg(F.count("*").alias("refs"))


def lineage_error(gops: DataFrame) -> DataFrame:
    """For each GOP the summed error of itself and of all that it was made from, by ``parent_id`` up to the root: id, error, depth.

    Each round doubles the way that is known, so a line of n takes about log2(n) joins. A parent that is no longer there ends the line.
    """
    rows = gops.select("id", F.col("parent_id").alias("up"), F.col("estimated_mse").alias("error"), F.lit(1).cast("long").alias("depth"))
    while True:
        above = rows.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("error").alias("more"), F.col("depth").alias("steps"))
        met = rows.join(above, "up", "left")
        rows = checkpointed(met.select("id", F.col("next").alias("up"), F.when(F.col("steps").isNull(), F.col("error")).otherwise(F.col("error") + F.col("more")).alias("error"), (F.col("depth") + F.coalesce("steps", F.lit(0))).alias("depth")))
        if rows.where("up is not null").isEmpty():
            return rows.select("id", "error", "depth")


def measured_bound(parent: Column, measured: Column) -> Column:
    """The error to expect of a copy: that of its parent where nothing was lost, else the bound on a copy of a copy."""
    return F.when(measured > 0, error_bound(parent, measured)).otherwise(parent)


def pairs_to_join(pairs: DataFrame) -> DataFrame:
    """Of ``compaction_pairs`` those that can be joined at once: no video is in two of them. The first of a chain and the one after it
    are always among them, so that going on ends."""
    step = pairs.groupBy("logical_id", "right_id").agg(F.min("left_id").alias("left_id"))
    step = step.groupBy("logical_id", "left_id").agg(F.min("right_id").alias("right_id"))
    return step.join(step.select(F.col("right_id").alias("left_id")), "left_id", "left_anti").select("left_id", "right_id")


def plan_runs(plan: DataFrame) -> DataFrame:
    """Runs of consecutive GOPs of one physical video in a plan: logical_id, position, physical_id, id."""
    order = Window.partitionBy("logical_id").orderBy("position")
    changed = (F.col("physical_id") != F.lag("physical_id").over(order)).cast("int")
    rows = plan.withColumn("run", F.sum(F.coalesce(changed, F.lit(0))).over(order))
    return rows.groupBy("logical_id", "run", "physical_id").agg(F.count("*").alias("n_gops"), F.min("position").alias("first"), F.max("position").alias("last"))


def evicted(gops: DataFrame, victims: DataFrame) -> DataFrame:
    """The GOPs without ``victims`` (id). Where one lay inside its physical video, what came before it gets the new physical id
    ``-id`` of the victim, so that each physical video stays without gaps."""
    gone = victims.select(F.col("id").alias("victim"))
    cuts = gops.join(gone, F.col("id") == F.col("victim")).select("physical_id", F.col("start_us").alias("cut_us"), "victim")
    last = Window.partitionBy("physical_id", "id").orderBy("cut_us")
    rest = gops.join(gone, F.col("id") == F.col("victim"), "left_anti").join(cuts, "physical_id", "left")
    rest = rest.withColumn("before", F.col("start_us") < F.col("cut_us")).withColumn("n", F.row_number().over(last.orderBy(F.col("before").desc_nulls_last(), "cut_us"))).where("n = 1")
    later = gops.join(cuts.select(F.col("victim").alias("id")), "id", "left_anti").groupBy("physical_id").agg(F.max("start_us").alias("last_us"))
    rest = rest.join(later, "physical_id", "left")
    split = F.col("before") & (F.col("last_us") > F.col("cut_us"))
    return rest.withColumn("physical_id", F.when(split, -F.col("victim")).otherwise(F.col("physical_id"))).select(*gops.columns)


def compacted(gops: DataFrame, pairs: DataFrame) -> DataFrame:
    """GOPs after each right video of ``pairs`` has joined the left one; chains of pairs join the first."""
    step = pairs.groupBy("right_id").agg(F.min("left_id").alias("left_id"))
    moved = gops.join(step, F.col("physical_id") == F.col("right_id"), "left")
    return moved.withColumn("physical_id", F.coalesce("left_id", "physical_id")).select(*gops.columns)
