"""Changes of the catalog as DataFrames: what a table is after a step. And choices of what a background step takes next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def budget_set(logicals: DataFrame, budgets: DataFrame) -> DataFrame:
    """Logical videos with new budgets (id, new_budget) where there is one."""
    return logicals.join(budgets, "id", "left").withColumn("budget", F.coalesce("new_budget", "budget")).select(*logicals.columns)


def stamped(gops: DataFrame, used: DataFrame, now: Column) -> DataFrame:
    """GOPs with the clock of those that a read used (id) at ``now``."""
    marked = used.select("id").distinct().withColumn("used", F.lit(True))
    return gops.join(marked, "id", "left").withColumn("clock", F.when(F.col("used"), now).otherwise(F.col("clock"))).select(*gops.columns)


def deleted(gops: DataFrame, physicals: DataFrame, logicals: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the logical videos of ``names`` (name) and all that is theirs."""
    kept = logicals.join(names, "name", "left_anti").select(*logicals.columns)
    mine = physicals.join(kept.select(F.col("id").alias("logical_id")), "logical_id", "left_semi").select(*physicals.columns)
    return gops.join(mine.select(F.col("id").alias("physical_id")), "physical_id", "left_semi").select(*gops.columns), mine, kept


def unreferenced(gops: DataFrame, victims: DataFrame, file_column: str = "filename") -> DataFrame:
    """The files that no GOP refers to once ``victims`` (id) are gone: those that may be deleted."""
    left = gops.join(victims, "id", "left_anti").select(file_column).distinct()
    return gops.join(victims, "id", "left_semi").select(file_column).distinct().join(left, file_column, "left_anti")


def aborted(pairs: DataFrame) -> DataFrame:
    """Aborted pairs (gop1, gop2) both ways, once each."""
    return pairs.select("gop1", "gop2").union(pairs.select("gop2", "gop1")).distinct()


def examined(gops: DataFrame, pairs: DataFrame) -> DataFrame:
    """GOPs with ``examined`` raised by the pairs (gop1, gop2) that they are in."""
    times = pairs.select(F.explode(F.array("gop1", "gop2")).alias("id")).groupBy("id").agg(F.count("*").alias("more"))
    return gops.join(times, "id", "left").withColumn("examined", F.col("examined") + F.coalesce("more", F.lit(0))).select(*gops.columns)


def joint_marked(gops: DataFrame, pairs: DataFrame) -> DataFrame:
    """GOPs with ``joint`` and ``is_left`` set where a pair (left, right) holds them together."""
    sides = pairs.select(F.col("left").alias("id"), F.lit(True).alias("side")).union(pairs.select(F.col("right").alias("id"), F.lit(False).alias("side")))
    sides = sides.groupBy("id").agg(F.max("side").alias("side"))
    return gops.join(sides, "id", "left").withColumns({"joint": F.col("side").isNotNull(), "is_left": F.col("side")}).drop("side")


def compressed(gops: DataFrame, levels: DataFrame) -> DataFrame:
    """GOPs with the compression level (id, level, new_size) and size of those that were compressed."""
    rows = gops.join(levels, "id", "left")
    return rows.withColumns({"zstandard": F.col("level"), "original_size": F.when(F.col("level").isNotNull(), F.col("size")), "size": F.coalesce("new_size", "size")}).select(*gops.columns, "zstandard", "original_size")


def errors_recorded(gops: DataFrame, errors: DataFrame) -> DataFrame:
    """GOPs with the exact error (id, error) where it is known."""
    return gops.join(errors.select("id", F.col("error").alias("mse")), "id", "left")


def clusters_assigned(rows: DataFrame, key: str = "histogram") -> DataFrame:
    """Rows with equal ``key`` as clusters numbered from 1 in order of the key; rows alone keep null."""
    groups = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    numbered = groups.select(key, F.row_number().over(Window.orderBy(key)).cast("long").alias("cluster"))  # a row for each cluster
    return rows.join(numbered, key, "left")


def unexamined(gops: DataFrame, in_flight: DataFrame) -> DataFrame:
    """GOPs that are still to be looked at: not examined, not joint, and not among those being worked on (id)."""
    return gops.where((F.col("examined") == 0) & ~F.col("joint")).join(in_flight, "id", "left_anti")


def next_in_turn(gops: DataFrame, last_physical: DataFrame) -> DataFrame:
    """For each logical video its lowest GOP that is not of the physical video served last (logical_id, physical_id)."""
    rows = gops.join(last_physical, ["logical_id", "physical_id"], "left_anti")
    return rows.groupBy("logical_id").agg(F.min("id").alias("id"))


def best_candidate(rows: DataFrame) -> DataFrame:
    """For each ``id`` the candidate with the same suffix first, then the most matches, then the highest number."""
    return rows.groupBy("id").agg(F.max(F.struct("same_suffix", "n_matches", "other")).alias("x")).select("id", F.col("x.other").alias("other"), F.col("x.n_matches").alias("n_matches"))


def suffix(name: Column) -> Column:
    """What follows the last hyphen of a file name."""
    return F.substring_index(name, "-", -1)


def part_name(template: Column, part: str) -> Column:
    """A file name with the place of its part filled in: left, overlap or right."""
    return F.replace(template, F.lit("{}"), F.lit(part))


def last_cover(candidates: DataFrame) -> DataFrame:
    """The plain choice: for each request the last physical video that covers all of it (t0, t1, start_us, end_us)."""
    return candidates.where("start_us <= t0 and end_us >= t1").groupBy("logical_id").agg(F.max("physical_id").alias("physical_id"))


def max_abs_scaled(rows: DataFrame, key: str, values: str) -> DataFrame:
    """Arrays scaled by the greatest magnitude at each place over all rows; a place that is 0 everywhere stays 0."""
    most = rows.select(F.posexplode(values).alias("place", "x")).groupBy("place").agg(F.max(F.abs("x")).alias("most"))
    scales = most.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "most"))), lambda x: x["most"]).alias("scales"))  # one row: a number for each place
    scaled = F.zip_with(values, "scales", lambda x, m: F.when(m == 0, F.lit(0.0)).otherwise(x / m))
    return rows.crossJoin(F.broadcast(scales)).select(key, scaled.alias(values))
