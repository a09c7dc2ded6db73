"""A video catalog over the plain tables: the input of the registered queries, the same in Spark and in SQL.

Events of one user and type are the starts of groups of pictures (GOPs); a week of them is one physical video, a user is a logical
video. Times are microseconds since 2024-01-01. Embeddings are 8 x 8 frames of one channel.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
CODECS = ("h264", "hevc", "rgb", "rgb", "h264")
SHAPES = ((540, 960), (1080, 1920), (2160, 3840), (540, 960), (1080, 1920))
WEEK_US = 604_800_000_000
FPS = 30
SIDE = 8


def _by_index(values: tuple, index: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.col(index) + 1)


@dataclass(frozen=True)
class Catalog:
    """The tables of the catalog under a folder of Parquet files; each is a lazy DataFrame."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        kind = sum((F.when(F.col("event_type") == name, index).otherwise(0) for index, name in enumerate(EVENT_TYPES)), F.lit(0))
        start = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts"))
        ev = self.table("events").select(
            F.col("event_id").alias("id"), F.col("user_id").alias("logical_id"), kind.cast("int").alias("ti"), start.alias("start_us"),
            F.round(F.col("value") * 100).cast("long").alias("size"), F.regexp_extract("props", r'"k":\s*(\d+)', 1).cast("int").alias("k"), (F.col("event_id") % 97).alias("clock"),
        )
        return ev.withColumn("physical_id", (F.col("logical_id") * 5 + F.col("ti")) * 8 + F.floor(F.col("start_us") / WEEK_US))

    @cached_property
    def gops(self) -> DataFrame:
        following = F.lead("start_us").over(Window.partitionBy("logical_id", "ti").orderBy("start_us", "id"))
        rows = self.events.withColumn("end_us", following).where("end_us is not null")
        return rows.select("id", "physical_id", "start_us", "end_us", "size", (F.col("k") * 10.0).alias("estimated_mse"), "clock", F.lit(FPS).alias("fps"))

    @cached_property
    def physical_videos(self) -> DataFrame:
        rows = self.events.select(F.col("physical_id").alias("id"), "logical_id", "ti").distinct()
        height, width = tuple(h for h, _ in SHAPES), tuple(w for _, w in SHAPES)
        return rows.select("id", "logical_id", _by_index(height, "ti").alias("height"), _by_index(width, "ti").alias("width"), _by_index(CODECS, "ti").alias("codec"))

    @cached_property
    def logical_videos(self) -> DataFrame:
        rows = self.events.select(F.col("logical_id").alias("id")).distinct()
        return rows.select("id", F.format_string("video%d", "id").alias("name"), ((F.col("id") % 7 + 1) * 80000.0).alias("budget"))

    @cached_property
    def requests(self) -> DataFrame:
        """A read request for each logical video: the second quarter of its time at 540 x 960 in h264."""
        spans = self.gops.join(self.physical_videos.select(F.col("id").alias("physical_id"), "logical_id"), "physical_id").groupBy("logical_id").agg(F.min("start_us").alias("low"), F.max("end_us").alias("high"))
        quarter = F.expr("(high - low) div 4")
        return spans.select("logical_id", (F.col("low") + quarter).alias("t0"), (F.col("low") + 2 * quarter).alias("t1"), F.lit(540).alias("h"), F.lit(960).alias("w"), F.lit("h264").alias("want"))

    @cached_property
    def frames(self) -> DataFrame:
        pixel = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 1.0) * 127.5).cast("int")))
        return self.table("embeddings").select(F.col("vec_id").alias("frame_no"), F.col("label").alias("cluster_id"), F.transform("embedding", pixel).alias("px"))


#: The same tables in DuckDB SQL, to be put before a query.
CTES = """
WITH events_ AS (
  SELECT event_id AS id, user_id AS logical_id,
         CAST(CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 ELSE 0 END AS INTEGER) AS ti,
         epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS start_us, CAST(round(value * 100) AS BIGINT) AS size,
         CAST(regexp_extract(props, '"k":\\s*(\\d+)', 1) AS INTEGER) AS k, event_id % 97 AS clock
  FROM events),
ev AS (SELECT *, CAST((logical_id * 5 + ti) * 8 + start_us // 604800000000 AS BIGINT) AS physical_id FROM events_),
gops AS (
  SELECT id, physical_id, start_us, end_us, size, k * 10.0::DOUBLE AS estimated_mse, clock, 30 AS fps
  FROM (SELECT *, lead(start_us) OVER (PARTITION BY logical_id, ti ORDER BY start_us, id) AS end_us FROM ev) WHERE end_us IS NOT NULL),
physical_videos AS (
  SELECT DISTINCT physical_id AS id, logical_id, [540, 1080, 2160, 540, 1080][ti + 1] AS height, [960, 1920, 3840, 960, 1920][ti + 1] AS width,
         ['h264', 'hevc', 'rgb', 'rgb', 'h264'][ti + 1] AS codec
  FROM ev),
logical_videos AS (SELECT DISTINCT logical_id AS id, 'video' || logical_id AS name, (logical_id % 7 + 1) * 80000.0::DOUBLE AS budget FROM ev),
g AS (
  SELECT gops.*, p.logical_id, p.height, p.width, p.codec FROM gops JOIN physical_videos p ON gops.physical_id = p.id),
requests AS (
  SELECT logical_id, low + (high - low) // 4 AS t0, low + 2 * ((high - low) // 4) AS t1, 540 AS h, 960 AS w, 'h264' AS want
  FROM (SELECT logical_id, min(start_us) AS low, max(end_us) AS high FROM g GROUP BY logical_id)),
frames AS (
  SELECT vec_id AS frame_no, label AS cluster_id,
         [CAST(greatest(0, least(255, floor((CAST(x AS DOUBLE) + 1.0) * 127.5))) AS INTEGER) FOR x IN embedding] AS px
  FROM embeddings)
"""
