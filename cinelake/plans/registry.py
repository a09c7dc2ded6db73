"""All queries of the store by name, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinelake.functions import expressions as E
from cinelake.operators import intervals, matching, pixels, views
from cinelake.plans import planner
from cinelake.plans.adapter import CTES, SIDE, Catalog
from cinelake.sources import frames as fr

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: str = "") -> Callable[[Callable[[Catalog], DataFrame]], Query]:
    """Registers a function of the catalog as a query, with its SQL put behind the catalog's."""

    def register(build: Callable[[Catalog], DataFrame]) -> Query:
        run = lambda spark, sf_dir: build(Catalog(spark, sf_dir))
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = CTES + (f", {ctes.strip()}\n" if ctes else "") + sql
        return run

    return register


def text(px: Column) -> Column:
    """Pixels as one string, so that results compare in any engine."""
    return F.array_join(px.cast("array<string>"), ",")


# --- selection of GOPs -----------------------------------------------------------------------------------------------------------

_OVERLAP = "g.logical_id = r.logical_id AND g.start_us < r.t1 AND g.end_us >= r.t0 AND g.height >= r.h AND g.width >= r.w"


@query(
    "q_temporal_select",
    f"""
SELECT g.logical_id, physical_id, codec, height, width, min(start_us) AS start_us, max(end_us) AS end_us, CAST(sum(size) AS BIGINT) AS size,
       max(fps) AS fps, CAST((max(end_us) - min(start_us)) * max(fps) // 1000000 AS BIGINT) AS frames
FROM g JOIN requests r ON {_OVERLAP} GROUP BY g.logical_id, physical_id, codec, height, width""",
)
def temporal_select(c: Catalog) -> DataFrame:
    return views.candidates(c.gops, c.physical_videos, c.requests)


@query(
    "q_fragment_overlap",
    """
SELECT g.logical_id, physical_id, id, start_us, end_us, row_number() OVER (PARTITION BY g.logical_id, physical_id ORDER BY start_us, id) AS position
FROM g JOIN requests r ON g.logical_id = r.logical_id
WHERE (start_us <= t0 AND end_us >= t1) OR (start_us <= t0 AND end_us > t0) OR (start_us < t1 AND end_us >= t1) OR (start_us >= t0 AND end_us <= t1)""",
)
def fragment_overlap(c: Catalog) -> DataFrame:
    return views.fragments(c.gops, c.physical_videos, c.requests).withColumn("position", F.col("position").cast("long"))


@query(
    "q_single_candidate",
    f"""
, cand AS (SELECT DISTINCT g.logical_id, physical_id FROM g JOIN requests r ON {_OVERLAP}),
alone AS (SELECT logical_id, min(physical_id) AS physical_id FROM cand GROUP BY logical_id HAVING count(*) = 1)
SELECT g.logical_id, g.physical_id, g.id, row_number() OVER (PARTITION BY g.logical_id ORDER BY start_us, g.id) AS position
FROM g JOIN requests r ON {_OVERLAP} JOIN alone a ON a.logical_id = g.logical_id AND a.physical_id = g.physical_id""",
)
def single_candidate(c: Catalog) -> DataFrame:
    return views.single_candidate(c.gops, c.physical_videos, c.requests).withColumn("position", F.col("position").cast("long"))


@query(
    "q_exact_match",
    """
SELECT g.logical_id, min(id) AS gop_id FROM g JOIN requests r ON g.logical_id = r.logical_id
WHERE height = h AND width = w AND codec = want AND start_us <= t0 AND end_us >= t0 + 1000000 GROUP BY g.logical_id""",
)
def exact_match(c: Catalog) -> DataFrame:
    """Of the first second of each request."""
    return views.exact_match(c.gops, c.physical_videos, c.requests.withColumn("t1", F.col("t0") + 1_000_000))


@query(
    "q_requires_transcode",
    f"""
SELECT g.logical_id, id, height <> h OR width <> w OR codec <> want OR (t0 > start_us AND t0 < end_us) OR (t1 > start_us AND t1 < end_us) AS transcode
FROM g JOIN requests r ON {_OVERLAP}""",
)
def requires_transcode(c: Catalog) -> DataFrame:
    return views.requires_transcode(c.gops, c.physical_videos, c.requests)


@query(
    "q_transcode_runs",
    f"""
, plan AS (
  SELECT g.logical_id, physical_id, id, row_number() OVER (PARTITION BY g.logical_id ORDER BY start_us, id) AS position FROM g JOIN requests r ON {_OVERLAP}),
m AS (SELECT *, CASE WHEN physical_id <> lag(physical_id) OVER (PARTITION BY logical_id ORDER BY position) THEN 1 ELSE 0 END AS changed FROM plan),
n AS (SELECT *, CAST(sum(changed) OVER (PARTITION BY logical_id ORDER BY position) AS BIGINT) AS run FROM m)
SELECT logical_id, run, physical_id, count(*) AS n_gops, min(position) AS first, max(position) AS last FROM n GROUP BY logical_id, run, physical_id""",
)
def transcode_runs(c: Catalog) -> DataFrame:
    rows = views.overlapping(c.gops, c.physical_videos, c.requests)
    plan = rows.withColumn("position", F.row_number().over(Window.partitionBy("logical_id").orderBy("start_us", "id")).cast("long"))
    return views.plan_runs(plan.select("logical_id", "physical_id", "id", "position"))


# --- listing and statistics ------------------------------------------------------------------------------------------------------


@query("q_list", "SELECT id, name, budget FROM logical_videos")
def listed(c: Catalog) -> DataFrame:
    return c.logical_videos


@query("q_duration", "SELECT logical_id, max(end_us) AS duration_us FROM g GROUP BY logical_id")
def duration(c: Catalog) -> DataFrame:
    return views.durations(c.gops, c.physical_videos)


@query(
    "q_physical_times",
    """
SELECT p.*, CAST(min(start_us) AS DOUBLE) AS min_us, CAST(max(end_us) AS DOUBLE) AS max_us, CAST(max(end_us) - min(start_us) AS DOUBLE) AS duration_us, CAST(sum(size) AS DOUBLE) AS size, count(gops.id) AS n_gops
FROM physical_videos p LEFT JOIN gops ON gops.physical_id = p.id GROUP BY ALL""",
)
def physical_times(c: Catalog) -> DataFrame:
    rows = views.physical_times(c.gops, c.physical_videos)
    return rows.withColumns({name: F.col(name).cast("double") for name in ("min_us", "max_us", "duration_us", "size")})  # nulls are the same in any engine


@query(
    "q_storage_pressure",
    """
SELECT logical_id, CAST(sum(size) AS BIGINT) AS size, budget, CAST(sum(size) AS DOUBLE) / (budget + 1.0) AS pressure
FROM g JOIN logical_videos l ON l.id = g.logical_id GROUP BY logical_id, budget""",
)
def storage_pressure(c: Catalog) -> DataFrame:
    return views.storage_pressure(c.gops, c.physical_videos, c.logical_videos).select("logical_id", "size", "budget", "pressure")


@query(
    "q_most_overbudget",
    """
SELECT * FROM (SELECT logical_id, CAST(sum(size) AS BIGINT) AS size, budget, CAST(sum(size) AS DOUBLE) / (budget + 1.0) AS pressure
FROM g JOIN logical_videos l ON l.id = g.logical_id GROUP BY logical_id, budget) WHERE pressure > 1 ORDER BY pressure DESC, logical_id LIMIT 1""",
)
def most_overbudget(c: Catalog) -> DataFrame:
    return views.most_over_budget(c.gops, c.physical_videos, c.logical_videos).select("logical_id", "size", "budget", "pressure")


@query("q_vacuum_empty", "SELECT * FROM physical_videos p WHERE NOT EXISTS (SELECT 1 FROM gops WHERE physical_id = p.id)")
def vacuum_empty(c: Catalog) -> DataFrame:
    return views.empty_physicals(c.gops, c.physical_videos)


@query(
    "q_file_refcount",
    """
SELECT name || '-' || physical_id || '.' || codec || CASE WHEN codec = 'rgb' THEN '' ELSE '.mp4' END AS filename, count(*) AS refs
FROM g JOIN logical_videos l ON l.id = g.logical_id GROUP BY 1""",
)
def file_refcount(c: Catalog) -> DataFrame:
    return views.file_references(c.gops, c.physical_videos, c.logical_videos)


@query(
    "q_nth_gop",
    """
SELECT logical_id, id FROM (SELECT logical_id, id, row_number() OVER (PARTITION BY logical_id ORDER BY id) AS n FROM g) WHERE n = 10""",
)
def nth_gop(c: Catalog) -> DataFrame:
    """The tenth GOP of each logical video."""
    order = Window.partitionBy("logical_id").orderBy("id")
    return views.located(c.gops, c.physical_videos).withColumn("n", F.row_number().over(order)).where("n = 10").select("logical_id", "id")


@query(
    "q_frame_bytes",
    """
SELECT id, CAST(floor(CASE codec WHEN 'rgb' THEN 24 END * CAST(height AS BIGINT) * width / 8) AS DOUBLE) AS frame_bytes FROM physical_videos""",
)
def frame_bytes(c: Catalog) -> DataFrame:
    return c.physical_videos.select("id", E.frame_bytes(F.col("codec"), F.col("height"), F.col("width")).cast("double").alias("frame_bytes"))


# --- quality, covers and eviction ------------------------------------------------------------------------------------------------

_RANKED = """
ranked AS (
  SELECT g.*, CASE WHEN estimated_mse IS NULL THEN 0 ELSE rank() OVER (PARTITION BY physical_id ORDER BY estimated_mse NULLS LAST) - 1 END AS lower_count,
         count(*) OVER (PARTITION BY physical_id) AS n_gops, min(start_us) OVER (PARTITION BY physical_id) AS min_us, max(end_us) OVER (PARTITION BY physical_id) AS max_us
  FROM g),
cover AS (
  SELECT a.id, min(b.id) AS cover_id FROM g a JOIN g b ON a.logical_id = b.logical_id AND b.start_us <= a.start_us AND b.end_us >= a.end_us AND b.id <> a.id AND b.height >= a.height AND b.width >= a.width
     AND b.estimated_mse <= CASE WHEN a.estimated_mse IS NOT NULL THEN greatest(a.estimated_mse, 100.0) END
  GROUP BY a.id),
ranks AS (
  SELECT r.logical_id, r.physical_id, r.id, cover_id, clock, start_us, start_us <> min_us AND end_us <> max_us AS requires_cut, end_us - start_us AS gop_duration,
         lower_count, n_gops, CAST(start_us - min_us AS DOUBLE) / nullif(CAST(max_us - min_us AS DOUBLE), 0) AS time_pct, CAST(lower_count AS DOUBLE) / n_gops AS quality_pct
  FROM ranked r JOIN cover USING (id))
"""


@query("q_quality_rank", "SELECT id, physical_id, CAST(lower_count AS BIGINT) AS lower_count, n_gops, CAST(lower_count AS DOUBLE) / n_gops AS quality_pct FROM ranked", _RANKED)
def quality_rank(c: Catalog) -> DataFrame:
    return views.quality_ranks(c.gops).select("id", "physical_id", "lower_count", "n_gops", "quality_pct")


@query("q_time_percentile", "SELECT id, physical_id, CAST(start_us - min_us AS DOUBLE) / nullif(CAST(max_us - min_us AS DOUBLE), 0) AS time_pct FROM ranked", _RANKED)
def time_percentile(c: Catalog) -> DataFrame:
    return views.time_percentiles(c.gops).select("id", "physical_id", "time_pct")


@query("q_covered_gops", "SELECT id, physical_id, start_us, end_us FROM gops WHERE id IN (SELECT id FROM cover)", _RANKED)
def covered_gops(c: Catalog) -> DataFrame:
    return views.covered(c.gops, c.physical_videos).select("id", "physical_id", "start_us", "end_us")


@query("q_cover_gop", "SELECT gops.id, CAST(cover_id AS DOUBLE) AS cover_id, (start_us + end_us) / 2.0::DOUBLE AS midpoint_us FROM gops LEFT JOIN cover USING (id)", _RANKED)
def cover_gop(c: Catalog) -> DataFrame:
    rows = c.gops.join(views.covers(c.gops, c.physical_videos), "id", "left")
    return rows.select("id", F.col("cover_id").cast("double").alias("cover_id"), ((F.col("start_us") + F.col("end_us")) / F.lit(2.0)).alias("midpoint_us"))


@query("q_gop_ranks", "SELECT * REPLACE (CAST(lower_count AS BIGINT) AS lower_count) FROM ranks", _RANKED)
def gop_ranks(c: Catalog) -> DataFrame:
    return views.gop_ranks(c.gops, c.physical_videos)


@query(
    "q_evict_candidate",
    """
SELECT logical_id, id, requires_cut, score FROM (
  SELECT *, row_number() OVER (PARTITION BY logical_id ORDER BY score NULLS FIRST, id) AS n
  FROM (SELECT *, clock + 4.0::DOUBLE * (1 - abs(0.5::DOUBLE - time_pct)) + 2.0::DOUBLE * (1 - quality_pct) AS score FROM ranks)) WHERE n = 1""",
    _RANKED,
)
def evict_candidate(c: Catalog) -> DataFrame:
    return views.evict_candidates(views.gop_ranks(c.gops, c.physical_videos))


@query(
    "q_evict_lru",
    """
SELECT logical_id, clock, id, physical_id, requires_cut, cover_id, n_gops FROM (
  SELECT *, row_number() OVER (PARTITION BY logical_id ORDER BY clock, id) AS n FROM ranks) WHERE n = 1""",
    _RANKED,
)
def evict_lru(c: Catalog) -> DataFrame:
    return views.evict_lru(views.gop_ranks(c.gops, c.physical_videos))


@query(
    "q_evict_apply",
    """
, victims AS (
  SELECT id AS victim, physical_id, start_us AS cut_us FROM (SELECT *, row_number() OVER (PARTITION BY logical_id ORDER BY clock, id) AS n FROM ranks) WHERE n = 1),
rest AS (SELECT gops.*, victim, cut_us FROM gops LEFT JOIN victims v ON v.physical_id = gops.physical_id WHERE gops.id NOT IN (SELECT victim FROM victims)),
late AS (SELECT *, max(start_us) OVER (PARTITION BY physical_id) AS last_us FROM rest)
SELECT id, CASE WHEN start_us < cut_us AND last_us > cut_us THEN -victim ELSE physical_id END AS physical_id, start_us, end_us FROM late""",
    _RANKED,
)
def evict_apply(c: Catalog) -> DataFrame:
    victims = views.evict_lru(views.gop_ranks(c.gops, c.physical_videos)).select("id")
    return views.evicted(c.gops, victims).select("id", "physical_id", "start_us", "end_us")


_PAIRS = """
times AS (SELECT logical_id, codec, height, width, physical_id AS id, min(start_us) AS min_us, max(end_us) AS max_us FROM g GROUP BY ALL),
pairs AS (
  SELECT l.logical_id, l.id AS left_id, r.id AS right_id, l.max_us AS at_us FROM times l JOIN times r
  ON l.logical_id = r.logical_id AND l.codec = r.codec AND l.height = r.height AND l.width = r.width AND l.max_us = r.min_us AND l.id <> r.id)
"""


@query("q_compaction_pairs", "SELECT * FROM pairs", _PAIRS)
def compaction_pairs(c: Catalog) -> DataFrame:
    return views.compaction_pairs(c.gops, c.physical_videos)


@query(
    "q_compact_apply",
    """
, step AS (SELECT right_id, min(left_id) AS left_id FROM pairs GROUP BY right_id)
SELECT coalesce(left_id, physical_id) AS physical_id, count(*) AS n_gops FROM gops LEFT JOIN step ON physical_id = right_id GROUP BY 1""",
    _PAIRS,
)
def compact_apply(c: Catalog) -> DataFrame:
    """GOPs of each physical video after one step of compaction."""
    return views.compacted(c.gops, views.compaction_pairs(c.gops, c.physical_videos)).groupBy("physical_id").agg(F.count("*").alias("n_gops"))


@query(
    "q_compress_candidates",
    """
, p AS (SELECT g.*, CAST(sum(size) OVER (PARTITION BY physical_id) AS DOUBLE) / (budget + 1.0) AS pressure FROM g JOIN logical_videos l ON l.id = g.logical_id WHERE codec = 'rgb')
SELECT logical_id, id, row_number() OVER (PARTITION BY logical_id ORDER BY clock, id) AS position,
       CAST(greatest(1, round_even(least(pressure, 1.0) * 20, 0)) AS INTEGER) AS level FROM p WHERE pressure > 0.25""",
)
def compress_candidates(c: Catalog) -> DataFrame:
    return views.compression_candidates(c.gops, c.physical_videos, c.logical_videos).withColumn("position", F.col("position").cast("long"))


@query(
    "q_error_lineage",
    """
, made AS (SELECT id, estimated_mse, CASE WHEN k % 4 <> 0 THEN lag(id) OVER (PARTITION BY logical_id, ti ORDER BY start_us, id) END AS parent_id FROM (SELECT ev.*, k * 10.0::DOUBLE AS estimated_mse FROM ev)),
line AS (
  SELECT id, estimated_mse AS error, parent_id, 1 AS depth FROM made
  UNION ALL SELECT line.id, line.error + made.estimated_mse, made.parent_id, line.depth + 1 FROM line JOIN made ON made.id = line.parent_id)
SELECT id, max(error) AS error, CAST(max(depth) AS BIGINT) AS depth FROM line GROUP BY id""",
)
def error_lineage(c: Catalog) -> DataFrame:
    """Three of four GOPs as copies of the one before of the same user and type."""
    before = F.lag("id").over(Window.partitionBy("logical_id", "ti").orderBy("start_us", "id"))
    return views.lineage_error(c.events.select("id", F.when(F.col("k") % 4 != 0, before).alias("parent_id"), (F.col("k") * 10.0).alias("estimated_mse")))


ORACLE_SQL["q_error_lineage"] = ORACLE_SQL["q_error_lineage"].replace("WITH ", "WITH RECURSIVE ", 1)

# --- planning --------------------------------------------------------------------------------------------------------------------

_SPANS = """
spans AS (
  SELECT * FROM (
    SELECT logical_id, physical_id, codec, height, width, CAST(round_even(min(start_us) / 1e6::DOUBLE * 30, 0) AS BIGINT) AS s,
           CAST(round_even(max(end_us) / 1e6::DOUBLE * 30, 0) AS BIGINT) - 1 AS e FROM g GROUP BY ALL) WHERE e >= s),
points AS (SELECT DISTINCT logical_id, place FROM (SELECT logical_id, s AS place FROM spans UNION ALL SELECT logical_id, e + 1 FROM spans)),
starts AS (
  SELECT spans.*, place FROM spans JOIN points ON spans.logical_id = points.logical_id AND place >= s AND place <= e),
fragments AS (
  SELECT logical_id, physical_id, codec, height, width, row_number() OVER w - 1 AS fragment, place AS start, coalesce(lead(place) OVER w - 1, e) AS end_
  FROM starts WINDOW w AS (PARTITION BY physical_id ORDER BY place)),
deps AS (
  SELECT f.logical_id, f.physical_id, f.codec, f.height, f.width, fragment, start, end_, sum(CAST(gs >= start AND ge <= end_ AS BIGINT)) AS keyframes,
         sum(CASE WHEN gs >= start AND ge <= end_ THEN ge - gs ELSE 0 END) AS p_frames, sum(CAST(NOT (gs >= start AND ge <= end_) AS BIGINT)) AS partial
  FROM fragments f JOIN (
    SELECT physical_id, CAST(round_even(start_us / 1e6::DOUBLE * 30, 0) AS BIGINT) AS gs, CAST(round_even(end_us / 1e6::DOUBLE * 30, 0) AS BIGINT) - 1 AS ge FROM gops) x
  ON x.physical_id = f.physical_id AND ge >= gs AND start <= ge AND gs <= end_ GROUP BY ALL)
"""


@query("q_transition_points", "SELECT logical_id, place FROM points", _SPANS)
def transition_points(c: Catalog) -> DataFrame:
    return intervals.transition_points(intervals.frame_spans(c.gops, c.physical_videos))


@query("q_split_fragments", 'SELECT logical_id, physical_id, codec, height, width, CAST(fragment AS INTEGER) AS fragment, start, end_ AS "end" FROM fragments', _SPANS)
def split_fragments(c: Catalog) -> DataFrame:
    return intervals.split_fragments(intervals.frame_spans(c.gops, c.physical_videos))


@query("q_goal_matches", 'SELECT logical_id, start, end_ AS "end", count(*) AS n, min(physical_id) AS physical_id FROM fragments GROUP BY ALL', _SPANS)
def goal_matches(c: Catalog) -> DataFrame:
    return intervals.goal_matches(intervals.split_fragments(intervals.frame_spans(c.gops, c.physical_videos)))


@query(
    "q_decode_deps",
    """SELECT logical_id, physical_id, codec, height, width, CAST(fragment AS INTEGER) AS fragment, start, end_ AS "end", CAST(keyframes AS BIGINT) AS keyframes,
       CAST(p_frames AS BIGINT) AS p_frames, CAST(partial AS BIGINT) AS partial FROM deps""",
    _SPANS,
)
def decode_deps(c: Catalog) -> DataFrame:
    return intervals.decode_dependencies(intervals.split_fragments(intervals.frame_spans(c.gops, c.physical_videos)), c.gops)


@query(
    "q_fragment_costs",
    """
SELECT logical_id, physical_id, CAST(fragment AS INTEGER) AS fragment,
       CASE WHEN codec = 'hevc' AND height = 540 AND width = 960 THEN 0.0 ELSE CAST(end_ - start + 1 AS DOUBLE) * (540 * 960 * 1.1::DOUBLE * 1.1::DOUBLE) END AS encode_cost,
       CASE WHEN codec = 'rgb' OR (codec = 'hevc' AND height = 540 AND width = 960) THEN 0.0
            ELSE CAST(p_frames AS DOUBLE) * (floor(540 * 960 * 1.1::DOUBLE) * 1.1::DOUBLE) + CAST(keyframes AS DOUBLE) * (540 * 960 * 1.1::DOUBLE) END AS decode_cost
FROM deps""",
    _SPANS,
)
def fragment_costs(c: Catalog) -> DataFrame:
    deps = intervals.decode_dependencies(intervals.split_fragments(intervals.frame_spans(c.gops, c.physical_videos)), c.gops)
    return intervals.fragment_costs(deps, "hevc", 540, 960)


@query(
    "q_byte_windows",
    """
, s AS (SELECT l_orderkey AS video, l_linenumber AS sample, sum(CAST(l_quantity AS BIGINT)) AS size FROM lineitem GROUP BY ALL),
o AS (
  SELECT video, coalesce(sum(size) OVER (PARTITION BY video ORDER BY sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
         row_number() OVER (PARTITION BY video ORDER BY sample) - 1 AS n, sum(size) OVER (PARTITION BY video) AS total FROM s)
SELECT video, n // 3 AS gop, CAST(off AS BIGINT) AS start_byte, CAST(coalesce(lead(off) OVER (PARTITION BY video ORDER BY n), total) AS BIGINT) AS end_byte
FROM o WHERE n % 3 = 0""",
)
def byte_windows(c: Catalog) -> DataFrame:
    """Line items of an order as the samples of a video, three to a GOP."""
    samples = c.table("lineitem").groupBy(F.col("l_orderkey").alias("video"), F.col("l_linenumber").alias("sample")).agg(F.sum(F.col("l_quantity").cast("long")).alias("size"))
    return intervals.byte_windows(samples, 3)


@query(
    "q_virtual_path",
    """
, paths AS (SELECT id, width || 'x' || height || CASE WHEN id % 2 = 0 THEN 'c10-20-50-60' ELSE '' END || CASE WHEN id % 3 = 0 THEN 't1-' || (2 + id % 7) ELSE '' END || '.' || codec AS path FROM physical_videos),
m AS (SELECT id, path, regexp_extract(path, '^(\\d+)x(\\d+)(?:c(\\d+)-(\\d+)-(\\d+)-(\\d+))?(?:t(\\d+)-(\\d+))?\\.(hevc|h264|rgb|yuv)$', ['w', 'h', 'l', 't', 'cw', 'ch', 's', 'e', 'codec']) AS x FROM paths)
SELECT id, CAST(nullif(x.w, '') AS INTEGER) AS width, CAST(nullif(x.h, '') AS INTEGER) AS height, CAST(nullif(x.l, '') AS INTEGER) / 100.0::DOUBLE AS "left",
       CAST(nullif(x.cw, '') AS INTEGER) / 100.0::DOUBLE AS crop_width, CAST(nullif(x.s, '') AS DOUBLE) AS start, CAST(nullif(x.e, '') AS DOUBLE) AS "end", x.codec AS codec FROM m""",
)
def virtual_path(c: Catalog) -> DataFrame:
    crop = F.when(F.col("id") % 2 == 0, "c10-20-50-60").otherwise("")
    times = F.when(F.col("id") % 3 == 0, F.concat(F.lit("t1-"), (2 + F.col("id") % 7).cast("string"))).otherwise("")
    path = F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"), crop, times, F.lit("."), F.col("codec"))
    return c.physical_videos.select("id", E.parse_path(path).alias("p")).select("id", "p.width", "p.height", "p.left", "p.crop_width", F.col("p.start").cast("double").alias("start"), F.col("p.end").cast("double").alias("end"), "p.codec")


@query("q_plan_dp")
def plan_dp(c: Catalog) -> DataFrame:
    """Plans of whole logical videos for 540 x 960 hevc."""
    fragments = intervals.split_fragments(intervals.frame_spans(c.gops, c.physical_videos))
    g = c.gops.select("physical_id", F.col("id").alias("gop_id"), E.to_frames(F.col("start_us")).alias("g_start"), (E.to_frames(F.col("end_us")) - 1).alias("g_end"))
    return planner.plan_all(fragments, g, planner.Format("hevc", 540, 960))


# --- frames ----------------------------------------------------------------------------------------------------------------------


@query("q_crop", "SELECT frame_no, array_to_string(px[18:23] || px[26:31] || px[34:39] || px[42:47], ',') AS px FROM frames")
def crop(c: Catalog) -> DataFrame:
    return c.frames.select("frame_no", text(pixels.crop(F.col("px"), SIDE, 2, 1, 6, 7)).alias("px"))


@query("q_scale_nearest", "SELECT frame_no, array_to_string([px[(k // 6 * 8 // 6) * 8 + (k % 6) * 8 // 6 + 1] FOR k IN range(0, 36)], ',') AS px FROM frames")
def scale_nearest(c: Catalog) -> DataFrame:
    return c.frames.select("frame_no", text(pixels.scale_nearest(F.col("px"), SIDE, SIDE, 6, 6)).alias("px"))


@query(
    "q_fps_resample",
    """
, n AS (SELECT max(frame_no) AS last FROM frames)
SELECT k, CAST(k * 30 // 24 AS BIGINT) AS frame_no FROM n, range(0, (SELECT (last + 1) * 24 // 30 + 1 FROM n)) r(k)
WHERE k * 30 // 24 IN (SELECT frame_no FROM frames)""",
)
def fps_resample(c: Catalog) -> DataFrame:
    return pixels.resample(c.frames.select("frame_no"), 30, 24)


_NEIGHBOURS = "nb AS (SELECT a.frame_no, a.px AS a, b.px AS b FROM frames a JOIN frames b ON b.frame_no = a.frame_no + 1)"


@query(
    "q_frame_psnr",
    """
, e AS (SELECT frame_no, CAST(list_sum([(a[k] - b[k]) * (a[k] - b[k]) FOR k IN range(1, 65)]) AS DOUBLE) / 64 AS mse FROM nb)
SELECT frame_no, mse, round(CASE WHEN mse > 0 THEN 10 * log10(65025.0::DOUBLE / mse) END, 6) AS psnr FROM e""",
    _NEIGHBOURS,
)
def frame_psnr(c: Catalog) -> DataFrame:
    return pixels.frame_quality(c.frames).withColumn("psnr", F.round("psnr", 6))


@query("q_histogram", "SELECT frame_no, array_to_string([" + ", ".join(f"len([x FOR x IN px IF x // 32 = {k}])" for k in range(8)) + "], ',') AS histogram FROM frames")
def histogram(c: Catalog) -> DataFrame:
    return c.frames.select("frame_no", text(pixels.bucket_histogram(F.col("px"))).alias("histogram"))


@query(
    "q_color_histogram",
    "SELECT frame_no, array_to_string([" + ", ".join(f"len([k FOR k IN range(1, 22) IF 4 * (px[3 * k] // 128) + 2 * (px[3 * k - 1] // 128) + px[3 * k - 2] // 128 = {b}])" for b in range(8)) + "], ',') AS histogram FROM frames",
)
def color_histogram(c: Catalog) -> DataFrame:
    """Three pixels in turn as the red, green and blue of one."""
    at = lambda k: F.element_at("px", k)
    packed = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: at(3 * k + 1) * 65536 + at(3 * k + 2) * 256 + at(3 * k + 3))
    return pixels.color_histogram(c.frames.select("frame_no", packed.alias("rgb"))).withColumn("histogram", text(F.col("histogram")))


@query(
    "q_dominant_value",
    """
, v AS (SELECT frame_no, unnest(px) AS value FROM frames), n AS (SELECT frame_no, value, count(*) AS n FROM v GROUP BY ALL)
SELECT frame_no, value, n FROM (SELECT *, row_number() OVER (PARTITION BY frame_no ORDER BY n DESC, value) AS r FROM n) WHERE r = 1""",
)
def dominant_value(c: Catalog) -> DataFrame:
    return pixels.dominant_value(c.frames)


@query("q_first_frame", "SELECT cluster_id, array_to_string(arg_min(px, frame_no), ',') AS px, min(frame_no) AS frame_no FROM frames GROUP BY cluster_id")
def first_frame(c: Catalog) -> DataFrame:
    return pixels.first_frames(c.frames).withColumn("px", text(F.col("px")))


@query("q_smallest_cluster", "SELECT cluster_id, count(*) AS n, min(frame_no) AS first FROM frames GROUP BY cluster_id ORDER BY n, cluster_id LIMIT 1")
def smallest_cluster(c: Catalog) -> DataFrame:
    return pixels.smallest_cluster(c.frames)


@query("q_interleave", "SELECT frame_no * 2 AS frame_no, array_to_string(px, ',') AS px FROM frames UNION ALL SELECT (frame_no - 1) * 2 + 1, array_to_string(px, ',') FROM frames WHERE frame_no > 0")
def interleave(c: Catalog) -> DataFrame:
    """A video and the same video a frame later."""
    later = c.frames.where("frame_no > 0").select((F.col("frame_no") - 1).alias("frame_no"), "px")
    return pixels.interleave(c.frames.select("frame_no", "px"), later).withColumn("px", text(F.col("px")))


@query("q_uninterleave", "SELECT frame_no // 2 AS frame_no, array_to_string(px, ',') AS px FROM frames WHERE frame_no % 2 = 1")
def uninterleave(c: Catalog) -> DataFrame:
    return pixels.uninterleave(c.frames, 1).withColumn("px", text(F.col("px")))


@query(
    "q_aligned_frames",
    """
, a AS (SELECT frame_no, px FROM frames), b AS (SELECT frame_no + 3 AS frame_no, px FROM frames)
SELECT frame_no, coalesce(array_to_string(a.px, ','), array_to_string([0 FOR k IN range(0, 64)], ',')) AS a, coalesce(array_to_string(b.px, ','), array_to_string([0 FOR k IN range(0, 64)], ',')) AS b
FROM a FULL JOIN b USING (frame_no)""",
)
def aligned_frames(c: Catalog) -> DataFrame:
    late = c.frames.select((F.col("frame_no") + 3).alias("frame_no"), "px")
    return pixels.aligned(c.frames.select("frame_no", "px"), late, SIDE * SIDE).select("frame_no", text(F.col("a")).alias("a"), text(F.col("b")).alias("b"))


def _pairwise(name: str, each: str, join: Callable[[Column, Column], Column]) -> None:
    sql = f"SELECT frame_no, array_to_string([{each} FOR k IN range(1, 65)], ',') AS px FROM nb"
    query(name, sql, _NEIGHBOURS)(lambda c: pixels.neighbours(c.frames).select("frame_no", text(join(F.col("a"), F.col("b"))).alias("px")))


_DELTA = "CAST(greatest(0, least(255, floor((b[k] - a[k]) / 2.0) + 127)) AS INTEGER)"
_pairwise("q_join_left", "CASE WHEN a[k] <> 0 THEN a[k] ELSE b[k] END", pixels.join_left)
_pairwise("q_join_right", "CASE WHEN b[k] <> 0 THEN b[k] ELSE a[k] END", pixels.join_right)
_pairwise("q_join_mean", "CASE WHEN b[k] >= 9 THEN (a[k] + b[k]) // 2 ELSE a[k] END", pixels.join_mean)
_pairwise("q_join_interlace", "CASE WHEN (k - 1) // 8 % 2 = 0 THEN a[k] ELSE b[k] END", lambda a, b: pixels.join_interlace(a, b, SIDE))
_pairwise("q_join_delta", _DELTA, pixels.join_delta)
_pairwise("q_recover_delta", f"greatest(0, least(255, ({_DELTA} - 127) * 2 + a[k]))", lambda a, b: pixels.recover_delta(a, pixels.join_delta(a, b)))
_pairwise("q_split_interlace", "CASE WHEN (k - 1) // 8 % 2 = 0 THEN a[k] ELSE a[k - 8] END", lambda a, b: pixels.split_interlace(pixels.join_interlace(a, b, SIDE), SIDE, 0))

_KNN = """
d AS (
  SELECT a.frame_no, b.frame_no AS other, CAST(list_sum([(a.px[k] - b.px[k]) * (a.px[k] - b.px[k]) FOR k IN range(1, 65)]) AS BIGINT) AS l2,
         CAST(list_sum([bit_count(xor(a.px[k], b.px[k])) FOR k IN range(1, 65)]) AS BIGINT) AS bits
  FROM frames a JOIN frames b ON a.cluster_id = b.cluster_id AND a.frame_no <> b.frame_no)
"""


def _knn(metric: str, column: str, good: str) -> str:
    return f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY frame_no ORDER BY {column}, other) AS n FROM d),
t AS (SELECT frame_no, max(other) FILTER (WHERE n = 1) AS first, max({column}) FILTER (WHERE n = 1) AS d1, max(other) FILTER (WHERE n = 2) AS second, max({column}) FILTER (WHERE n = 2) AS d2 FROM r GROUP BY frame_no)
SELECT f.frame_no, first, d1, second, d2, coalesce({good}, false) AS good FROM frames f LEFT JOIN t USING (frame_no)"""


@query("q_knn_ratio", _knn("l2", "l2", "sqrt(CAST(d1 AS DOUBLE)) < sqrt(CAST(d2 AS DOUBLE)) * 0.7::DOUBLE"), _KNN)
def knn_ratio(c: Catalog) -> DataFrame:
    return matching.ratio_matches(c.frames)


@query("q_knn_hamming", _knn("hamming", "bits", "CAST(d1 AS DOUBLE) < CAST(d2 AS DOUBLE) * 0.7::DOUBLE"), _KNN)
def knn_hamming(c: Catalog) -> DataFrame:
    return matching.ratio_matches(c.frames, metric="hamming")


@query("q_dedup", "SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS keeper FROM documents")
def dedup(c: Catalog) -> DataFrame:
    return pixels.deduplicated(c.table("documents"), "doc_id", "text")


@query("q_joint_anti", "SELECT frame_no, cluster_id FROM frames f WHERE NOT EXISTS (SELECT 1 FROM nb WHERE nb.frame_no = f.frame_no AND nb.a[1] = nb.b[1])", _NEIGHBOURS)
def joint_anti(c: Catalog) -> DataFrame:
    """Frames that are not in the list of aborted pairs: those that start with the same pixel as the next one."""
    aborted = pixels.neighbours(c.frames).where(F.element_at("a", 1) == F.element_at("b", 1)).select("frame_no")
    return c.frames.select("frame_no", "cluster_id").join(aborted, "frame_no", "left_anti")


@query("q_joint_count", "SELECT cluster_id, CAST(sum(CAST(px[1] % 2 = 0 AS INTEGER)) AS BIGINT) // 2 AS joint FROM frames GROUP BY cluster_id")
def joint_count(c: Catalog) -> DataFrame:
    """Pairs among the frames marked as joint: those whose first pixel is even."""
    return c.frames.groupBy("cluster_id").agg(F.sum((F.element_at("px", 1) % 2 == 0).cast("int")).alias("n")).select("cluster_id", F.expr("n div 2").alias("joint"))


@query(
    "q_best_share",
    """
, m AS (SELECT cluster_id AS "group", frame_no AS id, px[1] AS score FROM frames)
SELECT "group", id, n FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY score DESC, id) AS n, count(*) OVER (PARTITION BY "group") AS c FROM m) WHERE n <= c // 20 + 1""",
)
def best_share(c: Catalog) -> DataFrame:
    rows = c.frames.select(F.col("cluster_id").alias("group"), F.col("frame_no").alias("id"), F.element_at("px", 1).alias("score"))
    return pixels.best_share(rows).withColumn("n", F.col("n").cast("long"))


@query(
    "q_numbered",
    "SELECT frame_no, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY frame_no) + 99 AS n FROM frames",
)
def numbered(c: Catalog) -> DataFrame:
    """Consecutive numbers from an offset."""
    return c.frames.select("frame_no", "cluster_id", (F.row_number().over(Window.partitionBy("cluster_id").orderBy("frame_no")) + 99).cast("long").alias("n"))


@query(
    "q_color_distance",
    "SELECT frame_no, round(sqrt(CAST((px[1] - 127) * (px[1] - 127) + (px[2] - 127) * (px[2] - 127) + (px[3] - 127) * (px[3] - 127) AS DOUBLE)), 6) AS distance FROM frames",
)
def color_distance(c: Catalog) -> DataFrame:
    at = lambda k: F.element_at("px", k)
    return c.frames.select("frame_no", F.round(pixels.colour_distance(at(1) * 65536 + at(2) * 256 + at(3), (127, 127, 127)), 6).alias("distance"))


@query("q_zstd_roundtrip", "SELECT doc_id, strlen(text) AS n_bytes, true AS same FROM documents")
def zstd_roundtrip(c: Catalog) -> DataFrame:
    """Texts compressed and back."""
    rows = c.table("documents").select("doc_id", F.encode("text", "utf-8").alias("raw"), F.encode("text", "utf-8").alias("content"))
    back = fr.decompress(fr.compress(rows, "content", 3), "content")
    return back.select("doc_id", F.octet_length("content").cast("long").alias("n_bytes"), (F.col("raw") == F.col("content")).alias("same"))


@query("q_frame_ssim")
def frame_ssim(c: Catalog) -> DataFrame:
    """PSNR and SSIM of each frame and the next, by the functions on bytes."""
    chars = F.transform("px", lambda x: F.lpad(F.hex(x), 2, "0"))
    rows = c.frames.select(F.lit(0).cast("long").alias("video_id"), "frame_no", (F.col("frame_no") / 30.0).alias("t"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), F.lit(1).alias("channels"), F.unhex(F.array_join(chars, "")).alias("pixels"))
    return fr.quality(rows, rows.withColumn("frame_no", F.col("frame_no") - 1))


# --- detections ------------------------------------------------------------------------------------------------------------------

GAP_US = 3_600_000_000


@query("q_class_filter", "SELECT event_id, user_id AS video, value AS confidence FROM events WHERE event_type = 'error'")
def class_filter(c: Catalog) -> DataFrame:
    return c.table("events").where("event_type = 'error'").select("event_id", F.col("user_id").alias("video"), F.col("value").alias("confidence"))


@query(
    "q_sessionize",
    f"""
, h AS (SELECT logical_id AS video, start_us AS t, row_number() OVER (PARTITION BY logical_id ORDER BY start_us) AS n FROM ev),
walk AS (
  SELECT video, t, n, t AS anchor, 0 AS session FROM h WHERE n = 1
  UNION ALL
  SELECT h.video, h.t, h.n, CASE WHEN h.t - walk.anchor > {GAP_US} THEN h.t ELSE walk.anchor END, CASE WHEN h.t - walk.anchor > {GAP_US} THEN walk.session + 1 ELSE walk.session END
  FROM walk JOIN h ON h.video = walk.video AND h.n = walk.n + 1),
s AS (SELECT video, session, min(t) AS start_us, max(t) AS last, count(*) AS n_hits FROM walk GROUP BY video, session)
SELECT video, session, start_us, coalesce(lead(start_us) OVER (PARTITION BY video ORDER BY session), last + {GAP_US}) AS end_us, n_hits FROM s""",
)
def sessionize(c: Catalog) -> DataFrame:
    return intervals.sessions(c.events.select(F.col("logical_id").alias("video"), F.col("start_us").alias("t_us")), GAP_US)


ORACLE_SQL["q_sessionize"] = ORACLE_SQL["q_sessionize"].replace("WITH ", "WITH RECURSIVE ", 1)
