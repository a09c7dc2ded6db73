"""Queries of catalog changes, of background choices and of what joint storage measures, with their SQL. Stand-in columns that the plain
tables lack are derived from ids, in the query and its SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinelake.functions import expressions as E
from cinelake.operators import intervals, pixels, transitions, views
from cinelake.plans.adapter import SIDE, Catalog
from cinelake.plans.registry import query, text

_NEIGHBOURS = "nb AS (SELECT a.frame_no, a.px AS a, b.px AS b FROM frames a JOIN frames b ON b.frame_no = a.frame_no + 1)"
_NAMES = "names AS (SELECT g.id, name || '-' || physical_id || '.' || codec || CASE WHEN codec = 'rgb' THEN '' ELSE '.mp4' END AS filename, size FROM g JOIN logical_videos l ON l.id = g.logical_id)"


def _named(c: Catalog) -> DataFrame:
    rows = views.located(c.gops, c.physical_videos).join(c.logical_videos.select(F.col("id").alias("logical_id"), "name"), "logical_id")
    return rows.select("id", E.file_name(F.col("name"), F.col("physical_id"), F.col("codec")).alias("filename"), "size")


@query("q_budget_set", "SELECT id, name, CASE WHEN id % 5 = 0 THEN 1000.0::DOUBLE * id ELSE budget END AS budget FROM logical_videos")
def budget_set(c: Catalog) -> DataFrame:
    return transitions.budget_set(c.logical_videos, c.logical_videos.where("id % 5 = 0").select("id", (F.col("id") * 1000.0).alias("new_budget")))


@query(
    "q_clock_stamp",
    """
, used AS (SELECT DISTINCT g.id FROM g JOIN requests r ON g.logical_id = r.logical_id AND g.start_us < r.t1 AND g.end_us >= r.t0 AND g.height >= r.h AND g.width >= r.w)
SELECT id, CASE WHEN id IN (SELECT id FROM used) THEN (SELECT max(clock) + 1 FROM gops) ELSE clock END AS clock FROM gops""",
)
def clock_stamp(c: Catalog) -> DataFrame:
    used = views.overlapping(c.gops, c.physical_videos, c.requests).select("id")
    now = c.gops.agg((F.max("clock") + 1).alias("now"))
    return transitions.stamped(c.gops.crossJoin(F.broadcast(now)), used, F.col("now")).select("id", "clock")


@query("q_delete_cascade", "SELECT p.id AS physical_id, count(gops.id) AS n_gops FROM physical_videos p JOIN logical_videos l ON l.id = p.logical_id LEFT JOIN gops ON gops.physical_id = p.id WHERE l.id % 3 <> 0 GROUP BY p.id")
def delete_cascade(c: Catalog) -> DataFrame:
    gops, physicals, _ = transitions.deleted(c.gops, c.physical_videos, c.logical_videos, c.logical_videos.where("id % 3 = 0").select("name"))
    return views.physical_times(gops, physicals).select(F.col("id").alias("physical_id"), "n_gops")


@query("q_file_delete", "SELECT filename FROM names GROUP BY filename HAVING bool_and(id % 4 <> 0 OR size < 5000)", _NAMES)
def file_delete(c: Catalog) -> DataFrame:
    """Files whose GOPs are all evicted: those of an id not divisible by four, or of less than 5000 bytes."""
    rows = _named(c)
    return transitions.unreferenced(rows, rows.where("id % 4 != 0 or size < 5000").select("id"))


_ABORTED = "pairs AS (SELECT id AS gop1, id + 7 AS gop2 FROM gops WHERE id % 10 = 0 UNION ALL SELECT id + 7, id FROM gops WHERE id % 20 = 0)"


def _aborted(c: Catalog) -> DataFrame:
    one = c.gops.where("id % 10 = 0").select(F.col("id").alias("gop1"), (F.col("id") + 7).alias("gop2"))
    return one.union(c.gops.where("id % 20 = 0").select(F.col("id") + 7, "id"))


@query("q_abort_pairs", "SELECT gop1, gop2 FROM pairs UNION SELECT gop2, gop1 FROM pairs", _ABORTED)
def abort_pairs(c: Catalog) -> DataFrame:
    return transitions.aborted(_aborted(c))


@query("q_examined", "SELECT id, (SELECT count(*) FROM pairs WHERE gop1 = gops.id OR gop2 = gops.id) AS examined FROM gops", _ABORTED)
def examined(c: Catalog) -> DataFrame:
    return transitions.examined(c.gops.select("id", F.lit(0).cast("long").alias("examined")), _aborted(c))


@query("q_joint_mark", "SELECT id, id % 10 IN (0, 7) AND (id % 10 = 0 OR id - 7 IN (SELECT id FROM gops)) AS joint FROM gops")
def joint_mark(c: Catalog) -> DataFrame:
    pairs = c.gops.where("id % 10 = 0").select(F.col("id").alias("left"), (F.col("id") + 7).alias("right"))
    return transitions.joint_marked(c.gops, pairs).select("id", "joint")


@query("q_unexamined", "SELECT id FROM gops WHERE id % 3 = 0 AND NOT (id % 10 = 0) AND id NOT IN (SELECT id FROM gops WHERE id % 7 = 0)")
def unexamined(c: Catalog) -> DataFrame:
    rows = c.gops.select("id", (F.col("id") % 3).alias("examined"), (F.col("id") % 10 == 0).alias("joint"))
    return transitions.unexamined(rows, c.gops.where("id % 7 = 0").select("id")).select("id")


@query("q_next_in_turn", "SELECT logical_id, min(id) AS id FROM g WHERE physical_id <> (SELECT min(x.physical_id) FROM g x WHERE x.logical_id = g.logical_id) GROUP BY logical_id")
def next_in_turn(c: Catalog) -> DataFrame:
    rows = views.located(c.gops, c.physical_videos)
    return transitions.next_in_turn(rows, rows.groupBy("logical_id").agg(F.min("physical_id").alias("physical_id")))


@query(
    "q_compress_apply",
    """
, p AS (SELECT g.*, CAST(sum(size) OVER (PARTITION BY physical_id) AS DOUBLE) / (budget + 1.0) AS pressure FROM g JOIN logical_videos l ON l.id = g.logical_id WHERE codec = 'rgb'),
lv AS (SELECT id, CAST(greatest(1, round_even(least(pressure, 1.0) * 20, 0)) AS INTEGER) AS level FROM p WHERE pressure > 0.25)
SELECT gops.id, coalesce(level, 0) AS zstandard, CASE WHEN level IS NULL THEN size ELSE size // 2 END AS size, CASE WHEN level IS NULL THEN -1 ELSE size END AS original_size FROM gops LEFT JOIN lv ON lv.id = gops.id""",
)
def compress_apply(c: Catalog) -> DataFrame:
    """GOPs after compression to half their size."""
    levels = views.compression_candidates(c.gops, c.physical_videos, c.logical_videos).select("id", "level").join(c.gops.select("id", F.expr("size div 2").alias("new_size")), "id")
    return transitions.compressed(c.gops, levels).select("id", F.coalesce("zstandard", F.lit(0)).alias("zstandard"), "size", F.coalesce("original_size", F.lit(-1)).alias("original_size"))


@query("q_error_record", "SELECT id, CASE WHEN k % 2 = 0 THEN k * 5.0::DOUBLE ELSE -1 END AS mse FROM ev JOIN gops USING (id)")
def error_record(c: Catalog) -> DataFrame:
    known = c.events.where("k % 2 = 0").select("id", (F.col("k") * 5.0).alias("error"))
    return transitions.errors_recorded(c.gops, known).select("id", F.coalesce("mse", F.lit(-1.0)).alias("mse"))


@query(
    "q_error_bound",
    "SELECT id, CASE WHEN k % 2 = 1 THEN 2 * (before + k) ELSE before END AS bound FROM (SELECT id, k, lag(k * 10.0::DOUBLE) OVER (PARTITION BY logical_id, ti ORDER BY start_us, id) AS before FROM ev) WHERE before IS NOT NULL",
)
def error_bound(c: Catalog) -> DataFrame:
    """Of copies of the GOP before: those with an odd number lost something."""
    before = F.lag(F.col("k") * 10.0).over(Window.partitionBy("logical_id", "ti").orderBy("start_us", "id"))
    rows = c.events.withColumn("before", before).where("before is not null")
    return rows.select("id", views.measured_bound(F.col("before"), F.when(F.col("k") % 2 == 1, F.col("k")).otherwise(0).cast("double")).alias("bound"))


@query("q_file_names", "SELECT id, filename || '.zst' AS packed, ends_with(filename || '.zst', '.zst') AS is_packed, split_part(filename, '-', -1) AS suffix, replace(filename || '-{}', '{}', 'left') AS part FROM names", _NAMES)
def file_names(c: Catalog) -> DataFrame:
    name = F.col("filename")
    packed = E.compressed_name(name)
    return _named(c).select("id", packed.alias("packed"), E.is_compressed(packed).alias("is_packed"), transitions.suffix(name).alias("suffix"), transitions.part_name(F.concat(name, F.lit("-{}")), "left").alias("part"))


@query(
    "q_numbers",
    """SELECT event_id, CAST(round_even(value, 0) AS BIGINT) + CAST(round_even(value, 0) AS BIGINT) % 2 AS even, round(65025.0::DOUBLE / pow(10.0::DOUBLE, (event_id % 60) / 10.0::DOUBLE), 6) AS mse,
       event_id + 3 - user_id + 1 AS length, user_id <= event_id + 1 AND event_id <= user_id + 5 AS meets FROM events""",
)
def numbers(c: Catalog) -> DataFrame:
    """Even rounding, error of a PSNR, length and meeting of inclusive intervals."""
    a, b = F.col("event_id"), F.col("user_id")
    return c.table("events").select("event_id", E.round_even(F.col("value")).alias("even"), F.round(E.mse_of_psnr((a % 60).cast("double")), 6).alias("mse"), E.interval_length(b, a + 3).alias("length"), E.intersects(b, b + 5, a, a + 1).alias("meets"))


@query(
    "q_last_cover",
    """
, cand AS (SELECT g.logical_id, physical_id, min(start_us) AS s, max(end_us) AS e, any_value(t0) AS t0, any_value(t1) AS t1 FROM g JOIN requests r ON g.logical_id = r.logical_id AND g.start_us < r.t1 AND g.end_us >= r.t0 AND g.height >= r.h AND g.width >= r.w GROUP BY ALL)
SELECT logical_id, max(physical_id) AS physical_id FROM cand WHERE s <= t0 AND e >= t1 - (t1 - t0) // 2 GROUP BY logical_id""",
)
def last_cover(c: Catalog) -> DataFrame:
    """Of the first half of each request."""
    found = views.candidates(c.gops, c.physical_videos, c.requests).join(c.requests.select("logical_id", "t0", F.expr("t1 - (t1 - t0) div 2").alias("t1")), "logical_id")
    return transitions.last_cover(found)


@query(
    "q_goal_join",
    """SELECT f.logical_id, f.start, f.end_ AS "end", f.physical_id FROM fragments f JOIN (SELECT DISTINCT logical_id, start, end_ FROM fragments WHERE codec = 'h264') x
       ON x.logical_id = f.logical_id AND x.start = f.start AND x.end_ = f.end_""",
    """
spans AS (
  SELECT * FROM (
    SELECT logical_id, physical_id, codec, height, width, CAST(round_even(min(start_us) / 1e6::DOUBLE * 30, 0) AS BIGINT) AS s,
           CAST(round_even(max(end_us) / 1e6::DOUBLE * 30, 0) AS BIGINT) - 1 AS e FROM g GROUP BY ALL) WHERE e >= s),
points AS (SELECT DISTINCT logical_id, place FROM (SELECT logical_id, s AS place FROM spans UNION ALL SELECT logical_id, e + 1 FROM spans)),
starts AS (SELECT spans.*, place FROM spans JOIN points ON spans.logical_id = points.logical_id AND place >= s AND place <= e),
fragments AS (
  SELECT logical_id, physical_id, codec, place AS start, coalesce(lead(place) OVER w - 1, e) AS end_ FROM starts WINDOW w AS (PARTITION BY physical_id ORDER BY place))""",
)
def goal_join(c: Catalog) -> DataFrame:
    """Fragments that can serve the goal intervals, here those of h264 videos."""
    fragments = intervals.split_fragments(intervals.frame_spans(c.gops, c.physical_videos))
    goals = fragments.where("codec = 'h264'").select("logical_id", "start", "end").distinct()
    return intervals.fragments_for(fragments, goals).select("logical_id", "start", "end", "physical_id")


@query("q_gop_counts", "SELECT (SELECT count(*) FROM physical_videos) AS n_physical, (SELECT count(*) FROM logical_videos) AS n_logical, (SELECT max(clock) + 1 FROM gops) AS now")
def gop_counts(c: Catalog) -> DataFrame:
    counts = c.physical_videos.agg(F.count("*").alias("n_physical")).crossJoin(c.logical_videos.agg(F.count("*").alias("n_logical")))
    return counts.crossJoin(c.gops.agg((F.max("clock") + 1).alias("now")))  # one row each


@query("q_gops_of", "SELECT id, physical_id, start_us FROM gops WHERE id IN (SELECT id * 3 FROM gops) OR physical_id = (SELECT min(physical_id) FROM gops)")
def gops_of(c: Catalog) -> DataFrame:
    """Rows fetched by a list of ids, and those of one physical video."""
    listed = c.gops.join(c.gops.select((F.col("id") * 3).alias("id")), "id", "left_semi")
    of_one = c.gops.join(F.broadcast(c.gops.agg(F.min("physical_id").alias("physical_id"))), "physical_id", "left_semi")
    return listed.select("id", "physical_id", "start_us").union(of_one.select("id", "physical_id", "start_us")).distinct()


# --- frames


@query("q_frame_list", "SELECT frame_no, array_to_string(px, ',') AS px FROM frames WHERE frame_no IN (SELECT event_id FROM events WHERE event_type = 'error')")
def frame_list(c: Catalog) -> DataFrame:
    """The frames of a list of numbers."""
    wanted = c.table("events").where("event_type = 'error'").select(F.col("event_id").alias("frame_no"))
    return c.frames.join(wanted, "frame_no", "left_semi").select("frame_no", text(F.col("px")).alias("px"))


@query("q_trim", "SELECT frame_no - 30 AS frame_no, array_to_string(px, ',') AS px FROM frames WHERE frame_no / 30.0::DOUBLE >= 1 AND frame_no / 30.0::DOUBLE < 2.5")
def trim(c: Catalog) -> DataFrame:
    """Seconds 1 to 2.5, numbered anew."""
    t = F.col("frame_no") / F.lit(30.0)
    return c.frames.where((t >= 1) & (t < 2.5)).select((F.col("frame_no") - 30).alias("frame_no"), text(F.col("px")).alias("px"))


@query("q_concat", "SELECT row_number() OVER (ORDER BY cluster_id, frame_no) - 1 AS frame_no, cluster_id FROM frames WHERE cluster_id < 3")
def concat(c: Catalog) -> DataFrame:
    """The frames of clusters one after the other, by the counts of the clusters before: no global sort."""
    return pixels.concatenated(c.frames.where("cluster_id < 3"), "cluster_id").select(F.col("number").alias("frame_no"), "cluster_id")


@query(
    "q_transcode_chain",
    "SELECT k, array_to_string([px[((j // 3 * 4 // 3) + 2) * 8 + (j % 3) * 6 // 3 + 1 + 1] FOR j IN range(0, 9)], ',') AS px FROM frames, range(0, 100000) r(k) WHERE frame_no = k * 2",
)
def transcode_chain(c: Catalog) -> DataFrame:
    """Every other frame, cropped to 4 x 6 and scaled to 3 x 3."""
    rows = pixels.resample(c.frames.where("frame_no < 200000").select("frame_no"), 30, 15).join(c.frames.select("frame_no", "px"), "frame_no")
    cut = rows.select("k", pixels.crop(F.col("px"), SIDE, 2, 1, 6, 7).alias("px"))
    return cut.select("k", text(pixels.scale_nearest(F.col("px"), 4, 6, 3, 3)).alias("px"))


@query(
    "q_join_mean_rgb",
    "SELECT frame_no, array_to_string([CASE WHEN list_sum(b[4 * ((k - 1) // 4) + 1 : 4 * ((k - 1) // 4) + 4]) >= 900 THEN (a[k] + b[k]) // 2 ELSE a[k] END FOR k IN range(1, 65)], ',') AS px FROM nb",
    _NEIGHBOURS,
)
def join_mean_channels(c: Catalog) -> DataFrame:
    """Pixels of four channels, averaged where the sum of the right one's channels is at least 900."""
    return pixels.neighbours(c.frames).select("frame_no", text(pixels.join_mean(F.col("a"), F.col("b"), 900, 4)).alias("px"))


@query(
    "q_joint_benefit",
    """
, e AS (SELECT cluster_id, CAST(list_sum([(a[k] - b[k]) * (a[k] - b[k]) FOR k IN range(1, 65)]) AS DOUBLE) / 64 AS mse FROM nb JOIN frames USING (frame_no))
SELECT cluster_id, count(*) AS n, round(avg(CASE WHEN mse > 0 THEN 10 * log10(65025.0::DOUBLE / mse) END), 6) AS psnr, CAST(sum(64 - 48) AS BIGINT) AS saved, CAST(sum(64 - 48) AS DOUBLE) / sum(64) AS benefit FROM e GROUP BY cluster_id""",
    _NEIGHBOURS,
)
def joint_benefit(c: Catalog) -> DataFrame:
    """Mean PSNR, and what is saved where a quarter of each frame need not be stored."""
    rows = pixels.neighbours(c.frames).join(c.frames.select("frame_no", "cluster_id"), "frame_no").select("cluster_id", pixels.mse(F.col("a"), F.col("b")).alias("mse"), F.lit(64).alias("whole"), F.lit(48).alias("stored"))
    return pixels.joint_benefit(rows, "cluster_id").withColumn("psnr", F.round("psnr", 6))


@query(
    "q_max_abs",
    """
, h AS (SELECT frame_no, [""" + ", ".join(f"len([x FOR x IN px IF x // 32 = {k}])" for k in range(8)) + """] AS h FROM frames),
m AS (SELECT [""" + ", ".join(f"max(h[{k}])" for k in range(1, 9)) + """] AS m FROM h)
SELECT frame_no, array_to_string([CAST(CAST(round(1000 * CASE WHEN m[k] = 0 THEN 0.0::DOUBLE ELSE h[k] / CAST(m[k] AS DOUBLE) END, 0) AS INTEGER) AS VARCHAR) FOR k IN range(1, 9)], ',') AS scaled FROM h, m""",
)
def max_abs(c: Catalog) -> DataFrame:
    """Histograms scaled by the greatest count of each bucket, in thousandths."""
    rows = c.frames.select("frame_no", F.transform(pixels.bucket_histogram(F.col("px")), lambda x: x.cast("double")).alias("h"))
    scaled = transitions.max_abs_scaled(rows, "frame_no", "h")
    return scaled.select("frame_no", text(F.transform("h", lambda x: F.round(x * 1000).cast("int"))).alias("scaled"))


@query(
    "q_cluster_assign",
    """
, b AS (SELECT frame_no, px[1] // 16 * 100 + px[2] // 16 AS key FROM frames),
n AS (SELECT key, row_number() OVER (ORDER BY key) AS cluster FROM b GROUP BY key HAVING count(*) > 1)
SELECT frame_no, coalesce(cluster, 0) AS cluster FROM b LEFT JOIN n USING (key)""",
)
def cluster_assign(c: Catalog) -> DataFrame:
    """Frames whose first pixels are in the same ranges as one cluster, from 1; 0 for those alone."""
    at = lambda k: F.floor(F.element_at("px", k) / 16)
    rows = c.frames.select("frame_no", (at(1) * 100 + at(2)).alias("histogram"))
    return transitions.clusters_assigned(rows).select("frame_no", F.coalesce("cluster", F.lit(0)).alias("cluster"))


@query(
    "q_best_candidate",
    """
, x AS (SELECT a.frame_no AS id, b.frame_no AS other, a.px[1] = b.px[1] AS same_suffix, len([k FOR k IN range(1, 65) IF a.px[k] = b.px[k]]) AS n_matches
  FROM frames a JOIN frames b ON b.frame_no BETWEEN a.frame_no + 1 AND a.frame_no + 4)
SELECT id, other, n_matches FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY same_suffix DESC, n_matches DESC, other DESC) AS r FROM x) WHERE r = 1""",
)
def best_candidate(c: Catalog) -> DataFrame:
    """Of the next four frames the one most like a frame."""
    near = c.frames.select(F.col("frame_no").alias("id"), F.col("px").alias("a"), F.explode(F.sequence(F.col("frame_no") + 1, F.col("frame_no") + 4)).alias("other"))
    rows = near.join(c.frames.select(F.col("frame_no").alias("other"), F.col("px").alias("b")), "other")
    alike = F.aggregate(F.zip_with("a", "b", lambda x, y: (x == y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return transitions.best_candidate(rows.select("id", "other", (F.element_at("a", 1) == F.element_at("b", 1)).alias("same_suffix"), alike.alias("n_matches")))


@query("q_row_numbers", "SELECT id, row_number() OVER (ORDER BY id) + 4 AS n FROM gops")
def row_numbers(c: Catalog) -> DataFrame:
    """Numbers over the whole table, from an offset of 5: counts of ranges of ids come first, so that no task gets all rows."""
    return pixels.numbered_by(c.gops.select("id"), "id", 5)
