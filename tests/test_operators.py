import numpy as np
import pytest
from pyspark.sql import functions as F

from cinelake.functions import expressions as E
from cinelake.operators import intervals, joint, matching, views
from cinelake.streaming import sessions

GOPS = "id long, physical_id long, start_us long, end_us long, size long, estimated_mse double, clock long, fps int"


@pytest.fixture
def catalog(spark):
    gops = spark.createDataFrame(
        [(1, 1, 0, 10, 5, 0.0, 1, 30), (2, 1, 10, 20, 5, None, 2, 30), (3, 1, 20, 30, 5, 300.0, 3, 30), (4, 2, 0, 30, 9, 50.0, 4, 30), (5, 3, 10, 20, 7, 90.0, 1, 30), (6, 4, 30, 40, 1, 0.0, 1, 30), (7, 6, 5, 5, 1, 1.0, 1, 30)], GOPS
    )
    physicals = spark.createDataFrame([(1, 1, 4, 4, "rgb"), (2, 1, 8, 8, "h264"), (3, 1, 4, 4, "rgb"), (4, 1, 4, 4, "rgb"), (5, 1, 4, 4, "rgb"), (6, 2, 4, 4, "rgb")], "id long, logical_id long, height int, width int, codec string")
    return gops, physicals


def ids(df, name="id"):
    return sorted(r[name] for r in df.collect())


def request(spark, t0, t1):
    return spark.createDataFrame([(1, t0, t1, 4, 4, "rgb")], "logical_id long, t0 long, t1 long, h int, w int, want string")


def test_boundaries(spark, catalog):
    # an end counts, a start does not
    assert ids(views.overlapping(*catalog, request(spark, 10, 20))) == [1, 2, 4, 5]
    assert ids(views.fragments(*catalog, request(spark, 10, 20))) == [2, 4, 5]
    assert ids(views.fragments(*catalog, request(spark, None, None))) == [1, 2, 3, 4, 5, 6]
    assert views.exact_match(*catalog, request(spark, 12, 18)).first()["gop_id"] == 2


def test_unknown_error(catalog):
    gops, physicals = catalog
    ranks = {r["id"]: r["lower_count"] for r in views.quality_ranks(gops).collect()}
    assert ranks[1] == 0 and ranks[2] == 0 and ranks[3] == 1
    found = {r["id"]: r["cover_id"] for r in views.covers(gops, physicals).collect()}
    assert 2 not in found and found[1] == 4 and found[3] == 4 and found[5] == 4
    assert {r["id"]: r["time_pct"] for r in views.time_percentiles(gops).collect()}[7] is None


def test_unknown_score_is_evicted_first(spark):
    ranks = spark.createDataFrame([(1, 1, 5, None, 0.5, False), (1, 2, 0, 0.5, 0.5, True)], "logical_id long, id long, clock long, time_pct double, quality_pct double, requires_cut boolean")
    assert views.evict_candidates(ranks).first()["id"] == 1


def test_eviction_in_the_middle_splits(spark, catalog):
    gops, _ = catalog
    for victim, parts in ((2, {1: -2, 3: 1}), (1, {2: 1, 3: 1}), (3, {1: 1, 2: 1}), (4, {1: 1, 2: 1, 3: 1})):
        rest = {r["id"]: r["physical_id"] for r in views.evicted(gops, spark.createDataFrame([(victim,)], "id long")).collect()}
        assert victim not in rest and {k: v for k, v in rest.items() if k in parts} == parts


def test_pairs_and_empty(catalog):
    gops, physicals = catalog
    assert [(r["left_id"], r["right_id"]) for r in views.compaction_pairs(gops, physicals).collect()] == [(1, 4)]
    assert ids(views.empty_physicals(gops, physicals)) == [5]


def test_expressions(spark):
    row = spark.range(1).select(
        E.strict_greatest(F.lit(None).cast("double"), F.lit(1.0)).alias("a"), E.to_frames(F.lit(50_000)).alias("b"), E.round_even(F.lit(2.6)).alias("c"), E.compression_level(F.lit(0.01)).alias("d"),
        E.psnr(F.lit(0.0)).alias("e"), E.mse_of_psnr(F.lit(20.0)).alias("f"), E.inter_frame_cost(F.lit("h264"), F.lit(3), F.lit(3)).alias("g"), E.parse_path(F.lit("10x20c1-2-3-4t5-6.hevc")).alias("h"),
        E.parse_path(F.lit("10x20.rgb")).alias("i"), E.is_compressed(E.compressed_name(F.lit("x.rgb"))).alias("j"), E.interval_length(F.lit(3), F.lit(3)).alias("k"), E.intersects(F.lit(1), F.lit(2), F.lit(2), F.lit(9)).alias("l"),
        E.error_bound(F.lit(1.0), F.lit(2.0)).alias("m"),
    ).first()
    assert (row["a"], row["b"], row["c"], row["d"], row["e"]) == (None, 2, 4, 1, None) and row["f"] == pytest.approx(650.25) and row["g"] == 9
    assert row["h"].asDict() == {"width": 10, "height": 20, "left": 0.01, "top": 0.02, "crop_width": 0.03, "crop_height": 0.04, "start": 5, "end": 6, "codec": "hevc"} and row["i"]["start"] is None
    assert row["j"] and row["k"] == 1 and row["l"] and row["m"] == 6.0


def anchored(ts, gap):
    out = []
    for t in sorted(ts):
        if not out or t - out[-1][0] > gap:
            out.append([t, t, 0])
        out[-1][1:] = [t, out[-1][2] + 1]
    return [(a[0], b[0] if b else a[1] + gap, a[2]) for a, b in zip(out, [*out[1:], None], strict=True)]


def test_sessions(spark):
    rng = np.random.default_rng(1)
    hits = [(v, int(t)) for v in range(4) for t in rng.integers(0, 200, 30)]
    found = intervals.sessions(spark.createDataFrame(hits, "video long, t_us long"), 10).collect()
    for v in range(4):
        assert [(r["start_us"], r["end_us"], r["n_hits"]) for r in sorted(found) if r["video"] == v] == anchored([t for w, t in hits if w == v], 10)


def test_streamed_sessions(spark, tmp_path):
    second = 1_000_000
    hits = [(1, t * second) for t in (100, 101, 104, 106, 130)] + [(2, 105 * second)]
    rows = spark.createDataFrame(hits, "video long, t_us long").withColumn("ts", F.timestamp_micros("t_us"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    query = sessions.streamed(stream, 3 * second, "0 seconds").writeStream.format("memory").queryName("closed").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(90)
    found = sorted(tuple(r) for r in spark.table("closed").collect())
    assert [x for x in found if x[0] == 1][:2] == [(1, 100 * second, 104 * second, 2), (1, 104 * second, 130 * second, 2)] and (2, 105 * second, 108 * second, 1) in found


def test_matching_in_pieces(spark):
    rng = np.random.default_rng(2)
    rows = [(k, k % 3, rng.integers(0, 256, 8).tolist()) for k in range(60)] + [(100, 9, [0] * 8)]
    df = spark.createDataFrame(rows, "frame_no long, cluster_id int, px array<int>")
    whole, cut = sorted(map(tuple, matching.nearest_two(df).collect())), sorted(map(tuple, matching.nearest_two(df, block=7).collect()))
    assert whole == cut and whole[-1] == (100, None, None, None, None)
    assert matching.radius_matches(df, 1e9).count() <= 60 and matching.ratio_matches(df, metric="hamming").count() == 61


def test_homography_and_joint_storage():
    rng = np.random.default_rng(3)
    h = np.array([[1.1, 0.02, -30], [0.01, 0.95, 4], [1e-5, 2e-5, 1]])
    points = rng.uniform(0, 200, (60, 2))
    seen = joint.project(h, points)
    seen[:15] += rng.uniform(20, 60, (15, 2))
    found, inverse = joint.homography(points, seen)
    assert np.allclose(found, h, atol=1e-3) and np.allclose(found @ inverse / (found @ inverse)[2, 2], np.eye(3), atol=1e-6)
    assert joint.homography(points[:3], seen[:3]) is None
    scene = rng.integers(0, 256, (40, 200, 3)).astype(np.uint8)
    left, right = scene[:, :140], scene[:, 60:]
    both = joint.split(left, right, np.array([[1, 0, -60], [0, 1, 0], [0, 0, 1.0]]))
    assert (both.left.shape[1], both.overlap.shape[1], both.right.shape[1]) == (60, 80, 60) and both.saved() == pytest.approx(80 / 280)
    a, b = joint.merge(both)
    assert (a == left).all() and (b == right).all()
    assert joint.split(left, rng.integers(0, 256, right.shape).astype(np.uint8), both.h) is None
    assert joint.split(right, left, np.linalg.inv(both.h)) is None
