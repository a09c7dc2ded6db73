import numpy as np
import pytest
from pyspark.sql import functions as F

from cinelake.__main__ import main, parser
from cinelake.engine import Store
from cinelake.sources import frames as fr


@pytest.fixture(scope="module")
def video(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("store")
    pixels = np.random.default_rng(1).integers(0, 256, (90, 8, 12, 3)).astype(np.uint8)
    (folder / "v.rgb").write_bytes(pixels.tobytes())
    store = Store(spark, f"{folder}/store")
    store.write_raw("v", f"{folder}/v.rgb", (8, 12))
    return store, pixels, str(folder)


def test_read(video):
    store, pixels, _ = video
    assert store.duration("v") == 3.0 and store.resolution("v") == (8, 12) and [r["name"] for r in store.list().collect()] == ["v"]
    view = store.load("v")
    assert (view.to_numpy() == pixels).all()
    assert (view[1:2].to_numpy() == pixels[30:60]).all()
    assert (view[0.5:1.5, 2:6, 3:9].to_numpy() == pixels[15:45, 2:6, 3:9]).all()
    assert (store.load("v").at((4, 6)).to_numpy() == pixels[:, ::2, ::2]).all()
    assert store.read("v", fps=10).count() == 30
    with pytest.raises(KeyError):
        store.read("w")
    with pytest.raises(LookupError):
        store.read("v", resolution=(16, 24))
    with pytest.raises(ValueError):
        store.write("v", store.read("v"))


def test_reads_are_stamped(video):
    store, _, _ = video
    before = store.clock()
    store.read("v", t=(0, 1))
    clocks = {r["start_us"]: r["clock"] for r in store.catalog.read("gops").where("physical_id = 1").collect()}
    assert clocks[0] == before and clocks[2_000_000] < before


def test_many(video):
    store, _, _ = video
    rows = store.read_many([{"name": "v", "t": (0, 1)}, {"name": "v", "t": (1, 3)}])
    assert {r["request"]: r["count"] for r in rows.groupBy("request").count().collect()} == {0: 30, 1: 60}


def test_materialised_parts_serve_reads_and_are_evicted(video):
    store, pixels, _ = video
    store.read("v", resolution=(4, 6), t=(1, 2), materialize=True)
    plan = store.plan("v", (4, 6), (1, 2), "rgb")
    assert {(f.format.height, f.start, f.end) for f in plan} == {(4, 30, 59)}
    assert (store.load("v").at((4, 6))[1:2].to_numpy() == pixels[30:60, ::2, ::2]).all()
    gops = {r["id"]: r for r in store.catalog.read("gops").collect()}
    copy = next(r for r in gops.values() if r["parent_id"] is not None)
    back = pixels[30:60, ::2, ::2].repeat(2, axis=1).repeat(2, axis=2)
    assert gops[copy["parent_id"]]["start_us"] == 1_000_000 and copy["estimated_mse"] == pytest.approx(2 * ((pixels[30:60].astype(float) - back) ** 2).mean())
    # the original is never covered by the smaller copy, however little the original is used
    size = sum(r["size"] for r in gops.values())
    store.set_budget("v", size - 1000)
    for _ in range(3):
        store.read("v", resolution=(4, 6), t=(1, 2))
    removed = store.evict()
    assert removed in ([], [copy["id"]]) and (store.load("v").to_numpy() == pixels).all()


def test_the_first_piece_goes_and_the_others_stay(spark, tmp_path):
    pixels = np.random.default_rng(2).integers(0, 256, (90, 4, 4, 3)).astype(np.uint8)
    (tmp_path / "a").write_bytes(pixels.tobytes())
    store = Store(spark, f"{tmp_path}/s")
    store.write_raw("a", f"{tmp_path}/a", (4, 4))
    store.read("a", t=(0, 1), materialize=True)
    store.read("a", t=(0, 1))
    store.set_budget("a", 90 * 48)
    assert len(store.evict()) == 1 and (store.load("a").to_numpy() == pixels).all()
    assert store.compact() in (0, 1) and (store.load("a").to_numpy() == pixels).all()


def test_compression_and_vacuum(spark, tmp_path):
    pixels = np.arange(60 * 4 * 4 * 3, dtype=np.uint32).astype(np.uint8).reshape(60, 4, 4, 3)
    (tmp_path / "a").write_bytes(pixels.tobytes())
    store = Store(spark, f"{tmp_path}/s")
    store.write_raw("a", f"{tmp_path}/a", (4, 4))
    assert store.compress() == 2 and store.compress() == 0
    rows = store.catalog.read("gops").collect()
    assert all(r["zstandard"] == 20 and r["size"] < r["original_size"] == 30 * 48 for r in rows) and (store.load("a").to_numpy() == pixels).all()
    store.vacuum()
    assert len(list((tmp_path / "s/data").iterdir())) == 1 and (store.load("a")[1:].to_numpy() == pixels[30:]).all()
    store.write_raw("b", f"{tmp_path}/a", (4, 4))
    folder = store.catalog.read("physical_videos").where("id = 2").first()["folder"]
    for x in (tmp_path / "s" / folder).iterdir():
        x.unlink()
    store.vacuum()
    assert [r["id"] for r in store.catalog.read("physical_videos").collect()] == [1] and store.catalog.read("gops").where("physical_id = 2").isEmpty()


def test_mp4_is_stored_as_it_is(spark, tmp_path):
    from cinelake.sources import codecs, mp4
    from tests.mp4_bytes import mp4 as build

    data, _ = build()
    (tmp_path / "a.mp4").write_bytes(data)
    store = Store(spark, f"{tmp_path}/s")
    store.write_mp4("m", f"{tmp_path}/a.mp4")
    gops = store.catalog.read("gops").orderBy("id").collect()
    assert [(r["piece"], r["start_us"]) for r in gops] == [(0, 0), (1, 66_666), (2, 133_333)] and store.resolution("m") == (540, 960)
    content = [bytes(r["content"]) for r in spark.read.parquet(f"{tmp_path}/s/data/1").orderBy("gop").collect()]
    track = mp4.parse(data)
    assert content[0] == mp4.to_annexb(data[track.mdat_offset : track.mdat_offset + sum(track.sizes[:2])], track.headers) and all(x.count(mp4.START_CODE) == 4 for x in content)
    with pytest.raises(ValueError):
        store.write_mp4("m", f"{tmp_path}/a.mp4")
    assert codecs.CodecUnavailable


def test_catalog_survives_a_writer_that_stops(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    store.catalog.append("logical_videos", spark.createDataFrame([(1, "a", 0.0)], "id long, name string, budget double"))
    (tmp_path / "s/catalog/.new-x").write_text("logical_videos=nowhere")
    assert [r["name"] for r in store.list().collect()] == ["a"]
    with pytest.raises(RuntimeError):
        before = store.catalog._pointers
        store.catalog._pointers = lambda: []  # a writer that has not seen the other one
        try:
            store.catalog.append("logical_videos", spark.createDataFrame([(2, "b", 0.0)], "id long, name string, budget double"))
        finally:
            store.catalog._pointers = before
    assert [r["name"] for r in store.list().collect()] == ["a"]


def test_compaction(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    pixels = np.arange(60 * 2 * 2 * 3, dtype=np.uint32).astype(np.uint8).reshape(60, 2, 2, 3)
    (tmp_path / "a").write_bytes(pixels[:30].tobytes())
    store.write_raw("a", f"{tmp_path}/a", (2, 2))
    logical = store._logical("a")
    store._store(logical, "a", fr.read_raw(spark, f"{tmp_path}/a", 2, 2), "rgb", 30, 30, 1_000_000)
    assert store.catalog.read("physical_videos").count() == 2 and store.compact() == 1 and store.compact() == 0
    assert store.catalog.read("physical_videos").count() == 1 and store.catalog.read("gops").agg(F.max("end_us")).first()[0] == 2_000_000
    assert (store.load("a").to_numpy() == np.concatenate([pixels[:30]] * 2)).all()
    store.verify_quality()
    assert store.catalog.read("gops").where("mse is null").count() == 0


def test_command_line(video, capsys):
    store, _, folder = video
    main([f"{folder}/other", "write", "w", f"{folder}/v.rgb", "--resolution", "8x12"])
    main([f"{folder}/other", "list"])
    assert capsys.readouterr().out.strip() == "w"
    main([f"{folder}/other", "read", "w", f"{folder}/out", "--times", "1-2", "--roi", "0:0:4:4"])
    assert store.spark.read.parquet(f"{folder}/out").where("height = 4 and width = 4").count() == 30
    main([f"{folder}/other", "delete", "w"])
    main([f"{folder}/other", "vacuum"])
    main([f"{folder}/other", "list"])
    assert capsys.readouterr().out.strip() == "" and Store(store.spark, f"{folder}/other").catalog.read("physical_videos").count() == 0
    with pytest.raises(SystemExit):
        parser().parse_args(["s", "write", "n", "p", "--resolution", "8by12"])
