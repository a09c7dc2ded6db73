import numpy as np
import pytest

from cinelake.sources import codecs, detections, frames, mp4
from tests.mp4_bytes import mp4 as build


def test_container_is_parsed():
    data, units = build()
    t = mp4.parse(data)
    assert (t.codec, t.width, t.height, t.gop_size, len(t.sizes)) == ("h264", 960, 540, 2, 6)
    assert t.headers == [b"\x67\x01\x02", b"\x68\x03"] and abs(t.fps - 30000 / 1001) < 1e-9
    assert data[t.mdat_offset : t.mdat_offset + t.mdat_size] == units
    assert mp4.to_annexb(units, t.headers).startswith(b"\x00\x00\x01\x67\x01\x02\x00\x00\x01\x68\x03\x00\x00\x01\x00")
    assert mp4.parse(build(entry=b"hvc1")[0]).codec == "hevc"
    with pytest.raises(ValueError):
        mp4.to_annexb(units[:-1])


def test_bits():
    b = mp4.Bits(bytes([0b10100110, 0b01000010, 0xFF]))
    assert b.unsigned(1) == 1 and b.golomb() == 1 and b.unsigned(2) == 1
    b.align()
    assert b.unsigned(8) == 0b01000010 and b.text(1) == "\xff"
    with pytest.raises(EOFError):
        b.unsigned(1)


def test_container_rows(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(build()[0])
    (tmp_path / "b.mp4").write_bytes(build(640, 360, 9, 3)[0])
    rows = mp4.container_rows(spark, f"{tmp_path}/*.mp4").collect()
    assert sorted((r["width"], r["sample"], r["size"], r["gop_size"]) for r in rows) == sorted([(960, k, 7, 2) for k in range(6)] + [(640, k, 7, 3) for k in range(9)])


@pytest.fixture(scope="module")
def ramp(spark, tmp_path_factory):
    rng = np.random.default_rng(0)
    pixels = rng.integers(0, 256, (12, 16, 20, 3)).astype(np.uint8)
    path = tmp_path_factory.mktemp("raw") / "v.rgb"
    path.write_bytes(pixels.tobytes())
    return frames.read_raw(spark, str(path), 16, 20, 30).cache(), pixels


def as_array(df):
    return np.stack([np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"], r["channels"]) for r in df.orderBy("frame_no").collect()])


def test_frames(ramp):
    df, pixels = ramp
    assert (as_array(df) == pixels).all()
    assert (as_array(frames.crop(df, 2, 3, 10, 13)) == pixels[:, 2:10, 3:13]).all()
    assert (as_array(frames.scale(df, 8, 10)) == pixels[:, ::2, ::2]).all()
    assert as_array(frames.scale(df, 32, 40, "bilinear")).shape == (12, 32, 40, 3)
    assert (as_array(frames.trim(df, 0.1, 0.2)) == pixels[3:6]).all()
    assert (as_array(frames.change_rate(df, 30, 15)) == pixels[::2]).all() and (as_array(frames.change_rate(df, 30, 60)) == pixels.repeat(2, axis=0)).all()
    q = frames.quality(df, frames.each_frame(df, lambda p: 255 - p)).collect()
    assert all(abs(r["psnr"] - frames.psnr(pixels[r["frame_no"]], 255 - pixels[r["frame_no"]])) < 1e-9 and r["ssim"] < 0 for r in q)
    assert frames.psnr(pixels[0], pixels[0]) == float("inf") and abs(frames.ssim(pixels[0], pixels[0]) - 1) < 1e-12
    pieces = frames.encoded(df, "rgb", 30, 5).orderBy("gop").collect()
    assert [r["n_frames"] for r in pieces] == [5, 5, 2] and b"".join(bytes(r["content"]) for r in pieces) == pixels.tobytes()
    assert frames.histogram(pixels[0]).sum() == 320


def test_compression(ramp):
    df, pixels = ramp
    packed = frames.compress(df, "pixels", 3)
    assert packed.columns == df.columns and (as_array(frames.decompress(packed, "pixels")) == pixels).all()


def test_codecs(spark):
    with pytest.raises(codecs.CodecUnavailable):
        codecs.codec("h264")
    codecs.register_codec("twice", lambda data, h, w: iter([np.full((h, w, 3), data[0], np.uint8)] * 2), lambda pictures, fps: bytes([next(pictures)[0, 0, 0]]))
    assert [int(x[0, 0, 0]) for x in codecs.codec("twice").decode(b"\x07", 1, 1)] == [7, 7]


def test_detections(spark, tmp_path, ramp):
    rows = spark.createDataFrame([(0.5, 0.9, 1, 2, 3, 4)], detections.SCHEMA)
    detections.write(rows, f"{tmp_path}/d")
    assert detections.read(spark, f"{tmp_path}/d").collect() == rows.collect()
    found = detections.detect(ramp[0], lambda p: [("bright", 1.0, 0, 0, *p.shape[:2])] if p[0, 0, 0] > 127 else []).count()
    assert found == int((ramp[1][:, 0, 0, 0] > 127).sum())
