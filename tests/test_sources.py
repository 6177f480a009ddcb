"""Files written by hand and read back."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenogrid.sources import files as S


def test_frames_and_pixels(spark, tmp_path):
    px = bytes(range(2 * 12))
    rows = px[:9] + b"\0" * 3 + px[9:18] + b"\0" * 3  # three pixels a row, padded to four bytes
    head = b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 3, 2, 1, 24, 0, len(rows), 0, 0, 0, 0)
    for name in ("f1.bmp", "mask.bmp"):
        (tmp_path / name).write_bytes(head + rows)
    (tmp_path / "notes.txt").write_text("x")
    assert sorted(r["frame"] for r in S.frames(spark, str(tmp_path)).collect()) == ["f1", "mask"]
    assert S.white_image(spark, str(tmp_path)).count() == 1
    got = {(r["x"], r["y"]): (r["b"], r["g"], r["r"]) for r in S.pixels(spark, str(tmp_path)).where("frame = 'f1'").collect()}
    assert len(got) == 6 and got[0, 1] == (0, 1, 2) and got[2, 0] == (15, 16, 17)


def test_no_frame_is_passed_over(spark, tmp_path):
    head = b"BM" + struct.pack("<IHHI", 58, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0)
    (tmp_path / "f1.BMP").write_bytes(head + b"\1\2\3\0")
    assert [tuple(r) for r in S.pixels(spark, str(tmp_path)).collect()] == [("f1", 0, 0, 3, 2, 1)]
    (tmp_path / "f2.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    with pytest.raises(Exception, match="f2: not an image"):
        S.pixels(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("kind", ["png", "tif", "bmp", "jpg", "jpeg", "tiff"])
def test_frames_of_all_listed_formats(spark, tmp_path, kind):
    """Files that Java writes; all but jpg and jpeg keep every value."""
    jvm = spark._jvm
    for name, model, values in (("colour", 1, lambda x, y: (20 * x, 30 * y, 200)), ("gray", 10, lambda x, y: (10 * x + y,) * 3)):
        image = jvm.java.awt.image.BufferedImage(5, 4, model)
        for x in range(5):
            for y in range(4):
                r, g, b = values(x, y)
                image.setRGB(x, y, (255 << 24 | r << 16 | g << 8 | b) - (1 << 32))
        raster = image.getRaster()
        if name == "gray":  # the values themselves, as colours are turned into gray by their gamma
            for x in range(5):
                for y in range(4):
                    raster.setSample(x, y, 0, 10 * x + y)
        assert jvm.javax.imageio.ImageIO.write(image, kind.replace("jpeg", "jpg").replace("tiff", "tif"), jvm.java.io.File(str(tmp_path / f"{name}.{kind}")))
    got = {(r["frame"], r["x"], r["y"]): (r["r"], r["g"], r["b"]) for r in S.pixels(spark, str(tmp_path)).collect()}
    assert len(got) == 40
    far = 0
    for x in range(5):
        for y in range(4):
            want = {"colour": (20 * x, 30 * y, 200), "gray": (10 * x + y,) * 3}
            far = max(far, *(abs(a - b) for name in want for a, b in zip(got[name, x, y], want[name], strict=True)))
    assert far == 0 if not kind.startswith("jp") else far < 60


def test_lens_table(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 10.5, 20.25, 60.0, False), (3, 4, 1.0, 2.0, 61.0, True)], "tile_x long, tile_y long, cx double, cy double, area double, abandoned boolean")
    S.write_lens_table(df, str(tmp_path / "x"))
    assert [tuple(r) for r in S.lens_table(spark, str(tmp_path / "x")).collect()] == [(1, 2, 10.5, 20.25, 60.0, 1)]


def test_text_files(spark, tmp_path):
    (tmp_path / "c").write_text("# head\n1.5 2\n\n3 4 # no\n 5\t6 \n")
    assert sorted(tuple(r) for r in S.centres(spark, str(tmp_path / "c")).collect()) == [(1.5, 2.0), (5.0, 6.0)]
    (tmp_path / "pair.txt").write_text("2\n0\n2 1 0.5 2 0\n1\n1 0 3.25\n")
    assert sorted(tuple(r) for r in S.view_pairs(spark, str(tmp_path / "pair.txt")).collect()) == [(0, 1, 0.5), (1, 0, 3.25)]
    (tmp_path / "n").write_text("1\nx\n2.5\n")
    assert sorted(r["v"] for r in S.float_list(spark, str(tmp_path / "n")).collect()) == [1.0, 2.5]
    (tmp_path / "raw").write_bytes(np.array([1, 2.5], "<f4").tobytes() + b"\0")
    assert sorted(r["v"] for r in S.float_list(spark, str(tmp_path / "raw"), binary=True).collect()) == [1.0, 2.5]
    (tmp_path / "00_cam.txt").write_text("extrinsic\n1 0 0 5\n0 1 0 6\n0 0 1 7\n0 0 0 1\n\nintrinsic\n100 0 32\n0 110 24\n0 0 1\n\n2.5 0.1 64 9\n")
    r = S.cameras(spark, str(tmp_path / "00_cam.txt")).first()
    assert (r["camera"], r["t"], r["k"][0], r["k"][5], r["depth_min"], r["depth_max"]) == ("00_cam", [5.0, 6.0, 7.0], 100.0, 24.0, 2.5, 9.0)


def test_dmb_round_trip(spark, tmp_path):
    body = np.arange(6, dtype="<f4")
    (tmp_path / "d.dmb").write_bytes(struct.pack("<4i", 1, 2, 3, 1) + body.tobytes())
    got = S.dmb(spark, str(tmp_path))
    assert {(r["x"], r["y"]): r["v"] for r in got.collect()}[2, 1] == 5.0
    assert bytes(S.to_dmb(got, 3, 2).first()["content"]) == (tmp_path / "d.dmb").read_bytes()


def test_ply(spark):
    p = spark.createDataFrame([(1.0, 2.0, float("nan"), 0.0, 0.0, 1.0, 10, 20, 30)], "x double, y double, z double, nx double, ny double, nz double, b int, g int, r int").coalesce(1)
    c = bytes(S.to_ply(p).first()["content"])
    head, body = c.split(b"end_header\n")
    assert b"element vertex 1\n" in head
    assert tuple(np.frombuffer(body, S.PLY)[0]) == (1, 2, 0, 0, 0, 1, 30, 20, 10)


def test_segment_models(spark, tmp_path):
    m = spark.createDataFrame([(0, 3.9, 4.2, 10, 0.05, 1500.0, 2000.1234567)], "seg_id int, vd_min double, vd_max double, n long, c0 double, c1 double, c2 double")
    S.write_segment_models(m, str(tmp_path / "m"))
    assert tuple(S.segment_models(spark, str(tmp_path / "m")).first()) == (0, 3.9, 4.2, 10, 0.05, 1500.0, 2000.123457)


def test_pairs_obj_and_cache(spark, tmp_path):
    df = spark.range(2).select(F.col("id").alias("i"), F.lit(1.5).alias("v"))
    S.write_pairs(df.coalesce(1), str(tmp_path / "p"))
    text = next(tmp_path.glob("p/part*")).read_text().splitlines()
    assert text == ["#i v", "0 1.5", "1 1.5"]
    obj = [r["value"] for r in S.to_obj(spark.createDataFrame([(0, 0, 0, 0), (0, 0, 0, 5)], "vx long, vy long, vz long, face int")).collect()]
    assert sum(x[0] == "v" for x in obj) == 8 and obj[-1].startswith("f 5 6 7 8") or obj[-1].startswith("f 1 2 3 4")
    made = []
    for _ in range(2):
        assert S.cached(spark, str(tmp_path / "t"), lambda: made.append(1) or df).count() == 2
    assert made == [1]
