"""Readers and writers of camera, calibration and map files.

Text and XML go through Spark's own sources.  The binary codecs parse a file per
row of ``binaryFile``, so files are spread over the tasks by Spark; a file is
read by one task, as its format demands.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Extensions of frame images.
IMAGES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff")


def stem(path: str = "path"):
    return F.regexp_extract(path, r"([^/]+)\.[^./]*$", 1)


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """(frame, path, length) of the image files of a folder; contents are not read."""
    f = spark.read.format("binaryFile").load(folder).select("path", "length")
    return f.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*IMAGES)).select(stem().alias("frame"), "path", "length")


def white_image(spark: SparkSession, folder: str, name: str = "mask") -> DataFrame:
    """The calibration image among the frames."""
    return frames(spark, folder).where(F.col("frame") == name)


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """(frame, x, y, r, g, b) of the frames of a folder, in any of the listed formats.

    Spark's own image source decodes them; gray images give equal channels, an
    alpha channel is left out.  A frame that can't be decoded raises an error.
    """

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame, image in zip(batch.column("frame").to_pylist(), batch.column("image").to_pylist(), strict=True):
                if image["height"] < 0:
                    raise ValueError(f"{frame}: not an image")
                px = np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["nChannels"])
                blue, green, red = (px[..., min(c, px.shape[2] - 1)] if px.shape[2] >= 3 else px[..., 0] for c in range(3))
                y, x = np.mgrid[0 : px.shape[0], 0 : px.shape[1]]
                yield pa.RecordBatch.from_arrays([pa.array([frame] * x.size), *(pa.array(a.ravel().astype(np.int32)) for a in (x, y, red, green, blue))], ["frame", "x", "y", "r", "g", "b"])

    either = ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in IMAGES)
    f = spark.read.format("image").option("pathGlobFilter", f"*.{{{either}}}").load(folder)
    return f.select(stem("image.origin").alias("frame"), "image").mapInArrow(unpacked, "frame string, x int, y int, r int, g int, b int")


def intrinsics(spark: SparkSession, path: str) -> DataFrame:
    """D, d and the rest of the root element as one row; unknown elements are kept as text."""
    return spark.read.format("xml").option("rowTag", "_").load(path)


def lens_table(spark: SparkSession, path: str) -> DataFrame:
    """Lens rows of a calibration file: key "row,col", center "x,y", type and area."""
    raw = spark.read.format("xml").option("rowTag", "MLA").schema("key string, center string, MLAType int, aera double").load(path)
    key, centre = F.split("key", ","), F.split("center", ",")
    return raw.select(
        F.trim(key[1]).cast("long").alias("tile_x"), F.trim(key[0]).cast("long").alias("tile_y"), F.trim(centre[0]).cast("double").alias("cx"), F.trim(centre[1]).cast("double").alias("cy"),
        F.col("aera").alias("area"), F.col("MLAType").alias("blur_type"),
    )


def write_lens_table(lens: DataFrame, path: str) -> None:
    """The kept lenses, of type 1."""
    kept = lens.where(~F.coalesce(F.col("abandoned"), F.lit(False))) if "abandoned" in lens.columns else lens
    rows = kept.select(F.concat_ws(",", "tile_y", "tile_x").alias("key"), F.concat_ws(",", "cx", "cy").alias("center"), F.lit(1).alias("MLAType"), F.col("area").alias("aera"))
    rows.write.mode("overwrite").format("xml").option("rootTag", "CalibInfo").option("rowTag", "MLA").save(path)


def centres(spark: SparkSession, path: str) -> DataFrame:
    """S07: "x y" lines; lines with # are skipped."""
    t = spark.read.text(path).where(~F.col("value").contains("#")).select(F.split(F.trim("value"), r"\s+").alias("v")).where(F.size("v") >= 2)
    return t.select(F.col("v")[0].try_cast("double").alias("x"), F.col("v")[1].try_cast("double").alias("y")).where("x is not null and y is not null")


def view_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(ref, src, score) of a pair file: a count, then per reference its id and a line "n (id score)*"; scores of zero or less are dropped."""
    t = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", r"\s+"), lambda s: s != "").alias("w"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ref, src, score = [], [], []
            for w in batch.column("w").to_pylist():
                at = 1
                for _ in range(int(w[0])):
                    r, n = int(w[at]), int(w[at + 1])
                    at += 2
                    for _ in range(n):
                        if float(w[at + 1]) > 0:
                            ref.append(r)
                            src.append(int(w[at]))
                            score.append(float(w[at + 1]))
                        at += 2
            yield pa.RecordBatch.from_arrays([pa.array(ref, pa.int32()), pa.array(src, pa.int32()), pa.array(score, pa.float64())], ["ref", "src", "score"])

    return t.mapInArrow(parse, "ref int, src int, score double")


def cameras(spark: SparkSession, path: str) -> DataFrame:
    """One row per camera file: r, t, k and the depth range."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.filter(F.split("value", r"\s+"), lambda s: s.rlike(r"^[-+]?[0-9.]+([eE][-+]?[0-9]+)?$")).alias("w"))
    n = F.transform("w", lambda s: s.cast("double"))
    t = t.select(stem("path").alias("camera"), n.alias("n"))
    at = lambda *i: F.array(*[F.col("n")[k] for k in i])
    # The 4 x 4 extrinsic matrix (its last row is skipped), K, then the depth range.
    return t.select("camera", at(0, 1, 2, 4, 5, 6, 8, 9, 10).alias("r"), at(3, 7, 11).alias("t"), at(*range(16, 25)).alias("k"), F.col("n")[25].alias("depth_min"), F.col("n")[26].alias("interval"), F.get("n", F.lit(27)).alias("num"), F.get("n", F.lit(28)).alias("depth_max"))


DMB = "<4i"


def dmb(spark: SparkSession, path: str) -> DataFrame:
    """(map, x, y, c, v) of depth and normal maps: four 32-bit integers (type 1, height, width, channels), then 32-bit floats."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("map").to_pylist(), batch.column("content").to_pylist(), strict=True):
                kind, h, w, c = struct.unpack_from(DMB, content)
                if kind != 1:
                    raise ValueError(f"{name}: type {kind}")
                v = np.frombuffer(content, "<f4", h * w * c, struct.calcsize(DMB))
                y, x, k = np.unravel_index(np.arange(v.size), (h, w, c))
                yield pa.RecordBatch.from_arrays([pa.array([name] * v.size), *(pa.array(a.astype(np.int32)) for a in (x, y, k)), pa.array(v.astype(np.float64))], ["map", "x", "y", "c", "v"])

    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.dmb").load(path)
    return f.select(stem().alias("map"), "content").mapInArrow(decode, "map string, x int, y int, c int, v double")


def to_dmb(maps: DataFrame, width: int, height: int, channels: int = 1) -> DataFrame:
    """(map, content): each map's file as bytes; missing values are NaN.  A map is one row, bounded by its image size."""
    cell = (F.col("y") * width + F.col("x")) * channels + F.col("c")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cells in batch.column("cells").to_pylist():
                body = np.full(width * height * channels, np.nan, "<f4")
                for e in cells:
                    body[e["i"]] = np.nan if e["v"] is None else e["v"]
                out.append(struct.pack(DMB, 1, height, width, channels) + body.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("map"), pa.array(out, pa.binary())], ["map", "content"])

    return maps.groupBy("map").agg(F.collect_list(F.struct(cell.cast("int").alias("i"), "v")).alias("cells")).mapInArrow(encode, "map string, content binary")


PLY = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("nx", "<f4"), ("ny", "<f4"), ("nz", "<f4"), ("red", "u1"), ("green", "u1"), ("blue", "u1")])


def to_ply(points: DataFrame) -> DataFrame:
    """(part, content): point clouds as binary little-endian PLY, one complete file per partition.

    Coordinates that are no number become 0; input colours are b, g, r.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = []
        for batch in batches:
            rec = np.zeros(batch.num_rows, PLY)
            for name, own in [(n, n) for n in ("x", "y", "z", "nx", "ny", "nz")] + [("red", "r"), ("green", "g"), ("blue", "b")]:
                v = batch.column(own).to_numpy(zero_copy_only=False).astype(np.float64)
                v = np.where(np.isfinite(v), v, 0)
                rec[name] = v if PLY[name].kind == "f" else np.clip(v, 0, 255)
            parts.append(rec)
        body = np.concatenate(parts) if parts else np.zeros(0, PLY)
        kinds = {"f": "float", "u": "uchar"}
        head = "ply\nformat binary_little_endian 1.0\n" + f"element vertex {len(body)}\n" + "".join(f"property {kinds[PLY[n].kind]} {n}\n" for n in PLY.names) + "end_header\n"
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([head.encode() + body.tobytes()], pa.binary())], ["part", "content"])

    return points.select("x", "y", "z", "nx", "ny", "nz", F.col("b").alias("b"), F.col("g").alias("g"), F.col("r").alias("r")).mapInArrow(encode, "part int, content binary")


def float_list(spark: SparkSession, path: str, binary: bool = False) -> DataFrame:
    """Numbers, one a line (others skipped), or raw 32-bit floats."""
    if not binary:
        return spark.read.text(path).select(F.trim("value").try_cast("double").alias("v")).where("v is not null")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(content[: len(content) // 4 * 4], "<f4").astype(np.float64))], ["v"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(decode, "v double")


def segment_models(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a segmented behaviour model; a single model is one segment."""
    raw = spark.read.format("xml").option("rowTag", "Segment").schema("DepthMin double, DepthMax double, SampleCount long, Param struct<c0:double,c1:double,c2:double>").load(path)
    place = F.row_number().over(Window.orderBy("DepthMin")) - 1  # a few rows
    return raw.select(place.alias("seg_id"), F.col("DepthMin").alias("vd_min"), F.col("DepthMax").alias("vd_max"), F.col("SampleCount").alias("n"), "Param.*")


def write_segment_models(models: DataFrame, path: str) -> None:
    """Six decimals."""
    six = lambda c: F.round(c, 6).alias(c)
    rows = models.select(F.round("vd_min", 6).alias("DepthMin"), F.round("vd_max", 6).alias("DepthMax"), F.col("n").alias("SampleCount"), F.struct(six("c0"), six("c1"), six("c2")).alias("Param"))
    rows.write.mode("overwrite").format("xml").option("rootTag", "BehaviorModel").option("rowTag", "Segment").save(path)


def point_pairs(spark: SparkSession, path: str, tag: str = "Pair") -> DataFrame:
    """Calibration pairs (x, y, vd, gt)."""
    return spark.read.format("xml").option("rowTag", tag).schema("x long, y long, vd double, gt double").load(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Space-separated rows under a # header."""
    head = pairs.toDF(*[("#" + c if i == 0 else c) for i, c in enumerate(pairs.columns)])
    head.write.mode("overwrite").option("sep", " ").option("header", True).option("comment", "\u0001").csv(path)


def to_obj(faces: DataFrame, size: float = 1.0) -> DataFrame:
    """(value) lines of an OBJ file with the outer faces of voxels, four own corners per face.

    Faces are numbered within their partition and partitions by their counts,
    so corner indices are global without one task seeing all faces.
    """
    axis, high = F.floor(F.col("face") / 2), F.col("face") % 2
    numbered = faces.withColumn("id", F.monotonically_increasing_id())
    part = numbered.withColumn("p", F.shiftright("id", 33)).groupBy("p").agg(F.count("*").alias("n"))
    part = part.withColumn("base", F.sum("n").over(Window.orderBy("p")) - F.col("n"))  # one row a partition
    own = numbered.withColumn("p", F.shiftright("id", 33)).join(part, "p").withColumn("k", F.col("base") + F.col("id").bitwiseAND((1 << 33) - 1))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))])
    at = [F.when(axis == i, F.col(c) + high).otherwise(F.col(c) + F.when((axis + 1) % 3 == i, F.col("s.a")).otherwise(F.col("s.b"))) for i, c in enumerate(("vx", "vy", "vz"))]
    v = own.select("*", F.posexplode(steps).alias("j", "s"))
    lines = v.select(F.lit(0).alias("kind"), (F.col("k") * 4 + F.col("j")).alias("order"), F.concat_ws(" ", F.lit("v"), *[c * size for c in at]).alias("value"))
    f = own.select(F.lit(1).alias("kind"), F.col("k").alias("order"), F.concat_ws(" ", F.lit("f"), *[F.col("k") * 4 + i for i in (1, 2, 3, 4)]).alias("value"))
    return lines.unionByName(f).orderBy("kind", "order").select("value")


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path``, made and written there first where it is missing."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.parquet(path)
        return spark.read.parquet(path)
