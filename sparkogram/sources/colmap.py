"""COLMAP sparse models: binary files as data sources, text files by SQL functions."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from sparkogram.functions.geometry import CAMERA_MODELS, camera_centre, model_matrix, quaternion_rotation
from sparkogram.sources.files import read_bytes

_MODELS = list(CAMERA_MODELS)


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str) -> tuple:
        s = struct.Struct("<" + form)
        out = s.unpack_from(self.data, self.at)
        self.at += s.size
        return out

    def text(self) -> str:
        end = self.data.index(b"\0", self.at)
        out = self.data[self.at : end].decode()
        self.at = end + 1
        return out


def read_cameras(data: bytes) -> Iterator[tuple]:
    """(camera_id, model, width, height, params)"""
    c = _Cursor(data)
    for _ in range(c.take("Q")[0]):
        number, model, width, height = c.take("iiQQ")
        name = _MODELS[model]
        yield number, name, width, height, list(c.take(f"{CAMERA_MODELS[name][0]}d"))


def read_images(data: bytes) -> Iterator[tuple]:
    """(image_id, qvec, tvec, camera_id, name, points: [(x, y, point3d_id or None)])"""
    c = _Cursor(data)
    for _ in range(c.take("Q")[0]):
        v = c.take("i7di")
        name, n = c.text(), c.take("Q")[0]
        flat = c.take("ddq" * n)
        points = [(flat[i], flat[i + 1], None if flat[i + 2] == -1 else flat[i + 2]) for i in range(0, 3 * n, 3)]
        yield v[0], list(v[1:5]), list(v[5:8]), v[8], name, points


def read_points(data: bytes) -> Iterator[tuple]:
    """(point_id, x, y, z, r, g, b, error, track_length) by ascending id"""
    c, rows = _Cursor(data), []
    for _ in range(c.take("Q")[0]):
        v = c.take("Q3d3Bd")
        n = c.take("Q")[0]
        c.at += 8 * n
        rows.append((*v, n))
    yield from sorted(rows)


class _WholeFile(DataSourceReader):
    def __init__(self, path: str, parse):
        self.path, self.parse = path, parse

    def read(self, partition) -> Iterator[tuple]:
        yield from self.parse(read_bytes(self.path))


def _source(label: str, fields: str, parse) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self) -> str:
            return fields

        def reader(self, schema) -> DataSourceReader:
            return _WholeFile(self.options["path"], parse)

    return Source


CamerasBin = _source("colmap_cameras", "camera_id int, model string, width long, height long, params array<double>", read_cameras)
ImagesBin = _source(
    "colmap_images",
    "image_id int, qvec array<double>, tvec array<double>, camera_id int, name string, points array<struct<x:double,y:double,point_id:long>>",
    read_images,
)
PointsBin = _source("colmap_points", "point_id long, x double, y double, z double, r int, g int, b int, error double, track_length long", read_points)


def register(spark: SparkSession) -> None:
    for source in (CamerasBin, ImagesBin, PointsBin):
        spark.dataSource.register(source)


def model_cameras(cameras: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, image_name, R, t, K, cx, cy, cz): images joined with their cameras, renumbered by name."""
    j = images.join(cameras, "camera_id").select("name", F.col("tvec").alias("t"), quaternion_rotation("qvec").alias("R"), model_matrix("model", "params").alias("K"))
    number = (F.row_number().over(W.orderBy("name")) - 1).cast("int")  # one row per photo
    c = camera_centre("R", "t")
    return j.select(number.alias("image_id"), F.col("name").alias("image_name"), "R", "t", "K", *(v.alias(f"c{a}") for v, a in zip(c, "xyz", strict=True)))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(lines) of a whole text file, comments and a final empty line aside."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.filter(F.split(F.regexp_replace("value", r"\r", ""), "\n"), lambda x: ~x.startswith("#")).alias("lines"))


def read_cameras_text(spark: SparkSession, path: str) -> DataFrame:
    """(camera_id, model, width, height, params) of a cameras.txt."""
    part = F.split(F.trim("line"), r"\s+")
    rows = _lines(spark, path).select(F.explode("lines").alias("line")).where("trim(line) <> ''").select(part.alias("p"))
    return rows.select(
        F.col("p")[0].cast("int").alias("camera_id"), F.col("p")[1].alias("model"), F.col("p")[2].cast("long").alias("width"),
        F.col("p")[3].cast("long").alias("height"), F.expr("cast(slice(p, 5, size(p) - 4) as array<double>)").alias("params"),
    )


def read_images_text(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, qvec, tvec, camera_id, name): the first of every two lines; names may hold spaces."""
    rows = _lines(spark, path).select(F.posexplode("lines").alias("at", "line")).where("at % 2 = 0 and trim(line) <> ''")
    p = rows.select(F.split(F.trim("line"), r"\s+", 10).alias("p"))
    return p.select(
        F.col("p")[0].cast("int").alias("image_id"), F.expr("cast(slice(p, 2, 4) as array<double>)").alias("qvec"),
        F.expr("cast(slice(p, 6, 3) as array<double>)").alias("tvec"), F.col("p")[8].cast("int").alias("camera_id"), F.col("p")[9].alias("name"),
    )


def points_text_summary(spark: SparkSession, path: str) -> DataFrame:
    """One row: number of points and mean track length of a points3D.txt."""
    rows = spark.read.text(path).where("trim(value) <> '' and not startswith(value, '#')")
    n = F.floor((F.size(F.split(F.trim("value"), r"\s+")) - 8) / 2)
    return rows.agg(F.count("*").alias("n_points"), F.avg(n).alias("mean_track_length"))
