"""Photo folders: listing, decoding, EXIF fields, image-set hash."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "tif", "tiff")


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, image_name, length, content) of the folder's photos; content is read only where it is used.

    ValueError when the folder has none.
    """
    files = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select("path", name.alias("image_name"), "length", "content")
    out = out.where(F.lower(F.element_at(F.split("image_name", r"\."), -1)).isin(*EXTENSIONS))
    if not out.select("path").take(1):
        raise ValueError(f"no images in {folder}")
    return out


def load_images(spark: SparkSession, folder: str) -> DataFrame:
    """(image_id, image_name, width, height, channels, data): decoded photos, BGR rows; unreadable ones are skipped.

    Ids are ranks by name among the readable photos.
    """
    img = spark.read.format("image").option("dropInvalid", True).load(folder).select("image.*")
    name = F.element_at(F.split("origin", "/"), -1)
    good = img.select(name.alias("image_name"), "width", "height", F.col("nChannels").alias("channels"), "data")
    ids = good.select("image_name").withColumn("image_id", (F.row_number().over(W.orderBy("image_name")) - 1).cast("int"))
    return good.join(ids, "image_name").select("image_id", "image_name", "width", "height", "channels", "data")


def first_readable(images: DataFrame) -> DataFrame:
    return images.orderBy("image_name").limit(1)


def orient(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """Apply an EXIF orientation (1 to 8) to an H x W x C raster."""
    if orientation in (5, 6, 7, 8):
        pixels = pixels.transpose(1, 0, 2)
    if orientation in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    if orientation in (3, 4, 7, 8):
        pixels = pixels[::-1]
    return np.ascontiguousarray(pixels)


#: Bytes of the TIFF field types (fixed values of the format).
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def parse_exif(content: bytes | None) -> dict[int, str]:
    """Numeric EXIF tags as text, rationals as "a/b"; empty on any damage."""
    try:
        data = bytes(content or b"")
        if data[:2] == b"\xff\xd8":
            at = 2
            while data[at] == 0xFF and data[at + 1] not in (0xDA, 0xD9):
                size = struct.unpack(">H", data[at + 2 : at + 4])[0]
                if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                    data = data[at + 10 : at + 2 + size]
                    break
                at += 2 + size
            else:
                return {}
        if data[:2] not in (b"II", b"MM"):
            return {}
        order = "<" if data[:2] == b"II" else ">"
        out: dict[int, str] = {}
        queue, seen = [struct.unpack(order + "I", data[4:8])[0]], set()
        while queue:
            at = queue.pop()
            if at in seen or at + 2 > len(data):
                continue
            seen.add(at)
            for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
                tag, kind, count = struct.unpack(order + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
                size = _SIZES.get(kind, 0) * count
                if not size or size > len(data):
                    continue
                place = at + 10 + 12 * i
                if size > 4:
                    place = struct.unpack(order + "I", data[place : place + 4])[0]
                raw = data[place : place + size]
                if kind == 2:
                    out[tag] = raw.split(b"\0")[0].decode("latin-1")
                elif kind in (5, 10):
                    v = struct.unpack(order + ("II" if kind == 5 else "ii") * count, raw)
                    out[tag] = " ".join(f"{v[j]}/{v[j + 1]}" for j in range(0, len(v), 2))
                elif kind in (3, 4, 9):
                    v = struct.unpack(order + {3: "H", 4: "I", 9: "i"}[kind] * count, raw)
                    out[tag] = " ".join(map(str, v))
                    if tag == 0x8769:
                        queue.append(v[0])
        return out
    except (struct.error, IndexError, UnicodeDecodeError):
        return {}


def read_exif(images: DataFrame) -> DataFrame:
    """Adds ``exif`` map<int, string>; one call per photo, where the bytes are the cost."""
    parse = F.udf(parse_exif, "map<int,string>")
    return images.withColumn("exif", parse("content"))


#: EXIF tags of the focal routes (fixed values of the standard).
TAGS = {"make": 271, "model": 272, "orientation": 274, "focal_mm": 37386, "focal_35": 41989, "plane_res": 41486, "plane_unit": 41488, "exif_width": 40962}
#: Millimetres of the focal-plane resolution units (fixed values of the standard).
UNIT_MM = {2: 25.4, 3: 10.0, 4: 1.0, 5: 0.001}


def exif_fields(images: DataFrame) -> DataFrame:
    """The focal columns of operators.focal from ``exif``, ``width`` and ``height``."""
    from sparkogram.operators.focal import rational

    raw = images.select("*", *(F.col("exif").getItem(t).alias(f"_{k}") for k, t in TAGS.items()))
    unit = F.create_map(*(x for k, v in UNIT_MM.items() for x in (F.lit(str(k)), F.lit(v))))
    return raw.select(
        *images.columns, F.expr("try_cast(_focal_35 as double)").alias("focal_35"), rational("_focal_mm").alias("focal_mm"), rational("_plane_res").alias("plane_res"),
        F.coalesce(unit[F.col("_plane_unit")], F.lit(25.4)).alias("unit_mm"), F.coalesce(F.expr("try_cast(_exif_width as double)"), F.col("width").cast("double")).alias("exif_width"),
        F.col("_make").alias("make"), F.col("_model").alias("model"),
    )


def image_set_hash(images: DataFrame) -> str:
    """16 hex digits over names, sizes and contents; any change of a photo changes it."""
    one = images.select(F.concat_ws(":", "image_name", "length", F.md5("content")).alias("k"))
    row = one.agg(F.md5(F.array_join(F.array_sort(F.collect_list("k")), "\n")).alias("h")).first()
    return row["h"][:16]


def file_digest(images: DataFrame) -> DataFrame:
    return images.select("path", F.sha2("content", 256).alias("sha256"))
