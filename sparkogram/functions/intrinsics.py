"""Camera intrinsics as column expressions: structs, matrices, distortion, overrides, per-camera lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkogram.functions.geometry import at, intrinsics_matrix

FIELDS = ("fx", "fy", "cx", "cy", "k1", "k2")


def matrix(camera: str) -> Column:
    """K of an intrinsics struct."""
    return intrinsics_matrix(*(F.col(f"{camera}.{f}") for f in ("fx", "fy", "cx", "cy")))


def distortion(camera: str) -> Column:
    """[k1, k2, 0, 0] of an intrinsics struct."""
    return F.array(F.col(f"{camera}.k1"), F.col(f"{camera}.k2"), F.lit(0.0), F.lit(0.0))


def from_matrix(k: str, dist: str, width: Column | None = None, height: Column | None = None) -> Column:
    """The struct of a matrix and distortion coefficients; missing coefficients and sizes are 0."""
    coefficient = lambda i: F.coalesce(F.try_element_at(F.col(dist), F.lit(i)), F.lit(0.0))
    return F.struct(
        at(k, 0).alias("fx"), at(k, 4).alias("fy"), at(k, 2).alias("cx"), at(k, 5).alias("cy"), coefficient(1).alias("k1"), coefficient(2).alias("k2"),
        F.coalesce(width, F.lit(0)).cast("int").alias("width") if width is not None else F.lit(0).alias("width"),
        F.coalesce(height, F.lit(0)).cast("int").alias("height") if height is not None else F.lit(0).alias("height"),
    )


def updated(camera: str, **new: Column) -> Column:
    """The struct with the fields that an adjustment gives and null does not override."""
    return F.struct(*(F.coalesce(new.get(f, F.lit(None).cast("double")), F.col(f"{camera}.{f}")).alias(f) for f in FIELDS))


def per_camera(images: DataFrame, own: DataFrame, shared_k: list[float], shared_dist: list[float]) -> DataFrame:
    """(image_id, K, dist): an image's own intrinsics where there are any (image_id, K, dist), else the shared ones."""
    k, d = (F.array(*(F.lit(float(x)) for x in v)) for v in (shared_k, shared_dist))
    found = images.select("image_id").distinct().join(own.select("image_id", F.col("K").alias("_k"), F.col("dist").alias("_d")), "image_id", "left")
    return found.select("image_id", F.coalesce("_k", k).alias("K"), F.coalesce("_d", d).alias("dist"))


def as_document(*fields: str) -> Column:
    """Fields as one JSON object; null fields stay in it."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def focal_px(estimates: DataFrame) -> DataFrame:
    """(image_id, focal_px) of EXIF estimates; null where the length was only guessed."""
    return estimates.select("image_id", F.when(F.col("source") != "guess", F.col("focal_px")).alias("focal_px"))


def parse_intrinsics(text: str) -> Column:
    """A "fx,fy,cx,cy" text as a struct, null unless it holds four numbers with positive focal lengths."""
    parts = F.split(F.col(text), ",")
    values = F.transform(parts, lambda p: F.trim(p).try_cast("double"))
    good = (F.size(parts) == 4) & F.forall(values, lambda v: v.isNotNull()) & (F.try_element_at(values, F.lit(1)) > 0) & (F.try_element_at(values, F.lit(2)) > 0)
    return F.when(good, F.struct(*(F.try_element_at(values, F.lit(i + 1)).alias(n) for i, n in enumerate(FIELDS[:4]))))
