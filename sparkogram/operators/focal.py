"""Focal lengths from EXIF fields, and the search for one when there is none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkogram.functions.geometry import plausible_focal


def rational(text: str) -> Column:
    """A number or "a/b" as double; null on errors and zero denominators."""
    parts = F.split(F.col(text), "/")
    return F.try_divide(F.expr(f"try_cast(split({text}, '/')[0] as double)"), F.when(F.size(parts) > 1, F.expr(f"try_cast(try_element_at(split({text}, '/'), 2) as double)")).otherwise(F.lit(1.0)))


def focal_routes(exif: DataFrame, sensors: DataFrame) -> DataFrame:
    """Adds focal_px and source: 35 mm equivalent, focal-plane resolution, sensor table, else the longer side.

    ``exif``: image_id, focal_35, focal_mm, plane_res, unit_mm, exif_width, make,
    model, width, height.  ``sensors``: make, model, width_mm (lower case).  A model
    is found with its exact make first, else where the table's make is part of the
    image's.  Each route counts only when its field of view is plausible.
    """
    key = exif.withColumn("_make", F.lower(F.trim(F.coalesce("make", F.lit(""))))).withColumn("_model", F.lower(F.trim(F.coalesce("model", F.lit("")))))
    s = sensors.select(F.lower("make").alias("_smake"), F.lower("model").alias("_model"), "width_mm")
    found = key.join(s, "_model", "left")
    fits = F.when(F.col("_smake") == F.col("_make"), 0).when(F.contains(F.col("_make"), F.col("_smake")), 1)
    best = W.partitionBy("image_id").orderBy(F.coalesce(fits, F.lit(2)), "_smake")
    found = found.withColumn("_fit", fits).withColumn("_r", F.row_number().over(best)).where("_r = 1")
    sensor = F.when(F.col("_fit").isNotNull(), F.col("width_mm"))
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    routes = [
        ("equivalent", F.col("focal_35") / F.lit((36.0**2 + 24.0**2) ** 0.5) * F.hypot(w, h)),
        ("focal_plane", F.col("focal_mm") * F.try_divide(F.col("plane_res"), F.col("unit_mm")) * F.try_divide(w, F.col("exif_width").cast("double"))),
        ("sensor", F.try_divide(F.col("focal_mm"), sensor) * w),
    ]
    pick = [F.when(plausible_focal(f, F.col("width"), F.col("height")), F.struct(f.alias("px"), F.lit(name).alias("src"))) for name, f in routes]
    guess = F.struct(F.greatest(w, h).alias("px"), F.lit("guess").alias("src"))
    out = found.withColumn("_f", F.coalesce(*pick, guess))
    return out.select(*exif.columns, F.col("_f.px").alias("focal_px"), F.col("_f.src").alias("source"))


def summarise(estimates: DataFrame) -> DataFrame:
    return estimates.groupBy("source").agg(F.count("*").alias("n")).orderBy("source")


def intrinsics(estimates: DataFrame, shared: dict[str, float] | None = None) -> DataFrame:
    """(image_id, fx, fy, cx, cy, k1, k2): own EXIF focal length, else the shared one; centred principal point."""
    own = F.when(F.col("source") != "guess", F.col("focal_px"))
    f = F.coalesce(own, F.lit((shared or {}).get("fx")).cast("double"), F.col("focal_px"))
    s = {k: F.lit(float((shared or {}).get(k, 0.0))) for k in ("k1", "k2")}
    return estimates.select("image_id", f.alias("fx"), f.alias("fy"), (F.col("width") / 2).alias("cx"), (F.col("height") / 2).alias("cy"), s["k1"].alias("k1"), s["k2"].alias("k2"))


def peak(curve: DataFrame) -> DataFrame:
    """Refined maximum of (factor, accepted): one row factor, accepted, refined.

    A parabola through the best factor and its two neighbours; the vertex counts
    when the peak is interior, curved and the vertex lies strictly between them.
    """
    w = W.orderBy("factor")  # one row per candidate factor
    c = curve.select("factor", "accepted", F.lag("factor").over(w).alias("x0"), F.lag("accepted").over(w).alias("y0"), F.lead("factor").over(w).alias("x2"), F.lead("accepted").over(w).alias("y2"))
    bend = F.col("y0") - 2 * F.col("accepted") + F.col("y2")
    vertex = F.col("factor") + 0.5 * (F.col("y0") - F.col("y2")) / bend * (F.col("x2") - F.col("x0")) / 2
    good = (bend < -1e-9) & (vertex > F.col("x0")) & (vertex < F.col("x2"))
    best = c.orderBy(F.desc("accepted"), "factor").limit(1)
    return best.select("factor", "accepted", F.when(F.coalesce(good, F.lit(False)), vertex).otherwise(F.col("factor")).alias("refined"))
