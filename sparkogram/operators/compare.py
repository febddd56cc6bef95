"""Comparisons of meshes and clouds with a reference cloud."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkogram.operators.quantiles import quantiles

from sparkogram.operators.cloud import nearest
from sparkogram.operators.mesh import sample_surface
from sparkogram.operators.reports import distance_summary

XYZ = ("x", "y", "z")


def compare_to_reference(faces: DataFrame, vertices: DataFrame, reference: DataFrame, spacing: float, n_samples: int = 200_000, seed: int = 0) -> DataFrame:
    """(direction, n, mean, median, rms, p95, max, within_1, within_3) of surface samples against a cloud and back."""
    samples = sample_surface(faces, vertices, n_samples, seed)
    out = None
    for name, a, b in (("mesh_to_reference", samples, reference), ("reference_to_mesh", reference, samples)):
        d = nearest(a.select(F.col("pid").alias("qid"), *XYZ), b.select("pid", *XYZ), 1)
        within = d.agg(*(F.avg((F.col("distance") <= k * spacing).cast("double")).alias(f"within_{k}") for k in (1, 3)))
        row = distance_summary(d, "distance").join(within).select(F.lit(name).alias("direction"), "*")  # one row each
        out = row if out is None else out.unionAll(row)
    return out


def centre_and_scale(cloud: DataFrame) -> DataFrame:
    """The cloud around its median, scaled so that the 98th percentile of absolute coordinates is 1."""
    found = quantiles(cloud, {c: [0.5] for c in XYZ})
    mid = cloud.sparkSession.createDataFrame([tuple(found[c][0] for c in XYZ)], ", ".join(f"m{c} double" for c in XYZ))
    moved = cloud.join(F.broadcast(mid)).withColumns({c: F.col(c) - F.col(f"m{c}") for c in XYZ}).drop(*(f"m{c}" for c in XYZ))
    size = moved.select(F.explode(F.array(*(F.abs(c) for c in XYZ))).alias("v")).agg(F.expr("percentile(v, 0.98)").alias("s"))
    return moved.join(F.broadcast(size)).withColumns({c: F.try_divide(F.col(c), F.col("s")) for c in XYZ}).drop("s")


def close_points(points: DataFrame, radius: float) -> DataFrame:
    """(p, q) pairs of points (point_id, x, y, z) at most ``radius`` apart, by a grid join."""
    cell = lambda c: F.floor(F.col(c) / F.lit(radius))
    a = points.select(F.col("point_id").alias("p"), *(F.col(c).alias(f"a{c}") for c in XYZ), *(cell(c).alias(f"k{c}") for c in XYZ))
    for c in XYZ:
        a = a.withColumn(f"k{c}", F.explode(F.sequence(F.col(f"k{c}") - 1, F.col(f"k{c}") + 1)))
    b = points.select(F.col("point_id").alias("q"), *(F.col(c).alias(f"b{c}") for c in XYZ), *(cell(c).alias(f"k{c}") for c in XYZ))
    near = a.join(b, [f"k{c}" for c in XYZ]).where("p < q")
    return near.where(F.sqrt(sum((F.col(f"a{c}") - F.col(f"b{c}")) ** 2 for c in XYZ)) <= radius).select("p", "q")
