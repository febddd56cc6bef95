"""Pixel colours at observations, and how consistent they are between photos."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkogram.functions.geometry import project
from sparkogram.operators.observations import mean_colours


def bilinear(raster: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values of an H x W x C raster at positions, which are moved inside the border first."""
    h, w = raster.shape[:2]
    x, y = np.clip(x, 0, max(w - 1.001, 0)), np.clip(y, 0, max(h - 1.001, 0))
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = (x - x0)[:, None], (y - y0)[:, None]
    r = raster.astype(np.float64)
    return (1 - fy) * ((1 - fx) * r[y0, x0] + fx * r[y0, x1]) + fy * ((1 - fx) * r[y1, x0] + fx * r[y1, x1])


#: Observations of one photo that one row carries to its raster.
GROUP = 65_536


def sample_colours(obs: DataFrame, images: DataFrame) -> DataFrame:
    """``obs`` (image_id, point_id, x, y, ...) of readable photos with r, g, b (0..255).

    ``images``: image_id, width, height, channels, data (BGR rows).  Positions are
    packed by photo, at most GROUP in a row, so a raster meets a few rows and never
    a row per observation.
    """
    extra = [c for c in obs.columns if c != "image_id"]
    part = F.pmod(F.xxhash64(*extra), F.lit(1 << 16))
    share = obs.groupBy("image_id").agg(F.ceil(F.count("*") / GROUP).cast("long").alias("_n"))
    packed = obs.join(share, "image_id").withColumn("_p", F.pmod(part, F.col("_n"))).groupBy("image_id", "_p").agg(F.collect_list(F.struct(*extra)).alias("_o"))
    rows = packed.join(images.select("image_id", "width", "height", "channels", "data"), "image_id").select("_o", "width", "height", "channels", "data", "image_id", "_o.x", "_o.y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                w, h, ch, data = (batch.column(c)[i].as_py() for c in range(1, 5))
                raster = np.frombuffer(data, np.uint8)[: w * h * ch].reshape(h, w, ch)
                raster = np.repeat(raster, 3, axis=2) if ch == 1 else raster[..., 2::-1]
                x, y = (np.asarray(batch.column(c)[i].values, np.float64) for c in (6, 7))
                got = bilinear(raster, x, y)
                o = batch.column(0)[i].values
                image = pa.array(np.full(len(x), batch.column(5)[i].as_py()), batch.schema.field(5).type)
                yield pa.RecordBatch.from_arrays([image, *o.flatten(), *(pa.array(got[:, c]) for c in range(3))], names=["image_id", *extra, "r", "g", "b"])

    kinds = dict(obs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ["image_id", *extra]) + ", r double, g double, b double"
    return rows.mapInArrow(run, schema)


def colourise(obs: DataFrame, images: DataFrame, points: DataFrame, threshold: float = 4.0) -> DataFrame:
    """(point_id, r, g, b): the mean colour of a point's observations up to the error threshold, grey without any.

    ``obs``: image_id, point_id, x, y, err.
    """
    return mean_colours(sample_colours(obs.where(F.col("err") <= threshold), images), points, threshold)


def photometric_consistency(samples: DataFrame, cameras: DataFrame, images: DataFrame, min_views: int = 3) -> DataFrame:
    """(sid, n_views, deviation): how much a surface sample's colour varies between the photos that see it.

    ``samples``: sid, x, y, z and the normal nx, ny, nz; a photo sees a sample that
    projects into it from the side its normal points to.  ``cameras``: image_id, R,
    t, K, cx, cy, cz.  The deviation is the mean over channels of the standard
    deviation.  Samples are a bounded set (a parameter of the evaluation) against
    all cameras, so each camera's row meets each sample once.
    """
    u, v, z = project([F.col(c) for c in "xyz"], "R", "t", "K")
    seen = samples.crossJoin(cameras.select("image_id", "R", "t", "K", "cx", "cy", "cz")).withColumns({"_u": u, "_v": v, "_z": z})
    facing = sum(F.col(f"n{c}") * (F.col(f"c{c}") - F.col(c)) for c in "xyz") > 0
    seen = seen.where((F.col("_z") > 0) & facing).select("image_id", F.col("sid").alias("point_id"), F.col("_u").alias("x"), F.col("_v").alias("y"))
    size = images.select("image_id", "width", "height")
    seen = seen.join(size, "image_id").where("x >= 0 and y >= 0 and x <= width - 1 and y <= height - 1").drop("width", "height")
    got = sample_colours(seen, images).groupBy(F.col("point_id").alias("sid")).agg(F.count("*").alias("n_views"), ((F.stddev_pop("r") + F.stddev_pop("g") + F.stddev_pop("b")) / 3).alias("deviation"))
    return got.where(F.col("n_views") >= min_views)


def displaced(samples: DataFrame, distance: float) -> DataFrame:
    """The samples moved along their normals: the control that a wrong surface would look like."""
    return samples.select("sid", *((F.col(c) + F.lit(distance) * F.col(f"n{c}")).alias(c) for c in "xyz"), "nx", "ny", "nz")


def consistency_report(samples: DataFrame, cameras: DataFrame, images: DataFrame, spacing: float = 1.0, factors: tuple[float, ...] = (10.0, 30.0)) -> DataFrame:
    """(offset, n, mean_deviation) of the surface itself (offset 0) and of displaced controls."""
    out = None
    for f in (0.0, *factors):
        got = photometric_consistency(displaced(samples, f * spacing), cameras, images)
        row = got.agg(F.lit(f).alias("offset"), F.count("*").alias("n"), F.avg("deviation").alias("mean_deviation"))
        out = row if out is None else out.unionByName(row)
    return out
