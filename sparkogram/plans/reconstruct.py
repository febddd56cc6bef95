"""Verification and reconstruction as DataFrame plans over NumPy kernels.

A pair or a component of the scene graph is one group of an Arrow-batched
function; everything between groups is relational.  A component has to fit one
worker; the usual workflow reconstructs its largest component only, here all
components are reconstructed side by side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkogram.functions.geometry import camera_centre, reprojection_error

from sparkogram.kernels.incremental import Pair, Reconstruction, Settings
from sparkogram.kernels.twoview import triangulate, verify_pair
from sparkogram.operators.components import connected_components

VERIFIED = "img_i int, img_j int, F array<double>, E array<double>, H array<double>, R array<double>, t array<double>, n_inliers int, planar boolean, h_ratio double, kp_i array<int>, kp_j array<int>"


def with_pixels(matches: DataFrame, keypoints: DataFrame) -> DataFrame:
    """Matches with the pixels of both ends (xi, yi, xj, yj)."""
    side = lambda s: keypoints.select(F.col("image_id").alias(f"img_{s}"), F.col("kp_id").alias(f"kp_{s}"), F.col("x").cast("double").alias(f"x{s}"), F.col("y").cast("double").alias(f"y{s}"))
    return matches.join(side("i"), ["img_i", "kp_i"]).join(side("j"), ["img_j", "kp_j"])


def verify(matches: DataFrame, keypoints: DataFrame, K: np.ndarray, dist: np.ndarray | None = None, seed: int = 0, **gates) -> DataFrame:
    """VERIFIED rows of the pairs that pass; seeds depend on the pair, so results don't depend on partitioning."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["kp_i", "kp_j"], kind="stable")
        i, j = int(key[0]), int(key[1])
        v = verify_pair(pdf[["xi", "yi"]].to_numpy(), pdf[["xj", "yj"]].to_numpy(), K, seed=(i * 1_000_003 + j + seed) % (1 << 32), dist=dist, **gates)
        if v is None:
            return pd.DataFrame(columns=[c.split()[0] for c in VERIFIED.split(", ")])
        flat = lambda m: None if m is None else np.asarray(m, float).ravel().tolist()
        kept = pdf.iloc[v.inliers]
        row = (i, j, flat(v.F), flat(v.E), flat(v.H), flat(v.R), flat(v.t), len(kept), v.planar, v.h_ratio, kept["kp_i"].tolist(), kept["kp_j"].tolist())
        return pd.DataFrame([row], columns=[c.split()[0] for c in VERIFIED.split(", ")])

    return with_pixels(matches, keypoints).groupBy("img_i", "img_j").applyInPandas(run, VERIFIED)


RESULT = "component long, kind string, id long, other long, kp int, v array<double>"


def reconstruct(verified: DataFrame, keypoints: DataFrame, K: np.ndarray, settings: Settings = Settings()) -> DataFrame:
    """RESULT rows of every scene-graph component: cameras (v = R, t, fx, fy, cx, cy, k1, k2), points (v = x, y, z), observations (id = image, other = point, v = pixels) and log rows."""
    cc = connected_components(verified, "img_i", "img_j").select(F.col("node").alias("img_i"), "component")
    pairs = verified.join(cc, "img_i").select(
        "component", F.lit(0).alias("row"), F.col("img_i").cast("long").alias("a"), F.col("img_j").cast("long").alias("b"),
        F.concat("R", "t", F.array(F.col("planar").cast("double"))).alias("v"), "kp_i", "kp_j",
    )
    images = keypoints.join(cc.withColumnRenamed("img_i", "image_id"), "image_id")
    none = F.lit(None).cast("array<int>")
    pixels = images.groupBy("component", "image_id").agg(F.array_sort(F.collect_list(F.struct("kp_id", "x", "y"))).alias("k"))
    pixels = pixels.select(
        "component", F.lit(1).alias("row"), F.col("image_id").cast("long").alias("a"), F.lit(0).cast("long").alias("b"),
        F.flatten(F.transform("k", lambda p: F.array(p.x.cast("double"), p.y.cast("double")))).alias("v"), F.col("k.kp_id").alias("kp_i"), none.alias("kp_j"),
    )

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        feats, number = {}, {}
        for r in pdf[pdf["row"] == 1].itertuples():
            feats[int(r.a)] = np.asarray(r.v).reshape(-1, 2)
            number[int(r.a)] = np.asarray(r.kp_i)
        pairs = {}
        for r in pdf[pdf["row"] == 0].itertuples():
            i, j, v = int(r.a), int(r.b), np.asarray(r.v)
            inl = np.column_stack([np.searchsorted(number[i], r.kp_i), np.searchsorted(number[j], r.kp_j)])
            pairs[i, j] = Pair(inl[np.lexsort((inl[:, 1], inl[:, 0]))], v[:9].reshape(3, 3), v[9:12], bool(v[12]))
        rec = Reconstruction(feats, pairs, K, settings).run()
        out, comp = [], int(key[0])
        for c in sorted(rec.cameras):
            r, t = rec.cameras[c]
            out.append((comp, "camera", c, None, None, [*r.ravel(), *t, *rec.intr]))
        for p in sorted({p for _, p in rec.obs}):
            out.append((comp, "point", p, None, None, list(rec.points[p])))
        for (i, p), kp in sorted(rec.obs.items()):
            out.append((comp, "observation", i, p, int(number[i][kp]), list(feats[i][kp])))
        for n, e in enumerate(rec.log):
            vals = [float(e.get(k, np.nan)) for k in ("image", "new_points", "correspondences", "before", "after")]
            out.append((comp, e["kind"], n, None, None, vals))
        return pd.DataFrame(out, columns=["component", "kind", "id", "other", "kp", "v"]).astype({"other": "Int64", "kp": "Int32"})

    return pairs.unionByName(pixels).groupBy("component").applyInPandas(run, RESULT)


def cameras_of(result: DataFrame) -> DataFrame:
    c = result.where("kind = 'camera'").select(
        "component", F.col("id").cast("int").alias("image_id"), F.slice("v", 1, 9).alias("R"), F.slice("v", 10, 3).alias("t"),
        F.expr("array(v[12], 0d, v[14], 0d, v[13], v[15], 0d, 0d, 1d)").alias("K"), F.slice("v", 17, 2).alias("dist"),
    )
    return c.select("*", *(x.alias(f"c{a}") for x, a in zip(camera_centre("R", "t"), "xyz", strict=True)))


def points_of(result: DataFrame) -> DataFrame:
    return result.where("kind = 'point'").select("component", F.col("id").alias("point_id"), *(F.col("v").getItem(i).alias(a) for i, a in enumerate("xyz")))


def observations_of(result: DataFrame) -> DataFrame:
    return result.where("kind = 'observation'").select("component", F.col("id").cast("int").alias("image_id"), F.col("other").alias("point_id"), F.col("kp").alias("kp_id"), F.col("v").getItem(0).alias("x"), F.col("v").getItem(1).alias("y"))


def observation_errors(obs: DataFrame, cameras: DataFrame, points: DataFrame, square_pixels: bool = True) -> DataFrame:
    """Observations with ``err``: the pinhole error with the camera's own K, null behind it."""
    p = points.select("component", "point_id", *(F.col(a).alias(f"p{a}") for a in "xyz"))
    j = obs.join(cameras.select("component", "image_id", "R", "t", "K"), ["component", "image_id"]).join(p, ["component", "point_id"])
    err = reprojection_error([F.col(f"p{a}") for a in "xyz"], "x", "y", "R", "t", "K", square_pixels)
    return j.select(*obs.columns, err.alias("err"))


def better(first: DataFrame, second: DataFrame) -> DataFrame:
    """The second result when it has at least as many (cameras, points), compared in that order."""
    size = lambda d: d.agg(F.sum((F.col("kind") == "camera").cast("int")), F.sum((F.col("kind") == "point").cast("int"))).first()
    a, b = size(first), size(second)
    return second if (b[0] or 0, b[1] or 0) >= (a[0] or 0, a[1] or 0) else first


def score_focal(matches: DataFrame, keypoints: DataFrame, K: np.ndarray, factors: list[float], max_error: float = 4.0, seed: int = 0, **gates) -> DataFrame:
    """(factor, accepted): triangulated matches that pass at each assumed focal length; one group per factor and pair."""
    rows = with_pixels(matches, keypoints).withColumn("factor", F.explode(F.array(*(F.lit(float(f)) for f in factors))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["kp_i", "kp_j"], kind="stable")
        k = K.copy()
        k[0, 0], k[1, 1] = K[0, 0] * key[0], K[1, 1] * key[0]
        a, b = pdf[["xi", "yi"]].to_numpy(), pdf[["xj", "yj"]].to_numpy()
        v = verify_pair(a, b, k, seed=(int(key[1]) * 1_000_003 + int(key[2]) + seed) % (1 << 32), **gates)
        n = 0
        if v is not None:
            f = {0: a[v.inliers], 1: b[v.inliers]}
            rec = Reconstruction(f, {}, k, Settings(max_error=max_error))
            rec.cameras = {0: (np.eye(3), np.zeros(3)), 1: (v.R, v.t)}
            x, good = triangulate(k @ np.eye(3, 4), k @ np.column_stack([v.R, v.t]), f[0], f[1])
            n = int(rec._accept(x, good, 0, 1, f[0], f[1]).sum())
        return pd.DataFrame([(key[0], n)], columns=["factor", "accepted"])

    return rows.groupBy("factor", "img_i", "img_j").applyInPandas(run, "factor double, accepted long").groupBy("factor").agg(F.sum("accepted").alias("accepted"))


