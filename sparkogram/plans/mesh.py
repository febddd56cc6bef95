"""Cloud preparation, mesh cleaning and validation as DataFrame plans."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkogram.operators import cloud as C
from sparkogram.operators import mesh as X
from sparkogram.operators import reports as R
from sparkogram.operators.quantiles import quantile
from sparkogram.plans import backends
from sparkogram.plans.config import EXTENT, PRESETS, Config
from sparkogram.runtime import cut

XYZ = ("x", "y", "z")


@dataclass
class Prepared:
    cloud: DataFrame
    spacing: float
    stats: dict = field(default_factory=dict)


def estimate_normals(cloud: DataFrame, k: int) -> DataFrame:
    """Normals from the covariance of k neighbours: nine grouped sums per point, then a closed 3x3 kernel per batch."""
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    near = C.self_neighbours(cloud, k)
    p = cloud.select("pid", *XYZ)
    j = near.join(p, "pid").select("qid", *XYZ).unionAll(p.select(F.col("pid").alias("qid"), *XYZ))
    sums = j.groupBy("qid").agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s{c}") for c in XYZ), *(F.sum(F.col(a) * F.col(b)).alias(f"s{a}{b}") for i, a in enumerate(XYZ) for b in XYZ[i:]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = b["n"].to_numpy(float)
            m = np.stack([b[f"s{c}"].to_numpy() / n for c in XYZ], axis=1)
            cov = np.zeros((len(b), 3, 3))
            for i in range(3):
                for k2 in range(i, 3):
                    cov[:, i, k2] = cov[:, k2, i] = b[f"s{XYZ[i]}{XYZ[k2]}"].to_numpy() / n - m[:, i] * m[:, k2]
            v = np.linalg.eigh(cov)[1][:, :, 0] if len(b) else np.empty((0, 3))
            yield pd.DataFrame({"pid": b["qid"], "nx": v[:, 0], "ny": v[:, 1], "nz": v[:, 2]})

    return cloud.join(sums.mapInPandas(run, "pid long, nx double, ny double, nz double"), "pid")


def prepare(cloud: DataFrame, preset: dict, centres: DataFrame | None = None) -> Prepared:
    """Finite points, outliers and far remainder removed, down-sampled to the target, with oriented normals."""
    stats = {"n_input": cloud.count()}
    c = cut(C.finite(cloud), "cloud")
    n = stats["n_finite"] = c.count()
    if not n:
        raise ValueError("the cloud has no finite point")
    near = C.spacing(c).first()["spacing"]
    if n > preset["sor_neighbors"] + 1:
        c = cut(c.join(C.statistical_outliers(c, preset["sor_neighbors"], preset["sor_std_ratio"]).select("pid"), "pid", "left_semi"), "cloud")
        stats["n_sor"] = c.count()
    k = preset["ror_min_neighbors"]
    if stats.get("n_sor", n) > k + 1 and near > 0:
        kept = C.radius_outliers(c, k, preset["ror_multiplier"] * near, preset["ror_max_removal"])
        c = cut(c.join(kept.select("pid"), "pid", "left_semi"), "cloud")
        stats["n_ror"] = c.count()
    c = cut(C.extent_filter(c, **EXTENT), "cloud")
    stats["n_extent"] = n = c.count()
    target = preset["target_points"]
    if target and n > target and near > 0:
        size = C.voxel_size_for(c, target, near)
        rest = tuple(x for x in ("r", "g", "b") if x in c.columns)
        c = C.voxel_downsample(c, size, rest).drop("n")
        c = cut(c.select(F.xxhash64("vx", "vy", "vz").alias("pid"), *XYZ, *rest), "cloud")
        stats |= {"voxel_size": size, "n_voxel": c.count()}
    near = C.spacing(c).first()["spacing"]
    c = cut(estimate_normals(c, min(preset["normal_max_nn"], 16)), "normals")
    if centres is not None:
        c = cut(C.orient_normals(c, centres), "oriented")
    return Prepared(c, near, stats | {"n_points": c.count(), "spacing": near})


def poisson_depth(cloud: DataFrame, spacing: float, preset: dict) -> int:
    """min(max(base, ceil(log2(diagonal / (factor * spacing)))), most)"""
    diag = C._diagonal(cloud, cloud)
    auto = math.ceil(math.log2(max(diag / (preset["cell_factor"] * spacing), 1.0))) if spacing > 0 else 0
    return min(max(preset["poisson_depth"], auto), preset["poisson_max_auto"])


def alpha_radius(cloud: DataFrame, spacing: float, preset: dict) -> float:
    return min(preset["alpha_factor"] * spacing, C._diagonal(cloud, cloud) / 2)


def ball_radii(spacing: float, preset: dict) -> list[float]:
    return [spacing * f for f in preset["bpa_factors"]]


def trim(vertices: DataFrame, faces: DataFrame, cloud: DataFrame, spacing: float, preset: dict) -> tuple[DataFrame, DataFrame]:
    """Drop vertices far from the cloud: of low density, beyond k local spacings, or outside the box with its margin.

    The local spacing is the distance to the sixth neighbour over sqrt 6.  When
    nearly everything would go, only the density counts.
    """
    local = C.kth_distance(cloud, 6).select("pid", (F.col("distance") / F.lit(math.sqrt(6))).alias("local"))
    near = C.nearest(vertices.select(F.col("vid").alias("qid"), *XYZ), cloud, 1).join(local, "pid")
    far = F.col("distance") > preset["trim_factor"] * F.greatest("local", F.lit(spacing))
    box = cloud.agg(*(f(c).alias(f"{n}{c}") for c in XYZ for f, n in ((F.min, "lo"), (F.max, "hi")))).first()
    edge = preset["bbox_margin"] * spacing
    out = F.lit(False)
    for c in XYZ:
        out = out | (F.col(c) < box[f"lo{c}"] - edge) | (F.col(c) > box[f"hi{c}"] + edge)
    v = vertices.join(near.select(F.col("qid").alias("vid"), far.alias("_far")), "vid")
    if "density" in vertices.columns:
        q = quantile(vertices, "density", preset["density_threshold"])
        v = v.withColumn("_thin", F.col("density") < q)
    else:
        v = v.withColumn("_thin", F.lit(False))
    v = cut(v.withColumn("_bad", F.col("_thin") | F.col("_far") | out), "trim")
    share = v.agg(F.avg(F.col("_bad").cast("double")).alias("s")).first()["s"] or 0.0
    gone = v.where("_thin" if share >= 0.95 else "_bad").select("vid")
    keep = v.join(gone, "vid", "left_anti").select(*vertices.columns)
    f = faces
    for k in "abc":
        f = f.join(gone.withColumnRenamed("vid", k), k, "left_anti")
    return keep, f.select("fid", "a", "b", "c")


def clean(vertices: DataFrame, faces: DataFrame, preset: dict, cfg: Config, spacing: float) -> tuple[DataFrame, DataFrame, dict]:
    """Merge vertices, drop degenerate, repeated and small-component faces, close holes."""
    stats = {"input": faces.count()}
    f, v = X.merge_vertices(faces, vertices)
    f = cut(X.clean_faces(f), "faces")
    stats["deduplicated"] = f.count()
    comp = cut(X.face_components(f), "components")
    kept = X.component_keep(comp, preset["component_ratio"], preset["component_faces"], cfg.mesh_keep_largest).where("kept")
    f = cut(f.join(comp.join(kept.select("component"), "component", "left_semi").select("fid"), "fid", "left_semi"), "faces")
    stats["components"] = f.count()
    if cfg.mesh_fill_holes:
        f, v = X.fill_holes(f, v)
        f, v = cut(X.clean_faces(f), "faces"), cut(v, "vertices")
        stats["filled"] = f.count()
    return v, f, stats


#: Accuracy and completeness gates of the verdict (fixed values).
GATES = {"accuracy": (3.0, 6.0), "completeness": (0.95, 0.85), "largest": (0.95, 0.80), "slivers": (0.02, 0.10)}


def _level(value: float | None, good: float, fair: float, up: bool) -> str:
    if value is None:
        return "WARN"
    reach = (lambda x: value >= x) if up else (lambda x: value <= x)
    return "PASS" if reach(good) else "WARN" if reach(fair) else "FAIL"


def validate(vertices: DataFrame, faces: DataFrame, cloud: DataFrame, spacing: float, n_samples: int = 200_000, tau_factor: float = 3.0, trim_factor: float | None = None) -> dict:
    """Topology, geometry, accuracy, completeness, checks and verdict of a mesh against its cloud.

    Distances go both ways between surface samples and the cloud.
    """
    t, o = X.edge_topology(faces), X.orientable(faces)
    top = t.join(o).first().asDict()
    top["genus"] = X.genus(t, o).first()["genus"]
    top["watertight"] = top["n_boundary"] == 0
    geo = X.triangle_quality(faces, vertices).first().asDict()
    comp = X.face_components(faces).groupBy("component").count().agg(F.count("*"), F.max("count"), F.sum("count")).first()
    top["n_components"], geo["largest_share"] = comp[0], (comp[1] or 0) / max(comp[2] or 0, 1)
    if top["watertight"] and top["oriented"]:
        geo["volume"] = X.signed_volume(faces, vertices).first()["volume"]
    samples = cut(X.sample_surface(faces, vertices, n_samples), "samples")
    s = spacing or None
    to_cloud = C.nearest(samples.withColumnRenamed("pid", "qid"), cloud, 1)
    accuracy = R.distance_summary(to_cloud, "distance", s).first().asDict()
    to_mesh = cut(C.nearest(cloud.withColumnRenamed("pid", "qid"), samples, 1), "completeness")
    completeness = R.distance_summary(to_mesh, "distance", s).first().asDict()
    for f in (1.0, tau_factor):
        completeness[f"within_{f:g}"] = to_mesh.agg(F.avg((F.col("distance") <= f * spacing).cast("double"))).first()[0]
    good, fair = GATES["accuracy"]
    if trim_factor is not None:
        good, fair = max(good, trim_factor + 1), max(fair, 2 * trim_factor + 1)
    checks = [
        ("accuracy_p95", _level(accuracy.get("p95_spacings"), good, fair, False), accuracy.get("p95_spacings")),
        ("completeness", _level(completeness[f"within_{tau_factor:g}"], *GATES["completeness"], True), completeness[f"within_{tau_factor:g}"]),
        ("largest_component", _level(geo["largest_share"], *GATES["largest"], True), geo["largest_share"]),
        ("slivers", _level(geo["sliver_share"], *GATES["slivers"], False), geo["sliver_share"]),
        ("manifold", "PASS" if top["n_nonmanifold"] == 0 else "WARN", top["n_nonmanifold"]),
    ]
    levels = {c[1] for c in checks}
    verdict = "FAIL" if "FAIL" in levels else "WARN" if "WARN" in levels else "PASS"
    rows = [{"name": n, "level": lv, "detail": d} for n, lv, d in checks]
    return {"topology": top, "geometry": geo, "accuracy": accuracy, "completeness": completeness, "checks": rows, "verdict": verdict}


def format_report(report: dict) -> str:
    """Fixed-width text of a report."""
    lines = [f"verdict  {report['verdict']}"]
    for part in ("topology", "geometry", "accuracy", "completeness"):
        lines.append(part)
        lines += [f"  {k:<20} {v:.6g}" if isinstance(v, float) else f"  {k:<20} {v}" for k, v in report[part].items()]
    return "\n".join(lines + [f"  [{c['level']}] {c['name']}: {c['detail']}" for c in report["checks"]])


@dataclass
class MeshResult:
    success: bool
    message: str = ""
    vertices: DataFrame | None = None
    faces: DataFrame | None = None
    report: dict | None = None
    stats: dict = field(default_factory=dict)


class MeshPipeline:
    """Cloud to mesh; never raises.  The surface method is a registered backend (prepared cloud, spacing, preset) -> (vertices, faces)."""

    def __init__(self, cfg: Config):
        self.cfg, self.preset = cfg, cfg.preset()

    def run(self, cloud: DataFrame, path: str | None = None, centres: DataFrame | None = None) -> MeshResult:
        from sparkogram.sources.documents import export_mesh

        cfg, out = self.cfg, MeshResult(False)
        try:
            prepared = prepare(cloud, self.preset, centres)
            out.stats["prepare"] = prepared.stats
            if cfg.mesh_keep_pointcloud and path:
                # the exact input of meshing is on disk before meshing can fail
                prepared.cloud.write.mode("overwrite").parquet(path.rsplit(".", 1)[0] + "_prepared.parquet")
            v, f = backends.get("surface", cfg.mesh_method)(prepared.cloud, prepared.spacing, self.preset)
            v, f = trim(v, f, prepared.cloud, prepared.spacing, self.preset)
        except Exception as e:  # noqa: BLE001  the contract is a result, not an exception
            out.message = f"{type(e).__name__}: {e}"
            return out
        for name, step in (("clean", self._clean), ("finish", self._finish)):
            try:
                v, f = step(v, f, prepared, out)
            except Exception as e:  # noqa: BLE001
                out.stats[f"{name}_warning"] = str(e)
        out.vertices, out.faces = v, f
        try:
            if path:
                export_mesh(v, f, path)
        except Exception as e:  # noqa: BLE001
            out.message = f"{type(e).__name__}: {e}"
            return out
        out.success = True
        if not cfg.mesh_no_validate:
            try:
                out.report = validate(v, f, prepared.cloud, prepared.spacing, trim_factor=self.preset["trim_factor"])
                json.dumps(out.report)
            except Exception as e:  # noqa: BLE001
                out.stats["validate_warning"] = str(e)
        return out

    def _clean(self, v: DataFrame, f: DataFrame, prepared: Prepared, out: MeshResult) -> tuple[DataFrame, DataFrame]:
        if self.cfg.mesh_no_clean:
            return v, f
        v, f, out.stats["clean"] = clean(v, f, self.preset, self.cfg, prepared.spacing)
        return v, f

    def _finish(self, v: DataFrame, f: DataFrame, prepared: Prepared, out: MeshResult) -> tuple[DataFrame, DataFrame]:
        if self.cfg.mesh_smooth:
            v = X.smooth(f, v, self.cfg.mesh_smooth_iterations)
        if self.cfg.mesh_decimate:
            v, f = backends.get("decimate", "quadric")(v, f, self.cfg.mesh_decimate_target)
        if not self.cfg.mesh_no_texture and {"r", "g", "b"} <= set(prepared.cloud.columns):
            v = v.select("vid", *XYZ).join(C.transfer_colours(v.select("vid", *XYZ), prepared.cloud), "vid")
        return v, f


__all__ = ["GATES", "MeshPipeline", "MeshResult", "PRESETS", "Prepared", "alpha_radius", "ball_radii", "clean", "estimate_normals", "format_report", "poisson_depth", "prepare", "trim", "validate"]
