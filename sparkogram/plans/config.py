"""Configuration: every option of the workflow, its default and its validity."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields

#: Mesh quality presets (fixed values).
PRESETS = {
    "low": {
        "sor_neighbors": 10, "sor_std_ratio": 3.0, "ror_multiplier": 4.0, "ror_min_neighbors": 4, "ror_max_removal": 0.20,
        "normal_radius_factor": 3.0, "normal_max_nn": 20, "target_points": 50_000, "poisson_depth": 8, "poisson_max_auto": 10, "cell_factor": 2.5,
        "density_threshold": 0.03, "trim_factor": 4.0, "bbox_margin": 4.0, "bpa_factors": (1, 2, 4), "alpha_factor": 6.0,
        "component_ratio": 0.02, "component_faces": 50, "hole_factor": 10.0, "intersection_max_faces": 150_000, "tau_factor": 3.0,
    },
    "medium": {
        "sor_neighbors": 20, "sor_std_ratio": 2.0, "ror_multiplier": 3.0, "ror_min_neighbors": 5, "ror_max_removal": 0.15,
        "normal_radius_factor": 3.0, "normal_max_nn": 30, "target_points": 200_000, "poisson_depth": 9, "poisson_max_auto": 11, "cell_factor": 1.5,
        "density_threshold": 0.03, "trim_factor": 3.0, "bbox_margin": 3.0, "bpa_factors": (1, 2, 4, 8), "alpha_factor": 5.0,
        "component_ratio": 0.02, "component_faces": 50, "hole_factor": 15.0, "intersection_max_faces": 100_000, "tau_factor": 3.0,
    },
    "high": {
        "sor_neighbors": 30, "sor_std_ratio": 1.5, "ror_multiplier": 2.5, "ror_min_neighbors": 6, "ror_max_removal": 0.12,
        "normal_radius_factor": 2.5, "normal_max_nn": 40, "target_points": 500_000, "poisson_depth": 10, "poisson_max_auto": 12, "cell_factor": 1.0,
        "density_threshold": 0.02, "trim_factor": 2.5, "bbox_margin": 2.0, "bpa_factors": (0.75, 1.5, 3, 6), "alpha_factor": 4.0,
        "component_ratio": 0.01, "component_faces": 50, "hole_factor": 20.0, "intersection_max_faces": 150_000, "tau_factor": 3.0,
    },
    "ultra": {
        "sor_neighbors": 40, "sor_std_ratio": 1.2, "ror_multiplier": 2.0, "ror_min_neighbors": 8, "ror_max_removal": 0.10,
        "normal_radius_factor": 2.0, "normal_max_nn": 60, "target_points": None, "poisson_depth": 11, "poisson_max_auto": 13, "cell_factor": 0.8,
        "density_threshold": 0.02, "trim_factor": 2.0, "bbox_margin": 1.5, "bpa_factors": (0.5, 1, 2, 4), "alpha_factor": 3.0,
        "component_ratio": 0.005, "component_faces": 50, "hole_factor": 25.0, "intersection_max_faces": 200_000, "tau_factor": 3.0,
    },
}
EXTENT = {"max_removal": 0.05, "min_gap": 1.5, "min_shrink": 2.0}

CHOICES = {
    "backend": ("python", "colmap", "colmap-mvs"),
    "feature_backend": ("sift", "superpoint", "disk"),
    "match_strategy": ("exhaustive", "sequential", "vocab_tree", "loftr"),
    "retrieval": ("none", "dinov2"),
    "pnp_backend": ("cv2", "poselib"),
    "ba_backend": ("scipy", "pyceres"),
    "viz_format": ("png", "jpg", "pdf"),
    "mesh_method": ("poisson", "bpa", "alpha"),
    "mesh_quality": tuple(PRESETS),
}


@dataclass(frozen=True)
class Config:
    """One field per option; ``None`` means "decide from the data"."""

    image_dir: str = ""
    output: str = "output.ply"
    backend: str = "python"
    n_features: int = 8000
    feature_backend: str = "sift"
    sift_contrast_threshold: float = 0.02
    sift_edge_threshold: float = 10.0
    sift_n_octave_layers: int = 3
    sift_sigma: float = 1.6
    match_strategy: str = "exhaustive"
    match_workers: int = 0
    sequential_window: int = 5
    vocab_words: int = 4096
    vocab_top_k: int = 10
    retrieval: str = "none"
    retrieval_top_k: int = 10
    ratio: float = 0.75
    min_matches: int = 15
    min_inliers: int = 15
    ransac_thr: float = 1.0
    max_reproj_error: float = 4.0
    ba_interval: int = 5
    no_refine_intrinsics: bool = False
    ba_fix_principal_point: bool = False
    loop_closure: bool = False
    local_ba_window: int = 0
    track_merge: bool = False
    per_camera_intrinsics: bool = False
    pnp_backend: str = "cv2"
    ba_separate_focal: bool = False
    ba_backend: str = "scipy"
    no_track_completion: bool = False
    focal: float | None = None
    intrinsics: str | None = None
    focal_search: bool = False
    no_focal_search: bool = False
    focal_search_pairs: int = 12
    no_global_tracks: bool = False
    geometric_loop_closure: bool = True
    loop_max_angle: float = 45.0
    loop_max_centre_ratio: float = 0.6
    loop_max_pairs: int = 200
    ba_ftol: float = 1e-6
    ba_xtol: float = 1e-6
    ba_gtol: float = 1e-6
    ba_max_nfev: int = 200
    ba_no_param_scaling: bool = False
    dense: bool = False
    dense_output: str | None = None
    mvs_fusion: bool = False
    mvs_fusion_min_views: int = 2
    max_dense_points: int = 500_000
    no_filter: bool = False
    verbose: bool = False
    seed: int = 0
    export_cameras: str | None = None
    visualize: bool = False
    viz_samples: int = 3
    viz_output: str = "sfm_visualization"
    viz_format: str = "png"
    viz_interactive: bool = False
    viz_save_video: bool = False
    viz_dpi: int = 150
    viz_seed: int = 42
    colmap_bin: str = "colmap"
    colmap_workspace: str | None = None
    colmap_keep_workspace: bool = False
    colmap_vocab_tree: str | None = None
    mesh: bool = False
    mesh_output: str | None = None
    mesh_method: str = "poisson"
    mesh_quality: str = "medium"
    mesh_depth: int | None = None
    mesh_trim: float | None = None
    mesh_target_points: int | None = None
    mesh_no_clean: bool = False
    mesh_smooth: bool = False
    mesh_smooth_iterations: int = 5
    mesh_no_texture: bool = False
    mesh_decimate: bool = False
    mesh_decimate_target: int = 100_000
    mesh_fill_holes: bool = True
    mesh_hole_size: float | None = None
    mesh_keep_largest: bool = False
    mesh_keep_pointcloud: bool = True
    mesh_self_intersections: bool = False
    mesh_no_validate: bool = False
    mesh_preview: bool = False
    checkpoint_dir: str | None = None
    resume: bool = False

    def problems(self) -> list[str]:
        """What is wrong, in a fixed order; empty when everything is in range."""
        out = [f"{k} must be one of {', '.join(v)}" for k, v in CHOICES.items() if getattr(self, k) not in v]
        least = {
            "n_features": 1, "sequential_window": 1, "vocab_words": 2, "vocab_top_k": 1, "retrieval_top_k": 1, "min_matches": 1, "min_inliers": 5,
            "ba_interval": 1, "local_ba_window": 0, "focal_search_pairs": 1, "loop_max_pairs": 0, "ba_max_nfev": 1, "mvs_fusion_min_views": 1,
            "max_dense_points": 1, "mesh_smooth_iterations": 1, "mesh_decimate_target": 4, "match_workers": 0,
        }
        out += [f"{k} must be at least {v}" for k, v in least.items() if getattr(self, k) < v]
        out += [f"{k} must be positive" for k in ("ransac_thr", "max_reproj_error", "ba_ftol", "ba_xtol", "ba_gtol", "sift_sigma") if getattr(self, k) <= 0]
        if not 0 < self.ratio < 1:
            out.append("ratio must lie between 0 and 1")
        if self.focal is not None and self.focal <= 0:
            out.append("focal must be positive")
        if self.intrinsics is not None:
            try:
                self.shared_intrinsics()
            except ValueError as e:
                out.append(str(e))
        if self.mesh_target_points is not None and self.mesh_target_points < 1:
            out.append("mesh_target_points must be at least 1")
        return out

    def validated(self) -> Config:
        if found := self.problems():
            raise ValueError(found[0])
        return self

    def shared_intrinsics(self) -> dict[str, float] | None:
        """fx, fy, cx, cy of the ``intrinsics`` option."""
        if self.intrinsics is None:
            return None
        try:
            values = [float(x) for x in self.intrinsics.split(",")]
        except ValueError:
            values = []
        if len(values) != 4 or min(values[:2], default=0) <= 0:
            raise ValueError('intrinsics must be "fx,fy,cx,cy"')
        return dict(zip(("fx", "fy", "cx", "cy"), values, strict=True))

    def preset(self) -> dict:
        p = dict(PRESETS[self.mesh_quality])
        for option, key in (("mesh_depth", "poisson_depth"), ("mesh_trim", "trim_factor"), ("mesh_target_points", "target_points")):
            if getattr(self, option) is not None:
                p[key] = getattr(self, option)
        return p


def parser() -> argparse.ArgumentParser:
    """A command line with one option per field."""
    out = argparse.ArgumentParser(prog="sparkogram", description="Reconstruct points and cameras from photos with Spark")
    for f in fields(Config):
        kind = str(f.type)
        names = dict.fromkeys(("--" + f.name.replace("_", "-"), "--" + f.name))
        if kind == "bool":
            out.add_argument(*names, action=argparse.BooleanOptionalAction if f.default else "store_true", default=f.default, dest=f.name)
        else:
            cast = int if kind.startswith("int") else float if kind.startswith("float") else str
            out.add_argument(*names, type=cast, default=f.default, dest=f.name, choices=CHOICES.get(f.name))
    return out


def from_arguments(argv: list[str] | None = None) -> Config:
    return Config(**vars(parser().parse_args(argv))).validated()
