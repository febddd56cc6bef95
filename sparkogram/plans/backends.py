"""Registry of optional native backends behind one contract each.

Extractors map image rows to keypoint rows (``mapInArrow``; ``sift`` has a NumPy
form of its own where no library is registered), matchers map
(features, pairs) to matches, densifiers map an image pair to points, surface
methods map a cloud to a mesh.  Backends that need a library which is not
installed raise :class:`BackendMissing` with the way out.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable


class BackendMissing(RuntimeError):
    pass


def torch_available() -> bool:
    return importlib.util.find_spec("torch") is not None


def has_gpu() -> bool:
    """Does a library see a CUDA device?"""
    if torch_available():
        import torch

        return bool(torch.cuda.is_available())
    if importlib.util.find_spec("cv2") is not None:
        import cv2

        return hasattr(cv2, "cuda") and cv2.cuda.getCudaEnabledDeviceCount() > 0
    return False


def device() -> str:
    """``cuda`` or ``cpu``: where optional backends run."""
    return "cuda" if has_gpu() else "cpu"


#: Library that each optional backend needs.
NEEDS = {
    ("extractor", "superpoint"): "kornia", ("extractor", "disk"): "kornia", ("matcher", "loftr"): "kornia",
    ("matcher", "lightglue"): "kornia", ("retrieval", "dinov2"): "torch", ("pnp", "poselib"): "poselib", ("bundle", "pyceres"): "pyceres",
    ("dense", "sgbm"): "cv2", ("surface", "poisson"): "open3d", ("surface", "bpa"): "open3d", ("surface", "alpha"): "open3d",
}
_FOUND: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str, function: Callable) -> None:
    """Add or replace a backend."""
    _FOUND[kind, name] = function


def available(kind: str, name: str) -> bool:
    if (kind, name) in _FOUND or (kind, name) == ("extractor", "sift"):
        return True
    library = NEEDS.get((kind, name))
    return library is not None and importlib.util.find_spec(library) is not None


def get(kind: str, name: str) -> Callable:
    """The registered backend, or an error that names the missing library."""
    if (kind, name) in _FOUND:
        return _FOUND[kind, name]
    if (kind, name) == ("extractor", "sift"):
        from sparkogram.kernels import sift

        return sift.extract
    library = NEEDS.get((kind, name))
    if library is None:
        raise BackendMissing(f"no {kind} named {name!r}")
    raise BackendMissing(f"{kind} {name!r} needs {library}: install it and register the function with register({kind!r}, {name!r}, ...)")
