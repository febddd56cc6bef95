"""Camera geometry as column expressions over flat row-major arrays.

R and K are array<double> of 9, t and points array<double> of 3; the convention
is x_cam = R X + t with camera centre -R^T t.  Everything stays inside
whole-stage code generation; a point behind a camera has a null error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def at(v: str | Column, i: int) -> Column:
    """0-based element."""
    return _c(v).getItem(i)


def matvec(m: str | Column, v: list[Column], transpose: bool = False) -> list[Column]:
    pick = (lambda i, j: at(m, 3 * j + i)) if transpose else (lambda i, j: at(m, 3 * i + j))
    return [sum((pick(i, j) * v[j] for j in range(1, 3)), pick(i, 0) * v[0]) for i in range(3)]


def matmul(a: str | Column, b: str | Column, transpose_b: bool = False) -> Column:
    pick = (lambda i, j: at(b, 3 * j + i)) if transpose_b else (lambda i, j: at(b, 3 * i + j))
    return F.array(*(sum((at(a, 3 * i + k) * pick(k, j) for k in range(1, 3)), at(a, 3 * i) * pick(0, j)) for i in range(3) for j in range(3)))


def camera_centre(r: str, t: str) -> list[Column]:
    return [-x for x in matvec(r, [at(t, i) for i in range(3)], transpose=True)]


def viewing_direction(r: str) -> list[Column]:
    """Third row of R."""
    return [at(r, 6), at(r, 7), at(r, 8)]


def projection_matrix(k: str, r: str, t: str) -> Column:
    """K [R | t], 12 values."""
    cols = []
    for i in range(3):
        for j in range(4):
            part = [at(k, 3 * i + m) * (at(r, 3 * m + j) if j < 3 else at(t, m)) for m in range(3)]
            cols.append(part[0] + part[1] + part[2])
    return F.array(*cols)


def to_camera(x: list[Column], r: str, t: str) -> list[Column]:
    return [a + at(t, i) for i, a in enumerate(matvec(r, x))]


def project(x: list[Column], r: str, t: str, k: str, square_pixels: bool = False) -> tuple[Column, Column, Column]:
    """(u, v, depth); with ``square_pixels`` fx serves both axes."""
    cam = to_camera(x, r, t)
    z = F.when(F.abs(cam[2]) > 1e-9, cam[2]).otherwise(F.lit(1e-9))
    fy = at(k, 0) if square_pixels else at(k, 4)
    return at(k, 0) * cam[0] / z + at(k, 2), fy * cam[1] / z + at(k, 5), cam[2]


def reprojection_error(x: list[Column], u: str, v: str, r: str, t: str, k: str, square_pixels: bool = False) -> Column:
    pu, pv, z = project(x, r, t, k, square_pixels)
    return F.when(z > 0, F.hypot(pu - _c(u), pv - _c(v)))


def distort(x: Column, y: Column, k1: str | Column, k2: str | Column) -> tuple[Column, Column]:
    """Radial distortion of normalised coordinates."""
    r2 = x * x + y * y
    f = F.lit(1.0) + _c(k1) * r2 + _c(k2) * r2 * r2
    return x * f, y * f


def undistort(xd: Column, yd: Column, k1: str | Column, k2: str | Column, rounds: int = 5) -> tuple[Column, Column]:
    """Inverse of :func:`distort` by fixed-point iteration (a fold, so the expression stays small)."""

    def step(s: Column, _: Column) -> Column:
        x, y = s.getField("x"), s.getField("y")
        r2 = x * x + y * y
        f = F.lit(1.0) + _c(k1) * r2 + _c(k2) * r2 * r2
        return F.struct((xd / f).alias("x"), (yd / f).alias("y"))

    got = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(xd.alias("x"), yd.alias("y")), step)
    return got.getField("x"), got.getField("y")


def triangulation_angle(x: list[Column], c1: list[Column], c2: list[Column]) -> Column:
    """Degrees between the rays from two centres to a point; null when a ray is shorter than 1e-10."""
    a, b = [p - q for p, q in zip(x, c1, strict=True)], [p - q for p, q in zip(x, c2, strict=True)]
    dot = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (na * nb)))
    return F.when((na > 1e-10) & (nb > 1e-10), F.degrees(F.acos(cos)))


def accept_point(z1: Column, z2: Column, angle: Column, e1: Column, e2: Column, max_error: float = 4.0, min_angle: float = 2.0) -> Column:
    """In front of both cameras, wide enough, close enough to both observations."""
    good = (z1 > 0) & (z2 > 0) & (angle >= min_angle) & (e1 <= max_error) & (e2 <= max_error)
    return F.coalesce(good, F.lit(False))


def rotation_angle(r: str | Column) -> Column:
    """Degrees of a rotation matrix."""
    cos = (at(r, 0) + at(r, 4) + at(r, 8) - 1) / 2
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))


def rotation_difference(a: str, b: str) -> Column:
    return rotation_angle(matmul(a, b, transpose_b=True))


def quaternion_rotation(q: str, normalise: bool = True) -> Column:
    """Rotation matrix of a (w, x, y, z) quaternion."""
    w, x, y, z = (at(q, i) for i in range(4))
    if normalise:
        n = F.sqrt(w * w + x * x + y * y + z * z)
        w, x, y, z = w / n, x / n, y / n, z / n
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    )


def rotate(v: list[Column], p: list[Column]) -> list[Column]:
    """Axis-angle rotation; the identity below 1e-10."""
    theta = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    safe = F.greatest(theta, F.lit(1e-10))
    k = [x / safe for x in v]
    cross = [k[1] * p[2] - k[2] * p[1], k[2] * p[0] - k[0] * p[2], k[0] * p[1] - k[1] * p[0]]
    dot = k[0] * p[0] + k[1] * p[1] + k[2] * p[2]
    c, s = F.cos(theta), F.sin(theta)
    return [F.when(theta < 1e-10, a).otherwise(a * c + b * s + d * dot * (1 - c)) for a, b, d in zip(p, cross, k, strict=True)]


def similarity(p: list[Column], s: Column, r: str, t: str) -> list[Column]:
    """s R p + t."""
    return [s * a + at(t, i) for i, a in enumerate(matvec(r, p))]


def with_focal(k: str, focal: Column) -> Column:
    """K with both focal lengths replaced."""
    return F.array(focal, *(at(k, i) for i in range(1, 4)), focal, *(at(k, i) for i in range(5, 9)))


def intrinsics_matrix(fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    zero = F.lit(0.0)
    return F.array(fx, zero, cx, zero, fy, cy, zero, zero, F.lit(1.0))


def field_of_view(focal: Column, width: Column, height: Column) -> Column:
    """Diagonal field of view in degrees."""
    return F.degrees(2 * F.atan(F.hypot(width.cast("double"), height.cast("double")) / (2 * focal)))


def plausible_focal(focal: Column, width: Column, height: Column) -> Column:
    """Finite, positive, diagonal view between 5 and 150 degrees."""
    view = field_of_view(F.when(focal > 0, focal), width, height)
    return F.coalesce((focal > 0) & ~F.isnan(focal) & view.between(5.0, 150.0), F.lit(False))


#: COLMAP camera models: number of parameters and which of them are fx, fy, cx, cy, k1, k2 (fixed values).
CAMERA_MODELS = {
    "SIMPLE_PINHOLE": (3, (0, 0, 1, 2, None, None)),
    "PINHOLE": (4, (0, 1, 2, 3, None, None)),
    "SIMPLE_RADIAL": (4, (0, 0, 1, 2, 3, None)),
    "RADIAL": (5, (0, 0, 1, 2, 3, 4)),
    "OPENCV": (8, (0, 1, 2, 3, 4, 5)),
    "OPENCV_FISHEYE": (8, (0, 1, 2, 3, 4, 5)),
    "FULL_OPENCV": (12, (0, 1, 2, 3, 4, 5)),
    "FOV": (5, (0, 1, 2, 3, None, None)),
    "SIMPLE_RADIAL_FISHEYE": (4, (0, 0, 1, 2, 3, None)),
    "RADIAL_FISHEYE": (5, (0, 0, 1, 2, 3, 4)),
    "THIN_PRISM_FISHEYE": (12, (0, 1, 2, 3, 4, 5)),
}


def model_matrix(model: str, params: str) -> Column:
    """K of a camera model and its parameters; null for an unknown model."""
    out = None
    for name, (_, place) in CAMERA_MODELS.items():
        k = intrinsics_matrix(*(at(params, p) for p in place[:4]))
        out = F.when(F.col(model) == name, k) if out is None else out.when(F.col(model) == name, k)
    return out
