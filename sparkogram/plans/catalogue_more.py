"""More registered queries: camera geometry, tracks and links, reports, plots and evaluation.

Poses stand on embeddings (a quaternion and a translation each), as points, lines
and axis-angle vectors do; every query runs over its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkogram.functions import geometry as G
from sparkogram.functions import intrinsics as I
from sparkogram.operators import matching as M
from sparkogram.operators import observations as O
from sparkogram.operators import plots as V
from sparkogram.operators import poses as P
from sparkogram.operators import reports as R
from sparkogram.operators import tracks as T
from sparkogram.operators.focal import peak, rational, summarise
from sparkogram.plans import catalogue as C
from sparkogram.plans import dense, evaluation
from sparkogram.plans.catalogue import CLOUD, MUTUAL, OBS, TRACKS, cloud, longs, mutual, observations, query, rounded
from sparkogram.runtime import cut, table
from sparkogram.sources.images import file_digest, image_set_hash

#: Intrinsics of the stand-in cameras.
K = (900.0, 0.0, 320.0, 0.0, 905.0, 240.0, 0.0, 0.0, 1.0)
K1, K2 = -0.1, 0.01
XYZ = ("x", "y", "z")


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, label, R, t, K, the vector e and a point p per camera."""
    at = lambda i: F.col("embedding").getItem(i).cast("double")
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    e = e.select(
        F.col("vec_id").alias("image_id"), "label", F.col("embedding").cast("array<double>").alias("e"), F.array(*(at(i) for i in range(4))).alias("q"),
        F.array(*(at(i) for i in range(4, 7))).alias("t"), F.array(*(F.lit(x) for x in K)).alias("K"), F.array(2 * at(7), 2 * at(8), 2 * at(9) + 5).alias("p"),
    )
    return e.withColumn("R", G.quaternion_rotation("q"))


def _ROT(w: str = "w", x: str = "x", y: str = "y", z: str = "z") -> str:
    return (
        f"1 - 2 * ({y}*{y} + {z}*{z}) AS r0, 2 * ({x}*{y} - {w}*{z}) AS r1, 2 * ({x}*{z} + {w}*{y}) AS r2, 2 * ({x}*{y} + {w}*{z}) AS r3, "
        f"1 - 2 * ({x}*{x} + {z}*{z}) AS r4, 2 * ({y}*{z} - {w}*{x}) AS r5, 2 * ({x}*{z} - {w}*{y}) AS r6, 2 * ({y}*{z} + {w}*{x}) AS r7, 1 - 2 * ({x}*{x} + {y}*{y}) AS r8"
    )


_E = ", ".join(f"embedding[{i}]::DOUBLE AS e{i}" for i in range(1, 13))
VECTORS = f"v AS (SELECT vec_id AS image_id, label, {_E} FROM embeddings)"
POSE = f"""{VECTORS}, u AS (SELECT *, e1 / n AS w, e2 / n AS x, e3 / n AS y, e4 / n AS z FROM (SELECT *, sqrt(e1*e1 + e2*e2 + e3*e3 + e4*e4) AS n FROM v)
), r AS (SELECT image_id, label, e5 AS t0, e6 AS t1, e7 AS t2, 2 * e8 AS p0, 2 * e9 AS p1, 2 * e10 + 5 AS p2, e11, e12, {_ROT()} FROM u
), pose AS (SELECT *, -(r0*t0 + r3*t1 + r6*t2) AS cx, -(r1*t0 + r4*t1 + r7*t2) AS cy, -(r2*t0 + r5*t1 + r8*t2) AS cz FROM r)"""


def _xyz(column: str) -> list:
    return [F.col(column).getItem(i) for i in range(3)]


# ---- camera geometry -----------------------------------------------------------------------


@query(f"WITH {POSE} SELECT image_id, {', '.join(f'round(c{c}, 6) AS c{c}' for c in 'xyz')}, round(r6, 6) AS dx, round(r7, 6) AS dy, round(r8, 6) AS dz FROM pose")
def camera_centres(spark, sf_dir):
    """Camera centres and viewing directions."""
    p = poses(spark, sf_dir)
    cols = [c.alias(f"c{n}") for n, c in zip(XYZ, G.camera_centre("R", "t"), strict=True)] + [d.alias(f"d{n}") for n, d in zip(XYZ, G.viewing_direction("R"), strict=True)]
    return rounded(p.select("image_id", *cols))


@query(f"WITH {VECTORS}, r AS (SELECT image_id, {_ROT('e1', 'e2', 'e3', 'e4')} FROM v) SELECT image_id, {', '.join(f'round(r{i}, 6) AS r{i}' for i in range(9))} FROM r")
def raw_rotations(spark, sf_dir):
    """Rotation matrices of quaternions taken as they are."""
    r = G.quaternion_rotation("q", normalise=False)
    return rounded(poses(spark, sf_dir).select("image_id", *(r.getItem(i).alias(f"r{i}") for i in range(9))))


@query(f"""WITH {POSE} SELECT image_id, {', '.join(f'round({K[0]} * {a} + {K[2]} * {b}, 6) AS m{j}' for j, (a, b) in enumerate([('r0', 'r6'), ('r1', 'r7'), ('r2', 'r8'), ('t0', 't2')]))},
  {', '.join(f'round({K[4]} * {a} + {K[5]} * {b}, 6) AS m{j + 4}' for j, (a, b) in enumerate([('r3', 'r6'), ('r4', 'r7'), ('r5', 'r8'), ('t1', 't2')]))},
  {', '.join(f'round({a}, 6) AS m{j + 8}' for j, a in enumerate(['r6', 'r7', 'r8', 't2']))} FROM pose""")
def projection_matrices(spark, sf_dir):
    """K [R | t] of every camera."""
    m = G.projection_matrix("K", "R", "t")
    return rounded(poses(spark, sf_dir).select("image_id", *(m.getItem(i).alias(f"m{i}") for i in range(12))))


_CAM = "r0*p0 + r1*p1 + r2*p2 + t0 AS a, r3*p0 + r4*p1 + r5*p2 + t1 AS b, r6*p0 + r7*p1 + r8*p2 + t2 AS d"


@query(f"""WITH {POSE}, c AS (SELECT image_id, 320 + 100 * e11 AS u, 240 + 100 * e12 AS v, {_CAM} FROM pose
), s AS (SELECT *, CASE WHEN abs(d) > 1e-9 THEN d ELSE 1e-9 END AS z FROM c)
SELECT image_id, round(d, 6) AS depth, round(CASE WHEN d > 0 THEN sqrt((900 * a / z + 320 - u)**2 + (905 * b / z + 240 - v)**2) END, 5) AS err,
  round(CASE WHEN d > 0 THEN sqrt((900 * a / z + 320 - u)**2 + (900 * b / z + 240 - v)**2) END, 5) AS err_square FROM s""")
def reprojection_errors(spark, sf_dir):
    """Depths and reprojection errors with both conventions for the vertical focal length."""
    p = poses(spark, sf_dir).withColumns({"u": 320 + 100 * F.col("e").getItem(10), "v": 240 + 100 * F.col("e").getItem(11)})
    x = _xyz("p")
    err, square = (G.reprojection_error(x, "u", "v", "R", "t", "K", square_pixels=s) for s in (False, True))
    return p.select("image_id", F.round(G.to_camera(x, "R", "t")[2], 6).alias("depth"), F.round(err, 5).alias("err"), F.round(square, 5).alias("err_square"))


def _undistorted(rounds: int) -> str:
    x, y = "xd", "yd"
    out = []
    for i in range(rounds):
        out.append(f"s{i + 1} AS (SELECT image_id, xd, yd, xd / f AS x, yd / f AS y FROM (SELECT *, 1 + {K1} * ({x}*{x} + {y}*{y}) + {K2} * ({x}*{x} + {y}*{y})**2 AS f FROM s{i}))")
        x, y = "x", "y"
    return ", ".join(out)


@query(f"""WITH {VECTORS}, s0 AS (SELECT image_id, e1 * f AS xd, e2 * f AS yd FROM (SELECT *, 1 + {K1} * (e1*e1 + e2*e2) + {K2} * (e1*e1 + e2*e2)**2 AS f FROM v)), {_undistorted(5)}
SELECT image_id, round(xd, 6) AS xd, round(yd, 6) AS yd, round(x, 6) AS x, round(y, 6) AS y FROM s5""")
def distortions(spark, sf_dir):
    """Radial distortion and its inverse by fixed-point iteration."""
    e = poses(spark, sf_dir).select("image_id", F.col("e").getItem(0).alias("x"), F.col("e").getItem(1).alias("y"), F.lit(K1).alias("k1"), F.lit(K2).alias("k2"))
    xd, yd = G.distort(F.col("x"), F.col("y"), "k1", "k2")
    e = e.withColumns({"xd": xd, "yd": yd})
    x, y = G.undistort(F.col("xd"), F.col("yd"), "k1", "k2")
    return rounded(e.select("image_id", "xd", "yd", x.alias("x"), y.alias("y")))


@query(f"""WITH {VECTORS}, a AS (SELECT *, sqrt(e1*e1 + e2*e2 + e3*e3) AS th FROM v), k AS (SELECT *, e1 / greatest(th, 1e-10) AS kx, e2 / greatest(th, 1e-10) AS ky, e3 / greatest(th, 1e-10) AS kz FROM a
), d AS (SELECT *, kx*e4 + ky*e5 + kz*e6 AS dt FROM k)
SELECT image_id, round(e4 * cos(th) + (ky*e6 - kz*e5) * sin(th) + kx * dt * (1 - cos(th)), 6) AS x, round(e5 * cos(th) + (kz*e4 - kx*e6) * sin(th) + ky * dt * (1 - cos(th)), 6) AS y,
  round(e6 * cos(th) + (kx*e5 - ky*e4) * sin(th) + kz * dt * (1 - cos(th)), 6) AS z FROM d""")
def rotated_points(spark, sf_dir):
    """Axis-angle rotations of points."""
    e = poses(spark, sf_dir)
    got = G.rotate([F.col("e").getItem(i) for i in range(3)], [F.col("e").getItem(i) for i in range(3, 6)])
    return rounded(e.select("image_id", *(g.alias(c) for g, c in zip(got, XYZ, strict=True))))


@query(f"""WITH {POSE} SELECT a.image_id, round(degrees(acos(greatest(-1, least(1, (a.r0 + a.r4 + a.r8 - 1) / 2)))), 4) AS angle,
  round(degrees(acos(greatest(-1, least(1, ({' + '.join(f'a.r{i} * b.r{i}' for i in range(9))} - 1) / 2)))), 4) AS difference
FROM pose a JOIN pose b ON b.image_id = a.image_id + 1""")
def rotation_angles(spark, sf_dir):
    """Angles of rotations and between consecutive ones."""
    p = poses(spark, sf_dir).select("image_id", "R")
    nxt = p.select((F.col("image_id") - 1).alias("image_id"), F.col("R").alias("R2"))
    got = p.join(nxt, "image_id")
    return got.select("image_id", F.round(G.rotation_angle("R"), 4).alias("angle"), F.round(G.rotation_difference("R", "R2"), 4).alias("difference"))


@query(f"""WITH {POSE} SELECT image_id, round(1.5 * (r0*p0 + r1*p1 + r2*p2) + t0, 6) AS x, round(1.5 * (r3*p0 + r4*p1 + r5*p2) + t1, 6) AS y,
  round(1.5 * (r6*p0 + r7*p1 + r8*p2) + t2, 6) AS z FROM pose""")
def similarity_points(spark, sf_dir):
    """Points under a similarity transform."""
    got = G.similarity(_xyz("p"), F.lit(1.5), "R", "t")
    return rounded(poses(spark, sf_dir).select("image_id", *(g.alias(c) for g, c in zip(got, XYZ, strict=True))))


@query(f"""WITH {POSE}, two AS (SELECT a.image_id, a.p0, a.p1, a.p2, a.p0 - a.cx AS ax, a.p1 - a.cy AS ay, a.p2 - a.cz AS az, a.p0 - b.cx AS qx, a.p1 - b.cy AS qy, a.p2 - b.cz AS qz,
  a.r6*a.p0 + a.r7*a.p1 + a.r8*a.p2 + a.t2 AS z1, b.r6*a.p0 + b.r7*a.p1 + b.r8*a.p2 + b.t2 AS z2 FROM pose a JOIN pose b ON b.image_id = a.image_id + 1
), g AS (SELECT *, degrees(acos(greatest(-1, least(1, (ax*qx + ay*qy + az*qz) / (sqrt(ax*ax + ay*ay + az*az) * sqrt(qx*qx + qy*qy + qz*qz)))))) AS angle FROM two)
SELECT image_id, round(angle, 4) AS angle, z1 > 0 AND z2 > 0 AND angle >= 2 AS accepted FROM g""")
def accepted_points(spark, sf_dir):
    """Triangulation angles and the acceptance of points seen by two cameras."""
    p = poses(spark, sf_dir)
    b = p.select((F.col("image_id") - 1).alias("image_id"), F.col("R").alias("R2"), F.col("t").alias("t2"))
    j = p.join(b, "image_id")
    x = _xyz("p")
    angle = G.triangulation_angle(x, G.camera_centre("R", "t"), G.camera_centre("R2", "t2"))
    good = G.accept_point(G.to_camera(x, "R", "t")[2], G.to_camera(x, "R2", "t2")[2], angle, F.lit(1.0), F.lit(1.0))
    return j.select("image_id", F.round(angle, 4).alias("angle"), good.alias("accepted"))


@query("""WITH p AS (SELECT p_partkey AS image_id, p_retailprice AS fx, p_retailprice * 1.01 AS fy, CASE WHEN p_size % 2 = 0 THEN p_size * 10.0 END AS new_fx, CASE WHEN p_size % 3 = 0 THEN 0.125 END AS new_k1 FROM part)
SELECT image_id, round(coalesce(new_fx, fx), 6) AS fx, round(fy, 6) AS fy, 320.0::DOUBLE AS cx, 240.0::DOUBLE AS cy, round(coalesce(new_k1, 0.05), 6) AS k1, 0.0::DOUBLE AS k2, round(coalesce(new_fx, fx), 6) AS focal, 4::BIGINT AS n_dist FROM p""")
def intrinsics_updates(spark, sf_dir):
    """Intrinsics to a matrix and back, with the fields that an adjustment overrides."""
    p = table(spark, sf_dir, "part")
    price = F.col("p_retailprice")
    s = p.select(
        F.col("p_partkey").alias("image_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_size") * 10.0).alias("new_fx"), F.when(F.col("p_size") % 3 == 0, F.lit(0.125)).alias("new_k1"),
        F.struct(price.alias("fx"), (price * 1.01).alias("fy"), F.lit(320.0).alias("cx"), F.lit(240.0).alias("cy"), F.lit(0.05).alias("k1"), F.lit(0.0).alias("k2")).alias("camera"),
    )
    s = s.withColumn("camera", I.updated("camera", fx=F.col("new_fx"), k1=F.col("new_k1")))
    s = s.withColumns({"K": I.matrix("camera"), "dist": I.distortion("camera")}).withColumn("again", I.from_matrix("K", "dist"))
    focal = G.with_focal("K", F.col("again.fx")).getItem(4).alias("focal")
    return longs(rounded(s.select("image_id", *(f"again.{f}" for f in I.FIELDS), focal, F.size("dist").alias("n_dist"))))


@query("""WITH p AS (SELECT p_partkey AS image_id, p_partkey % 5 AS m, p_retailprice AS a, p_size * 1.0 AS b FROM part)
SELECT image_id, round(CASE WHEN m < 4 THEN a END, 6) AS fx, round(CASE m WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN a WHEN 3 THEN b END, 6) AS fy,
  CASE m WHEN 0 THEN b WHEN 1 THEN 320.0 WHEN 2 THEN b WHEN 3 THEN 320.0 END::DOUBLE AS cx, CASE m WHEN 0 THEN 320.0 WHEN 1 THEN 240.0 WHEN 2 THEN 320.0 WHEN 3 THEN 240.0 END::DOUBLE AS cy FROM p""")
def model_matrices(spark, sf_dir):
    """Camera models and their parameters to matrices; an unknown model has none."""
    names = F.array(*(F.lit(n) for n in ("SIMPLE_PINHOLE", "PINHOLE", "SIMPLE_RADIAL", "OPENCV", "NO_SUCH")))
    params = F.array(F.col("p_retailprice"), F.col("p_size").cast("double"), F.lit(320.0), F.lit(240.0), *(F.lit(0.0),) * 4)
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), names[(F.col("p_partkey") % 5).cast("int")].alias("model"), params.alias("params"))
    k = G.model_matrix("model", "params")
    return rounded(p.select("image_id", *(k.getItem(i).alias(n) for n, i in (("fx", 0), ("fy", 4), ("cx", 2), ("cy", 5)))))


@query(f"""WITH {VECTORS}, m AS (SELECT *, avg(e1) OVER w AS mx, avg(e2) OVER w AS my FROM v WINDOW w AS (PARTITION BY label)
), s AS (SELECT *, sqrt(2.0) / greatest(avg(sqrt((e1 - mx)**2 + (e2 - my)**2)) OVER (PARTITION BY label), 1e-12) AS s FROM m)
SELECT image_id, round((e1 - mx) * s, 6) AS nx, round((e2 - my) * s, 6) AS ny FROM s""")
def normalised_points(spark, sf_dir):
    """Points of each image moved to their centroid and scaled."""
    p = poses(spark, sf_dir).select("image_id", "label", F.col("e").getItem(0).alias("x"), F.col("e").getItem(1).alias("y"))
    return rounded(P.hartley(p, ["label"]).select("image_id", "nx", "ny"))


@query(f"""WITH {VECTORS}, b AS (SELECT image_id, e1, e2, e3, abs(e2) >= abs(e1) AS flat FROM v)
SELECT image_id, round(CASE WHEN flat THEN 0 ELSE -e3 / e1 END, 4)::DOUBLE AS x0, round(CASE WHEN flat THEN -e3 / e2 ELSE 0 END, 4)::DOUBLE AS y0,
  round(CASE WHEN flat THEN 640 ELSE -(e3 + e2 * 480) / e1 END, 4)::DOUBLE AS x1, round(CASE WHEN flat THEN -(e3 + e1 * 640) / e2 ELSE 480 END, 4)::DOUBLE AS y1 FROM b""")
def epipolar_borders(spark, sf_dir):
    """Where lines cross the border of an image."""
    got = R.epipolar_ends("e", 640.0, 480.0)
    return rounded(poses(spark, sf_dir).select("image_id", *(g.alias(n) for g, n in zip(got, ("x0", "y0", "x1", "y1"), strict=True))), 4)


@query("""WITH d AS (SELECT vec_id AS image_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS a FROM embeddings), s AS (SELECT image_id, a, greatest(list_sum(a), 1e-7) AS n FROM d)
SELECT image_id, round(sqrt(a[1] / n), 6) AS first, round(list_sum(list_transform(a, lambda x: x / n)), 6) AS total FROM s""")
def root_sift(spark, sf_dir):
    """Hellinger mapping of descriptors: the first value and the sum of squares."""
    e = poses(spark, sf_dir).withColumn("r", M.root_sift("e"))
    return rounded(e.select("image_id", F.col("r").getItem(0).alias("first"), F.aggregate("r", F.lit(0.0), lambda s, x: s + x * x).alias("total")))


@query(f"""WITH {POSE}, m AS (SELECT 1 - r6*r6 AS a, -r6*r7 AS b, -r6*r8 AS c, 1 - r7*r7 AS d, -r7*r8 AS e, 1 - r8*r8 AS f, cx, cy, cz FROM pose
), s AS (SELECT sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(d) AS d, sum(e) AS e, sum(f) AS f, sum(a*cx + b*cy + c*cz) AS u, sum(b*cx + d*cy + e*cz) AS v, sum(c*cx + e*cy + f*cz) AS w FROM m
), t AS (SELECT *, a * (d*f - e*e) - b * (b*f - c*e) + c * (b*e - c*d) AS det FROM s)
SELECT round((u * (d*f - e*e) - b * (v*f - e*w) + c * (v*e - d*w)) / det, 6) AS x, round((a * (v*f - e*w) - u * (b*f - c*e) + c * (b*w - v*c)) / det, 6) AS y,
  round((a * (d*w - v*e) - b * (b*w - v*c) + u * (b*e - c*d)) / det, 6) AS z FROM t""")
def scene_centre(spark, sf_dir):
    """The point closest to all viewing axes."""
    p = poses(spark, sf_dir)
    cams = p.select("image_id", *(c.alias(f"c{n}") for n, c in zip(XYZ, G.camera_centre("R", "t"), strict=True)), *(d.alias(f"d{n}") for n, d in zip(XYZ, G.viewing_direction("R"), strict=True)))
    return rounded(spark.createDataFrame([tuple(P.axes_centre(cams))], "x double, y double, z double"))


@query(f"""WITH {POSE} SELECT image_id::VARCHAR AS key, 0.0::DOUBLE AS position_error, 0.0::DOUBLE AS rotation_error FROM pose""")
def pose_errors(spark, sf_dir):
    """Poses against the same poses in another frame and scale: the alignment leaves no error."""
    p = poses(spark, sf_dir)
    c = G.camera_centre("R", "t")
    true = p.select(F.concat(F.col("image_id"), F.lit(".jpg.txt")).alias("image_name"), "R", *(x.alias(f"c{n}") for n, x in zip(XYZ, c, strict=True)))
    turn = F.array(*(F.lit(x) for x in (0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)))
    moved = [-2 * F.col("cy") + 1, 2 * F.col("cx") - 3, 2 * F.col("cz") + 5]  # s Q c + shift
    est = true.withColumn("Q", turn).select(F.concat(F.split("image_name", r"\.").getItem(0), F.lit(".png")).alias("image_name"), G.matmul("R", "Q", transpose_b=True).alias("R"), *(m.alias(f"c{n}") for n, m in zip(XYZ, moved, strict=True)))
    got = P.pose_errors(cut(est, "estimate"), cut(true, "truth"))
    return got.select("key", (F.round("position_error", 6) + 0.0).alias("position_error"), F.when(F.col("rotation_error") < 1e-4, 0.0).otherwise(F.col("rotation_error")).alias("rotation_error"))


@query(f"""WITH {POSE}, c AS (SELECT vec_id AS pid, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE + 5 AS z FROM embeddings
), s AS (SELECT pid, x, y, z, r0*x + r1*y + r2*z + t0 AS a, r3*x + r4*y + r5*z + t1 AS b, r6*x + r7*y + r8*z + t2 AS d FROM c, pose
), n AS (SELECT pid, count(*) AS n FROM s WHERE d > 0.01 AND 900 * a / d + 320 BETWEEN 0 AND 639.9999999 AND 905 * b / d + 240 BETWEEN 0 AND 479.9999999 GROUP BY 1)
SELECT pid, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM c JOIN n USING (pid) WHERE n >= 20""")
def depth_consistent(spark, sf_dir):
    """Points that project into at least twenty images."""
    c = cloud(spark, sf_dir).select("pid", "x", "y", (F.col("z") + 5).alias("z"))
    return rounded(dense.depth_consistent(c, poses(spark, sf_dir), 20))


@query(f"""WITH {CLOUD}, m AS (SELECT quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my, quantile_cont(z, 0.5) AS mz FROM cloud
), d AS (SELECT quantile_cont(sqrt((x - mx)**2 + (y - my)**2 + (z - mz)**2), 0.98) AS q FROM cloud, m), far AS (SELECT pid, x * (1 + pid % 9) AS x, y * (1 + pid % 9) AS y, z * (1 + pid % 9) AS z FROM cloud)
SELECT pid, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM far, m, d WHERE sqrt((x - mx)**2 + (y - my)**2 + (z - mz)**2) <= 3 * q""")
def scene_filter(spark, sf_dir):
    """Dense points near the sparse cloud."""
    c = cloud(spark, sf_dir)
    far = c.select("pid", *((F.col(a) * (1 + F.col("pid") % 9)).alias(a) for a in XYZ))
    return rounded(dense.scene_filter(far, c))


@query(f"WITH {VECTORS} SELECT image_id, e1 * 100 > 0.5 AND e2 * 10 > 0 AND e2 * 10 < 1e6 AND e3 > 0.01 AS valid FROM v")
def valid_disparities(spark, sf_dir):
    """The validity mask of disparities and depths."""
    e = poses(spark, sf_dir).select("image_id", (F.col("e").getItem(0) * 100).alias("d"), (F.col("e").getItem(1) * 10).alias("z"), F.col("e").getItem(2).alias("depth"))
    return e.select("image_id", dense.valid_disparity("d", 0.0, "z", "depth").alias("valid"))


# ---- matches, tracks, links ----------------------------------------------------------------

SYM = f"""{TRACKS}, sym AS (SELECT img_i AS image_id, img_j AS other_id, kp_i AS kp, kp_j AS other_kp, ord FROM m UNION ALL SELECT img_j, img_i, kp_j, kp_i, ord FROM m
), links AS (SELECT image_id, kp_id AS kp, track_id AS point_id FROM tr WHERE kp_id % 2 = 0)"""


def _tracks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Matches, their symmetric view, tracks, and links of every second keypoint."""
    m = cut(mutual(spark, sf_dir), "matches")
    t = cut(T.clean_tracks(T.match_components(m)), "tracks")
    links = t.where("kp_id % 2 = 0").select("image_id", F.col("kp_id").alias("kp"), F.col("track_id").alias("point_id"))
    return m, M.symmetric(m), t, links


@query(f"""WITH RECURSIVE {SYM}, free AS (SELECT s.* FROM sym s ANTI JOIN links l ON l.image_id = s.image_id AND l.kp = s.kp
), cand AS (SELECT f.image_id, f.kp, f.other_id, f.ord, l.point_id FROM free f JOIN links l ON l.image_id = f.other_id AND l.kp = f.other_kp
  WHERE NOT EXISTS (SELECT 1 FROM links o WHERE o.image_id = f.image_id AND o.point_id = l.point_id)
), a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, kp ORDER BY other_id, ord, point_id) AS a FROM cand) WHERE a = 1
), b AS (SELECT *, row_number() OVER (PARTITION BY image_id, point_id ORDER BY other_id, ord, kp) AS b FROM a) SELECT image_id, kp, point_id FROM b WHERE b = 1""")
def completions(spark, sf_dir):
    """Observations that matches with one linked end could add."""
    _, sym, _, links = _tracks(spark, sf_dir)
    return longs(O.completion_candidates(sym, links, links))


@query(f"""WITH RECURSIVE {SYM}, v AS (SELECT track_id, point_id, count(*) AS n FROM tr JOIN links ON links.image_id = tr.image_id AND links.kp = tr.kp_id GROUP BY 1, 2
), k AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY n DESC, point_id) AS k FROM v) SELECT track_id, point_id, n FROM k WHERE k = 1""")
def track_votes(spark, sf_dir):
    """The point that most members of a track are linked to."""
    _, _, t, links = _tracks(spark, sf_dir)
    return longs(O.track_votes(t, links))


@query(f"""WITH RECURSIVE {SYM}, l2 AS (SELECT image_id, kp_id AS kp, kp_id % 7 AS point_id FROM tr)
SELECT DISTINCT least(a.point_id, b.point_id)::BIGINT AS p, greatest(a.point_id, b.point_id)::BIGINT AS q FROM sym s JOIN l2 a ON a.image_id = s.image_id AND a.kp = s.kp
JOIN l2 b ON b.image_id = s.other_id AND b.kp = s.other_kp WHERE a.point_id <> b.point_id""")
def merge_candidates(spark, sf_dir):
    """Point pairs whose keypoints are matched with each other."""
    _, sym, t, _ = _tracks(spark, sf_dir)
    return longs(O.merge_candidates(sym, t.select("image_id", F.col("kp_id").alias("kp"), (F.col("kp_id") % 7).alias("point_id"))))


@query(f"""WITH RECURSIVE {SYM} SELECT kp.image_id, kp.kp_id, coalesce(tr.track_id, -1) AS track_id FROM kp LEFT JOIN tr USING (image_id, kp_id)""")
def track_lookup(spark, sf_dir):
    """The track of every keypoint, -1 without one."""
    _, _, t, _ = _tracks(spark, sf_dir)
    kp = C.keypoints(spark, sf_dir).select("image_id", "kp_id")
    return longs(T.track_of(t, kp).select("image_id", "kp_id", F.coalesce("track_id", F.lit(-1)).alias("track_id")))


@query(f"""WITH RECURSIVE {SYM} SELECT track_id, image_id, kp_id FROM tr WHERE image_id < 5""")
def track_members(spark, sf_dir):
    """Track members inside a set of images (those registered)."""
    _, _, t, _ = _tracks(spark, sf_dir)
    images = t.select("image_id").where("image_id < 5")
    return longs(T.track_members(t, images).select("track_id", "image_id", "kp_id"))


@query(f"""WITH RECURSIVE {SYM}, o AS (SELECT s.image_id, l.point_id, s.kp, row_number() OVER (PARTITION BY s.image_id, l.point_id ORDER BY s.other_id, s.ord, s.kp) AS k
  FROM sym s JOIN links l ON l.image_id = s.other_id AND l.kp = s.other_kp WHERE s.image_id >= 5 AND s.other_id < 5) SELECT image_id, point_id, kp FROM o WHERE k = 1""")
def correspondences(spark, sf_dir):
    """2-D to 3-D correspondences of unregistered images."""
    _, sym, _, links = _tracks(spark, sf_dir)
    registered = links.select("image_id").where("image_id < 5")
    return longs(O.correspondences(sym, links, registered))


@query(f"""WITH {MUTUAL} SELECT fwd.img_i, fwd.img_j, fwd.kp_i, fwd.kp_j, m.kp_i IS NOT NULL AS inlier FROM fwd LEFT JOIN m ON m.img_i = fwd.img_i AND m.img_j = fwd.img_j AND m.kp_i = fwd.kp_i AND m.kp_j = fwd.kp_j""")
def inlier_flags(spark, sf_dir):
    """One-sided matches with a flag whether both sides agree."""
    kp = C.keypoints(spark, sf_dir)
    raw = M.match_pairs(kp, M.all_pairs(kp), C.RATIO, cross_check=False)
    return longs(R.inlier_flags(raw.select("img_i", "img_j", "kp_i", "kp_j"), mutual(spark, sf_dir)))


@query(f"""WITH {MUTUAL}, c AS (SELECT img_i, img_j, count(*) AS n FROM m GROUP BY 1, 2 HAVING count(*) >= 5), deg AS (SELECT i, count(*) AS n FROM (SELECT img_i AS i FROM c UNION ALL SELECT img_j FROM c) GROUP BY 1)
SELECT s.label::BIGINT AS image_id, coalesce(deg.n, 0) AS degree, deg.n IS NULL AS isolated FROM (SELECT DISTINCT label FROM embeddings) s LEFT JOIN deg ON deg.i = s.label""")
def graph_nodes(spark, sf_dir):
    """Degrees and isolated images of the match graph."""
    c = M.pair_counts(mutual(spark, sf_dir)).where("n_matches >= 5")
    return longs(V.graph_nodes(C.keypoints(spark, sf_dir), c))


@query(f"""WITH {MUTUAL}, c AS (SELECT img_i, img_j, count(*) AS n FROM m GROUP BY 1, 2) SELECT img_i, img_j, n AS n_inliers, round(0.5 + 4.5 * n / max(n) OVER (), 6) AS width FROM c""")
def graph_edges(spark, sf_dir):
    """Edges of the match graph with their line widths."""
    c = cut(M.pair_counts(mutual(spark, sf_dir)).withColumnRenamed("n_matches", "n_inliers"), "edges")
    return longs(rounded(V.graph_edges(c)))


@query(f"""WITH RECURSIVE {MUTUAL}, c AS (SELECT img_i, img_j, count(*) AS n FROM m GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, img_i, img_j) AS k FROM c
), walk AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS used, []::BIGINT[] AS chosen UNION ALL
  SELECT k.k, CASE WHEN ok THEN list_concat(used, [k.img_i::BIGINT, k.img_j::BIGINT]) ELSE used END, CASE WHEN ok THEN list_append(chosen, k.k) ELSE chosen END
  FROM (SELECT walk.r, walk.used, walk.chosen, k.k, k.img_i, k.img_j, len(chosen) < 6 AND len(list_filter(used, lambda x: x = k.img_i)) < 2 AND len(list_filter(used, lambda x: x = k.img_j)) < 2 AS ok
    FROM walk JOIN k ON k.k = walk.r + 1) k
), last AS (SELECT chosen FROM walk ORDER BY r DESC LIMIT 1)
SELECT img_i, img_j, n AS n_matches, k AS rank FROM k, last WHERE list_contains(chosen, k)""")
def greedy_pairs_le2(spark, sf_dir):
    """At most two pairs per image, in rank order."""
    return R.greedy_pairs(C.ranked_pairs(spark, sf_dir), 6, 2)


@query("""WITH o AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT c_custkey, c_nationkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 3 = 0)
SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey, round(c_acctbal, 6) AS c_acctbal FROM o WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT c_custkey, c_nationkey, round(c_acctbal, 6) FROM n""")
def upserted(spark, sf_dir):
    """New rows replace old ones with the same key."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal")
    new = c.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    return longs(rounded(O.upsert(c.where("c_custkey % 2 = 0"), new, ["c_custkey"])))


@query("""SELECT c_custkey, round(c_acctbal + CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1 END, 6) AS c_acctbal FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""")
def inserted(spark, sf_dir):
    """New rows come in only where their key is absent."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    new = c.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    return rounded(O.insert_absent(c.where("c_custkey % 2 = 0"), new, ["c_custkey"]))


@query(f"""WITH {OBS}, e AS (SELECT abs(x - 25) AS err FROM obs) SELECT round(least(10, greatest(0.5, 1.4826 * quantile_cont(err, 0.5))), 6) AS scale FROM e""")
def robust_scale(spark, sf_dir):
    """The scale of a robust loss from the median deviation."""
    return rounded(O.robust_scale(observations(spark, sf_dir).select(F.abs(F.col("x") - 25).alias("err"))))


# ---- focal lengths, text, hashes -----------------------------------------------------------


@query(f"SELECT source, count(*) AS n FROM ({C.ORACLE_SQL['focal_length_routes']}) GROUP BY 1")
def focal_sources(spark, sf_dir):
    """Images by the route of their focal length."""
    return summarise(C.focal_length_routes(spark, sf_dir))


@query(f"SELECT image_id, CASE WHEN source <> 'guess' THEN focal_px END AS focal_px FROM ({C.ORACLE_SQL['focal_length_routes']})")
def exif_focal_px(spark, sf_dir):
    """Focal lengths that EXIF gives, in pixels."""
    return I.focal_px(C.focal_length_routes(spark, sf_dir))


@query("""WITH p AS (SELECT p_partkey AS image_id, p_partkey % 3 = 0 AS own, p_retailprice AS f FROM part)
SELECT image_id, round(CASE WHEN own THEN f ELSE 900 END, 6)::DOUBLE AS fx, CASE WHEN own THEN 0.25 ELSE -0.1 END::DOUBLE AS k1 FROM p""")
def camera_settings(spark, sf_dir):
    """Own intrinsics where an image has some, else the shared ones."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), "p_retailprice")
    own = p.where("image_id % 3 = 0").select("image_id", G.intrinsics_matrix(F.col("p_retailprice"), F.col("p_retailprice"), F.lit(1.0), F.lit(1.0)).alias("K"), F.array(F.lit(0.25), F.lit(0.0)).alias("dist"))
    got = I.per_camera(p, own, list(K), [K1, K2])
    return rounded(got.select("image_id", F.col("K").getItem(0).alias("fx"), F.col("dist").getItem(0).alias("k1")))


@query("""WITH c AS (SELECT p_size::DOUBLE AS factor, count(*) AS accepted FROM part GROUP BY 1), w AS (SELECT *, lag(factor) OVER o AS x0, lag(accepted) OVER o AS y0, lead(factor) OVER o AS x2, lead(accepted) OVER o AS y2 FROM c WINDOW o AS (ORDER BY factor)
), b AS (SELECT *, y0 - 2 * accepted + y2 AS bend FROM w ORDER BY accepted DESC, factor LIMIT 1), v AS (SELECT *, factor + 0.5 * (y0 - y2) / bend * (x2 - x0) / 2 AS vertex FROM b)
SELECT factor, accepted, round(CASE WHEN bend < -1e-9 AND vertex > x0 AND vertex < x2 THEN vertex ELSE factor END, 6) AS refined FROM v""")
def focal_peak(spark, sf_dir):
    """The refined maximum of a curve."""
    c = table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("double").alias("factor")).agg(F.count("*").alias("accepted"))
    return rounded(peak(c))


@query("""WITH p AS (SELECT p_partkey AS image_id, CASE WHEN p_size % 7 = 0 THEN 'x,' || p_size ELSE p_size || ', ' || (p_partkey + 1) || ',320,240' END AS t FROM part)
SELECT image_id, CASE WHEN NOT contains(t, 'x') THEN string_split(t, ',')[1]::DOUBLE END AS fx, CASE WHEN NOT contains(t, 'x') THEN trim(string_split(t, ',')[2])::DOUBLE END AS fy FROM p""")
def parsed_intrinsics(spark, sf_dir):
    """Intrinsics given as text; malformed ones are null."""
    good = F.concat(F.col("p_size"), F.lit(", "), F.col("p_partkey") + 1, F.lit(",320,240"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("x,"), F.col("p_size"))).otherwise(good).alias("t"))
    return p.withColumn("k", I.parse_intrinsics("t")).select("image_id", "k.fx", "k.fy")


@query("""SELECT p_partkey AS image_id, CASE WHEN p_partkey % 4 <> 0 THEN round(p_size::DOUBLE / (p_partkey % 4), 6) END AS value FROM part""")
def rational_numbers(spark, sf_dir):
    """EXIF rationals; a zero denominator is null."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), F.concat_ws("/", "p_size", F.col("p_partkey") % 4).alias("t"))
    return rounded(p.select("image_id", rational("t").alias("value")))


@query("SELECT o_orderkey AS id, translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS text FROM orders")
def german_numbers(spark, sf_dir):
    """Numbers in German notation."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), R.german("o_totalprice", 2).alias("text"))


@query("SELECT p_partkey AS id, string_split(p_brand || '.' || p_size || '.jpg', '.')[1] AS key FROM part")
def image_keys(spark, sf_dir):
    """Image names up to their first dot."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(".", "p_brand", "p_size", F.lit("jpg")).alias("name"))
    return p.select("id", P.image_key("name").alias("key"))


@query("""SELECT c_custkey AS id, '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","none":null}' AS document FROM customer""")
def documents_of_rows(spark, sf_dir):
    """Rows as JSON documents."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").withColumn("none", F.lit(None).cast("int"))
    return c.select(F.col("c_custkey").alias("id"), I.as_document("c_custkey", "c_mktsegment", "none").alias("document"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    p = table(spark, sf_dir, "pages")
    return p.select(F.concat(F.lit("/f/"), F.col("page_id")).alias("path"), F.col("page_id").cast("string").alias("image_name"), F.octet_length(html).cast("long").alias("length"), html.cast("binary").alias("content"))


@query("SELECT '/f/' || page_id AS path, sha256(coalesce(html, '')) AS sha256 FROM pages")
def file_digests(spark, sf_dir):
    """Digests of file contents."""
    return file_digest(_files(spark, sf_dir))


@query("SELECT substr(md5(string_agg(k, chr(10) ORDER BY k)), 1, 16) AS hash FROM (SELECT page_id || ':' || strlen(coalesce(html, '')) || ':' || md5(coalesce(html, '')) AS k FROM pages)")
def set_hash(spark, sf_dir):
    """One hash over names, sizes and contents of a set of files."""
    return spark.createDataFrame([(image_set_hash(_files(spark, sf_dir)),)], "hash string")


# ---- reports, plots, evaluation ------------------------------------------------------------


@query("""SELECT count(*) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(sqrt(avg(v * v)), 6) AS rms, round(quantile_cont(v, 0.95), 6) AS p95, round(max(v), 6) AS max,
  round(avg(v) / 2, 6) AS mean_spacings, round(quantile_cont(v, 0.5) / 2, 6) AS median_spacings, round(sqrt(avg(v * v)) / 2, 6) AS rms_spacings, round(quantile_cont(v, 0.95) / 2, 6) AS p95_spacings, round(max(v) / 2, 6) AS max_spacings
FROM (SELECT abs(value) AS v FROM events WHERE value IS NOT NULL)""")
def distance_summary(spark, sf_dir):
    """Distances summarised, also in units of the spacing."""
    return rounded(R.distance_summary(table(spark, sf_dir, "events").select(F.abs("value").alias("v")), "v", 2.0))


@query("""WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
SELECT count(*) AS n_images, sum(n)::BIGINT AS total, round(avg(n), 6) AS mean, min(n) AS min, max(n) AS max, sum((n < 50)::INT)::BIGINT AS n_few FROM n""")
def keypoint_statistics(spark, sf_dir):
    """Keypoints per image summarised."""
    return rounded(R.keypoint_statistics(C.keypoints(spark, sf_dir), 50))


@query("""SELECT c_name AS name, c_nationkey::BIGINT AS n_images, c_nationkey * (c_nationkey - 1) // 2 AS n_pairs, CASE WHEN c_nationkey * (c_nationkey - 1) <> 0 THEN round(c_acctbal / (c_nationkey * (c_nationkey - 1) / 2), 6) END AS s_per_pair,
  CASE WHEN c_nationkey <> 0 THEN round(c_acctbal * 2 / c_nationkey, 6) END AS s_per_image FROM customer""")
def scaling(spark, sf_dir):
    """Pairs, seconds per pair and per image of runs."""
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("n_images"), F.col("c_acctbal").alias("matching_s"), (F.col("c_acctbal") * 2).alias("total_s"))
    return rounded(R.scaling(c))


@query("""SELECT c_name AS name, stage, round(seconds, 6) AS seconds FROM (SELECT c_name, 'match' AS stage, c_acctbal AS seconds FROM customer UNION ALL SELECT c_name, 'adjust', c_acctbal / 2 FROM customer)""")
def stage_times(spark, sf_dir):
    """Stage times of runs, a row each."""
    m = F.create_map(F.lit("match"), F.col("c_acctbal"), F.lit("adjust"), F.col("c_acctbal") / 2)
    return rounded(R.stage_times(table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), m.alias("stages"))))


_VERDICT = """v AS (SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 'FAIL' WHEN o_orderstatus = 'F' THEN CASE WHEN o_custkey % 2 = 0 THEN 'PASS' ELSE 'FAIL' END
  WHEN o_custkey % 2 = 0 THEN 'FAIL' WHEN o_orderpriority LIKE '%HIGH%' THEN 'PASS' ELSE 'WEAK' END AS verdict FROM orders)"""


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_custkey") % 7 != 0, (F.col("o_custkey") % 2).cast("int")).alias("code"), F.col("o_orderpriority").alias("output"),
        F.when(F.col("o_orderstatus") == "F", "ok").otherwise("error").alias("expect"), F.array(F.lit("high")).alias("keywords"),
    )
    return o.select("o_orderkey", evaluation.verdict("code", "output", "expect", "keywords").alias("verdict"))


@query(f"WITH {_VERDICT} SELECT o_orderkey, verdict FROM v")
def run_verdicts(spark, sf_dir):
    """Verdicts on runs with degenerate inputs."""
    return _verdicts(spark, sf_dir)


@query(f"WITH {_VERDICT} SELECT verdict, count(*) AS n FROM v GROUP BY 1")
def verdict_counts(spark, sf_dir):
    """Runs by verdict."""
    return R.verdicts(_verdicts(spark, sf_dir))


@query("SELECT CASE WHEN count(*) FILTER (l_linenumber = 7) > 0 THEN 'FAIL' WHEN count(*) FILTER (l_linenumber = 6) > 0 THEN 'WARN' ELSE 'PASS' END AS verdict FROM lineitem")
def worst_verdict(spark, sf_dir):
    """The worst level of all checks."""
    level = F.when(F.col("l_linenumber") == 7, "FAIL").when(F.col("l_linenumber") == 6, "WARN").otherwise("PASS")
    return R.roll_up(table(spark, sf_dir, "lineitem").select(level.alias("level")))


@query("""SELECT o_orderpriority AS artefact, count(DISTINCT o_custkey % 5) AS n_runs, count(DISTINCT md5(o_orderstatus)) AS n_versions, count(DISTINCT md5(o_orderstatus)) = 1 AS reproducible FROM orders GROUP BY 1""")
def identical_outputs(spark, sf_dir):
    """Artefacts that all runs wrote byte by byte alike."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("artefact"), (F.col("o_custkey") % 5).alias("run"), F.md5("o_orderstatus").alias("sha256"))
    return evaluation.identical(o)


@query("""SELECT c_name AS name, stage, n_faces FROM (SELECT c_name, 'raw' AS stage, c_custkey AS n_faces FROM customer UNION ALL SELECT c_name, 'clean', c_custkey - 1 FROM customer)""")
def stage_counts(spark, sf_dir):
    """Face counts per cleaning stage."""
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("raw"), (F.col("c_custkey") - 1).alias("clean"))
    return R.unpivot_stages(c, "name", ["raw", "clean"])


@query("""WITH q AS (SELECT min(o_totalprice) AS lo, quantile_cont(o_totalprice, 0.99) AS hi, avg(o_totalprice) AS mean, stddev_pop(o_totalprice) / avg(o_totalprice) AS variation FROM orders
), b AS (SELECT least(39, floor((least(o_totalprice, hi) - lo) / ((hi - lo) / 40)))::BIGINT AS bin, lo, hi, mean, variation FROM orders, q)
SELECT 'area' AS quantity, bin, round(max(lo + bin * ((hi - lo) / 40)), 4) AS low, count(*) AS n, round(max(mean), 4) AS mean, round(max(variation), 4) AS variation FROM b GROUP BY 2""")
def clipped_histograms(spark, sf_dir):
    """A histogram clipped at the 99th percentile."""
    o = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("area"))
    return longs(rounded(V.face_histograms(o, ("area",)), 4))


@query(f"""WITH {CLOUD} SELECT {', '.join(f'round(min({c}), 6) AS min_{c}, round(max({c}), 6) AS max_{c}, round(max({c}) - min({c}), 6) AS extent_{c}' for c in 'xyz')} FROM cloud""")
def bounding_box(spark, sf_dir):
    """Corners and extent of a cloud."""
    return rounded(V.bounding_box(cloud(spark, sf_dir)))


@query(f"""WITH {POSE} SELECT image_id, {', '.join(f'round(c{c}, 6) AS c{c}' for c in 'xyz')}, {', '.join(f'round(c{c} + r{3 * a + i}, 6) AS {x}{c}' for a, x in enumerate('xyz') for i, c in enumerate('xyz'))} FROM pose""")
def camera_axes(spark, sf_dir):
    """Centres and axes of cameras."""
    p = poses(spark, sf_dir)
    p = p.select("image_id", "R", *(c.alias(f"c{n}") for n, c in zip(XYZ, G.camera_centre("R", "t"), strict=True)))
    return rounded(V.camera_axes(p))


@query("SELECT image_id FROM (SELECT DISTINCT vec_id AS image_id FROM embeddings) ORDER BY md5(concat_ws(':', image_id, 42)), image_id LIMIT 40")
def sampled_images(spark, sf_dir):
    """A seeded sample of images (a sampling operator)."""
    return V.sampled_images(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id")), 40)


@query("""WITH i AS (SELECT DISTINCT label::BIGINT AS i FROM embeddings) SELECT a.i AS img_i, b.i AS img_j FROM i a JOIN i b ON a.i < b.i ORDER BY md5(concat_ws(':', a.i, b.i, 42)), a.i, b.i LIMIT 12""")
def sampled_pairs(spark, sf_dir):
    """A seeded sample of image pairs (a sampling operator)."""
    return longs(V.sampled_pairs(M.all_pairs(C.keypoints(spark, sf_dir)), 12))


@query("""WITH n AS (SELECT least(n, 30) AS n_observers, err FROM (SELECT point_id, count(DISTINCT image_id) AS n, avg(err) AS err FROM (SELECT l_partkey AS point_id, l_suppkey AS image_id, abs(l_discount) AS err FROM lineitem) GROUP BY 1))
SELECT n_observers, count(*) AS n_points, round(avg(err), 6) AS mean_error FROM n GROUP BY 1""")
def point_histories(spark, sf_dir):
    """Points and their mean error by how many images see them."""
    obs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("point_id"), F.col("l_suppkey").alias("image_id"), F.abs("l_discount").alias("err"))
    return rounded(V.lifecycle(obs, 30))


@query("""WITH s AS (SELECT o_custkey AS step, count(*) AS n_new FROM orders GROUP BY 1) SELECT step, step AS image_id, n_new, sum(n_new) OVER (ORDER BY step)::BIGINT AS n_points, row_number() OVER (ORDER BY step) AS n_cameras FROM s""")
def registration_steps(spark, sf_dir):
    """What every registration added, and the totals after it."""
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("step")).agg(F.count("*").alias("n_new")).withColumn("image_id", F.col("step"))
    return V.registration_steps(s)


@query("""SELECT DISTINCT * FROM (SELECT l_suppkey AS img_i, l_partkey AS img_j FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT l_suppkey, l_partkey FROM lineitem WHERE l_linenumber = 2)""")
def united_pairs(spark, sf_dir):
    """Candidate pairs of two sources, each once."""
    of = lambda n: table(spark, sf_dir, "lineitem").where(F.col("l_linenumber") == n).select(F.col("l_suppkey").alias("img_i"), F.col("l_partkey").alias("img_j"))
    return of(1).unionByName(of(2)).distinct()


@query("SELECT pid, x, y, z FROM (SELECT vec_id AS pid, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y, round(embedding[3]::DOUBLE, 6) AS z FROM embeddings) t UNION ALL SELECT vec_id, round(embedding[2]::DOUBLE, 6), round(embedding[3]::DOUBLE, 6), round(embedding[4]::DOUBLE, 6) FROM embeddings")
def united_clouds(spark, sf_dir):
    """All points of several clouds."""
    at = lambda i: F.col("embedding").getItem(i).cast("double")
    of = lambda k: table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), at(k).alias("x"), at(k + 1).alias("y"), at(k + 2).alias("z"))
    return rounded(of(0).unionByName(of(1)))
