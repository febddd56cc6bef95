"""Triangle meshes as tables: vertices (vid, x, y, z, ...), faces (fid, a, b, c)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkogram.operators.components import connected_components
from sparkogram.operators.quantiles import quantile
from sparkogram.runtime import cut

XYZ = ("x", "y", "z")
_SIDES_SQL = "array(named_struct('p', a, 'q', b), named_struct('p', b, 'q', c), named_struct('p', c, 'q', a))"


def edges(faces: DataFrame) -> DataFrame:
    """Undirected edges (fid, u, v) with u < v, three per face."""
    e = faces.select("fid", F.explode(F.expr(_SIDES_SQL)).alias("e"))
    return e.select("fid", F.least("e.p", "e.q").alias("u"), F.greatest("e.p", "e.q").alias("v"))


def edge_topology(faces: DataFrame) -> DataFrame:
    """One row: vertices in use, edges, faces, boundary and non-manifold edges, Euler characteristic."""
    counts = edges(faces).groupBy("u", "v").agg(F.count("*").alias("n"))
    e = counts.agg(
        F.count("*").alias("n_edges"),
        F.coalesce(F.sum((F.col("n") == 1).cast("long")), F.lit(0)).alias("n_boundary"),
        F.coalesce(F.sum((F.col("n") > 2).cast("long")), F.lit(0)).alias("n_nonmanifold"),
    )
    used = faces.select(F.explode(F.array("a", "b", "c")).alias("vid")).agg(F.countDistinct("vid").alias("n_vertices"))
    out = e.join(used).join(faces.agg(F.count("*").alias("n_faces")))  # one row each
    return out.withColumn("euler", F.col("n_vertices") - F.col("n_edges") + F.col("n_faces"))


def orientable(faces: DataFrame) -> DataFrame:
    """One row: does every directed edge occur once?"""
    d = faces.select(F.explode(F.expr(_SIDES_SQL)).alias("e"))
    n = d.groupBy("e.p", "e.q").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(1)).alias("m"))
    return n.select((F.col("m") == 1).alias("oriented"))


def genus(topology: DataFrame, oriented: DataFrame) -> DataFrame:
    """Genus of watertight, manifold, oriented meshes, else null."""
    good = (F.col("n_boundary") == 0) & (F.col("n_nonmanifold") == 0) & F.col("oriented")
    return topology.join(oriented).select(F.when(good, F.floor((2 - F.col("euler")) / 2)).alias("genus"))


def corners(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces with the coordinates of their corners: ax ... cz."""
    out = faces
    for k in "abc":
        v = vertices.select(F.col("vid").alias(k), *(F.col(c).alias(f"{k}{c}") for c in XYZ))
        out = out.join(v, k)
    return out


def _length(p: str, q: str) -> F.Column:
    return F.sqrt(sum((F.col(f"{p}{c}") - F.col(f"{q}{c}")) ** 2 for c in XYZ))


def triangle_measures(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(fid, ab, bc, ca, area, aspect): aspect = circumradius / (2 * inradius), null for degenerate faces."""
    c = corners(faces, vertices)
    d = {f"{k}{x}": F.col(f"{k}{x}") - F.col(f"a{x}") for k in "bc" for x in XYZ}
    cross = [d["by"] * d["cz"] - d["bz"] * d["cy"], d["bz"] * d["cx"] - d["bx"] * d["cz"], d["bx"] * d["cy"] - d["by"] * d["cx"]]
    c = c.select(
        "fid", _length("a", "b").alias("ab"), _length("b", "c").alias("bc"), _length("c", "a").alias("ca"), (0.5 * F.sqrt(sum(x * x for x in cross))).alias("area")
    )
    s, p = F.col("ab") + F.col("bc") + F.col("ca"), F.col("ab") * F.col("bc") * F.col("ca")
    # R = abc / 4A and r = 2A / (a + b + c)
    return c.withColumn("aspect", F.when(F.col("area") > 1e-20, p * s / (16 * F.col("area") * F.col("area"))))


def triangle_quality(faces: DataFrame, vertices: DataFrame, sliver: float = 10.0) -> DataFrame:
    """One row: edge length figures, area, aspect, slivers among sound faces, degenerate faces."""
    m = cut(triangle_measures(faces, vertices), "triangles")
    sides = m.select(F.explode(F.array("ab", "bc", "ca")).alias("e"))
    edge = sides.agg(
        F.avg("e").alias("edge_mean"), F.lit(quantile(sides, "e", 0.5)).cast("double").alias("edge_median"), F.min("e").alias("edge_min"), F.max("e").alias("edge_max")
    )
    rest = m.agg(
        F.sum("area").alias("area"),
        F.avg("aspect").alias("aspect_mean"),
        F.max("aspect").alias("aspect_max"),
        F.avg((F.col("aspect") > sliver).cast("double")).alias("sliver_share"),
        F.coalesce(F.sum((F.col("area") <= 1e-20).cast("long")), F.lit(0)).alias("n_degenerate"),
    )
    return edge.join(rest)  # one row each


def signed_volume(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row: volume enclosed by an oriented closed mesh."""
    c = corners(faces, vertices)
    det = (
        F.expr("ax * (by * cz - bz * cy)") - F.expr("ay * (bx * cz - bz * cx)") + F.expr("az * (bx * cy - by * cx)")
    )
    return c.agg(F.abs(F.sum(det) / 6).alias("volume"))


def face_components(faces: DataFrame) -> DataFrame:
    """(fid, component): faces joined by an edge; an edge links its faces to its smallest one, not all pairs."""
    e = edges(faces)
    lead = e.groupBy("u", "v").agg(F.min("fid").alias("head"))
    links = e.join(lead, ["u", "v"]).where("fid <> head").select(F.col("fid").alias("a"), F.col("head").alias("b"))
    cc = connected_components(links)
    return faces.select("fid").join(cc.withColumnRenamed("node", "fid"), "fid", "left").select("fid", F.coalesce("component", "fid").alias("component"))


def component_keep(components: DataFrame, ratio: float = 0.02, least: int = 50, largest_only: bool = False) -> DataFrame:
    """(component, n_faces, kept): at least max(ratio * largest, least) faces; the largest always stays."""
    sizes = components.groupBy("component").agg(F.count("*").alias("n_faces"))
    top = sizes.agg(F.max("n_faces").alias("top"), F.max_by("component", F.struct("n_faces", -F.col("component"))).alias("first"))
    enough = F.lit(False) if largest_only else F.col("n_faces") >= F.greatest(F.lit(ratio) * F.col("top"), F.lit(least))
    return sizes.join(F.broadcast(top)).select("component", "n_faces", (enough | (F.col("component") == F.col("first"))).alias("kept"))


def clean_faces(faces: DataFrame) -> DataFrame:
    """Without degenerate faces and repeats of a face (same corners in any order; the smallest fid stays)."""
    good = faces.where("a <> b and b <> c and c <> a")
    key = F.array_sort(F.array("a", "b", "c"))
    first = good.groupBy(key.alias("k")).agg(F.min(F.struct("fid", "a", "b", "c")).alias("f"))
    return first.select("f.fid", "f.a", "f.b", "f.c")


def merge_vertices(faces: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices at the same place become the one with the smallest number."""
    first = vertices.groupBy(*XYZ).agg(F.min("vid").alias("to"))
    to = vertices.join(first, list(XYZ)).select("vid", "to")
    out = faces
    for k in "abc":
        out = out.join(to.select(F.col("vid").alias(k), F.col("to").alias(f"_{k}")), k).drop(k)
    kept = vertices.join(first.select(F.col("to").alias("vid")), "vid", "left_semi")
    return out.select("fid", *(F.col(f"_{k}").alias(k) for k in "abc")), kept


def boundary_loops(faces: DataFrame) -> DataFrame:
    """(loop, n_edges): boundary edges grouped into loops."""
    b = edges(faces).groupBy("u", "v").agg(F.count("*").alias("n")).where("n = 1").select("u", "v")
    cc = connected_components(b, "u", "v")
    return b.join(cc, b.u == cc.node).groupBy(F.col("component").alias("loop")).agg(F.count("*").alias("n_edges"))


def fill_holes(faces: DataFrame, vertices: DataFrame, max_edges: int = 200) -> tuple[DataFrame, DataFrame]:
    """Close boundary loops of up to ``max_edges`` edges by fans around their centroids.

    The directed boundary edge (p, q) of a face becomes the face (q, p, centre).
    """
    f = faces
    d = f.select(F.explode(F.expr(_SIDES_SQL)).alias("e")).select("e.p", "e.q")
    k = d.select("p", "q", F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v"))
    once = k.groupBy("u", "v").agg(F.count("*").alias("n"), F.first("p").alias("p"), F.first("q").alias("q")).where("n = 1")
    cc = connected_components(once, "u", "v")
    loops = once.join(cc, once.u == cc.node).select("p", "q", F.col("component").alias("loop"))
    small = loops.groupBy("loop").agg(F.count("*").alias("n")).where(F.col("n").between(3, max_edges)).select("loop")
    base = vertices.agg(F.max("vid").alias("m")).first()["m"]
    top = faces.agg(F.max("fid").alias("m")).first()["m"]
    if base is None or top is None:
        return faces, vertices
    picked = loops.join(small, "loop", "left_semi")
    centre = picked.join(vertices, picked.p == vertices.vid).groupBy("loop").agg(*(F.avg(c).alias(c) for c in XYZ))
    centre = centre.withColumn("vid", F.lit(base + 1) + F.col("loop"))
    fan = picked.select((F.lit(top + 1) + F.col("p")).alias("fid"), F.col("q").alias("a"), F.col("p").alias("b"), (F.lit(base + 1) + F.col("loop")).alias("c"))
    return faces.select("fid", "a", "b", "c").unionByName(fan), vertices.select("vid", *XYZ).unionByName(centre.select("vid", *XYZ))


def smooth(faces: DataFrame, vertices: DataFrame, rounds: int = 5, shrink: float = 0.5, grow: float = -0.53) -> DataFrame:
    """Taubin smoothing: every round a shrinking and a growing step towards the mean of neighbours."""
    from sparkogram.runtime import cut

    e = edges(faces).select("u", "v").distinct()
    arcs = cut(e.unionAll(e.select(F.col("v"), F.col("u"))).toDF("u", "v"), "arcs")
    out = vertices
    rest = [c for c in vertices.columns if c not in ("vid", *XYZ)]
    for _ in range(rounds):
        for step in (shrink, grow):
            near = arcs.join(out.select(F.col("vid").alias("v"), *XYZ), "v").groupBy(F.col("u").alias("vid")).agg(*(F.avg(c).alias(f"m{c}") for c in XYZ))
            moved = [(F.col(c) + F.lit(step) * (F.coalesce(F.col(f"m{c}"), F.col(c)) - F.col(c))).alias(c) for c in XYZ]
            out = cut(out.join(near, "vid", "left").select("vid", *moved, *rest), "smooth")
    return out


def sample_surface(faces: DataFrame, vertices: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """About n points (pid, x, y, z) spread over the surface by area, from seeded hashes."""
    m = triangle_measures(faces, vertices).select("fid", "area")
    total = m.agg(F.sum("area").alias("total"))
    u = lambda k: (F.pmod(F.xxhash64("fid", "i", F.lit(seed), F.lit(k)), F.lit(1 << 40)) / F.lit(float(1 << 40)))
    share = m.join(F.broadcast(total)).withColumn("want", F.col("area") / F.col("total") * n).withColumn("i", F.lit(0))
    share = share.withColumn("count", F.floor(F.col("want") + u(0)).cast("int")).where("count > 0")
    each = corners(faces, vertices).join(share.select("fid", "count"), "fid").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("count"))))
    each = each.withColumn("r1", F.sqrt(u(1))).withColumn("r2", u(2))
    at = [(F.expr(f"(1 - r1) * a{c} + r1 * (1 - r2) * b{c} + r1 * r2 * c{c}")).alias(c) for c in XYZ]
    return each.select(F.xxhash64("fid", "i").alias("pid"), "fid", *at)
