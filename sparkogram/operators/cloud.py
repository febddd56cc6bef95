"""Point clouds: neighbours, outliers, extent, voxels, colour transfer, health.

Clouds: pid, x, y, z and optional attributes.  Neighbour searches are grid joins:
cells of side s, every query looks into the 27 cells around it, which is exact up
to distance s; queries with fewer than k neighbours within s go on with the side
doubled until all are served, so no pair of far points is ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkogram.operators.quantiles import gaps, quantile, quantiles
from sparkogram.runtime import cut

XYZ = ("x", "y", "z")


def _square(a: str, b: str) -> Column:
    return sum((F.col(f"{a}{c}") - F.col(f"{b}{c}")) ** 2 for c in XYZ)


def finite(cloud: DataFrame) -> DataFrame:
    """Rows whose coordinates are all finite."""
    test = " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in XYZ)
    return cloud.where(test)


def start_side(cloud: DataFrame, k: int) -> float:
    """A cell side that holds about k points of an evenly filled bounding box surface."""
    r = cloud.agg(F.count("*").alias("n"), *(f(c).alias(f"{g}{c}") for c in XYZ for f, g in ((F.min, "lo"), (F.max, "hi")))).first()
    if not r["n"]:
        return 1.0
    spans = sorted(r[f"hi{c}"] - r[f"lo{c}"] for c in XYZ)
    area = max(spans[1] * spans[2], (spans[2] * 1e-3) ** 2)
    return max((area * max(k, 1) / r["n"]) ** 0.5, spans[2] * 1e-6, 1e-12)


def nearest(queries: DataFrame, cloud: DataFrame, k: int = 1, side: float | None = None, same: bool = False, max_rounds: int = 40) -> DataFrame:
    """(qid, pid, distance, rank): the k nearest cloud points of every query; ties to the smaller pid.

    ``queries``: qid, x, y, z.  With ``same`` a query never finds the point of its
    own number.  Fewer than k cloud points give fewer rows.
    """
    side = side or start_side(cloud, k + 1)
    total = cloud.count()
    want = min(k, total - 1 if same else total)
    points = cloud.select("pid", *(F.col(c).alias(f"p_{c}") for c in XYZ))
    left = queries.select("qid", *(F.col(c).alias(f"q_{c}") for c in XYZ))
    out, diagonal = None, None
    if want == total or (same and want == total - 1):
        diagonal = _diagonal(cloud, queries)
    for _ in range(max_rounds):
        last = diagonal is not None and side >= diagonal
        cell = lambda p, c, s=side: F.floor(F.col(f"{p}_{c}") / F.lit(s))
        a = left
        for c in XYZ:
            a = a.withColumn(f"c{c}", F.explode(F.sequence(cell("q", c) - 1, cell("q", c) + 1)))
        b = points.select("*", *(cell("p", c).alias(f"c{c}") for c in XYZ))
        pairs = a.join(b, [f"c{c}" for c in XYZ])
        if same:
            pairs = pairs.where("qid <> pid")
        pairs = pairs.select("qid", "pid", F.sqrt(_square("q_", "p_")).alias("distance"))
        if not last:  # beyond the side another cell may hold nearer points, so nothing there is ranked
            pairs = pairs.where(F.col("distance") <= side)
        order = W.partitionBy("qid").orderBy("distance", "pid")
        sure = cut(pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "nearest")
        done = sure.groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") >= want)
        found = sure.join(done.select("qid"), "qid", "left_semi")
        out = found if out is None else out.unionByName(found)
        left = cut(left.join(done.select("qid"), "qid", "left_anti"), "left")
        if want == 0 or not left.take(1):
            return out
        side *= 2
    raise RuntimeError("neighbour search did not finish")


def _diagonal(cloud: DataFrame, queries: DataFrame) -> float:
    every = cloud.select(*XYZ).unionAll(queries.select(*XYZ))
    r = every.agg(*((F.max(c) - F.min(c)).alias(c) for c in XYZ)).first()
    return sum((r[c] or 0.0) ** 2 for c in XYZ) ** 0.5 + 1e-12


def self_neighbours(cloud: DataFrame, k: int = 1, side: float | None = None) -> DataFrame:
    return nearest(cloud.withColumnRenamed("pid", "qid"), cloud, k, side, same=True)


def spacing(cloud: DataFrame, sample: int | None = 50_000, seed: int = 0) -> DataFrame:
    """One row: the median positive nearest-neighbour distance, 0 without any.

    ``sample`` bounds the query points (a parameter of this statistic, by a seeded
    hash order); None takes all.
    """
    queries = cloud.withColumnRenamed("pid", "qid")
    if sample is not None and cloud.count() > sample:
        queries = queries.orderBy(F.xxhash64("qid", F.lit(seed)), "qid").limit(sample)
    near = nearest(queries, cloud, 1, same=True).where("distance > 0")
    return cloud.sparkSession.createDataFrame([(quantile(near, "distance", 0.5) or 0.0,)], "spacing double")


def kth_distance(cloud: DataFrame, k: int) -> DataFrame:
    """(pid, distance) to the k-th neighbour."""
    return self_neighbours(cloud, k).where(F.col("rank") == k).select(F.col("qid").alias("pid"), "distance")


def statistical_outliers(cloud: DataFrame, k: int = 20, ratio: float = 2.0) -> DataFrame:
    """Points whose mean distance to k neighbours (themselves included) is at most mean + ratio * deviation."""
    near = self_neighbours(cloud, k - 1).groupBy(F.col("qid").alias("pid")).agg((F.sum("distance") / (F.count("*") + 1)).alias("mean_distance"))
    limit = near.agg((F.avg("mean_distance") + ratio * F.stddev_samp("mean_distance")).alias("limit"))
    return near.join(F.broadcast(limit)).where("mean_distance <= limit").select("pid", "mean_distance")


def radius_outliers(cloud: DataFrame, k: int, radius: float, max_removal: float) -> DataFrame:
    """Points whose k-th neighbour is within ``radius``, widened so that at most ``max_removal`` of them go."""
    d = cut(kth_distance(cloud, k), "kth")
    beyond = d.agg(F.avg((F.col("distance") > radius).cast("double"))).first()[0] or 0.0
    limit = quantile(d, "distance", 1 - max_removal) if beyond > max_removal else radius
    return d.where(F.col("distance") <= limit).select("pid", "distance")


def centre_distance(cloud: DataFrame) -> DataFrame:
    """The cloud with ``dist``, the distance from its coordinate-wise median."""
    centre = quantiles(cloud, {c: [0.5] for c in XYZ})
    return cloud.withColumn("dist", F.sqrt(sum((F.col(c) - F.lit(centre[c][0]).cast("double")) ** 2 for c in XYZ)))


#: Quantiles at which a cut is tried besides the largest gap.
EXTENT_SHARES = (0.001, 0.002, 0.005, 0.01, 0.02, 0.05)


def extent_filter(cloud: DataFrame, max_removal: float = 0.05, min_gap: float = 1.5, min_shrink: float = 2.0) -> DataFrame:
    """The cloud without a far-off remainder.

    Cuts are tried at the largest relative gap of the outer ``max_removal`` share
    and at fixed quantiles; the one that removes fewest points and shrinks the
    bounding box diagonal ``min_shrink`` times wins, else nothing is removed.
    Clouds under 100 points stay as they are.
    """
    d = cut(centre_distance(cloud), "extent")
    n = d.count()
    if n < 100:
        return d.drop("dist")
    # gaps only among the outer points
    shares = [s for s in EXTENT_SHARES if s <= max_removal]
    edge, *got = quantiles(d, {"dist": [1 - max_removal, *(1 - s for s in shares)]})["dist"]
    tail = gaps(d.where(F.col("dist") >= edge), "dist").where(F.col("before") > 0)
    gap = tail.select((F.col("value") / F.col("before")).alias("gap"), "before").orderBy(F.desc("gap"), "before").limit(1).collect()
    cuts = [("gap", gap[0]["before"])] if gap and gap[0]["gap"] >= min_gap else []
    cuts += [(f"q{s}", q) for s, q in zip(shares, got, strict=True)]
    # one pass for all cuts: what stays, and its box
    box = lambda when: [f(F.when(when, F.col(c))) for c in XYZ for f in (F.max, F.min)]
    aggs = [F.array(F.sum(F.when(F.col("dist") <= q, 1.0).otherwise(0.0)), *box(F.col("dist") <= q)).alias(f"c{i}") for i, (_, q) in enumerate(cuts)]
    row = d.agg(F.array(*box(F.lit(True))).alias("all"), *aggs).first()
    diag = lambda v: sum((v[2 * i] - v[2 * i + 1]) ** 2 for i in range(3)) ** 0.5
    tried = sorted((n - row[f"c{i}"][0], q, label, diag(row[f"c{i}"][1:])) for i, (label, q) in enumerate(cuts))
    for removed, q, _, size in tried:
        if 0 < removed < n and size > 0 and diag(row["all"]) / size >= min_shrink:
            return d.where(F.col("dist") <= q).drop("dist")
    return d.drop("dist")


def voxel_cell(size: float, origin: dict[str, float]) -> list[Column]:
    return [F.floor((F.col(c) - F.lit(origin[c])) / F.lit(size)).alias(f"v{c}") for c in XYZ]


def voxel_origin(cloud: DataFrame, size: float) -> dict[str, float]:
    """Half a voxel below the cloud's lower corner."""
    r = cloud.agg(*(F.min(c).alias(c) for c in XYZ)).first()
    return {c: (r[c] or 0.0) - size / 2 for c in XYZ}


def voxel_downsample(cloud: DataFrame, size: float, attributes: tuple[str, ...] = (), origin: dict[str, float] | None = None) -> DataFrame:
    """Mean position and attributes per voxel, with its number of points."""
    cells = voxel_cell(size, origin or voxel_origin(cloud, size))
    return cloud.groupBy(*cells).agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in (*XYZ, *attributes)))


def voxel_size_for(cloud: DataFrame, target: int, near: float, tolerance: float = 0.05, rounds: int = 16) -> float:
    """The voxel size by bisection that leaves between (1 - tolerance) * target and target voxels.

    Each round is one distributed count of distinct cells.
    """
    diag = _diagonal(cloud, cloud)
    count = lambda s: cloud.select(*voxel_cell(s, voxel_origin(cloud, s))).distinct().count()
    lo = max(near / 2, diag * 1e-6)
    hi = max(4 * near, 2 * lo)
    while hi < diag and count(hi) > target:
        hi *= 2
    hi = min(hi, max(diag, lo * 2))
    for _ in range(rounds):
        mid = (lo + hi) / 2
        n = count(mid)
        if (1 - tolerance) * target <= n <= target:
            return mid
        lo, hi = (mid, hi) if n > target else (lo, mid)
    return hi


def transfer_colours(vertices: DataFrame, cloud: DataFrame, k: int = 5, columns: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """(vid, columns): inverse-distance mean of the k nearest cloud points, clipped to 0..1."""
    near = nearest(vertices.withColumnRenamed("vid", "qid"), cloud, k)
    w = 1 / F.greatest("distance", F.lit(1e-10))
    joined = near.join(cloud.select("pid", *columns), "pid").withColumn("w", w)
    mean = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum(F.col("w") * F.col(c)) / F.sum("w")))
    return joined.groupBy(F.col("qid").alias("vid")).agg(*(mean(c).alias(c) for c in columns))


def health(cloud: DataFrame) -> DataFrame:
    """One row of cloud statistics: nearest neighbours, duplicates, flyers, far points, distinct colours."""
    d = cut(centre_distance(cloud), "health")
    near = cut(self_neighbours(cloud, 1).select("distance"), "near")
    median = F.lit(quantile(near, "distance", 0.5)).cast("double")
    nn = near.agg(
        median.alias("nn_median"),
        F.avg("distance").alias("nn_mean"),
        F.avg((F.col("distance") < 1e-9).cast("double")).alias("duplicate_share"),
        F.avg((F.col("distance") > 10 * median).cast("double")).alias("flyer_share"),
    )
    middle, p95, p99 = (F.lit(x).cast("double") for x in quantiles(d, {"dist": [0.5, 0.95, 0.99]})["dist"])
    far = d.agg(
        F.count("*").alias("n_points"),
        p95.alias("radius_p95"),
        p99.alias("radius_p99"),
        F.avg((F.col("dist") > 5 * middle).cast("double")).alias("outlier_share"),
    )
    return far.join(nn)  # one row each


def orient_normals(cloud: DataFrame, centres: DataFrame, grazing: float = 0.2) -> DataFrame:
    """Normals turned towards the nearest camera; grazing ones take the sign of the nearest confident neighbour.

    ``cloud``: pid, x, y, z, nx, ny, nz; ``centres``: cid, x, y, z.
    """
    side = max(_diagonal(cloud, centres.select(*XYZ)), 1e-9) / 2
    near = nearest(cloud.withColumnRenamed("pid", "qid"), centres.withColumnRenamed("cid", "pid"), 1, side)
    c = centres.select(F.col("cid").alias("cam"), *(F.col(a).alias(f"c{a}") for a in XYZ))
    v = cloud.join(near.select(F.col("qid").alias("pid"), F.col("pid").alias("cam")), "pid").join(c, "cam")
    dots = sum((F.col(f"c{a}") - F.col(a)) * F.col(f"n{a}") for a in XYZ)
    norm = F.greatest(F.sqrt(sum((F.col(f"c{a}") - F.col(a)) ** 2 for a in XYZ)), F.lit(1e-12))
    v = v.withColumn("cosine", dots / norm)
    sign = F.when(F.col("cosine") < 0, -1.0).otherwise(1.0)
    v = cut(v.select(*cloud.columns, "cosine", *((F.col(f"n{a}") * sign).alias(f"o{a}") for a in XYZ)), "oriented")
    sure, unsure = v.where(F.abs("cosine") >= grazing), v.where(F.abs("cosine") < grazing)
    keep = [c for c in cloud.columns if c not in ("nx", "ny", "nz")]
    if not unsure.take(1) or not sure.take(1):
        return v.select(*keep, *(F.col(f"o{a}").alias(f"n{a}") for a in XYZ))
    ref = nearest(unsure.select(F.col("pid").alias("qid"), *XYZ), sure.select("pid", *XYZ), 1)
    n = sure.select("pid", *(F.col(f"o{a}").alias(f"s{a}") for a in XYZ))
    ref = ref.join(n, "pid").select(F.col("qid").alias("pid"), *(f"s{a}" for a in XYZ))
    j = unsure.join(ref, "pid")
    flip = F.when(sum(F.col(f"n{a}") * F.col(f"s{a}") for a in XYZ) < 0, -1.0).otherwise(1.0)
    fixed = j.select(*keep, *((F.col(f"n{a}") * flip).alias(f"n{a}") for a in XYZ))
    return sure.select(*keep, *(F.col(f"o{a}").alias(f"n{a}") for a in XYZ)).unionByName(fixed)


def normal_consistency(cloud: DataFrame, sample: int = 2000, seed: int = 0) -> DataFrame:
    """One row: mean absolute cosine between normals of nearest neighbours of sampled points."""
    q = cloud.orderBy(F.xxhash64("pid", F.lit(seed)), "pid").limit(sample).select(F.col("pid").alias("qid"), *XYZ)
    near = nearest(q, cloud.select("pid", *XYZ), 1, same=True).select("qid", "pid")
    a = cloud.select(F.col("pid").alias("qid"), *(F.col(f"n{c}").alias(f"a{c}") for c in XYZ))
    b = cloud.select("pid", *(F.col(f"n{c}").alias(f"b{c}") for c in XYZ))
    return near.join(a, "qid").join(b, "pid").agg(F.avg(F.abs(sum(F.col(f"a{c}") * F.col(f"b{c}") for c in XYZ))).alias("consistency"))
