"""Plot-ready tables, run reports and their formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkogram.operators.observations import dense_ids
from sparkogram.operators.quantiles import quantile, quantiles


def match_matrix(counts: DataFrame, value: str = "n_matches") -> DataFrame:
    """Symmetric matrix in long form (image_id, other_id, n)."""
    return counts.select(F.col("img_i").alias("image_id"), F.col("img_j").alias("other_id"), F.col(value).alias("n")).unionAll(
        counts.select("img_j", "img_i", value)
    )


def isolated(images: DataFrame, pairs: DataFrame) -> DataFrame:
    """Images without a pair."""
    ends = pairs.select(F.col("img_i").alias("image_id")).unionAll(pairs.select("img_j"))
    return images.select("image_id").distinct().join(ends, "image_id", "left_anti")


def density_grid(points: DataFrame, width: float, height: float, nx: int, ny: int) -> DataFrame:
    """Counts per image and grid cell; the far border belongs to the last cell."""
    gx = F.least(F.floor(F.col("x") / F.lit(width) * nx), F.lit(nx - 1)).cast("long")
    gy = F.least(F.floor(F.col("y") / F.lit(height) * ny), F.lit(ny - 1)).cast("long")
    return points.groupBy("image_id", gx.alias("gx"), gy.alias("gy")).agg(F.count("*").alias("n"))


def clamped_histogram(df: DataFrame, column: str, top: int, name: str) -> DataFrame:
    return df.groupBy(F.least(F.col(column), F.lit(top).cast("long")).alias(column)).agg(F.count("*").alias(name))


def clipped_histogram(df: DataFrame, column: str, bins: int, share: float = 0.99) -> DataFrame:
    """(bin, low, n) of a column clipped at a quantile."""
    top = F.lit(quantile(df, column, share)).cast("double").alias("hi")
    c = df.join(F.broadcast(df.agg(F.min(column).alias("lo"), top)))  # one row
    step = (F.col("hi") - F.col("lo")) / bins
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.try_divide(F.least(F.col(column), F.col("hi")) - F.col("lo"), step))))
    return c.groupBy(F.coalesce(b, F.lit(0)).cast("int").alias("bin"), "lo", "hi").agg(F.count("*").alias("n")).select("bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("low"), "n")


def keypoint_statistics(keypoints: DataFrame, few: int = 100) -> DataFrame:
    """One row: images, total, mean, min, max keypoints, images with few."""
    n = keypoints.groupBy("image_id").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("n_images"), F.sum("n").alias("total"), F.avg("n").alias("mean"), F.min("n").alias("min"), F.max("n").alias("max"), F.sum((F.col("n") < few).cast("long")).alias("n_few"))


def inlier_flags(matches: DataFrame, inliers: DataFrame) -> DataFrame:
    """Raw matches with a flag whether verification kept them."""
    keys = ["img_i", "img_j", "kp_i", "kp_j"]
    return matches.join(inliers.select(*keys).distinct().withColumn("inlier", F.lit(True)), keys, "left").withColumn("inlier", F.coalesce("inlier", F.lit(False)))


def epipolar_ends(line: str, width: float, height: float) -> list[Column]:
    """Where a line (a, b, c) crosses the left and right image border, or top and bottom when it is steep."""
    a, b, c = (F.col(line).getItem(i) for i in range(3))
    flat = F.abs(b) >= F.abs(a)
    return [
        F.when(flat, F.lit(0.0)).otherwise(-F.try_divide(c, a)),
        F.when(flat, -F.try_divide(c, b)).otherwise(F.lit(0.0)),
        F.when(flat, F.lit(float(width))).otherwise(-F.try_divide(c + b * F.lit(float(height)), a)),
        F.when(flat, -F.try_divide(c + a * F.lit(float(width)), b)).otherwise(F.lit(float(height))),
    ]


def cumulative(steps: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    w = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return steps.withColumn("total", F.sum(value).over(w))


def unpivot_stages(stats: DataFrame, id_column: str, stages: list[str]) -> DataFrame:
    """Face counts per cleaning stage, a row each."""
    return stats.unpivot(id_column, stages, "stage", "n_faces")


def ranked_pairs(counts: DataFrame) -> DataFrame:
    """Pairs in order of matches, ranked without a task that sorts them all."""
    keyed = counts.withColumn("_key", F.struct((-F.col("n_matches")).alias("n"), "img_i", "img_j"))
    return dense_ids(keyed, "_key", "rank").drop("_key").withColumn("rank", F.col("rank") + 1)


def greedy_pairs(ranked: DataFrame, n_pairs: int = 12, per_image: int = 2, considered: int = 5000) -> DataFrame:
    """Best pairs with each image at most ``per_image`` times, filled up by rank.

    The choice is a fold over ranks: the driver walks at most ``considered`` pairs
    at a time, and goes on behind them without the images that are used up until
    the choice or the ranking is complete.  Every walk chooses a pair at least.
    """
    used: dict[int, int] = {}
    chosen, rest, more = [], ranked, n_pairs > 0
    while more:
        rows = rest.orderBy("rank").limit(considered).collect()
        for r in rows:
            if len(chosen) < n_pairs and used.get(r["img_i"], 0) < per_image and used.get(r["img_j"], 0) < per_image:
                chosen.append(r)
                for i in (r["img_i"], r["img_j"]):
                    used[i] = used.get(i, 0) + 1
        more = len(chosen) < n_pairs and len(rows) == considered
        if more:
            full = [i for i, n in used.items() if n >= per_image]
            rest = ranked.where((F.col("rank") > rows[-1]["rank"]) & ~F.col("img_i").isin(full) & ~F.col("img_j").isin(full))
    if len(chosen) < n_pairs:  # the first n_pairs ranks hold enough that are not chosen yet
        first = ranked.orderBy("rank").limit(n_pairs).collect()
        chosen += [r for r in first if r not in chosen][: n_pairs - len(chosen)]
    return ranked.sparkSession.createDataFrame(chosen, ranked.schema)


def even_selection(total: int, n: int) -> list[int]:
    """n of ``total`` positions, evenly spaced with both ends, rounding half to even."""
    if n >= total:
        return list(range(total))
    return [0] if n == 1 else [round(i * (total - 1) / (n - 1)) for i in range(n)]


def spread(runs: DataFrame, group: str, value: str) -> DataFrame:
    """(run, n, low, high, spread_percent = 100 (max - min) / max) over repeated runs."""
    lo, hi = F.min(value), F.max(value)
    return runs.groupBy(F.col(group).alias("run")).agg(F.count("*").alias("n"), lo.alias("low"), hi.alias("high"), (100 * F.try_divide(hi - lo, hi)).alias("spread_percent"))


def enrich(runs: DataFrame, poses: DataFrame, clouds: DataFrame, key: str = "name") -> DataFrame:
    """Runs with pose metrics and cloud statistics where there are any."""
    return runs.join(poses, key, "left").join(clouds, key, "left")


def scaling(runs: DataFrame) -> DataFrame:
    """Pairs n (n - 1) / 2, seconds per pair and per image; runs: name, n_images, matching_s, total_s."""
    pairs = F.col("n_images") * (F.col("n_images") - 1) / 2
    return runs.select("name", "n_images", pairs.cast("long").alias("n_pairs"), F.try_divide(F.col("matching_s"), pairs).alias("s_per_pair"), F.try_divide(F.col("total_s"), F.col("n_images")).alias("s_per_image"))


def stage_times(runs: DataFrame) -> DataFrame:
    """(name, stage, seconds) of runs with a map of stage times."""
    return runs.select("name", F.explode("stages").alias("stage", "seconds"))


def verdicts(results: DataFrame) -> DataFrame:
    return results.groupBy("verdict").agg(F.count("*").alias("n"))


def roll_up(checks: DataFrame) -> DataFrame:
    """The worst level of all checks: FAIL, WARN or PASS."""
    level = F.max(F.when(F.col("level") == "FAIL", 2).when(F.col("level") == "WARN", 1).otherwise(0))
    return checks.agg(F.coalesce(level, F.lit(0)).alias("v")).select(F.when(F.col("v") == 2, "FAIL").when(F.col("v") == 1, "WARN").otherwise("PASS").alias("verdict"))


def distance_summary(d: DataFrame, column: str, spacing: float | None = None) -> DataFrame:
    """One row: mean, median, rms, p95, max of finite distances, and in units of the spacing."""
    x = F.col(column)
    finite = d.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    median, p95 = (F.lit(v).cast("double") for v in quantiles(finite, {column: [0.5, 0.95]})[column])
    out = finite.agg(F.count("*").alias("n"), F.avg(x).alias("mean"), median.alias("median"), F.sqrt(F.avg(x * x)).alias("rms"), p95.alias("p95"), F.max(x).alias("max"))
    if spacing:
        out = out.select("*", *((F.col(c) / F.lit(spacing)).alias(f"{c}_spacings") for c in ("mean", "median", "rms", "p95", "max")))
    return out


def number(column: str, digits: int = 2, missing: str = "n/a", suffix: str = "") -> Column:
    """Fixed-point text of a number, ``missing`` for null."""
    return F.when(F.col(column).isNull(), F.lit(missing)).otherwise(F.concat(F.format_string(f"%.{digits}f", F.col(column)), F.lit(suffix)))


def german(column: str, digits: int = 0) -> Column:
    """German notation: points between thousands, a decimal comma."""
    return F.translate(F.format_number(F.col(column), digits), ",.", ".,")


def markdown(df: DataFrame, order: list[str]) -> str:
    """A Markdown table of a (small) report."""
    rows = df.orderBy(*order).collect()
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join("n/a" if v is None else str(v) for v in r) + " |" for r in rows])
