"""Quality classifier: regularised quadratic discriminant analysis.

Document statistics are transformed towards normality, class means and second
moments come from two distributed aggregations over all labelled training rows
(two result rows each), and the covariances are shrunk twice: towards the pooled
covariance and towards a multiple of the identity.  Their Cholesky factors are
inverted once and cached as literals; a document's score is the difference of
Mahalanobis log densities plus the log prior, calibrated on training rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkogram.llm.textstats import bounded_sample, one_row_each, ratios
from sparkogram.runtime import cut


def features(counts: DataFrame) -> dict[str, Column]:
    """Transformed statistics: shares by asinh of a multiple, lengths by logarithm."""
    r = ratios(counts)
    squash = lambda c: F.asinh(F.lit(20.0) * c)
    out = {k: squash(r[k]) for k in ("symbols", "dup_lines", "repeats", "upper", "bars", "bangs", "punct", "digits", "long_words")}
    return out | {"words": r["words"], "word_length": F.log1p(r["word_length"]), "distinct": r["distinct"], "end_lines": r["end_lines"], "line_words": r["line_words"]}


@dataclass(frozen=True)
class Qda:
    """Fitted densities: per class mean, inverse Cholesky factor and log constant; calibration a, b."""

    names: tuple[str, ...]
    mean: tuple[np.ndarray, np.ndarray]
    whiten: tuple[np.ndarray, np.ndarray]
    const: tuple[float, float]
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: dict[str, Column]) -> Column:
        """log p(x | 1) P(1) - log p(x | 0) P(0)."""
        part = []
        for k in (0, 1):
            total = F.lit(self.const[k])
            diff = [x[n] - F.lit(float(m)) for n, m in zip(self.names, self.mean[k], strict=True)]
            for row in self.whiten[k]:
                z = F.lit(0.0)
                for w, d in zip(row.tolist(), diff, strict=True):
                    if w:
                        z = z + F.lit(w) * d
                total = total - F.lit(0.5) * z * z
            part.append(total)
        return part[1] - part[0]


def _exact(c: Column) -> Column:
    """Sums of these do not depend on the order of the rows, so refits give the same numbers."""
    return F.sum(c.cast("decimal(24,12)"))


def fit(train: DataFrame, x: dict[str, Column], pool: float = 0.3, ridge: float = 0.05, platt_rows: int = 20_000) -> Qda | None:
    """Fit on ``train`` (label 0/1 and counts); None unless both classes have two rows.

    Moments use every training row, in two passes: class means, then products of
    what is left after subtracting them, which cannot cancel.  The two calibration
    numbers are fitted on at most ``platt_rows`` of the same rows (documented bound).
    """
    names, d = tuple(x), len(x)
    label = F.when(F.col("label") > 0, 1).otherwise(0).alias("label")
    cols = cut(train.select("doc_id", label, *(c.alias(n) for n, c in x.items())), "moments")
    sums = cols.groupBy("label").agg(F.count("*").alias("n"), F.array(*(_exact(F.col(n)) for n in names)).alias("s"))
    got = {r["label"]: r for r in sums.collect()}
    if not all(k in got and got[k]["n"] > 1 for k in (0, 1)):
        return None
    count = {k: got[k]["n"] for k in (0, 1)}
    mean = {k: np.array([float(v) for v in got[k]["s"]]) / count[k] for k in (0, 1)}
    at = [F.col(n) - F.when(F.col("label") == 1, float(mean[1][i])).otherwise(float(mean[0][i])) for i, n in enumerate(names)]
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    products = cols.select("label", F.array(*at).alias("c")).groupBy("label").agg(
        F.array(*(_exact(F.col("c")[i] * F.col("c")[j]) for i, j in pairs)).alias("q")
    )
    scatter = {}
    for r in products.collect():
        q = scatter[r["label"]] = np.zeros((d, d))
        for (i, j), v in zip(pairs, r["q"], strict=True):
            q[i, j] = q[j, i] = float(v)
    total = count[0] + count[1]
    pooled = (scatter[0] + scatter[1]) / max(total - 2, 1)
    whiten, const = [], []
    for k in (0, 1):
        own = scatter[k] / (count[k] - 1)
        cov = (1 - pool) * own + pool * pooled
        cov = (1 - ridge) * cov + ridge * max(np.trace(cov) / d, 1e-9) * np.eye(d)
        factor = np.linalg.cholesky(cov)
        whiten.append(np.linalg.inv(factor))
        const.append(float(np.log(count[k] / total) - np.log(np.diag(factor)).sum()))
    model = Qda(names, (mean[0], mean[1]), (whiten[0], whiten[1]), (const[0], const[1]))
    sample = bounded_sample(cols, platt_rows)
    scored = sample.select("doc_id", "label", model.margin({n: F.col(n) for n in names}).alias("m")).toPandas().sort_values("doc_id")
    slope, shift = _platt(scored["m"].to_numpy(float), scored["label"].to_numpy(float))
    return Qda(names, model.mean, model.whiten, model.const, slope, shift)


def _platt(m: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Logistic calibration of margins by damped Newton steps, with smoothed targets."""
    scale = max(float(np.std(m)), 1e-9)
    m = np.clip(m / scale, -20, 20)
    pos, neg = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.array([1.0, 0.0])
    x = np.column_stack([m, np.ones_like(m)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - t) + 1e-3 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - step / max(1.0, float(np.abs(step).max()) / 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 1e-6) / scale), float(w[1])


def score(counts: DataFrame, model: Qda | None) -> Column:
    """Score column in 0..1 (0.5 without a model)."""
    if model is None:
        return F.lit(0.5)
    z = F.lit(model.slope) * model.margin(features(counts)) + F.lit(model.shift)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))


def quality_scores(counts: DataFrame, labels: DataFrame, train: Column, threshold: float = 0.3, **options) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``counts``.

    ``labels`` (doc_id, quality) are used where ``train``, a column over doc_id,
    holds.  Defined results: null and empty texts are scored by their zero
    statistics; repeated and null ids keep a row each, and a labelled id with
    several texts is learned from the one with the least counts; labels with
    nulls are ignored, of contradicting ones the higher counts; without both
    classes every score is 0.5; an empty table gives no rows; other columns are
    ignored.
    """
    one = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    one = one.where("label is not null").where(train).groupBy("doc_id").agg(F.max("label").alias("label"))
    model = fit(one_row_each(counts.join(one, "doc_id"), "label"), features(counts), **options)
    got = counts.withColumn("score", score(counts, model))
    return got.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
