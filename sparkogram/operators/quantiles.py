"""Exact quantiles and gaps of ordered values without a task that holds them all.

Spark's ``percentile`` merges a map of every distinct value into one task.  Here
a sketch brackets each wanted rank, counts narrow the bracket until it holds a
bounded number of values, and only those are looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkogram.runtime import cut

#: Values of one bracket that the driver may read.
HELD = 50_000


def quantiles(df: DataFrame, wanted: dict[str, Sequence[float]], held: int = HELD) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of columns, exactly as ``percentile`` gives them; nulls are left out.

    The columns are written once; each pass over them is one aggregation, and the
    number of passes grows with the logarithm of the number of rows.
    """
    values = cut(df.select(*(F.col(c).cast("double").alias(c) for c in wanted)), "quantiles")
    counts = values.agg(*(F.count(c).alias(c) for c in wanted)).first()
    out: dict[str, list[float | None]] = {}
    small = [c for c in wanted if counts[c] <= held]
    if small and max(counts[c] for c in wanted) <= held:
        got = values.toPandas()
        for c in small:
            v = got[c].dropna().to_numpy()
            out[c] = [float(x) for x in np.quantile(v, wanted[c])] if len(v) else [None] * len(wanted[c])
        return out
    for c, shares in wanted.items():
        n = counts[c]
        if not n:
            out[c] = [None] * len(shares)
            continue
        ranks = sorted({r for s in shares for r in (int(np.floor(s * (n - 1))), int(np.ceil(s * (n - 1))))})
        at = _ranked(values.select(F.col(c).alias("v")).where("v is not null"), ranks, n, held)
        out[c] = []
        for s in shares:
            lo, hi = int(np.floor(s * (n - 1))), int(np.ceil(s * (n - 1)))
            part = s * (n - 1) - lo
            out[c].append(at[lo] if lo == hi else (1 - part) * at[lo] + part * at[hi])
    return out


def _ranked(values: DataFrame, ranks: list[int], n: int, held: int) -> dict[int, float]:
    """The values at 0-based ranks of ``n`` values."""
    ends = values.agg(F.min("v"), F.max("v")).first()
    todo = {r: (ends[0], ends[1], 0, n) for r in ranks}  # bounds (both included), values below, values inside
    found: dict[int, float] = {}
    while todo:
        for r, (lo, hi, below, inside) in list(todo.items()):
            if lo == hi:
                found[r] = float(lo)
            elif inside <= held:
                rows = values.where(F.col("v").between(lo, hi)).toPandas()["v"].to_numpy()
                found[r] = float(np.partition(rows, r - below)[r - below])
            if r in found:
                del todo[r]
        if not todo:
            break
        aggs = []
        for r, (lo, hi, below, inside) in todo.items():
            share = (r - below) / max(inside - 1, 1)
            near = [float(np.clip(share - 0.004, 0, 1)), share, float(np.clip(share + 0.004, 0, 1))]
            aggs.append(F.percentile_approx(F.when(F.col("v").between(lo, hi), F.col("v")), near, 1000).alias(f"q{r}"))
        sketch = values.agg(*aggs).first()
        steps = {r: sorted({lo, *sketch[f"q{r}"], hi}) for r, (lo, hi, _, _) in todo.items()}
        counts = values.agg(*(F.sum((F.col("v") < s).cast("long")).alias(f"c{r}_{i}") for r, st in steps.items() for i, s in enumerate(st)),
                            *(F.sum((F.col("v") == s).cast("long")).alias(f"e{r}_{i}") for r, st in steps.items() for i, s in enumerate(st))).first()
        for r, st in steps.items():
            less, equal = [counts[f"c{r}_{i}"] for i in range(len(st))], [counts[f"e{r}_{i}"] for i in range(len(st))]
            for i, s in enumerate(st):
                if less[i] <= r < less[i] + equal[i]:
                    todo[r] = (s, s, less[i], equal[i])
                    break
                if i + 1 < len(st) and less[i] + equal[i] <= r < less[i + 1]:
                    # strictly between two steps: the next representable values bound it
                    todo[r] = (float(np.nextafter(s, np.inf)), float(np.nextafter(st[i + 1], -np.inf)), less[i] + equal[i], less[i + 1] - less[i] - equal[i])
                    break
    return found


def quantile(df: DataFrame, column: str, share: float) -> float | None:
    return quantiles(df, {column: [share]})[column][0]


def gaps(df: DataFrame, column: str) -> DataFrame:
    """(value, before): every value of a column with the next smaller row's; the smallest has none.

    Rows are range partitioned and looked at inside their range; a range's first
    row gets the last value of the ranges before it, one row per range.
    """
    parts = cut(df.select(F.col(column).alias("value")).repartitionByRange(F.col("value")).withColumn("_p", F.spark_partition_id()), "gaps")
    inside = parts.withColumn("before", F.lag("value").over(W.partitionBy("_p").orderBy("value")))
    ends = parts.groupBy("_p").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    edge = ends.select("_p", F.lag("_hi").over(W.orderBy("_lo", "_hi")).alias("_edge"))  # one row per range
    return inside.join(F.broadcast(edge), "_p").select("value", F.coalesce("before", "_edge").alias("before"))
