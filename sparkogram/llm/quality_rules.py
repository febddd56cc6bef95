"""Quality rules: decision lists learned by sequential covering.

From labelled statistics a list of rules is grown, each a conjunction of
thresholds that picks low-quality documents.  A rule grows on two thirds of what
earlier rules left by the test of the highest information gain, and is then cut
back on the other third to the prefix of the best (p - n) / (p + n).  Learning
stops when no rule reaches the wanted precision.  The list is emitted as one
ordered ``CASE WHEN`` expression, so applying it is a plain projection.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkogram.llm.textstats import bounded_sample, counted_rows, one_row_each, ratios, text_counts
from sparkogram.runtime import cut


@dataclass(frozen=True)
class Test:
    feature: str
    op: str  # ">=" or "<="
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.op == ">=" else x[self.feature] <= self.threshold

    def expression(self, columns: dict[str, Column]) -> Column:
        c = columns[self.feature]
        return c >= F.lit(self.threshold) if self.op == ">=" else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {self.op} {self.threshold:.6g}"


Rule = tuple[Test, ...]


def _covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for t in rule:
        hit &= t.holds(x)
    return hit


def _best_test(x: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray, steps: int) -> Test | None:
    """The test with the highest gain over the rows inside the rule so far."""
    p0, n0 = int((bad & inside).sum()), int((~bad & inside).sum())
    base = np.log2(p0 / (p0 + n0))
    best, test = 1e-9, None
    for name, values in x.items():
        v, b = values[inside], bad[inside]
        at = np.unique(np.quantile(v, np.linspace(0, 1, steps), method="nearest"))
        order = np.argsort(v, kind="stable")
        sv, sp = v[order], np.concatenate([[0], np.cumsum(b[order])])
        # thresholds lie halfway between neighbouring values, where rows not seen yet may fall
        for op in (">=", "<="):
            k = np.searchsorted(sv, at, side="left" if op == ">=" else "right")
            p = sp[-1] - sp[k] if op == ">=" else sp[k]
            total = len(sv) - k if op == ">=" else k
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / np.maximum(total, 1)) - base), -1.0)
            i = int(np.argmax(gain))
            if gain[i] > best:
                best, j = float(gain[i]), int(k[i])
                if op == ">=":
                    edge = sv[j] if j == 0 else (sv[j] + sv[j - 1]) / 2
                else:
                    edge = sv[j - 1] if j == len(sv) else (sv[j] + sv[j - 1]) / 2
                test = Test(name, op, float(edge))
    return test


def learn_list(
    x: dict[str, np.ndarray],
    bad: np.ndarray,
    max_rules: int = 16,
    max_tests: int = 4,
    precision: float = 0.9,
    least: int = 5,
    steps: int = 256,
    seed: int = 7,
) -> list[Rule]:
    """Ordered rules for ``bad`` rows; deterministic for given rows and seed."""
    n, rules = len(bad), []
    part = np.random.default_rng(seed).random(n) < 2 / 3
    left = np.ones(n, bool)
    while len(rules) < max_rules and (bad & left).sum() >= least:
        grow, prune = left & part, left & ~part
        inside, rule = grow.copy(), ()
        while len(rule) < max_tests and (bad & inside).any() and (~bad & inside).any():
            test = _best_test(x, bad, inside, steps)
            if test is None:
                break
            rule += (test,)
            inside &= test.holds(x)

        def worth(r: Rule, rows: np.ndarray = prune) -> tuple[float, int]:
            hit = _covered(r, x, n) & rows
            p, q = int((bad & hit).sum()), int((~bad & hit).sum())
            return ((p - q) / (p + q) if p + q else -1.0, -len(r))

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=worth, default=())
        hit = _covered(rule, x, n) & left
        p = int((bad & hit).sum())
        if not rule or p < least or p < precision * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def keep_expression(rules: list[Rule], columns: dict[str, Column]) -> Column:
    """False for the first rule that fires, else true, as an ordered conditional."""
    out = None
    for rule in rules:
        test = rule[0].expression(columns)
        for t in rule[1:]:
            test = test & t.expression(columns)
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def picked_labels(labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, label) of at most ``max_rows`` labelled ids (by a hash order)."""
    one = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label")).where("label is not null and doc_id is not null")
    return bounded_sample(one.groupBy("doc_id").agg(F.max("label").alias("label")), max_rows)


def learn_rules(counts: DataFrame, picked: DataFrame, **options) -> list[Rule]:
    """A decision list from ``picked`` labels and the counts of those documents.

    The driver holds the 14 ratios of the picked rows, a documented bound.
    Without labels of both kinds there are no rules.
    """
    columns = ratios(counts)
    rows = one_row_each(counts.join(F.broadcast(picked), "doc_id"), "label").orderBy("doc_id")
    got = rows.select("label", *(c.alias(k) for k, c in columns.items())).toPandas()
    if got.empty or got["label"].nunique() < 2:
        return []
    return learn_list({k: got[k].to_numpy(float) for k in columns}, (got["label"] == 0).to_numpy(), **options)


def _verdicts(counts: DataFrame, rules: list[Rule]) -> tuple[Column, Column]:
    """``base_failed`` and ``kept`` over COUNTS."""
    failed = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    return failed, ~failed & keep_expression(rules, ratios(counts))


def quality_report(docs: DataFrame, labels: DataFrame, counts: DataFrame | None = None, max_rows: int = 30_000, **options) -> DataFrame:
    """Base counts, ``base_failed`` and ``kept`` of every document.

    ``base_failed``: under 50 words, or more than half of the words repeat in
    3-word windows.  Other documents are judged by the learned list, which is
    fitted on at most ``max_rows`` labelled rows (a documented bound).  Defined
    results: null or empty texts have zero counts and fail; repeated and null ids
    keep a row each, and a labelled id with several texts is learned from the one
    with the least counts; labels with a null are ignored, of contradicting labels
    the higher counts; an empty table gives no rows; columns other than doc_id
    and text are ignored.
    """
    counts = text_counts(docs) if counts is None else counts
    rules = learn_rules(counts, picked_labels(labels, "quality", max_rows), **options)
    failed, kept = _verdicts(counts, rules)
    return counts.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        kept.alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = 30_000, **options) -> DataFrame:
    """``docs`` without the rows that the report rejects; columns unchanged.

    The texts of the picked labels are counted first and the list learned from
    them; then one narrow pass judges each row by its own text, whatever its id
    is: rows with null or repeated ids, or null texts, are treated like any other
    (a null text fails the base checks and goes), an empty table stays empty.
    """
    picked = cut(picked_labels(labels, "quality", max_rows), "picked")
    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi")
    rules = learn_rules(text_counts(few), picked, **options)
    rows = counted_rows(docs)
    return rows.where(_verdicts(rows, rules)[1]).select("row.*")
