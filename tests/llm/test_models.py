"""The learned operators against plain re-implementations: fit, scores and verdicts."""

from __future__ import annotations

import os
import random
import sys

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import corpus as B  # noqa: E402

from sparkogram.llm import quality_qda, quality_rules, textstats, toxicity_weak  # noqa: E402

SF = "/root/testdata/sf0.001"


def shares(c: dict) -> dict[str, float]:
    """The statistics of one document from its counts, in plain Python."""
    per = lambda a, b: c[a] / max(c[b], 1)
    return {
        "words": np.log1p(c["n_words"]), "word_length": per("word_chars", "n_words"), "symbols": per("n_symbols", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"),
        "repeats": per("n_repeat_words", "n_words"), "distinct": per("n_distinct", "n_words"), "upper": c["n_upper"] / max(c["n_upper"] + c["n_lower"], 1),
        "digits": per("n_digits", "word_chars"), "punct": per("n_punct", "n_words"), "bars": per("n_bars", "n_words"), "bangs": per("n_bangs", "n_words"),
        "end_lines": per("n_end_lines", "n_lines"), "long_words": per("n_long_words", "n_words"), "line_words": np.log1p(per("n_words", "n_lines")),
    }


def test_quality_scores_equal_a_plain_discriminant(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r["score"] for r in quality_qda.quality_scores(textstats.text_counts(docs), labels, F.expr("doc_id % 4 <> 0")).collect()}
    counts = {r["doc_id"]: dict(zip(textstats.COUNTS, textstats.counts((r["text"] or "").encode()), strict=True)) for r in docs.collect()}
    squashed = ("symbols", "dup_lines", "repeats", "upper", "bars", "bangs", "punct", "digits", "long_words")

    def vector(c: dict) -> list[float]:
        s = shares(c)
        return [np.arcsinh(20 * s[k]) for k in squashed] + [s["words"], np.log1p(s["word_length"]), s["distinct"], s["end_lines"], s["line_words"]]

    x = {d: np.array(vector(c)) for d, c in counts.items()}
    y = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] % 4 and r["doc_id"] in x}
    rows = {k: np.array([x[d] for d in y if y[d] == k]) for k in (0, 1)}
    n, dim = len(y), len(next(iter(x.values())))
    pooled = sum((r - r.mean(0)).T @ (r - r.mean(0)) for r in rows.values()) / (n - 2)
    gauss = {}
    for k, r in rows.items():
        cov = 0.7 * np.cov(r.T) + 0.3 * pooled
        gauss[k] = (r.mean(0), 0.95 * cov + 0.05 * np.trace(cov) / dim * np.eye(dim), np.log(len(r) / n))

    def density(v: np.ndarray, k: int) -> float:
        mean, cov, prior = gauss[k]
        return prior - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (v - mean) @ np.linalg.solve(cov, v - mean)

    margin = {d: density(v, 1) - density(v, 0) for d, v in x.items()}
    # calibration: the penalised likelihood of smoothed targets, by plain gradient steps
    ids = sorted(y)
    m, t = np.array([margin[d] for d in ids]), np.array([float(y[d]) for d in ids])
    scale = m.std()
    z = np.column_stack([np.clip(m / scale, -20, 20), np.ones(len(m))])
    goal = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))
    w = np.array([1.0, 0.0])
    for _ in range(200_000):
        g = z.T @ (1 / (1 + np.exp(-z @ w)) - goal) + 1e-3 * w
        w -= 0.05 * g
        if np.abs(g).max() < 1e-10:
            break
    for d, s in got.items():
        plain = 1 / (1 + np.exp(-np.clip(w[0] / scale * margin[d] + w[1], -40, 40)))
        assert abs(s - plain) < 1e-5
    again = {r["doc_id"]: r["score"] for r in quality_qda.quality_scores(textstats.text_counts(docs.repartition(7)), labels, F.expr("doc_id % 4 <> 0")).collect()}
    assert again == got  # sums do not depend on the order of the rows


def plain_list(x: dict[str, list[float]], bad: list[bool], part: list[bool], max_tests: int = 4, precision: float = 0.9, least: int = 5, steps: int = 256) -> list[list[tuple]]:
    """Sequential covering without arrays: every threshold tried by counting rows."""
    holds = lambda rule, i: all(x[f][i] >= v if op == ">=" else x[f][i] <= v for f, op, v in rule)
    left, rules = set(range(len(bad))), []
    while len(rules) < 16 and sum(bad[i] for i in left) >= least:
        inside, rule = [i for i in sorted(left) if part[i]], []
        while len(rule) < max_tests and 0 < sum(bad[i] for i in inside) < len(inside):
            p0 = sum(bad[i] for i in inside) / len(inside)
            best, test = 1e-9, None
            for f in x:
                values = sorted(x[f][i] for i in inside)
                tried = sorted({float(v) for v in np.quantile(np.array(values), np.linspace(0, 1, steps), method="nearest")})
                for op in (">=", "<="):
                    top = (-1.0, None)
                    for v in tried:
                        rows = [i for i in inside if (x[f][i] >= v if op == ">=" else x[f][i] <= v)]
                        p = sum(bad[i] for i in rows)
                        gain = p * (np.log2(p / len(rows)) - np.log2(p0)) if p else -1.0
                        if gain > top[0]:
                            top = (gain, v)
                    if top[0] > best:
                        best, v = top
                        beside = [u for u in values if (u < v if op == ">=" else u > v)]
                        edge = v if not beside else (v + (max(beside) if op == ">=" else min(beside))) / 2
                        test = (f, op, edge)
            if test is None:
                break
            rule.append(test)
            inside = [i for i in inside if holds([test], i)]

        def worth(k: int, rule: list = rule, left: set = left) -> tuple:
            rows = [i for i in left if not part[i] and holds(rule[:k], i)]
            p = sum(bad[i] for i in rows)
            return ((2 * p - len(rows)) / len(rows) if rows else -1.0, -k)

        rule = rule[: max(range(1, len(rule) + 1), key=worth, default=0)]
        hit = [i for i in left if holds(rule, i)]
        p = sum(bad[i] for i in hit)
        if not rule or p < least or p < precision * len(hit):
            break
        rules.append(rule)
        left -= set(hit)
    return rules


def test_rules_and_verdicts_equal_plain_covering(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    quality = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] in texts}
    stats = {d: shares(dict(zip(textstats.COUNTS, textstats.counts(t.encode()), strict=True))) for d, t in texts.items()}
    ids = sorted(quality)
    x = {f: [float(stats[d][f]) for d in ids] for f in next(iter(stats.values()))}
    bad = [quality[d] == 0 for d in ids]
    part = (np.random.default_rng(7).random(len(ids)) < 2 / 3).tolist()
    want = plain_list(x, bad, part)
    got = quality_rules.learn_list({f: np.array(v) for f, v in x.items()}, np.array(bad))
    assert want and [[(t.feature, t.op) for t in r] for r in got] == [[t[:2] for t in r] for r in want]
    assert np.allclose([t.threshold for r in got for t in r], [t[2] for r in want for t in r])
    for r in quality_rules.quality_report(docs, labels).collect():
        n, chars, symbols, dup, repeat = B.base_counts(texts[r["doc_id"]])
        failed = n < 50 or 100 * repeat > 50 * n
        fires = any(all(stats[r["doc_id"]][f] >= v if op == ">=" else stats[r["doc_id"]][f] <= v for f, op, v in rule) for rule in want)
        assert (r["base_failed"], r["kept"]) == (failed, not failed and not fires)


def test_toxicity_posterior_equals_plain_enumeration():
    """log P(votes, class) summed voter by voter along the forest, silent voters included."""
    rng = random.Random(9)
    m = 7
    parent = np.array([-1, 0, 0, 1, -1, 4, -1])
    rate = np.array([[[rng.uniform(0.01, 0.6) for _ in range(m)] for _ in range(2)] for _ in range(2)])
    model = toxicity_weak.LabelModel(parent, rate, np.zeros(m), np.zeros(m), 0.15)
    rows = [sorted(rng.sample(range(m), rng.randrange(m))) for _ in range(60)]
    for row, got in zip(rows, model.posterior(toxicity_weak.Votes(rows, m)), strict=True):
        logs = []
        for y in (0, 1):
            total = np.log(0.15 if y else 0.85)
            for j in range(m):
                p = rate[y, int(parent[j] in row if parent[j] >= 0 else 0), j]
                total += np.log(p if j in row else 1 - p)
            logs.append(total)
        assert abs(got - 1 / (1 + np.exp(logs[0] - logs[1]))) < 1e-9


def test_toxicity_scores_equal_a_plain_pass(spark):
    """The distributed scores are those of the trained weights over every whole text."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r["score"] for r in toxicity_weak.toxicity_scores(docs, labels, F.lit(True)).collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    y = {r["doc_id"]: int(r["toxic"] > 0) for r in labels.collect() if r["doc_id"] in texts}
    # the sample: of texts with one least shingle the toxic one with the smallest id
    near: dict = {}
    for d in sorted(y, key=lambda d: (-y[d], d)):
        s = toxicity_weak.shingle_set(texts[d])
        near.setdefault(int(s[0]) if len(s) else (d,), d)
    sample = sorted(near.values())
    count: dict[bytes, list[int]] = {}
    for d in sample:
        for t in toxicity_weak.terms(texts[d]):
            count.setdefault(t, [0, 0])[y[d]] += 1
    toxic, share = sum(y[d] for d in sample), sum(y[d] for d in sample) / len(sample)

    def tied(n0: int, n1: int) -> bool:
        n, expected = n0 + n1, (n0 + n1) * share
        gain = 2 * ((n1 * np.log(n1 / expected) if n1 else 0) + (n0 * np.log(n0 / (n - expected)) if n0 else 0))
        return (n1 >= 4 and n1 >= 0.7 * (n + 1)) or (n1 <= 0.25 * expected and gain >= 9)

    mined = sorted((t, n1, n0 + n1) for t, (n0, n1) in count.items() if tied(n0, n1))
    voters = {t: i for i, (t, _, _) in enumerate(mined)}
    assert voters
    fire = lambda d: sorted(voters[t] for t in toxicity_weak.terms(texts[d]) if t in voters)
    size = lambda ids: np.array([len(toxicity_weak.alnum_words(texts[d])) for d in ids])
    model = toxicity_weak.train_classifier(mined, [fire(d) for d in sample], size(sample), toxic)
    ids = sorted(texts)
    want = model.score([fire(d) for d in ids], size(ids))
    assert np.allclose([got[d] for d in ids], want, atol=1e-9)
