"""Toxicity by weak supervision.

1. Voters.  Lexicon voters are words, pattern voters are word beginnings of 4 to
   7 bytes and habits of writing (capitals, exclamation marks, stretched letters,
   masked words).  Those that labelled training documents tie to a class, to
   either one, become voters; each votes for its class when it occurs in a text
   and otherwise abstains.  Voters that always occur together count as one.
2. Label model.  A generative model of the votes, fitted by expectation
   maximisation: the hidden class draws the votes along a forest of dependencies,
   so that a voter's rate depends on the class and on one other voter.  The forest
   joins the voters with the largest mutual information given the class.  It gives
   every voter's accuracy and the correlation along every dependency.
3. Classifier.  A ridge-regularised logistic regression over voter indicators and
   hit density is trained on the posterior labels, and scores every whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkogram.llm.textops import alnum_words, pieces, shingle_set, tidy
from sparkogram.llm.textstats import bounded_sample
from sparkogram.runtime import cut

PREFIXES = (4, 5, 6, 7)
#: Habits of writing that can become voters.
HABITS = {
    b"\1capitals": regex.compile(rb"(?<![A-Za-z])[A-Z]{3,}[^A-Za-z\n]+[A-Z]{3,}(?![A-Za-z])"),
    b"\1marks": regex.compile(rb"[!?]{2,}"),
    b"\1stretched": regex.compile(rb"([A-Za-z])\1{3,}"),
    b"\1masked": regex.compile(rb"(?<![\w*])[A-Za-z]+\*{2,}[A-Za-z]*"),
}


def _begins(word: bytes, k: int) -> bool:
    """Is the first k bytes' end inside the word and no half of a character?"""
    return len(word) > k and word[k] & 0xC0 != 0x80


def terms(text: bytes) -> set[bytes]:
    """Distinct voters a text could fire: words as they are, word beginnings behind a zero byte, habits."""
    words = set(alnum_words(text))
    out = set(words)
    for k in PREFIXES:
        out.update([b"\0" + w[:k] for w in words if _begins(w, k)])
    out.update([name for name, pattern in HABITS.items() if pattern.search(text)])
    return out


def _term_batches():
    """mapInArrow function: (text, label) to (term, toxic, n) counts of documents per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 0):
            found: tuple[Counter, Counter] = (Counter(), Counter())
            for t, y in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), strict=True):
                found[int(y > 0)].update(terms(t.as_py() or b""))
            rows = [(w, y, n) for y in (0, 1) for w, n in found[y].items()]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())], names=["term", "toxic", "n"]
            )

    return run


def _vote_batches(voters: list[bytes]):
    """mapInArrow function: (doc_id, text) to (doc_id, n_words, votes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {v: i for i, v in enumerate(voters)}
        whole = {v for v in voters if v[:1] not in (b"\0", b"\1")}
        begins = [(k, {v[1:]: i for v, i in number.items() if v.startswith(b"\0") and len(v) == k + 1}) for k in PREFIXES]
        begins = [(k, b) for k, b in begins if b]
        habits = [(number[name], pattern) for name, pattern in HABITS.items() if name in number]
        for batch in pieces(batches, 1):
            n, votes = [], []
            for t in batch.column(1).cast(pa.binary()):
                text = t.as_py() or b""
                words = alnum_words(text)
                distinct = set(words)
                hit = {number[w] for w in distinct & whole}
                for k, b in begins:
                    hit.update([b[p] for p in {w[:k] for w in distinct if len(w) > k} & b.keys()])
                hit.update([i for i, pattern in habits if pattern.search(text)])
                n.append(len(words))
                votes.append(sorted(hit))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(votes, pa.list_(pa.int32()))], names=["doc_id", "n_words", "votes"]
            )

    return run


def _near_batches():
    """mapInArrow function: (doc_id, label, text) with the least 5-word shingle, which near copies mostly share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            ids = batch.column(0).to_pylist()
            sets = [shingle_set(t.as_py()) for t in batch.column(2).cast(pa.binary())]
            near = [int(s[:1].view(np.int64)[0]) if len(s) else -1 - abs(i) for i, s in zip(ids, sets, strict=True)]
            label = batch.column(1).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), label, batch.column(2), pa.array(near, pa.int64())], names=["doc_id", "label", "text", "near"])

    return run


VOTES = "doc_id long, n_words long, votes array<int>"


def mine_voters(train: DataFrame, support: int = 4, purity: float = 0.7, rare: float = 0.25, surprise: float = 9.0) -> list[tuple[bytes, int, int]]:
    """(term, toxic, all) of the terms that the training documents tie to a class.

    Toxic voters occur in at least ``support`` toxic documents and, at ``purity``,
    mostly in toxic ones.  Clean voters occur in toxic documents at most ``rare``
    times as often as chance would have it, with a log-likelihood ratio of at
    least ``surprise``.  One aggregation counts every term of the bounded sample
    in both classes; every term that passes becomes a voter.
    """
    counts = train.select("text", "label").mapInArrow(tidy(_term_batches()), "term binary, toxic int, n long")
    got = counts.groupBy("term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum("n").alias("n")
    )
    toxic, total = train.agg(F.sum((F.col("label") > 0).cast("long")), F.count("*")).first()
    share = (toxic or 0) / max(total, 1)
    p, n = F.col("p"), F.col("n")
    tied = (p >= support) & (p >= F.lit(purity) * (n + 1))
    if 0 < share < 1:
        expected = n * F.lit(share)
        gain = F.lit(2.0) * (F.when(p > 0, p * F.log(p / expected)).otherwise(0.0) + (n - p) * F.log((n - p) / (n - expected)))
        tied = tied | ((p <= F.lit(rare) * expected) & (gain >= surprise))
    return sorted((bytes(r["term"]), r["p"], r["n"]) for r in got.where(tied).collect())


class Votes:
    """A sparse 0/1 matrix of documents and voters."""

    def __init__(self, rows: list[list[int]], voters: int):
        self.n, self.m = len(rows), voters
        self.size = np.array([len(r) for r in rows], np.int64)
        self.row = np.repeat(np.arange(self.n), self.size)
        self.voter = np.concatenate([np.asarray(r, np.int64) for r in rows]) if rows else np.empty(0, np.int64)
        self.key = self.row * max(self.m, 1) + self.voter  # ascending

    def per_voter(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.voter, weights=weight[self.row], minlength=self.m)

    def per_row(self, value: np.ndarray) -> np.ndarray:
        """Sums over a row's entries of a value per entry."""
        return np.bincount(self.row, weights=value, minlength=self.n)

    def has(self, row: np.ndarray, voter: np.ndarray) -> np.ndarray:
        key = row * max(self.m, 1) + voter
        at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        return (voter >= 0) & (self.key[at] == key) if len(self.key) else np.zeros(len(key), bool)

    def merged(self) -> tuple[Votes, np.ndarray]:
        """Without voters that fire in the same rows as an earlier one, and the number of each voter's first twin."""
        order = np.lexsort((self.row, self.voter))
        ends = np.cumsum(np.bincount(self.voter, minlength=self.m))
        rows = np.split(self.row[order], ends[:-1]) if self.m else []
        first: dict[bytes, int] = {}
        twin = np.array([first.setdefault(r.tobytes(), j) for j, r in enumerate(rows)], np.int64)
        kept = np.unique(twin)
        number = np.full(self.m, -1)
        number[kept] = np.arange(len(kept))
        split = np.split(self.voter, np.cumsum(self.size)[:-1]) if self.n else []
        return Votes([number[v][number[v] >= 0].tolist() for v in split], len(kept)), twin


@dataclass(frozen=True)
class LabelModel:
    """Rates of every voter given the class (first axis) and its parent's vote (second), accuracies, correlations, prior."""

    parent: np.ndarray  # -1: none
    rate: np.ndarray  # 2 x 2 x voters: [class, parent's vote]
    accuracy: np.ndarray
    correlation: np.ndarray  # with the parent, among texts of the class the voter votes for
    prior: float

    def posterior(self, votes: Votes) -> np.ndarray:
        """P(toxic | votes): silent voters count too, by their parent's vote."""
        off = np.log(1 - self.rate[1]) - np.log(1 - self.rate[0])
        on = np.log(self.rate[1]) - np.log(self.rate[0])
        moved = np.zeros(votes.m)  # what a vote changes for the voters that hang on it
        has = self.parent >= 0
        np.add.at(moved, self.parent[has], (off[1] - off[0])[has])
        with_parent = votes.has(votes.row, self.parent[votes.voter]).astype(int)
        own = (on - off)[with_parent, votes.voter]
        z = np.log(self.prior / (1 - self.prior)) + off[0].sum() + votes.per_row(own + moved[votes.voter])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def dependencies(votes: Votes, post: np.ndarray, least: float = 14.0) -> np.ndarray:
    """Parent of every voter (-1: none): a maximum spanning forest by mutual information given the class.

    Only pairs that occur together and whose likelihood-ratio statistic reaches
    ``least`` are joined; trees hang on their most frequent voter.
    """
    parent = np.full(votes.m, -1)
    starts = np.concatenate([[0], np.cumsum(votes.size)])
    together: list[np.ndarray] = []
    rows: list[np.ndarray] = []
    for i in np.flatnonzero(votes.size > 1).tolist():
        v = votes.voter[starts[i] : starts[i + 1]]
        a, b = np.triu_indices(len(v), 1)
        together.append(v[a] * votes.m + v[b])
        rows.append(np.full(len(a), i))
    if not together:
        return parent
    pair, at = np.unique(np.concatenate(together), return_inverse=True)
    row = np.concatenate(rows)
    a, b = pair // votes.m, pair % votes.m
    statistic = np.zeros(len(pair))
    for weight in (post, 1 - post):
        total, single = weight.sum(), votes.per_voter(weight)
        both = np.bincount(at, weights=weight[row], minlength=len(pair))
        for x, p, q in ((both, single[a], single[b]), (single[a] - both, single[a], total - single[b]), (single[b] - both, total - single[a], single[b]), (total - single[a] - single[b] + both, total - single[a], total - single[b])):
            x = np.maximum(x, 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                statistic += np.where(x > 1e-9, 2 * x * np.log(np.maximum(x, 1e-12) * total / np.maximum(p * q, 1e-12)), 0.0)
    root = list(range(votes.m))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    joined: dict[int, list[int]] = {}
    for k in np.lexsort((pair, -statistic)).tolist():
        if statistic[k] < least:
            break
        x, y = find(int(a[k])), find(int(b[k]))
        if x != y:
            root[x] = y
            joined.setdefault(int(a[k]), []).append(int(b[k]))
            joined.setdefault(int(b[k]), []).append(int(a[k]))
    seen = np.zeros(votes.m, bool)
    for top in np.argsort(-votes.per_voter(np.ones(votes.n)), kind="stable").tolist():
        todo = [] if seen[top] else [top]
        seen[top] = True
        while todo:
            x = todo.pop()
            for y in joined.get(x, ()):
                if not seen[y]:
                    seen[y], parent[y] = True, x
                    todo.append(y)
    return parent


def fit_label_model(votes: Votes, prior: float, mined: tuple[np.ndarray, np.ndarray], worth: float = 1.0, rounds: int = 40) -> LabelModel:
    """Expectation maximisation over the votes.

    ``mined`` are the voters' rates on toxic and on other training texts: the
    first guess, and then pseudo-counts worth ``worth`` times the data.  Voters that
    hardly ever fire together leave it open which of them mean the class, and with
    less than the data's worth one group of them takes it over.  The forest is
    chosen by the first posterior and once more by a later one.
    """
    n, m = votes.n, votes.m
    guess = np.clip(np.stack([mined[1], mined[0]]), 1e-6, 1 - 1e-4)
    rate = np.stack([guess, guess], axis=1)
    model = LabelModel(np.full(m, -1), rate, np.zeros(m), np.zeros(m), float(np.clip(prior, 1e-3, 0.5)))
    post = model.posterior(votes)
    for i in range(rounds):
        if i in (0, 5):
            parent = dependencies(votes, post)
            with_parent = votes.has(votes.row, parent[votes.voter])
        share = float(np.clip((post.sum() + worth * prior * n) / ((1 + worth) * n), 1e-3, 0.5))
        rate, single, both = np.empty((2, 2, m)), np.empty((2, m)), np.empty((2, m))
        for y, weight in enumerate((1 - post, post)):
            total, pseudo = weight.sum(), worth * max((prior if y else 1 - prior) * n, 1.0)
            single[y] = votes.per_voter(weight)
            both[y] = np.bincount(votes.voter[with_parent], weights=weight[votes.row[with_parent]], minlength=m)
            up = np.where(parent >= 0, single[y][parent], 0.0)
            rate[y, 0] = (single[y] - both[y] + pseudo * guess[y]) / (total - up + pseudo)
            # a parent's vote that was hardly ever seen says little: two pseudo-counts at the rate without it
            rate[y, 1] = (both[y] + 2 * rate[y, 0]) / (up + 2)
        rate = np.clip(rate, 1e-6, 1 - 1e-4)
        all1, all0 = (single[1] + worth * prior * n * guess[1]), (single[0] + worth * (1 - prior) * n * guess[0])
        toward = guess[1] >= guess[0]
        accuracy = np.where(toward, all1, all0) / np.maximum(all1 + all0, 1e-9)
        model = LabelModel(parent, rate, accuracy, _phi(single, both, post, parent, toward), share)
        new = model.posterior(votes)
        moved, post = np.abs(new - post).max(initial=0.0), new
        if moved < 1e-6 and i > 5:
            break
    return model


def _phi(single: np.ndarray, both: np.ndarray, post: np.ndarray, parent: np.ndarray, toward: np.ndarray) -> np.ndarray:
    """Correlation of every voter with its parent among texts of the class that the voter votes for."""
    total = np.where(toward, post.sum(), (1 - post).sum())
    p = np.where(toward, single[1], single[0]) / total
    q = np.where(parent >= 0, np.where(toward, single[1][parent], single[0][parent]), 0.0) / total
    joint = np.where(toward, both[1], both[0]) / total
    spread = np.sqrt(np.maximum(p * (1 - p) * q * (1 - q), 1e-12))
    return np.where(parent >= 0, np.clip((joint - p * q) / spread, -1, 1), 0.0)


#: Inputs of the classifier besides the voters: hits of toxic voters, their density, a constant.
EXTRA = 3


def _extra(hits: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    return np.column_stack([np.log1p(hits), hits / np.sqrt(1.0 + n_words), np.ones(len(hits))])


def fit_linear(votes: Votes, extra: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 2000) -> np.ndarray:
    """Logistic regression on soft targets; weights of the voters, then of ``extra``.

    Accelerated descent under a diagonal bound of the curvature, restarted when
    it overshoots, so no voter-by-voter matrix is formed; the constant is hardly penalised.
    """
    m, e = votes.m, extra.shape[1]
    penalty = np.full(m + e, ridge)
    penalty[-1] = 1e-3
    reach = votes.size + np.abs(extra).sum(axis=1)
    bound = 0.25 * np.concatenate([votes.per_voter(reach), np.abs(extra).T @ reach]) + penalty
    w = np.zeros(m + e)
    look, speed = w, 1.0
    for _ in range(rounds):
        z = votes.per_row(look[votes.voter]) + extra @ look[m:]
        miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        new = look - (np.concatenate([votes.per_voter(miss), extra.T @ miss]) + penalty * look) / bound
        if (look - new) @ (bound * (new - w)) > 0:
            look, speed = w, 1.0
            if np.abs(new - w).max() < 1e-6:
                break
            z = votes.per_row(w[votes.voter]) + extra @ w[m:]
            miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
            new = w - (np.concatenate([votes.per_voter(miss), extra.T @ miss]) + penalty * w) / bound
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        step = new - w
        look, speed, w = new + (speed - 1) / faster * step, faster, new
        if np.abs(step).max() < 1e-7:
            break
    return w


@dataclass(frozen=True)
class Classifier:
    """Voters with their weights, which of them vote toxic, and the weights of the other inputs."""

    voters: list[bytes]
    weight: np.ndarray
    toxic: np.ndarray
    extra: np.ndarray

    def score(self, votes: list[list[int]], n_words: np.ndarray) -> np.ndarray:
        size = [len(v) for v in votes]
        row = np.repeat(np.arange(len(votes)), size)
        voter = np.concatenate([np.asarray(v, np.int64) for v in votes]) if votes else np.empty(0, np.int64)
        hits = np.bincount(row, weights=self.toxic[voter], minlength=len(votes))
        z = np.bincount(row, weights=self.weight[voter], minlength=len(votes)) + _extra(hits, n_words) @ self.extra
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train_classifier(mined: list[tuple[bytes, int, int]], votes: list[list[int]], n_words: np.ndarray, toxic: int) -> Classifier:
    """Label model and classifier from the votes of ``len(votes)`` training texts, ``toxic`` of them labelled so."""
    total = len(votes)
    every = Votes(votes, len(mined))
    once, twin = every.merged()
    kept = np.unique(twin)
    p, n = (np.array([mined[j][i] for j in kept], float) for i in (1, 2))
    rates = (p + 0.5) / (toxic + 1), (n - p + 0.1) / (total - toxic + 1)
    model = fit_label_model(once, toxic / total, rates)
    toward = rates[0] >= rates[1]
    hits = once.per_row(toward[once.voter].astype(float))
    w = fit_linear(once, _extra(hits, n_words), model.posterior(once))
    # twins fired together in every training text; elsewhere each counts as a part of the whole
    place = np.searchsorted(kept, twin)
    share = 1 / np.bincount(place)[place]
    return Classifier([v for v, _, _ in mined], w[place] * share, toward[place] * share, w[once.m :])


def score_batches(model: Classifier | None):
    """mapInArrow function: (doc_id, text) to (doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in _vote_batches(model.voters if model else [])(batches):
            score = model.score(got.column(2).to_pylist(), got.column(1).to_numpy()) if model else np.full(got.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([got.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return run


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, train: Column, threshold: float = 0.3, max_rows: int = 12_000, **mining
) -> DataFrame:
    """(doc_id, score, predicted) of every whole text of ``docs`` (doc_id, text).

    ``labels`` (doc_id, toxic) are used where ``train``, a column over doc_id,
    holds, and of those at most ``max_rows`` (by a hash order; a documented bound
    on what is mined and what the driver holds of votes), one of near copies.
    Defined results: a null
    or empty text fires no voter and gets the score of that; repeated and null ids
    keep a row each, and a labelled id with several texts is learned from the
    one with the smallest hash; labels with nulls are ignored, of contradicting
    ones the higher counts; without toxic training rows every score is 0.5; an
    empty table gives no rows; other columns are ignored.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    one = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("label"))
    one = one.where("label is not null and doc_id is not null").where(train).groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = cut(bounded_sample(one, max_rows), "picked")
    rows = src.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    rows = rows.select("doc_id", "label", "t.text").mapInArrow(tidy(_near_batches()), "doc_id long, label int, text string, near long")
    # of near copies one is learned from: their shared words would pass for signs of their class
    first = F.max(F.struct("label", (-F.col("doc_id")).alias("rank"), "doc_id", "text")).alias("t")
    rows = cut(rows.groupBy("near").agg(first).select("t.doc_id", "t.label", "t.text"), "train")
    mined = mine_voters(rows, **mining)
    model = None
    toxic = rows.where("label > 0").count()
    if mined and toxic:
        got = rows.select("doc_id", "text").mapInArrow(tidy(_vote_batches([v for v, _, _ in mined])), VOTES).orderBy("doc_id").toPandas()
        model = train_classifier(mined, [list(v) for v in got["votes"]], got["n_words"].to_numpy(), toxic)
    out = src.mapInArrow(tidy(score_batches(model)), "doc_id long, score double")
    return out.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
