"""Keypoint matching and candidate pairs.

Keypoints: image_id, kp_id, descriptor array<double>.  Matching packs an image's
descriptors into one block row, so that a pair of images is one small matrix
product on an executor and its cost does not grow with the number of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkogram.kernels.match import ratio_pairs
from sparkogram.operators.observations import dense_ids
from sparkogram.runtime import cut

MATCHES = "img_i int, img_j int, ord int, kp_i int, kp_j int, distance double"


def root_sift(descriptor: str) -> F.Column:
    """Hellinger mapping: L1-normalise, then square root; zero vectors stay zero."""
    total = F.aggregate(descriptor, F.lit(0.0), lambda s, x: s + F.abs(x))
    return F.transform(descriptor, lambda x: F.sqrt(F.abs(x) / F.greatest(total, F.lit(1e-7))))


def feature_blocks(keypoints: DataFrame) -> DataFrame:
    """One row per image: image_id, n, and its keypoints in kp_id order (bounded by the feature limit per image)."""
    packed = keypoints.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("kp_id", "descriptor"))).alias("k"))
    return packed.select("image_id", F.size("k").alias("n"), F.col("k.kp_id").alias("kp"), F.flatten("k.descriptor").alias("desc"))


def all_pairs(images: DataFrame) -> DataFrame:
    """(img_i, img_j) with img_i < img_j: every pair of images is what exhaustive matching is asked for."""
    ids = images.select("image_id").distinct()
    return ids.alias("a").join(ids.alias("b"), F.expr("a.image_id < b.image_id")).select(
        F.col("a.image_id").alias("img_i"), F.col("b.image_id").alias("img_j")
    )


def band_pairs(images: DataFrame, window: int = 5) -> DataFrame:
    """Images at most ``window`` ranks apart; ``images`` has image_id and rank (0, 1, ...)."""
    left = images.select(F.col("image_id").alias("img_i"), F.explode(F.sequence(F.col("rank") + 1, F.col("rank") + window)).alias("rank"))
    return left.join(images.select(F.col("image_id").alias("img_j"), "rank"), "rank").select("img_i", "img_j")


def canonical_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs as (smaller, larger), without repeats and self pairs."""
    return (
        pairs.where("img_i <> img_j")
        .select(F.least("img_i", "img_j").alias("img_i"), F.greatest("img_i", "img_j").alias("img_j"))
        .distinct()
    )


def _match_batches(ratio: float, mutual: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                img_i, img_j = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                kp = [np.asarray(batch.column(c)[i].values) for c in (2, 4)]
                desc = [np.asarray(batch.column(c)[i].values, dtype=np.float64).reshape(len(k), -1) for c, k in ((3, kp[0]), (5, kp[1]))]
                a, b, d = ratio_pairs(desc[0], desc[1], ratio, mutual)
                n = len(a)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, img_i, np.int32)),
                        pa.array(np.full(n, img_j, np.int32)),
                        pa.array(np.arange(n, dtype=np.int32)),
                        pa.array(kp[0][a].astype(np.int32)),
                        pa.array(kp[1][b].astype(np.int32)),
                        pa.array(d),
                    ],
                    names=["img_i", "img_j", "ord", "kp_i", "kp_j", "distance"],
                )

    return run


def match_pairs(keypoints: DataFrame, pairs: DataFrame, ratio: float = 0.75, cross_check: bool = True, min_matches: int = 0) -> DataFrame:
    """Matches of the given image pairs: ratio test, from both sides with ``cross_check``.

    The pair table is spread evenly and joined with the feature blocks of either
    side; pairs with fewer than ``min_matches`` matches are dropped.
    """
    blocks = feature_blocks(keypoints).where("n >= 2")
    side = lambda s: blocks.select(F.col("image_id").alias(f"img_{s}"), F.col("kp").alias(f"kp_{s}"), F.col("desc").alias(f"desc_{s}"))
    rows = pairs.join(side("i"), "img_i").join(side("j"), "img_j").select("img_i", "img_j", "kp_i", "desc_i", "kp_j", "desc_j")
    found = rows.mapInArrow(_match_batches(ratio, cross_check), MATCHES)
    return at_least(found, min_matches) if min_matches > 1 else found


def pair_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("img_i", "img_j").agg(F.count("*").alias("n_matches"))


def at_least(matches: DataFrame, min_matches: int) -> DataFrame:
    """Matches of pairs that have at least ``min_matches``."""
    enough = pair_counts(matches).where(F.col("n_matches") >= min_matches).select("img_i", "img_j")
    return matches.join(enough, ["img_i", "img_j"], "left_semi")


def symmetric(matches: DataFrame) -> DataFrame:
    """Matches seen from either image: (image_id, other_id, kp, other_kp, ord)."""
    return matches.select(
        F.col("img_i").alias("image_id"), F.col("img_j").alias("other_id"), F.col("kp_i").alias("kp"), F.col("kp_j").alias("other_kp"), "ord"
    ).unionAll(matches.select("img_j", "img_i", "kp_j", "kp_i", "ord"))


# ---- retrieval -----------------------------------------------------------------------------


def top_pairs(scores: DataFrame, k: int) -> DataFrame:
    """Pairs that either side ranks among its k best; ``scores``: image_id, other_id, score (both directions)."""
    best = W.partitionBy("image_id").orderBy(F.desc("score"), "other_id")
    ranked = scores.where("image_id <> other_id").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return canonical_pairs(ranked.select(F.col("image_id").alias("img_i"), F.col("other_id").alias("img_j")))


def dot(a: str, b: str) -> F.Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: str) -> F.Column:
    """L2-normalised vector; vectors of norm up to 1e-10 stay as they are."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 1e-10, F.transform(v, lambda x: x / norm)).otherwise(F.col(v))


def _block_top(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for i in range(batch.num_rows):
                ids = [np.asarray(batch.column(c)[i].values) for c in (0, 2)]
                a, b = (np.asarray(batch.column(c)[i].values).reshape(len(x), -1) for c, x in zip((1, 3), ids, strict=True))
                s = a @ b.T
                s[ids[0][:, None] == ids[1][None, :]] = -np.inf
                n = min(k, s.shape[1])
                best = np.argpartition(-s, n - 1, axis=1)[:, :n] if n < s.shape[1] else np.tile(np.arange(n), (len(s), 1))
                out.append((np.repeat(ids[0], n), ids[1][best].ravel(), np.take_along_axis(s, best, axis=1).ravel()))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 2 + [np.empty(0)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["image_id", "other_id", "score"])

    return run


def cosine_top(vectors: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """(image_id, other_id, score): candidates that hold every image's k most similar others.

    Vectors are packed into blocks; each pair of blocks is one matrix product that
    hands on only its k best per row, so what is shuffled is k rows per image and
    block, never the similarity matrix.
    """
    u = vectors.select(F.col("image_id").cast("long").alias("image_id"), unit("v").alias("v"))
    n = max(1, -(-u.count() // block))
    packed = u.groupBy(F.pmod(F.xxhash64("image_id"), F.lit(n)).alias("b")).agg(F.array_sort(F.collect_list(F.struct("image_id", "v"))).alias("r"))
    packed = packed.select("b", F.col("r.image_id").alias("ids"), F.flatten("r.v").alias("v"))
    left = packed.select(F.col("ids").alias("ids_a"), F.col("v").alias("v_a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("b"))
    pairs = left.join(packed, "b").select("ids_a", "v_a", "ids", "v")
    return pairs.mapInArrow(_block_top(k), "image_id long, other_id long, score double").where("image_id <> other_id")


def term_counts(words: DataFrame) -> DataFrame:
    """Bag of words: (image_id, word) rows to counts."""
    return words.groupBy("image_id", "word").agg(F.count("*").alias("tf"))


def inverse_frequency(tf: DataFrame, n: DataFrame | int | None = None) -> DataFrame:
    """(word, df, idf) with idf = ln((n + 1) / (df + 1)) over n images."""
    total = tf.select(F.countDistinct("image_id").alias("n"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(total)).select("word", "df", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("idf"))


def tfidf(tf: DataFrame) -> DataFrame:
    """L2-normalised tf-idf weights (image_id, word, weight); norms up to 1e-10 are left alone."""
    tf = cut(tf, "tf")  # counted three times, but texts are split once
    raw = tf.join(inverse_frequency(tf), "word").select("image_id", "word", (F.col("tf") * F.col("idf")).alias("w"))
    return raw.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("image_id")))).select(
        "image_id", "word", F.when(F.col("norm") > 1e-10, F.col("w") / F.col("norm")).otherwise(F.col("w")).alias("weight")
    )


def sparse_scores(weights: DataFrame) -> DataFrame:
    """Dot products of images that share a weighted word, both directions."""
    w = weights.where("weight <> 0")
    other = w.select(F.col("image_id").alias("other_id"), "word", F.col("weight").alias("v"))
    return w.join(other, "word").where("image_id <> other_id").groupBy("image_id", "other_id").agg(F.sum(F.col("weight") * F.col("v")).alias("score"))


def sample_per_image(keypoints: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """At most k keypoints of each image in a seeded hash order, without replacement."""
    order = W.partitionBy("image_id").orderBy(F.md5(F.concat_ws(":", F.col("image_id"), F.col("kp_id"), F.lit(seed))), "kp_id")
    return keypoints.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")


def nearest_word(keypoints: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(image_id, kp_id, word): the closest centroid; ``vocabulary`` (word, centre) is bounded by the vocabulary size."""
    words = vocabulary.orderBy("word").collect()
    ids = np.array([r["word"] for r in words], np.int64)
    centres = np.array([r["centre"] for r in words], np.float64)
    sizes = (centres**2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = np.asarray(batch.column(2).flatten(), np.float64).reshape(batch.num_rows, -1)
            out = np.empty(len(d), np.int64)
            for at in range(0, len(d), 1024):
                q = d[at : at + 1024]
                far = sizes - 2 * (q @ centres.T)  # squared distances less the query's own square
                best = far.min(axis=1)
                # products round: what is as near as that is compared by differences, ties to the smaller word
                near = far <= (best + 1e-9 * (1 + np.abs(best)))[:, None]
                pick = near.argmax(axis=1)
                for i in np.flatnonzero(near.sum(axis=1) > 1):
                    some = np.flatnonzero(near[i])
                    pick[i] = some[((q[i] - centres[some]) ** 2).sum(axis=1).argmin()]
                out[at : at + 1024] = ids[pick]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["image_id", "kp_id", "word"])

    return keypoints.select("image_id", "kp_id", "descriptor").mapInArrow(run, "image_id int, kp_id int, word long")


def build_vocabulary(keypoints: DataFrame, n_words: int = 4096, per_image: int = 1000, seed: int = 0, rounds: int = 20) -> DataFrame:
    """k-means centres (word, centre) of sampled descriptors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    pool = sample_per_image(keypoints, per_image, seed).select(array_to_vector("descriptor").alias("features"))
    k = min(n_words, pool.count())
    model = KMeans(k=max(k, 2), maxIter=rounds, seed=seed).fit(pool)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return keypoints.sparkSession.createDataFrame(rows, "word long, centre array<double>")


def candidate_pairs(keypoints: DataFrame, strategy: str = "exhaustive", window: int = 5, top_k: int = 10, vectors: DataFrame | None = None, n_words: int = 4096) -> DataFrame:
    """Image pairs to match: exhaustive, sequential, vocab_tree or retrieval (``vectors`` of a global descriptor).

    Retrieval falls back to all pairs when there are at most top_k + 1 images.
    """
    images = keypoints.select("image_id").distinct()
    if strategy == "sequential":
        return band_pairs(dense_ids(images, "image_id", "rank"), window)
    if strategy in ("vocab_tree", "retrieval") and images.count() > top_k + 1:
        if strategy == "retrieval":
            return top_pairs(cosine_top(vectors, top_k), top_k)
        words = nearest_word(keypoints, build_vocabulary(keypoints, n_words))
        return top_pairs(sparse_scores(tfidf(term_counts(words))), top_k)
    return all_pairs(images)
