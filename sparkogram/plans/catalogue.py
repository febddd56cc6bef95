"""The registered queries of the reconstruction engine and their SQL.

The driver's tables stand in for pipeline relations: embeddings are descriptors
(label = image), positions and global image vectors; lineitem rows observe a part
(point) from a supplier (image); events are an image sequence; documents are bags
of words.  Every query runs over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkogram.operators import cloud as C
from sparkogram.operators import matching as M
from sparkogram.operators import mesh as X
from sparkogram.operators import observations as O
from sparkogram.operators import poses as P
from sparkogram.operators import reports as R
from sparkogram.operators import tracks as T
from sparkogram.operators.focal import focal_routes
from sparkogram.runtime import cut, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

RATIO = 0.95


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def longs(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


# ---- bindings ------------------------------------------------------------------------------


def keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return e.select(F.col("label").alias("image_id"), number.alias("kp_id"), F.col("embedding").cast("array<double>").alias("descriptor"))


def mutual(spark: SparkSession, sf_dir: str) -> DataFrame:
    kp = keypoints(spark, sf_dir)
    return M.match_pairs(kp, M.all_pairs(kp), RATIO, cross_check=True)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("image_id"), F.col("l_partkey").alias("point_id"), F.col("l_quantity").alias("x"),
        F.col("l_extendedprice").alias("y"), F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"),
    )


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.col("embedding").getItem(i).cast("double")
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return e.select(F.col("vec_id").alias("pid"), *(at(i).alias(c) for i, c in enumerate("xyz")), *(((at(i + 3) + 1) / 2).alias(c) for i, c in enumerate("rgb")))


def strip(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A triangle strip over consecutive cloud points, broken after every 40th."""
    v = cloud(spark, sf_dir).select(F.col("pid").alias("vid"), "x", "y", "z")
    ids = v.select("vid")
    f = ids.join(ids.select((F.col("vid") - 2).alias("vid")), "vid").where("vid % 40 < 38")
    return f.select(F.col("vid").alias("fid"), F.col("vid").alias("a"), (F.col("vid") + 1).alias("b"), (F.col("vid") + 2).alias("c")), v


KP = """kp AS (SELECT label AS image_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS kp_id,
  embedding::DOUBLE[] AS descriptor FROM embeddings)"""
FORWARD = f"""{KP}, d AS (
  SELECT a.image_id AS img_i, b.image_id AS img_j, a.kp_id AS kp_i, b.kp_id AS kp_j, list_distance(a.descriptor, b.descriptor) AS d
  FROM kp a JOIN kp b ON a.image_id < b.image_id
), f AS (
  SELECT *, row_number() OVER w AS k, lead(d) OVER w AS d2 FROM d WINDOW w AS (PARTITION BY img_i, img_j, kp_i ORDER BY d, kp_j)
), fwd AS (SELECT * FROM f WHERE k = 1 AND d < {RATIO} * d2)"""
MUTUAL = f"""{FORWARD}, g AS (
  SELECT *, row_number() OVER w AS k, lead(d) OVER w AS d2 FROM d WINDOW w AS (PARTITION BY img_i, img_j, kp_j ORDER BY d, kp_i)
), m AS (
  SELECT fwd.img_i, fwd.img_j, row_number() OVER (PARTITION BY fwd.img_i, fwd.img_j ORDER BY fwd.kp_i, fwd.kp_j) - 1 AS ord,
    fwd.kp_i, fwd.kp_j, fwd.d FROM fwd JOIN g ON g.k = 1 AND g.d < {RATIO} * g.d2
  AND g.img_i = fwd.img_i AND g.img_j = fwd.img_j AND g.kp_i = fwd.kp_i AND g.kp_j = fwd.kp_j
)"""
COMPONENTS = f"""{MUTUAL}, e AS (
  SELECT img_i * 16777216::BIGINT + kp_i AS a, img_j * 16777216::BIGINT + kp_j AS b FROM m
), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (
  SELECT a, a AS b FROM s UNION SELECT reach.a, s.b FROM reach JOIN s ON reach.b = s.a
), cc AS (
  SELECT min(b) AS component, a // 16777216 AS image_id, a % 16777216 AS kp_id FROM reach GROUP BY a
)"""
TRACKS = f"""{COMPONENTS}, once AS (
  SELECT component, image_id, min(kp_id) AS kp_id FROM cc GROUP BY component, image_id HAVING count(*) = 1
), tr AS (
  SELECT component AS track_id, image_id, kp_id FROM once
  WHERE component IN (SELECT component FROM once GROUP BY component HAVING count(*) BETWEEN 2 AND 200)
)"""
OBS = """obs AS (SELECT l_suppkey AS image_id, l_partkey AS point_id, l_quantity AS x, l_extendedprice AS y,
  l_orderkey AS ord, l_linenumber AS line FROM lineitem), seen AS (SELECT DISTINCT image_id, point_id FROM obs)"""
COVIS = f"""{OBS}, cov AS (SELECT a.image_id AS img_a, b.image_id AS img_b, count(*) AS n_shared
  FROM seen a JOIN seen b ON a.point_id = b.point_id AND a.image_id < b.image_id GROUP BY 1, 2)"""
CLOUD = """cloud AS (SELECT vec_id AS pid, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z,
  (embedding[4]::DOUBLE + 1) / 2 AS r, (embedding[5]::DOUBLE + 1) / 2 AS g, (embedding[6]::DOUBLE + 1) / 2 AS b FROM embeddings)"""
NEAR = f"""{CLOUD}, nn AS (
  SELECT a.pid AS qid, b.pid, sqrt((a.x - b.x)**2 + (a.y - b.y)**2 + (a.z - b.z)**2) AS distance,
    row_number() OVER (PARTITION BY a.pid ORDER BY sqrt((a.x - b.x)**2 + (a.y - b.y)**2 + (a.z - b.z)**2), b.pid) AS rank
  FROM cloud a JOIN cloud b ON a.pid <> b.pid)"""
STRIP = f"""{CLOUD}, v AS (SELECT pid AS vid, x, y, z FROM cloud), f AS (
  SELECT a.vid AS fid, a.vid AS a, a.vid + 1 AS b, a.vid + 2 AS c FROM v a JOIN v t ON t.vid = a.vid + 2 WHERE a.vid % 40 < 38
), ed AS (
  SELECT fid, least(p, q) AS u, greatest(p, q) AS w FROM (
    SELECT fid, a AS p, b AS q FROM f UNION ALL SELECT fid, b, c FROM f UNION ALL SELECT fid, c, a FROM f)
)"""


# ---- matching and retrieval ----------------------------------------------------------------


@query(f"WITH {FORWARD} SELECT img_i, img_j, kp_i, kp_j, round(d, 6) AS distance FROM fwd")
def ratio_matches(spark, sf_dir):
    """Two nearest descriptors and the ratio test."""
    kp = keypoints(spark, sf_dir)
    got = M.match_pairs(kp, M.all_pairs(kp), RATIO, cross_check=False)
    return longs(rounded(got.drop("ord")))


@query(f"WITH {MUTUAL} SELECT img_i, img_j, ord, kp_i, kp_j, round(d, 6) AS distance FROM m")
def mutual_matches(spark, sf_dir):
    """Ratio matches that agree from both sides."""
    return longs(rounded(mutual(spark, sf_dir)))


@query(f"WITH {MUTUAL} SELECT img_i, img_j, count(*) AS n_matches FROM m GROUP BY 1, 2 HAVING count(*) >= 3")
def pair_counts_min(spark, sf_dir):
    """Image pairs with at least three matches."""
    return longs(M.pair_counts(M.at_least(cut(mutual(spark, sf_dir), "matches"), 3)))


@query("""WITH r AS (SELECT event_id AS image_id, row_number() OVER (ORDER BY ts, event_id) AS rk FROM events)
SELECT a.image_id AS img_i, b.image_id AS img_j FROM r a JOIN r b ON b.rk BETWEEN a.rk + 1 AND a.rk + 5""")
def sequential_pairs(spark, sf_dir):
    """Band join of a sequence."""
    seq = table(spark, sf_dir, "events", "event_id", "ts").select(F.col("event_id").alias("image_id"), F.struct("ts", "event_id").alias("key"))
    return M.band_pairs(O.dense_ids(seq, "key", "rank"), 5)


@query("""WITH i AS (SELECT DISTINCT label AS image_id FROM embeddings)
SELECT a.image_id AS img_i, b.image_id AS img_j FROM i a JOIN i b ON a.image_id < b.image_id""")
def exhaustive_pairs(spark, sf_dir):
    """All image pairs."""
    return M.all_pairs(keypoints(spark, sf_dir))


@query("""WITH e AS (SELECT vec_id AS i, embedding::DOUBLE[] AS v FROM embeddings), s AS (
  SELECT a.i, b.i AS j, row_number() OVER (PARTITION BY a.i ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.i) AS k
  FROM e a JOIN e b ON a.i <> b.i)
SELECT DISTINCT least(i, j) AS img_i, greatest(i, j) AS img_j FROM s WHERE k <= 5""")
def cosine_topk_pairs(spark, sf_dir):
    """Every image's five most similar images by global descriptor."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("embedding").cast("array<double>").alias("v"))
    return M.top_pairs(M.cosine_top(v, 5), 5)


def _words(spark, sf_dir, image: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    w = d.select(F.col(image).alias("image_id"), F.explode(F.split("text", "[ \\n\\t\\r]+")).alias("word"))
    return w.where("word <> ''")


def _tf_sql(image: str) -> str:
    return rf"""tf AS (SELECT image_id, word, count(*) AS tf FROM (
  SELECT {image} AS image_id, unnest(regexp_split_to_array(text, '[ \n\t\r]+')) AS word FROM documents) WHERE word <> '' GROUP BY 1, 2
), idf AS (SELECT word, count(*) AS df, ln(((SELECT count(DISTINCT image_id) FROM tf) + 1) / (count(*) + 1)) AS idf FROM tf GROUP BY 1
), raw AS (SELECT image_id, tf.word, tf * idf AS w FROM tf JOIN idf USING (word)
), nrm AS (SELECT image_id, sqrt(sum(w * w)) AS n FROM raw GROUP BY 1
), wt AS (SELECT image_id, word, CASE WHEN n > 1e-10 THEN w / n ELSE w END AS weight FROM raw JOIN nrm USING (image_id))"""


@query(f"WITH {_tf_sql('doc_id')} SELECT image_id, word, tf FROM tf")
def bow_tf(spark, sf_dir):
    """Bag-of-words counts."""
    return M.term_counts(_words(spark, sf_dir, "doc_id"))


@query(f"WITH {_tf_sql('doc_id')} SELECT word, df, round(idf, 6) AS idf FROM idf")
def idf(spark, sf_dir):
    """Inverse document frequencies."""
    return rounded(M.inverse_frequency(bow_tf(spark, sf_dir)))


@query(f"WITH {_tf_sql('doc_id')} SELECT image_id, word, round(weight, 6) AS weight FROM wt")
def tfidf_norm(spark, sf_dir):
    """L2-normalised tf-idf weights."""
    return rounded(M.tfidf(bow_tf(spark, sf_dir)))


@query(f"""WITH {_tf_sql('source')}, sc AS (SELECT a.image_id AS i, b.image_id AS j, sum(a.weight * b.weight) AS s
  FROM wt a JOIN wt b ON a.word = b.word AND a.image_id <> b.image_id WHERE a.weight <> 0 AND b.weight <> 0 GROUP BY 1, 2
), k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(s, 9) DESC, j) AS k FROM sc)
SELECT DISTINCT least(i, j) AS img_i, greatest(i, j) AS img_j FROM k WHERE k <= 3""")
def tfidf_topk_pairs(spark, sf_dir):
    """Top-3 retrieval of the document sources by tf-idf."""
    w = cut(M.tfidf(M.term_counts(_words(spark, sf_dir, "source"))), "tfidf")
    return M.top_pairs(M.sparse_scores(w).withColumn("score", F.round("score", 9)), 3)


@query(f"""WITH {KP}, s AS (SELECT image_id, kp_id, row_number() OVER (PARTITION BY image_id
  ORDER BY md5(concat_ws(':', image_id, kp_id, 0)), kp_id) AS k FROM kp) SELECT image_id, kp_id FROM s WHERE k <= 20""")
def vocab_sample(spark, sf_dir):
    """Seeded sample of 20 keypoints per image (a sampling operator)."""
    return longs(M.sample_per_image(keypoints(spark, sf_dir), 20).select("image_id", "kp_id"))


@query(f"""WITH {KP}, d AS (SELECT image_id, kp_id, vec_id AS word,
  row_number() OVER (PARTITION BY image_id, kp_id ORDER BY list_distance(descriptor, embedding::DOUBLE[]), vec_id) AS k
  FROM kp, embeddings WHERE vec_id < 16) SELECT image_id, kp_id, word FROM d WHERE k = 1""")
def nearest_word(spark, sf_dir):
    """Visual word of every keypoint; the vocabulary is the first 16 vectors."""
    v = table(spark, sf_dir, "embeddings").where("vec_id < 16")
    vocabulary = v.select(F.col("vec_id").alias("word"), F.col("embedding").cast("array<double>").alias("centre"))
    return longs(M.nearest_word(keypoints(spark, sf_dir), vocabulary))


# ---- tracks --------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {COMPONENTS} SELECT component, image_id, kp_id FROM cc")
def components(spark, sf_dir):
    """Connected components of the match graph."""
    return longs(T.match_components(cut(mutual(spark, sf_dir), "matches")))


@query(f"WITH RECURSIVE {TRACKS} SELECT track_id, image_id, kp_id FROM tr")
def tracks_clean(spark, sf_dir):
    """Tracks without images that occur twice."""
    return longs(T.clean_tracks(T.match_components(cut(mutual(spark, sf_dir), "matches"))))


@query(f"""WITH RECURSIVE {TRACKS} SELECT least(n, 12) AS length, count(*) AS n_tracks
  FROM (SELECT track_id, count(*) AS n FROM tr GROUP BY 1) GROUP BY 1""")
def track_hist(spark, sf_dir):
    """Track length histogram: the flagship query."""
    return T.length_histogram(tracks_clean(spark, sf_dir)).select(F.col("length").cast("long").alias("length"), "n_tracks")


@query(f"""WITH RECURSIVE {TRACKS}, per AS (SELECT component, image_id, count(*) AS n FROM cc GROUP BY 1, 2
), c AS (SELECT component, max(n) > 1 AS bad, sum(n) AS nodes FROM per GROUP BY 1
), l AS (SELECT track_id, count(*) AS n FROM tr GROUP BY 1)
SELECT * FROM (SELECT count(*) AS n_components, count(*) FILTER (bad) AS n_conflicted, sum(nodes)::BIGINT AS n_nodes,
  max(nodes)::BIGINT AS largest_component FROM c), (SELECT count(*) AS n_tracks, sum(n)::BIGINT AS n_observations, round(avg(n), 6) AS mean_length,
  round(quantile_cont(n, 0.5), 6) AS median_length, max(n) AS max_length, count(*) FILTER (n = 2) AS n_two_view,
  count(*) FILTER (n >= 3) AS n_three_plus FROM l)""")
def track_stats(spark, sf_dir):
    """Track graph statistics."""
    cc = cut(T.match_components(cut(mutual(spark, sf_dir), "matches")), "components")
    return rounded(longs(T.track_statistics(cc, T.clean_tracks(cc))))


@query(f"""WITH RECURSIVE {COMPONENTS}, k AS (SELECT m.*, cc.component, row_number() OVER (PARTITION BY img_i, img_j, component
  ORDER BY ord, kp_i, kp_j) AS k FROM m JOIN cc ON cc.image_id = img_i AND cc.kp_id = kp_i)
SELECT img_i, img_j, kp_i, kp_j, component, count(*) OVER (PARTITION BY img_i, img_j) AS n_inliers FROM k WHERE k = 1""")
def first_match_per_component(spark, sf_dir):
    """Track merging keeps one match per pair and component."""
    m = cut(mutual(spark, sf_dir), "matches")
    return longs(T.first_match_per_component(m, T.match_components(m)))


@query(f"""WITH RECURSIVE {MUTUAL}, p AS (SELECT img_i, img_j, count(*) AS n FROM m GROUP BY 1, 2 HAVING count(*) >= 6
), s AS (SELECT img_i AS a, img_j AS b FROM p UNION SELECT img_j, img_i FROM p), i AS (SELECT DISTINCT label AS image_id FROM embeddings
), reach AS (SELECT image_id AS a, image_id AS b FROM i UNION SELECT reach.a, s.b FROM reach JOIN s ON reach.b = s.a
), c AS (SELECT a AS image_id, min(b) AS component FROM reach GROUP BY 1), z AS (SELECT component, count(*) AS size FROM c GROUP BY 1)
SELECT image_id, component, size, rank FROM c JOIN (SELECT *, row_number() OVER (ORDER BY size DESC, component) AS rank FROM z) USING (component)""")
def scene_components(spark, sf_dir):
    """Scene graph components over pairs with at least six matches."""
    m = cut(mutual(spark, sf_dir), "matches")
    pairs = M.pair_counts(m).withColumnRenamed("n_matches", "n_inliers")
    return longs(T.image_components(pairs, keypoints(spark, sf_dir), 6))


# ---- observations --------------------------------------------------------------------------


@query(f"""WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY image_id, point_id ORDER BY ord, line, x, y) AS k FROM obs)
SELECT image_id, point_id, x, y FROM r WHERE k = 1""")
def obs_dedupe(spark, sf_dir):
    """The first observation of every image and point."""
    return O.first_observations(observations(spark, sf_dir), ["order", "line", "x", "y"]).select("image_id", "point_id", "x", "y")


@query(f"WITH {COVIS} SELECT img_a, img_b, n_shared FROM cov")
def covisibility(spark, sf_dir):
    """Points that two images share."""
    return O.covisibility(observations(spark, sf_dir))


@query(f"""WITH {COVIS}, b AS (SELECT img_a AS image_id, img_b AS other_id, n_shared FROM cov UNION ALL SELECT img_b, img_a, n_shared FROM cov
), r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n_shared DESC, other_id) AS rank FROM b)
SELECT image_id, other_id, n_shared, rank FROM r WHERE rank <= 2""")
def covis_topk(spark, sf_dir):
    """Every image's two best covisible images."""
    return longs(O.top_neighbours(O.covisibility(observations(spark, sf_dir)), 2))


@query(f"WITH {OBS} SELECT point_id, count(*) AS n_observers FROM seen GROUP BY 1")
def observers(spark, sf_dir):
    """Distinct images per point."""
    return O.observers(observations(spark, sf_dir))


@query(f"""WITH {OBS}, e AS (SELECT point_id, avg(y) AS err FROM obs GROUP BY 1
), t AS (SELECT least(1e9, quantile_cont(err, 0.5) + 3 * stddev_pop(err)) AS threshold FROM e)
SELECT point_id, round(err, 3) AS err, row_number() OVER (ORDER BY point_id) - 1 AS new_id FROM e, t WHERE err <= threshold""")
def outlier_filter(spark, sf_dir):
    """Points within median + 3 deviations of the mean error, renumbered densely."""
    e = O.point_errors(observations(spark, sf_dir).withColumn("err", F.col("y")))
    return rounded(O.inlier_points(e, 1e9), 3)


@query(f"""WITH {OBS} SELECT count(*) AS n_obs, count(DISTINCT point_id) AS n_points, round(sqrt(avg(x * x)), 6) AS rmse,
  round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.95), 6) AS p95, round(max(x), 6) AS max,
  round(avg((x > 25)::INT), 6) AS share_above FROM obs""")
def reproj_summary(spark, sf_dir):
    """Reprojection error summary."""
    return rounded(O.error_summary(observations(spark, sf_dir).withColumn("err", F.col("x")), 25.0))


@query(f"""WITH {OBS} SELECT image_id, CASE WHEN x < 1 THEN 'below_1' WHEN x < 2 THEN '1_to_2' ELSE 'from_2' END AS bin, count(*) AS n
  FROM (SELECT image_id, x / 16 AS x FROM obs) GROUP BY 1, 2""")
def error_bins(spark, sf_dir):
    """Observation errors per image in three bins."""
    return O.error_bins(observations(spark, sf_dir).withColumn("err", F.col("x") / 16))


def _links(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symmetric matches, links of all tracked keypoints, registered images 0 to 4."""
    m = cut(mutual(spark, sf_dir), "matches")
    tracks = T.clean_tracks(T.match_components(m))
    links = tracks.select("image_id", F.col("kp_id").alias("kp"), F.col("track_id").alias("point_id"))
    return M.symmetric(m), cut(links, "links"), keypoints(spark, sf_dir).select("image_id").where("image_id < 5").distinct()


CORR = f"""{TRACKS}, sym AS (SELECT img_i AS image_id, img_j AS other_id, kp_i AS kp, kp_j AS other_kp FROM m
  UNION ALL SELECT img_j, img_i, kp_j, kp_i FROM m
), cnt AS (SELECT sym.image_id, count(DISTINCT track_id) AS n_points FROM sym JOIN tr ON tr.image_id = other_id AND tr.kp_id = other_kp
  WHERE sym.image_id >= 5 AND other_id < 5 GROUP BY 1)"""


@query(f"WITH RECURSIVE {CORR} SELECT image_id, n_points FROM cnt")
def corr_count(spark, sf_dir):
    """Reachable points of unregistered images."""
    return longs(O.correspondence_counts(*_links(spark, sf_dir)))


@query(f"WITH RECURSIVE {CORR} SELECT image_id, n_points FROM cnt WHERE n_points >= 2 ORDER BY n_points DESC, image_id LIMIT 1")
def pick_next(spark, sf_dir):
    """The next image to register."""
    return longs(O.next_image(O.correspondence_counts(*_links(spark, sf_dir)), 2))


@query(f"""WITH {MUTUAL}, p AS (SELECT img_i, img_j, count(*) AS n_inliers, avg(d) AS baseline, 10 * min(d) AS angle,
  (img_i + img_j) % 2 = 0 AS planar FROM m GROUP BY 1, 2
), s AS (SELECT img_i, img_j, n_inliers, CASE WHEN NOT planar AND angle >= 5 THEN 0 ELSE 1 END AS fallback,
  CASE WHEN NOT planar AND angle >= 5 THEN baseline * n_inliers ELSE n_inliers END AS score FROM p)
SELECT img_i, img_j, n_inliers, fallback, round(score, 6) AS score FROM s ORDER BY fallback, score DESC, img_i, img_j LIMIT 1""")
def seed_select(spark, sf_dir):
    """The seed pair, with fallback."""
    p = mutual(spark, sf_dir).groupBy("img_i", "img_j").agg(
        F.count("*").alias("n_inliers"), F.avg("distance").alias("baseline"), (10 * F.min("distance")).alias("angle")
    )
    return rounded(longs(O.seed_pair(p.withColumn("planar", (F.col("img_i") + F.col("img_j")) % 2 == 0))))


@query(f"""WITH {MUTUAL}, c AS (SELECT img_i, img_j, count(*) AS n FROM m GROUP BY 1, 2
), b AS (SELECT img_i AS image_id, img_j AS other_id, n FROM c UNION ALL SELECT img_j, img_i, n FROM c
), r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, other_id) AS k FROM b WHERE image_id >= 5 AND other_id < 5)
SELECT DISTINCT least(image_id, other_id) AS img_i, greatest(image_id, other_id) AS img_j FROM r WHERE k <= 2""")
def rescue_pairs(spark, sf_dir):
    """Registered partners for unregistered images."""
    images = keypoints(spark, sf_dir).select("image_id").distinct()
    return longs(P.rescue_pairs(M.pair_counts(mutual(spark, sf_dir)), images.where("image_id < 5"), images, 2))


@query("""WITH c AS (SELECT vec_id AS image_id, embedding[1]::DOUBLE AS cx, embedding[2]::DOUBLE AS cy, embedding[3]::DOUBLE AS cz,
  embedding[4]::DOUBLE AS ex, embedding[5]::DOUBLE AS ey, embedding[6]::DOUBLE AS ez FROM embeddings
), n AS (SELECT *, sqrt(ex * ex + ey * ey + ez * ez) AS l FROM c), r AS (SELECT quantile_cont(sqrt(cx * cx + cy * cy + cz * cz), 0.5) AS r FROM c
), p AS (SELECT a.image_id AS img_i, b.image_id AS img_j, (a.ex * b.ex + a.ey * b.ey + a.ez * b.ez) / (a.l * b.l) AS cosine,
  sqrt((a.cx - b.cx)**2 + (a.cy - b.cy)**2 + (a.cz - b.cz)**2) AS d FROM n a JOIN n b ON a.image_id < b.image_id)
SELECT img_i, img_j, round(cosine * (1 - d / (0.6 * r)), 6) AS score FROM p, r
WHERE cosine >= cos(radians(45)) AND d BETWEEN 1e-6 * r AND 0.6 * r AND img_j <> img_i + 1
ORDER BY cosine * (1 - d / (0.6 * r)) DESC, img_i, img_j LIMIT 200""")
def loop_pairs(spark, sf_dir):
    """The 200 best loop candidates among cameras built from vectors (a top-k report)."""
    at = lambda i: F.col("embedding").getItem(i).cast("double")
    norm = F.sqrt(at(3) * at(3) + at(4) * at(4) + at(5) * at(5))
    cams = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"), *(at(i).alias(f"c{c}") for i, c in enumerate("xyz")), *((at(i + 3) / norm).alias(f"d{c}") for i, c in enumerate("xyz"))
    )
    known = cams.select(F.col("image_id").alias("img_i"), (F.col("image_id") + 1).alias("img_j"))
    return rounded(P.loop_pairs(cut(cams, "cameras"), known, centre=[0.0, 0.0, 0.0]))


@query(f"""WITH {MUTUAL}, c AS (SELECT DISTINCT label AS image_id, label % 3 AS component FROM embeddings)
SELECT a.image_id AS img_i, b.image_id AS img_j FROM c a JOIN c b ON a.image_id < b.image_id AND a.component <> b.component
WHERE (a.image_id, b.image_id) NOT IN (SELECT (img_i, img_j) FROM m GROUP BY img_i, img_j HAVING count(*) >= 5)""")
def bridge_pairs(spark, sf_dir):
    """Unmatched pairs across components."""
    c = keypoints(spark, sf_dir).select("image_id", (F.col("image_id") % 3).alias("component")).distinct()
    return longs(P.bridge_pairs(c, M.at_least(cut(mutual(spark, sf_dir), "matches"), 5)))


@query(f"""WITH {OBS}, g AS (SELECT point_id, avg(x * 5) AS r, avg((ord % 256)) AS g, avg(line * 30) AS b FROM obs WHERE y / 10000 <= 1.5 GROUP BY 1)
SELECT p.point_id, coalesce(trunc(r), 128)::BIGINT AS r, coalesce(trunc(g), 128)::BIGINT AS g, coalesce(trunc(b), 128)::BIGINT AS b
FROM (SELECT DISTINCT point_id FROM obs) p LEFT JOIN g USING (point_id)""")
def colour_mean_default(spark, sf_dir):
    """Mean colour of close observations, grey without any."""
    o = observations(spark, sf_dir).withColumn("err", F.col("y") / 10000)
    o = o.withColumn("r", F.col("x") * 5).withColumn("g", F.col("order") % 256).withColumn("b", F.col("line") * 30)
    return longs(O.mean_colours(o, o, 1.5))


# ---- clouds --------------------------------------------------------------------------------


@query(f"WITH {NEAR} SELECT round(coalesce(quantile_cont(distance, 0.5), 0), 6) AS spacing FROM nn WHERE rank = 1 AND distance > 0")
def spacing(spark, sf_dir):
    """Median distance to the nearest neighbour."""
    return rounded(C.spacing(cloud(spark, sf_dir), None))


@query(f"WITH {NEAR} SELECT qid AS pid, round(distance, 6) AS distance FROM nn WHERE rank = 3")
def kth_nn(spark, sf_dir):
    """Distance to the third neighbour."""
    return rounded(C.kth_distance(cloud(spark, sf_dir), 3))


@query(f"""WITH {NEAR}, d AS (SELECT qid AS pid, sum(distance) / 10 AS m FROM nn WHERE rank <= 9 GROUP BY 1
), t AS (SELECT avg(m) + 1.5 * stddev_samp(m) AS t FROM d) SELECT pid, round(m, 6) AS mean_distance FROM d, t WHERE m <= t""")
def sor(spark, sf_dir):
    """Statistical outlier removal."""
    return rounded(C.statistical_outliers(cloud(spark, sf_dir), 10, 1.5))


@query(f"""WITH {NEAR}, d AS (SELECT qid AS pid, distance FROM nn WHERE rank = 5
), t AS (SELECT CASE WHEN avg((distance > 0.05)::INT) > 0.15 THEN quantile_cont(distance, 0.85) ELSE 0.05 END AS t FROM d)
SELECT pid, round(distance, 6) AS distance FROM d, t WHERE distance <= t""")
def ror_capped(spark, sf_dir):
    """Radius outlier removal with a removal cap."""
    return rounded(C.radius_outliers(cloud(spark, sf_dir), 5, 0.05, 0.15))


@query(f"""WITH {CLOUD}, blob AS (SELECT pid, CASE WHEN pid % 50 = 7 THEN x + 10 ELSE x END AS x, y, z FROM cloud
), c AS (SELECT quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my, quantile_cont(z, 0.5) AS mz FROM blob
), d AS (SELECT blob.*, sqrt((x - mx)**2 + (y - my)**2 + (z - mz)**2) AS dist FROM blob, c
), tail AS (SELECT dist, lag(dist) OVER (ORDER BY dist) AS before FROM d WHERE dist >= (SELECT quantile_cont(dist, 0.95) FROM d)
), gap AS (SELECT before AS cutoff, dist / before AS g FROM tail WHERE before > 0 ORDER BY g DESC, before LIMIT 1
), cuts AS (SELECT 'gap' AS label, cutoff FROM gap WHERE g >= 1.5 UNION ALL
  SELECT unnest(['q0.001', 'q0.002', 'q0.005', 'q0.01', 'q0.02', 'q0.05']), unnest(quantile_cont(dist, [0.999, 0.998, 0.995, 0.99, 0.98, 0.95])) FROM d
), whole AS (SELECT count(*) AS n, sqrt((max(x) - min(x))**2 + (max(y) - min(y))**2 + (max(z) - min(z))**2) AS diag FROM d
), tried AS (SELECT label, cutoff, count(*) AS kept, sqrt((max(x) - min(x))**2 + (max(y) - min(y))**2 + (max(z) - min(z))**2) AS diag
  FROM d, cuts WHERE dist <= cutoff GROUP BY 1, 2
), best AS (SELECT cutoff FROM tried, whole WHERE kept < n AND whole.diag / tried.diag >= 2 ORDER BY n - kept, cutoff, label LIMIT 1)
SELECT pid, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM d WHERE dist <= coalesce((SELECT cutoff FROM best), 1e300)""")
def extent_filter(spark, sf_dir):
    """A far blob is cut off."""
    c = cloud(spark, sf_dir).select("pid", F.when(F.col("pid") % 50 == 7, F.col("x") + 10).otherwise(F.col("x")).alias("x"), "y", "z")
    return rounded(C.extent_filter(c))


@query(f"""WITH {CLOUD} SELECT floor(x / 0.1)::BIGINT AS vx, floor(y / 0.1)::BIGINT AS vy, floor(z / 0.1)::BIGINT AS vz, count(*) AS n,
  round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b
  FROM cloud GROUP BY 1, 2, 3""")
def voxel(spark, sf_dir):
    """Voxel down-sampling."""
    return rounded(C.voxel_downsample(cloud(spark, sf_dir), 0.1, ("r", "g", "b"), dict.fromkeys("xyz", 0.0)))


@query(f"""WITH {CLOUD}, q AS (SELECT pid AS vid, y AS x, z AS y, x AS z FROM cloud), nn AS (
  SELECT vid, r, g, b, 1 / greatest(sqrt((q.x - c.x)**2 + (q.y - c.y)**2 + (q.z - c.z)**2), 1e-10) AS w,
    row_number() OVER (PARTITION BY vid ORDER BY sqrt((q.x - c.x)**2 + (q.y - c.y)**2 + (q.z - c.z)**2), pid) AS k FROM q, cloud c)
SELECT vid, round(least(1, greatest(0, sum(w * r) / sum(w))), 6) AS r, round(least(1, greatest(0, sum(w * g) / sum(w))), 6) AS g,
  round(least(1, greatest(0, sum(w * b) / sum(w))), 6) AS b FROM nn WHERE k <= 5 GROUP BY 1""")
def idw_k5(spark, sf_dir):
    """Colours of vertices from the five nearest cloud points."""
    c = cloud(spark, sf_dir)
    return rounded(C.transfer_colours(c.select(F.col("pid").alias("vid"), F.col("y").alias("x"), F.col("z").alias("y"), F.col("x").alias("z")), c, 5))


@query(f"""WITH {NEAR}, c AS (SELECT quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my, quantile_cont(z, 0.5) AS mz FROM cloud
), d AS (SELECT sqrt((x - mx)**2 + (y - my)**2 + (z - mz)**2) AS dist FROM cloud, c), m AS (SELECT quantile_cont(dist, 0.5) AS r FROM d
), n AS (SELECT distance, (SELECT quantile_cont(distance, 0.5) FROM nn WHERE rank = 1) AS med FROM nn WHERE rank = 1)
SELECT * FROM (SELECT count(*) AS n_points, round(quantile_cont(dist, 0.95), 6) AS radius_p95, round(quantile_cont(dist, 0.99), 6) AS radius_p99,
  round(avg((dist > 5 * r)::INT), 6) AS outlier_share FROM d, m), (SELECT round(max(med), 6) AS nn_median, round(avg(distance), 6) AS nn_mean,
  round(avg((distance < 1e-9)::INT), 6) AS duplicate_share, round(avg((distance > 10 * med)::INT), 6) AS flyer_share FROM n)""")
def cloud_health(spark, sf_dir):
    """Cloud statistics."""
    return rounded(C.health(cloud(spark, sf_dir)))


# ---- meshes --------------------------------------------------------------------------------


@query(f"""WITH {STRIP}, n AS (SELECT u, w, count(*) AS n FROM ed GROUP BY 1, 2)
SELECT *, n_vertices - n_edges + n_faces AS euler FROM (SELECT count(*) AS n_edges, count(*) FILTER (n = 1) AS n_boundary, count(*) FILTER (n > 2) AS n_nonmanifold FROM n),
  (SELECT count(DISTINCT x) AS n_vertices FROM (SELECT a AS x FROM f UNION ALL SELECT b FROM f UNION ALL SELECT c FROM f)), (SELECT count(*) AS n_faces FROM f)""")
def edge_topology(spark, sf_dir):
    """Edges, boundaries and Euler characteristic of a mesh."""
    return X.edge_topology(strip(spark, sf_dir)[0])


@query(f"""WITH {STRIP}, c AS (SELECT fid, sqrt((p.x - q.x)**2 + (p.y - q.y)**2 + (p.z - q.z)**2) AS ab, sqrt((q.x - r.x)**2 + (q.y - r.y)**2 + (q.z - r.z)**2) AS bc,
    sqrt((r.x - p.x)**2 + (r.y - p.y)**2 + (r.z - p.z)**2) AS ca,
    0.5 * sqrt(((q.y - p.y) * (r.z - p.z) - (q.z - p.z) * (r.y - p.y))**2 + ((q.z - p.z) * (r.x - p.x) - (q.x - p.x) * (r.z - p.z))**2
      + ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x))**2) AS area
  FROM f JOIN v p ON p.vid = a JOIN v q ON q.vid = b JOIN v r ON r.vid = c
), m AS (SELECT *, CASE WHEN area > 1e-20 THEN (ab * bc * ca / (4 * area)) / (2 * (2 * area / (ab + bc + ca))) END AS aspect FROM c
), e AS (SELECT ab AS e FROM m UNION ALL SELECT bc FROM m UNION ALL SELECT ca FROM m)
SELECT * FROM (SELECT round(avg(e), 6) AS edge_mean, round(quantile_cont(e, 0.5), 6) AS edge_median, round(min(e), 6) AS edge_min, round(max(e), 6) AS edge_max FROM e),
  (SELECT round(sum(area), 6) AS area, round(avg(aspect), 6) AS aspect_mean, round(max(aspect), 6) AS aspect_max,
    round(avg((aspect > 10)::INT), 6) AS sliver_share, count(*) FILTER (area <= 1e-20) AS n_degenerate FROM m)""")
def triangle_quality(spark, sf_dir):
    """Edge lengths, areas and aspect ratios of a mesh."""
    return rounded(X.triangle_quality(*strip(spark, sf_dir)))


@query(f"""WITH {STRIP}, c AS (SELECT fid // 40 AS k, count(*) AS n_faces, min(fid) AS component FROM f GROUP BY 1
), t AS (SELECT max(n_faces) AS top FROM c), b AS (SELECT min(component) AS b FROM c, t WHERE n_faces = top)
SELECT component, n_faces, n_faces >= greatest(0.6 * top, 10) OR component = b AS kept FROM c, t, b""")
def component_keep(spark, sf_dir):
    """Mesh components and which of them stay."""
    return X.component_keep(X.face_components(strip(spark, sf_dir)[0]), 0.6, 10)


@query(f"""WITH {CLOUD}, c AS (SELECT least(a, b) AS p, greatest(a, b) AS q FROM (SELECT pid AS a, (pid * 7) % 97 AS b FROM cloud) WHERE a <> b
), s AS (SELECT p AS a, q AS b FROM c UNION SELECT q, p FROM c) SELECT a AS node, count(*) AS degree FROM s GROUP BY 1""")
def vertex_degrees(spark, sf_dir):
    """Node degrees of an undirected graph without repeats."""
    e = cloud(spark, sf_dir).select(F.col("pid").alias("img_i"), ((F.col("pid") * 7) % 97).alias("img_j"))
    e = M.canonical_pairs(e)
    both = e.select(F.col("img_i").alias("node")).unionAll(e.select("img_j"))
    return both.groupBy("node").agg(F.count("*").alias("degree"))


# ---- plot tables, focal lengths, alignment, reports ----------------------------------------


@query(f"""WITH {MUTUAL}, c AS (SELECT img_i, img_j, count(*) AS n FROM m GROUP BY 1, 2)
SELECT img_i AS image_id, img_j AS other_id, n FROM c UNION ALL SELECT img_j, img_i, n FROM c""")
def match_matrix(spark, sf_dir):
    """Symmetric match matrix in long form."""
    return longs(R.match_matrix(M.pair_counts(mutual(spark, sf_dir))))


@query("""SELECT l_suppkey AS image_id, least(floor(l_quantity / 50 * 10), 9)::BIGINT AS gx, least(floor(l_extendedprice / 110000 * 8), 7)::BIGINT AS gy, count(*) AS n
  FROM lineitem GROUP BY 1, 2, 3""")
def density_grid(spark, sf_dir):
    """Keypoint density per image on a grid."""
    return R.density_grid(observations(spark, sf_dir), 50.0, 110000.0, 10, 8)


@query(f"""WITH {OBS}, n AS (SELECT point_id, count(*) AS n FROM seen GROUP BY 1) SELECT least(n, 40) AS n_observers, count(*) AS n_points FROM n GROUP BY 1""")
def point_lifecycle(spark, sf_dir):
    """Histogram of observers per point."""
    return R.clamped_histogram(O.observers(observations(spark, sf_dir)), "n_observers", 40, "n_points")


@query("""WITH p AS (SELECT p_partkey AS image_id, CASE WHEN p_size % 3 = 0 THEN p_size * 1.0 END AS f35, CASE WHEN p_size % 2 = 0 THEN p_retailprice / 100 END AS mm,
  CASE WHEN p_size % 5 <> 0 THEN p_retailprice / 10 END AS res, p_brand AS model FROM part
), s(model, width_mm) AS (VALUES ('Brand#1', 23.5), ('Brand#11', 36.0), ('Brand#23', 13.2)
), r AS (SELECT image_id, f35 / sqrt(36.0**2 + 24.0**2) * sqrt(4000.0**2 + 3000.0**2) AS a, mm * res / 25.4 AS b, mm / width_mm * 4000 AS c FROM p LEFT JOIN s USING (model)
), ok AS (SELECT image_id, a, b, c, a > 0 AND degrees(2 * atan(5000.0 / (2 * a))) BETWEEN 5 AND 150 AS ua,
  b > 0 AND degrees(2 * atan(5000.0 / (2 * b))) BETWEEN 5 AND 150 AS ub, c > 0 AND degrees(2 * atan(5000.0 / (2 * c))) BETWEEN 5 AND 150 AS uc FROM r)
SELECT image_id, round(CASE WHEN ua THEN a WHEN ub THEN b WHEN uc THEN c ELSE 4000 END, 6) AS focal_px,
  CASE WHEN ua THEN 'equivalent' WHEN ub THEN 'focal_plane' WHEN uc THEN 'sensor' ELSE 'guess' END AS source FROM ok""")
def focal_length_routes(spark, sf_dir):
    """Focal lengths by three routes in order, else a guess."""
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("image_id"), F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("double")).alias("focal_35"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice") / 100).alias("focal_mm"),
        F.when(F.col("p_size") % 5 != 0, F.col("p_retailprice") / 10).alias("plane_res"), F.lit(25.4).alias("unit_mm"), F.lit(4000).alias("exif_width"),
        F.lit("").alias("make"), F.col("p_brand").alias("model"), F.lit(4000).alias("width"), F.lit(3000).alias("height"),
    )
    sensors = spark.createDataFrame([("", "brand#1", 23.5), ("", "brand#11", 36.0), ("", "brand#23", 13.2)], "make string, model string, width_mm double")
    return rounded(focal_routes(p, sensors).select("image_id", "focal_px", "source"))


@query(f"""WITH {MUTUAL}, c AS (SELECT img_i, img_j, count(*) AS n FROM m GROUP BY 1, 2
), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, img_i, img_j) AS k FROM c)
SELECT img_i, img_j, n AS n_matches, k AS rank FROM k""")
def ranked_pairs(spark, sf_dir):
    """Pairs ranked by matches, the input of the greedy choice."""
    return longs(R.ranked_pairs(M.pair_counts(mutual(spark, sf_dir))))


@query("""WITH p AS (SELECT embedding[1]::DOUBLE AS sx, embedding[2]::DOUBLE AS sy, embedding[3]::DOUBLE AS sz,
  2 * embedding[2]::DOUBLE + 1 AS tx, 2 * embedding[1]::DOUBLE - 1 AS ty, embedding[4]::DOUBLE AS tz FROM embeddings)
SELECT count(*) AS n, round(avg(sx), 6) AS msx, round(avg(sy), 6) AS msy, round(avg(sz), 6) AS msz, round(avg(tx), 6) AS mtx, round(avg(ty), 6) AS mty, round(avg(tz), 6) AS mtz,
  round(covar_pop(tx, sx), 6) AS cov_xx, round(covar_pop(tx, sy), 6) AS cov_xy, round(covar_pop(tx, sz), 6) AS cov_xz,
  round(covar_pop(ty, sx), 6) AS cov_yx, round(covar_pop(ty, sy), 6) AS cov_yy, round(covar_pop(ty, sz), 6) AS cov_yz,
  round(covar_pop(tz, sx), 6) AS cov_zx, round(covar_pop(tz, sy), 6) AS cov_zy, round(covar_pop(tz, sz), 6) AS cov_zz,
  round(var_pop(sx) + var_pop(sy) + var_pop(sz), 6) AS var_s FROM p""")
def umeyama_sums(spark, sf_dir):
    """Sums of a similarity fit."""
    at = lambda i: F.col("embedding").getItem(i).cast("double")
    p = table(spark, sf_dir, "embeddings").select(
        at(0).alias("sx"), at(1).alias("sy"), at(2).alias("sz"), (2 * at(1) + 1).alias("tx"), (2 * at(0) - 1).alias("ty"), at(3).alias("tz")
    )
    return rounded(P.alignment_sums(p))


@query("""SELECT o_orderpriority AS run, count(*) AS n, round(min(o_totalprice), 6) AS low, round(max(o_totalprice), 6) AS high,
  round(100 * (max(o_totalprice) - min(o_totalprice)) / max(o_totalprice), 6) AS spread_percent FROM orders GROUP BY 1""")
def reproducibility(spark, sf_dir):
    """Spread of a figure over repeated runs."""
    return rounded(R.spread(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice"))


@query("""SELECT c_custkey AS run, c_mktsegment AS backend, coalesce(n, 0) AS n_runs, CASE WHEN n IS NULL THEN 'n/a' ELSE printf('%.2f', total) END AS total
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def run_report(spark, sf_dir):
    """Runs enriched by a left join, with null-safe formatting."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    c = table(spark, sf_dir, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    return c.select(F.col("c_custkey").alias("run"), F.col("c_mktsegment").alias("backend"), F.coalesce("n", F.lit(0)).cast("long").alias("n_runs"), R.number("total").alias("total"))


@query("""WITH p AS (SELECT c_nationkey AS image_id, c_mktsegment AS backend, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT image_id, coalesce(sum(n) FILTER (backend = 'BUILDING'), 0)::BIGINT AS "BUILDING", coalesce(sum(n) FILTER (backend = 'MACHINERY'), 0)::BIGINT AS "MACHINERY" FROM p GROUP BY 1""")
def backend_pivot(spark, sf_dir):
    """Pivot of a metric, a column per backend."""
    p = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("image_id")).pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).count()
    return p.na.fill(0)


@query("""WITH s AS (SELECT image_id, step, n_new FROM (SELECT l_suppkey AS image_id, l_linenumber::BIGINT AS step, count(*) AS n_new FROM lineitem GROUP BY 1, 2))
SELECT image_id, step, n_new, sum(n_new) OVER (PARTITION BY image_id ORDER BY step)::BIGINT AS total FROM s""")
def registration_curve(spark, sf_dir):
    """Cumulative registration curve."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("image_id"), F.col("l_linenumber").cast("long").alias("step")).agg(F.count("*").alias("n_new"))
    return R.cumulative(s, ["image_id"], "step", "n_new")
