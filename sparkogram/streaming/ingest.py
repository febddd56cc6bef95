"""Incremental ingest: new images are matched with all images so far, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkogram.operators.matching import match_pairs


def new_pairs(new: DataFrame, old: DataFrame) -> DataFrame:
    """Pairs of new images with each other and with old ones, smaller id first."""
    n = new.select("image_id").distinct()
    every = n.unionByName(old.select("image_id").distinct()).distinct()
    pairs = n.select(F.col("image_id").alias("a")).join(every.select(F.col("image_id").alias("b")), F.expr("a <> b"))
    return pairs.select(F.least("a", "b").alias("img_i"), F.greatest("a", "b").alias("img_j")).distinct()


def ingest(stream: DataFrame, store: str, checkpoint: str, ratio: float = 0.75, min_matches: int = 15):
    """Start a query that keeps ``store``/keypoints and ``store``/matches up to date.

    ``stream``: keypoints (image_id, kp_id, descriptor); all keypoints of an image
    come in one micro-batch.  Files carry the batch number, so a batch that is
    run again replaces what it wrote before.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select("image_id", "kp_id", "descriptor").persist()
        try:
            new.write.mode("overwrite").parquet(f"{store}/keypoints/batch={number}")
            every = spark.read.parquet(f"{store}/keypoints").where(F.col("batch") <= number).drop("batch")
            old = every.join(new.select("image_id").distinct(), "image_id", "left_anti")
            got = match_pairs(every, new_pairs(new, old), ratio, True, min_matches)
            got.write.mode("overwrite").parquet(f"{store}/matches/batch={number}")
        finally:
            new.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
