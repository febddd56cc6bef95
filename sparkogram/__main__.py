"""Command line: ``python -m sparkogram --image-dir photos --output cloud.ply``."""

from __future__ import annotations

import json
import logging
import sys

import numpy as np
from pyspark.sql import SparkSession

from sparkogram.plans import backends, workflow
from sparkogram.plans.config import from_arguments
from sparkogram.sources.images import exif_fields, image_set_hash, list_images, load_images, read_exif


def main(argv: list[str] | None = None) -> int:
    """0 when a cloud was written, 1 on a plain error."""
    try:
        cfg = from_arguments(argv)
        logging.basicConfig(level=logging.DEBUG if cfg.verbose else logging.INFO, format="%(levelname)s %(message)s")
        spark = SparkSession.builder.appName("sparkogram").getOrCreate()
        files = list_images(spark, cfg.image_dir)
        images = load_images(spark, cfg.image_dir)
        shared = cfg.shared_intrinsics()
        first = images.orderBy("image_name").select("image_name", "width", "height").first()
        if first is None:
            raise ValueError("no readable image")
        f = cfg.focal
        if shared is None and f is None:
            from sparkogram.operators.focal import focal_routes

            sensors = spark.createDataFrame([], "make string, model string, width_mm double")
            exif = exif_fields(read_exif(files.where(files.image_name == first["image_name"]).crossJoin(images.where(images.image_name == first["image_name"]).select("image_id", "width", "height"))))
            row = focal_routes(exif, sensors).first()
            known, f = row["source"] != "guess", row["focal_px"]
        else:
            known = True
        k = shared or {"fx": f, "fy": f, "cx": first["width"] / 2, "cy": first["height"] / 2}
        K = np.array([[k["fx"], 0, k["cx"]], [0, k["fy"], k["cy"]], [0, 0, 1.0]])
        keypoints = workflow.extract(images, cfg)
        out = workflow.run(keypoints, cfg, K, known, image_hash=image_set_hash(files), names=images.select("image_id", "image_name"))
        workflow.save_points(out.points, cfg.output)
        print(json.dumps(out.summary, default=str))
        return 0
    except (ValueError, OSError, backends.BackendMissing) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
