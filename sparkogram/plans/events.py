"""Lifecycle hooks of a run as rows.

Stages call the hooks of an :class:`EventLog`; each call is one event row, and the
plot tables of ``operators.plots`` are made from them.  A hook never stops the
run: what goes wrong in a listener is logged.  A run has a few events per photo,
so they are held by the driver and become a DataFrame on request.
"""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkogram.operators import plots

log = logging.getLogger("sparkogram")

EVENTS = "seq long, at double, event string, image_id long, step long, n_new long, n_points_before long, n_points_after long, n_cameras long, rmse_before double, rmse_after double, details string"
_COLUMNS = [c.split()[0] for c in EVENTS.split(", ")]


class EventLog:
    """Collects event rows and tells listeners."""

    def __init__(self, *listeners: Callable[[dict[str, Any]], None]):
        self.rows: list[dict[str, Any]] = []
        self.listeners = list(listeners)

    def add(self, event: str, **fields: Any) -> None:
        """One event; fields that are no column go into ``details`` as JSON."""
        known = {k: v for k, v in fields.items() if k in _COLUMNS}
        rest = {k: v for k, v in fields.items() if k not in _COLUMNS}
        row = dict.fromkeys(_COLUMNS) | {"seq": len(self.rows), "at": time.time(), "event": event, "details": json.dumps(rest, default=str, sort_keys=True)} | known
        self.rows.append(row)
        for listen in self.listeners:
            try:
                listen(row)
            except Exception:  # a listener must not stop the run
                log.exception("a listener failed at %s", event)

    def frame(self, spark: SparkSession) -> DataFrame:
        """All events in order."""
        return spark.createDataFrame([tuple(r[c] for c in _COLUMNS) for r in self.rows], EVENTS)

    # ---- hooks ---------------------------------------------------------------------------

    def pipeline_start(self, n_images: int, K: Any = None, options: dict | None = None) -> None:
        self.add("pipeline_start", n_images=n_images, K=None if K is None else [[float(x) for x in r] for r in K], options=options or {})

    def features_done(self, keypoints: DataFrame) -> None:
        got = keypoints.agg(F.countDistinct("image_id").alias("i"), F.count("*").alias("n")).first()
        self.add("features_done", n_images=got["i"], n_keypoints=got["n"])

    def matching_done(self, matches: DataFrame) -> None:
        got = matches.agg(F.count("*").alias("n"), F.countDistinct("img_i", "img_j").alias("p")).first()
        self.add("matching_done", n_matches=got["n"], n_pairs=got["p"])

    def verification_done(self, matches: DataFrame, verified: DataFrame) -> None:
        pairs = matches.agg(F.countDistinct("img_i", "img_j")).first()[0]
        got = verified.agg(F.count("*").alias("n"), F.sum("n_inliers").alias("s")).first()
        self.add("verification_done", n_pairs=pairs, n_verified=got["n"], n_inliers=got["s"] or 0)

    def seed_selected(self, img_i: int, img_j: int) -> None:
        self.add("seed_selected", img_i=img_i, img_j=img_j)

    def camera_registered(self, image_id: int, n_new: int, n_cameras: int) -> None:
        step = sum(r["event"] == "camera_registered" for r in self.rows)
        self.add("camera_registered", image_id=image_id, step=step, n_new=n_new, n_cameras=n_cameras)

    def adjustment_run(self, rmse_before: float, rmse_after: float, n_cameras: int, n_points_before: int, n_points_after: int) -> None:
        step = sum(r["event"] == "adjustment_run" for r in self.rows)
        self.add("adjustment_run", step=step, rmse_before=rmse_before, rmse_after=rmse_after, n_cameras=n_cameras, n_points_before=n_points_before, n_points_after=n_points_after)

    def reconstruction_complete(self, n_cameras: int, n_points: int, summary: dict | None = None) -> None:
        self.add("reconstruction_complete", n_cameras=n_cameras, n_points_after=n_points, summary=summary or {})

    def mesh_complete(self, path: str, stats: dict | None = None) -> None:
        self.add("mesh_complete", path=path, stats=stats or {})

    def pipeline_complete(self, summary: dict) -> None:
        self.add("pipeline_complete", summary=summary)

    # ---- tables --------------------------------------------------------------------------

    def registration(self, spark: SparkSession) -> DataFrame:
        """The registration curve."""
        return plots.registration_steps(self.frame(spark).where("event = 'camera_registered'"))

    def adjustments(self, spark: SparkSession) -> DataFrame:
        """The convergence of the bundle adjustments."""
        return plots.adjustment_rounds(self.frame(spark).where("event = 'adjustment_run'").withColumnRenamed("step", "round"))
