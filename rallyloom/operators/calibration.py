"""Homographies from labelled points: normalised direct linear transform, per clip."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyloom.functions.geometry import adjugate, project
from rallyloom.operators.events import H_COLUMNS
from rallyloom.params import REFERENCE_POINTS


def reference_points(spark: SparkSession, layout: str = "reference") -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(REFERENCE_POINTS[layout])]
    return spark.createDataFrame(rows, "point_no int, label string, court_x double, court_y double")


def reference_array(layout: str = "reference") -> Column:
    """The reference points as a constant: ten rows."""
    names = ("point_no", "label", "court_x", "court_y")
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, (i, *r))]) for i, r in enumerate(REFERENCE_POINTS[layout])])


def _normaliser(points: np.ndarray) -> np.ndarray:
    """Moves points to mean 0 and mean distance sqrt(2)."""
    mean = points.mean(0)
    spread = np.sqrt(((points - mean) ** 2).sum(1)).mean()
    s = np.sqrt(2) / spread if spread else 1.0
    return np.array([[s, 0, -s * mean[0]], [0, s, -s * mean[1]], [0, 0, 1]])


def fit(pixels: np.ndarray, court: np.ndarray) -> np.ndarray:
    """Least squares over all points, without outlier rejection; exact for four."""
    if len(pixels) < 4:
        raise ValueError(f"a homography needs 4 known points, not {len(pixels)}")
    a, b = _normaliser(pixels), _normaliser(court)
    p = np.c_[pixels, np.ones(len(pixels))] @ a.T
    q = np.c_[court, np.ones(len(court))] @ b.T
    zero = np.zeros_like(p)
    rows = np.r_[np.c_[p, zero, -q[:, :1] * p], np.c_[zero, p, -q[:, 1:2] * p]]
    _, values, vectors = np.linalg.svd(rows)
    h = np.linalg.inv(b) @ vectors[-1].reshape(3, 3) @ a
    if not np.isfinite(h).all() or abs(h[2, 2]) < 1e-12 or values[min(len(values), 8) - 1] < 1e-9:
        raise RuntimeError("the points fix no homography")
    return h / h[2, 2]


def fit_homographies(points: DataFrame, reference: DataFrame) -> DataFrame:
    """One row a clip, ``clip, h00 .. h22``, from ``clip, label, px, py``. Unknown labels are ignored.

    Fewer than four known points, or points that fix no homography, fail the job.
    A clip has at most ten points, so a group is tiny.
    """
    known = points.join(reference, "label")
    schema = ", ".join(["clip bigint", *[f"{h} double" for h in H_COLUMNS]])

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("point_no")
        h = fit(rows[["px", "py"]].to_numpy(float), rows[["court_x", "court_y"]].to_numpy(float))
        return pd.DataFrame([[key[0], *h.ravel()]], columns=["clip", *H_COLUMNS])

    return known.groupBy("clip").applyInPandas(one, schema)


def to_pixels(points: DataFrame, homographies: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Add ``px, py``: court positions on the screen."""
    joined = points.join(homographies, "clip")
    px, py = project(adjugate([F.col(h) for h in H_COLUMNS]), F.col(x), F.col(y))
    return joined.withColumn("px", px).withColumn("py", py).drop(*H_COLUMNS)
