"""Frames: ranges, samples, signatures of decoded images, and what a renderer draws."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyloom.functions.geometry import sample_indices
from rallyloom.operators.calibration import to_pixels
from rallyloom.params import COURT_LENGTH_M, COURT_WIDTH_M, NET_Y_M

#: Lines of the court as (name, x1, y1, x2, y2) in metres (fixed values).
COURT_LINES = (
    ("left sideline", 0.0, 0.0, 0.0, COURT_LENGTH_M), ("right sideline", COURT_WIDTH_M, 0.0, COURT_WIDTH_M, COURT_LENGTH_M),
    ("near baseline", 0.0, 0.0, COURT_WIDTH_M, 0.0), ("far baseline", 0.0, COURT_LENGTH_M, COURT_WIDTH_M, COURT_LENGTH_M),
    ("net", 0.0, NET_Y_M, COURT_WIDTH_M, NET_Y_M), ("near attack line", 0.0, 3.0, COURT_WIDTH_M, 3.0), ("far attack line", 0.0, 15.0, COURT_WIDTH_M, 15.0),
)


def frame_range(df: DataFrame, start: int = 0, max_frames: int | None = None) -> DataFrame:
    """Frames from ``start`` on, at most ``max_frames`` of them; none or 0 means all."""
    f = F.col("frame_idx")
    return df.where(f.between(start, start + max_frames - 1) if max_frames else f >= start)


def sampled(frames: DataFrame, clips: DataFrame, count: int) -> DataFrame:
    """The frames of a spread sample (``clips``: ``clip, total``)."""
    wanted = clips.select("clip", F.explode(sample_indices(F.col("total"), F.lit(count), distinct=True)).alias("frame_idx"))
    return frames.join(wanted, ["clip", "frame_idx"], "left_semi")


def _gray(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float32)
    return pixels[..., 0] if channels == 1 else pixels[..., :3] @ np.array([0.114, 0.587, 0.299], np.float32)


def _shrunk(gray: np.ndarray, width: int) -> np.ndarray:
    """Averages over equal areas."""
    height = max(1, int(width * gray.shape[0] / gray.shape[1]))
    rows = np.add.reduceat(gray, np.arange(height) * gray.shape[0] // height, 0)
    both = np.add.reduceat(rows, np.arange(width) * gray.shape[1] // width, 1)
    sizes = lambda n, m: np.diff(np.append(np.arange(m) * n // m, n))
    return both / np.outer(sizes(gray.shape[0], height), sizes(gray.shape[1], width))


def signatures(images: DataFrame, crop: tuple[int, int, int, int] | None = None, roi_top: float = 0.36, width: int = 320) -> DataFrame:
    """``clip, frame_idx, signature`` from rows ``clip, frame_idx, image`` of Spark's image source.

    Gray values of the part below ``roi_top``, shrunk to ``width``; or of a fixed
    crop (x1, y1, x2, y2), unshrunk, for a scoreboard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                gray = _gray(r["data"], r["height"], r["width"], r["nChannels"])
                if crop:
                    part = gray[crop[1] : crop[3], crop[0] : crop[2]]
                else:
                    low = gray[int(gray.shape[0] * roi_top) :]
                    part = _shrunk(low, min(width, low.shape[1]))
                out.append(part.ravel().astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column("clip"), batch.column("frame_idx"), pa.array(out, pa.list_(pa.float64()))], ["clip", "frame_idx", "signature"])

    kind = dict(images.dtypes)["clip"]
    flat = images.select("clip", F.col("frame_idx").cast("bigint").alias("frame_idx"), "image.height", "image.width", "image.nChannels", "image.data")
    return flat.mapInArrow(run, f"clip {kind}, frame_idx bigint, signature array<double>")


def court_lines(homographies: DataFrame) -> DataFrame:
    """``clip, line, px1, py1, px2, py2``: the court's lines on the screen."""
    names = ("line", "x", "y", "x2", "y2")
    lines = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, line)]) for line in COURT_LINES])  # a few constants a clip
    every = homographies.select("clip", F.inline(lines))
    start = to_pixels(every, homographies).withColumnsRenamed({"px": "px1", "py": "py1"})
    end = to_pixels(start.select("clip", "line", "px1", "py1", F.col("x2").alias("x"), F.col("y2").alias("y")), homographies)
    return end.select("clip", "line", "px1", "py1", F.col("px").alias("px2"), F.col("py").alias("py2"))


def box_labels(tracks: DataFrame) -> DataFrame:
    """What is drawn for each tracked box: integer corners and ``#id``, placed inside the frame."""
    cut = lambda c: F.col(c).cast("int").alias(c)
    text: Column = F.concat(F.lit("#"), F.col("track_id").cast("string"))
    return tracks.select("clip", "frame_idx", *[cut(c) for c in ("x1", "y1", "x2", "y2")], text.alias("label"), F.greatest(F.lit(0), F.col("y1").cast("int") - 5).alias("label_y"))
