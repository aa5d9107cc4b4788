"""Filling short holes of a track, by straight lines or by parabolas through both ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _holes(points: DataFrame, max_gap: int, keep: list[str]) -> DataFrame:
    """Rows of missing frames: the row before, the row after (``next``), ``t`` and ``gap``."""
    w = Window.partitionBy("clip").orderBy("frame_idx")
    ahead = points.select("*", F.lead(F.struct("frame_idx", *keep)).over(w).alias("next"))
    gap = F.col("next.frame_idx") - F.col("frame_idx")
    holes = ahead.where((gap > 1) & (gap <= max_gap)).withColumn("gap", gap)
    return holes.withColumn("t", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("gap") - 1)))


def _between(a: str, b: str) -> Column:
    return F.col(a) + (F.col(b) - F.col(a)) * (F.col("t").cast("double") / F.col("gap"))


def fill_linear(points: DataFrame, max_gap: int = 15) -> DataFrame:
    """``clip, frame_idx, cx, cy, is_interpolated``: the points of ``points`` and those between."""
    filled = _holes(points.select("clip", "frame_idx", "cx", "cy"), max_gap, ["cx", "cy"])
    made = filled.select("clip", (F.col("frame_idx") + F.col("t")).alias("frame_idx"), _between("cx", "next.cx").alias("cx"), _between("cy", "next.cy").alias("cy"), F.lit(True).alias("is_interpolated"))
    return points.select("clip", "frame_idx", "cx", "cy", F.lit(False).alias("is_interpolated")).unionByName(made)


def fill_ballistic(states: DataFrame, max_gap: int = 15) -> DataFrame:
    """The same from tracker states; the acceleration at the gap's start bends the line.

    A gap with a contact at either end stays straight.
    """
    holes = _holes(states, max_gap, ["px", "py", "is_contact"])
    straight = F.col("is_contact") | F.col("next.is_contact")
    bend = lambda acc: F.when(straight, F.lit(0.0)).otherwise(F.lit(0.5) * F.col(acc) * F.col("t") * (F.col("t") - F.col("gap")))
    made = holes.select(
        "clip", (F.col("frame_idx") + F.col("t")).alias("frame_idx"),
        (_between("px", "next.px") + bend("ax")).alias("cx"), (_between("py", "next.py") + bend("ay")).alias("cy"), F.lit(True).alias("is_interpolated"),
    )
    return states.select("clip", "frame_idx", F.col("px").alias("cx"), F.col("py").alias("cy"), F.lit(False).alias("is_interpolated")).unionByName(made)


def coverage(filled: DataFrame) -> DataFrame:
    """``clip, real, interpolated``."""
    return filled.groupBy("clip").agg(F.count_if(~F.col("is_interpolated")).alias("real"), F.count_if("is_interpolated").alias("interpolated"))
