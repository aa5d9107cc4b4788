"""Ball contacts, net crossings and rallies: window functions over one clip's frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyloom.functions.geometry import project, within_court
from rallyloom.operators.spread import block_of, in_block, pieces, with_guests
from rallyloom.params import COURT_WIDTH_M, NET_Y_M, EventParams

H_COLUMNS = [f"h{i}{j}" for i in range(3) for j in range(3)]


def to_court(points: DataFrame, homographies: DataFrame, px: str = "cx", py: str = "cy") -> DataFrame:
    """Add ``x, y`` in metres; a clip without a homography has no court positions (inner join)."""
    joined = points.join(homographies, "clip")
    x, y = project([F.col(h) for h in H_COLUMNS], F.col(px), F.col(py))
    return joined.withColumn("x", x).withColumn("y", y).drop(*H_COLUMNS)


def ball_contacts(ball: DataFrame, params: EventParams = EventParams()) -> DataFrame:
    """Frames where the ball is lowest on the screen (pixel y at its maximum).

    All frames of the window must be there; of a plateau the first frame counts; the
    excursion in the window must reach the minimum.
    """
    r = params.contact_radius
    around, before = in_block().rangeBetween(-r, r), in_block().rangeBetween(-r, -1)
    cy = F.col("cy")
    found = with_guests(ball, r, r).select(
        "clip", "frame_idx", "cy", "at_home",
        F.count(F.lit(1)).over(around).alias("n"), F.max(cy).over(around).alias("hi"), F.min(cy).over(around).alias("lo"),
        F.max(cy).over(before).alias("earlier"),
    )
    peak = (F.col("n") == 2 * r + 1) & (cy == F.col("hi")) & (cy - F.col("lo") >= params.contact_min_excursion)
    return found.where(F.col("at_home") & peak & (F.col("earlier").isNull() | (F.col("earlier") < cy))).select("clip", "frame_idx", "cy")


def net_crossings(court: DataFrame, params: EventParams = EventParams()) -> DataFrame:
    """The later frame of each adjacent pair on different sides of the net, both near it in x."""
    net = F.lit(NET_Y_M)
    low, high = F.lit(-params.crossing_x_margin), F.lit(COURT_WIDTH_M + params.crossing_x_margin)
    w = in_block()
    pairs = with_guests(court, 1, 0).select(
        "clip", "frame_idx", "x", "y", "at_home",
        F.lag("frame_idx").over(w).alias("pf"), F.lag("x").over(w).alias("px"), F.lag("y").over(w).alias("py"),
    )
    sides = ((F.col("py") < net) & (F.col("y") > net)) | ((F.col("py") > net) & (F.col("y") < net))
    inside = F.col("x").between(low, high) & F.col("px").between(low, high)
    return pairs.where(F.col("at_home") & (F.col("frame_idx") - F.col("pf") == 1) & sides & inside).select("clip", "frame_idx")


def _segments(court: DataFrame, params: EventParams) -> DataFrame:
    """Gaps and islands over in-bounds frames."""
    inside = court.where(within_court(F.col("x"), F.col("y"), params.bounds_margin)).select("clip", "frame_idx")
    runs = pieces(inside, params.max_dead_gap).groupBy("clip", "piece")
    return runs.agg(F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"))


def within(points: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """Range join of frames with spans of the same clip, by blocks of frames.

    A span is listed under each block it touches, a frame meets the spans of its own
    block only. So the work follows frames and spans, not their product, and a long
    clip spreads over tasks.
    """
    s = spans.withColumnRenamed("clip", "_clip").withColumn("_block", F.explode(F.sequence(block_of(F.col("start_frame")), block_of(F.col("end_frame")))))
    on = (points["clip"] == s["_clip"]) & (block_of(points["frame_idx"]) == s["_block"]) & points["frame_idx"].between(s["start_frame"], s["end_frame"])
    joined = points.join(s, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop("_clip", "_block")


def rallies(court: DataFrame, crossings: DataFrame, params: EventParams = EventParams()) -> DataFrame:
    """``clip, rally_id, start_frame, end_frame, net_crossings``, numbered by start within the clip."""
    hits = within(crossings, _segments(court, params), "inner")
    kept = hits.groupBy("clip", "start_frame", "end_frame").agg(F.count(F.lit(1)).alias("net_crossings")).where(F.col("net_crossings") >= params.min_crossings)
    number = F.row_number().over(Window.partitionBy("clip").orderBy("start_frame")).cast("bigint")
    return kept.select("clip", number.alias("rally_id"), "start_frame", "end_frame", "net_crossings")


def in_play(points: DataFrame, rally: DataFrame) -> DataFrame:
    """Rows whose frame lies in a rally."""
    return within(points, rally.select("clip", "start_frame", "end_frame"), "left_semi")


def rally_frames(rally: DataFrame) -> DataFrame:
    """Distinct ``clip, frame_idx`` of all rallies."""
    return rally.select("clip", F.explode(F.sequence("start_frame", "end_frame")).alias("frame_idx")).distinct()
