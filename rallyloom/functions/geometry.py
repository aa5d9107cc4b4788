"""Scalar expressions on boxes, pixels and court positions, as columns."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rallyloom.params import COURT_LENGTH_M, COURT_WIDTH_M, FRONT_ZONE_DEPTH_M, NET_Y_M


def lit(x: float) -> Column:
    return F.lit(float(x))


def box_center(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    return (x1 + x2) / lit(2), (y1 + y2) / lit(2)


def foot_point(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """Middle of the box's lower edge."""
    del y1
    return (x1 + x2) / lit(2), y2


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def project(h: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a 3x3 matrix given row by row; null on the line at infinity."""
    w = h[6] * x + h[7] * y + h[8]
    return F.try_divide(h[0] * x + h[1] * y + h[2], w), F.try_divide(h[3] * x + h[4] * y + h[5], w)


def adjugate(h: list[Column]) -> list[Column]:
    """The inverse up to a scale, which the perspective division cancels."""
    a, b, c, d, e, f, g, i, j = h
    return [e * j - f * i, c * i - b * j, b * f - c * e, f * g - d * j, a * j - c * g, c * d - a * f, d * i - e * g, b * g - a * i, a * e - b * d]


def within_court(x: Column, y: Column, margin: float = 3.0) -> Column:
    """Inclusive bounds; unknown and not-a-number positions are outside."""
    inside = x.between(lit(-margin), lit(COURT_WIDTH_M + margin)) & y.between(lit(-margin), lit(COURT_LENGTH_M + margin))
    return F.coalesce(inside, F.lit(False))


def zone(x: Column, y: Column) -> Column:
    """Zone 1-6 of a court position, clamped into the court.

    Each half has a front row (4 3 2) at the net and a back row (5 6 1), seen by a
    team that faces the net; the far half is the near one turned by 180 degrees.
    """
    cx = F.least(F.greatest(x, lit(0)), lit(COURT_WIDTH_M - 1e-9))
    cy = F.least(F.greatest(y, lit(0)), lit(COURT_LENGTH_M - 1e-9))
    col = F.floor(cx / lit(COURT_WIDTH_M / 3)).cast("int")
    near = cy <= lit(NET_Y_M)
    left = F.when(near, col).otherwise(2 - col)  # column from the team's own left
    front = F.abs(cy - lit(NET_Y_M)) <= lit(FRONT_ZONE_DEPTH_M)
    back = F.element_at(F.array(F.lit(5), F.lit(6), F.lit(1)), left + 1)
    return F.when(x.isNotNull() & y.isNotNull(), F.when(front, 4 - left).otherwise(back))


def measurement_variance(confidence: Column, low: float = 3.0, high: float = 30.0) -> Column:
    c = F.least(F.greatest(confidence, lit(0)), lit(1))
    sigma = lit(low) + lit(high - low) * (lit(1) - c)
    return sigma * sigma


def half_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)


def fixed(x: Column, digits: int) -> Column:
    """Rounded half up on the binary value, with the same two operations in any engine."""
    return F.floor(x * lit(10**digits) + lit(0.5)).cast("double") / lit(10**digits)


def seconds(frame: Column, fps: Column) -> Column:
    return F.bround(F.try_divide(frame.cast("double"), fps), 2)


def bucket(center: Column, width: float = 40.0) -> Column:
    """The nearest multiple of ``width``, halves to even."""
    return F.rint(center / lit(width)) * lit(width)


def sample_indices(total: Column, count: Column, distinct: bool = False) -> Column:
    """Array of ``count`` frame numbers spread over a clip, inside a margin of 2 %."""
    margin = F.greatest(F.lit(1).cast("bigint"), F.floor(total * lit(0.02)).cast("bigint"))
    step = F.greatest(F.lit(1).cast("bigint"), count.cast("bigint") - 1)
    at = F.transform(
        F.sequence(F.lit(0).cast("bigint"), count.cast("bigint") - 1),
        lambda i: margin + F.floor(F.try_divide(i * (total - 2 * margin), step)).cast("bigint"),
    )
    return F.array_distinct(at) if distinct else at


def video_summary(width: Column, height: Column, fps: Column, frames: Column) -> list[Column]:
    duration = F.when(fps == 0, lit(0)).otherwise(F.try_divide(frames.cast("double"), fps))
    return [F.concat_ws("x", width.cast("string"), height.cast("string")).alias("resolution"), F.bround(fps, 2).alias("fps"), F.bround(duration, 1).alias("duration_s")]


def normalised_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> list[Column]:
    """Centre and size as fractions of the image."""
    cx, cy = box_center(x1, y1, x2, y2)
    return [cx / width, cy / height, F.abs(x2 - x1) / width, F.abs(y2 - y1) / height]


def corners(cx: Column, cy: Column, w: Column, h: Column) -> list[Column]:
    """Integer corners of a centred box, cut towards zero."""
    return [(v).cast("int") for v in (cx - w / lit(2), cy - h / lit(2), cx + w / lit(2), cy + h / lit(2))]


def drawn_box(ax: Column, ay: Column, bx: Column, by: Column, scale: Column) -> list[Column]:
    """Two dragged corners on a scaled display as a box in native pixels."""
    return [F.least(ax, bx) / scale, F.least(ay, by) / scale, F.greatest(ax, bx) / scale, F.greatest(ay, by) / scale]


def ellipse_polygon(cx: Column, cy: Column, w: Column, h: Column, points: int = 16) -> Column:
    """Array of structs ``x, y`` on the ellipse inside a box."""
    turns = [2 * math.pi * i / points for i in range(points)]
    return F.array(*[F.struct((cx + w / lit(2) * lit(math.cos(t))).alias("x"), (cy + h / lit(2) * lit(math.sin(t))).alias("y")) for t in turns])


def mean_abs_difference(a: Column, b: Column) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lit(0), lambda acc, x: acc + x)
    return F.coalesce(F.try_divide(total, F.size(a)), lit(0))
