"""Queries over ``events``: the match pipeline from tracks to statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyloom.functions.geometry import fixed, half_even, lit, seconds
from rallyloom.operators import events as ev
from rallyloom.operators import gapfill, stats, tracking
from rallyloom.plans import adapters as ad
from rallyloom.sources.scratch import stored


def _court(spark: SparkSession, d: str) -> DataFrame:
    return ev.to_court(ad.ball(spark, d), ad.homographies(spark))


def _rallies(spark: SparkSession, d: str) -> DataFrame:
    court = _court(spark, d)
    return ev.rallies(court, ev.net_crossings(court))


def _players(spark: SparkSession, d: str) -> DataFrame:
    return ev.in_play(stats.active_positions(ad.feet(spark, d), ad.homographies(spark)), _rallies(spark, d))


def ball_contacts(spark, d):
    return ev.ball_contacts(ad.ball(spark, d))


def court_positions(spark, d):
    return _court(spark, d).select("clip", "frame_idx", fixed(F.col("x"), 6).alias("x"), fixed(F.col("y"), 6).alias("y"))


def net_crossings(spark, d):
    return ev.net_crossings(_court(spark, d))


def rallies(spark, d):
    return _rallies(spark, d)


def rally_seconds(spark, d):
    fps = lit(ad.FPS)
    return _rallies(spark, d).select("clip", "rally_id", seconds(F.col("start_frame"), fps).alias("start_s"), seconds(F.col("end_frame"), fps).alias("end_s"))


def in_play_frames(spark, d):
    return ev.rally_frames(_rallies(spark, d))


def touches(spark, d):
    contacts = ev.in_play(ev.ball_contacts(ad.ball(spark, d)), _rallies(spark, d))
    return stats.touches(contacts, _court(spark, d), _players(spark, d)).withColumn("distance_m", fixed(F.col("distance_m"), 6))


def stationary_tracks(spark, d):
    return stats.stationary_tracks(ad.feet(spark, d)).withColumn("extent", fixed(F.col("extent"), 6))


def active_positions(spark, d):
    found = stats.active_positions(ad.feet(spark, d), ad.homographies(spark))
    return found.select("clip", "frame_idx", "track_id", fixed(F.col("x"), 6).alias("x"), fixed(F.col("y"), 6).alias("y"))


def zone_occupancy(spark, d):
    return stats.zone_occupancy(_players(spark, d))


def zone_occupancy_wide(spark, d):
    return stats.zone_occupancy_wide(_players(spark, d))


def match_stats_doc(spark, d):
    frames = stored(ad.frames(spark, d), "frames")
    return stats.match_stats(ad.ball_of(frames), ad.feet_of(frames), ad.homographies(spark), ad.clips_of(frames))


def match_stats_summary(spark, d):
    """The statistics document, flattened: its lists as counts and sums."""
    doc = match_stats_doc(spark, d)
    total = lambda name, field: F.aggregate(F.transform(name, lambda x: x[field]), lit(0), lambda a, x: a + F.coalesce(x, lit(0)))
    some = lambda name, c: F.when(F.col(name).isNotNull(), c)
    return doc.select(
        "clip", "video", F.col("frame_range")[0].alias("first_frame"), F.col("frame_range")[1].alias("last_frame"),
        some("rallies", F.size("rallies")).cast("bigint").alias("rallies"),
        F.aggregate("rallies", F.lit(0).cast("bigint"), lambda a, x: a + x["net_crossings"]).alias("crossings"), half_even(total("rallies", "end_s"), 4).alias("end_s"),
        some("touches", F.size("touches")).cast("bigint").alias("touches"), half_even(total("touches", "distance_m"), 4).alias("distance_m"),
        some("zone_occupancy", F.size("zone_occupancy")).cast("bigint").alias("players"), F.array_join(F.col("excluded_stationary_track_ids").cast("array<string>"), ",").alias("excluded"),
    )


def linear_gap_fill(spark, d):
    filled = gapfill.fill_linear(ad.observed(spark, d))
    return filled.withColumns({c: fixed(F.col(c), 6) for c in ("cx", "cy")})


def heuristic_track(spark, d):
    return tracking.heuristic_track(ad.candidates(spark, d)).withColumns({c: fixed(F.col(c), 6) for c in ("cx", "cy")})


def kalman_track(spark, d):
    states = tracking.kalman_track(ad.candidates(spark, d))
    return states.select("clip", "frame_idx", *[fixed(F.col(c), 4).alias(c) for c in ("px", "py", "vx", "vy")], "is_contact")


def _filled(spark: SparkSession, d: str) -> DataFrame:
    return gapfill.fill_ballistic(tracking.kalman_track(ad.candidates(spark, d)))


def ballistic_gap_fill(spark, d):
    return _filled(spark, d).withColumns({c: fixed(F.col(c), 4) for c in ("cx", "cy")})


def track_coverage(spark, d):
    return gapfill.coverage(_filled(spark, d))


def overlay_markers(spark, d):
    """What a renderer draws: marker centres, filled where the ball was seen."""
    return _filled(spark, d).select("clip", "frame_idx", half_even(F.col("cx"), 0).cast("int").alias("mx"), half_even(F.col("cy"), 0).cast("int").alias("my"), (~F.col("is_interpolated")).alias("filled"))


QUERIES = {
    f.__name__: f
    for f in (
        ball_contacts, court_positions, net_crossings, rallies, rally_seconds, in_play_frames, touches, stationary_tracks, active_positions, zone_occupancy,
        zone_occupancy_wide, match_stats_doc, match_stats_summary, linear_gap_fill, heuristic_track, kalman_track, ballistic_gap_fill, track_coverage, overlay_markers,
    )
}
