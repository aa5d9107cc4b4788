"""Touches, zones, stationary tracks and the match statistics document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyloom.functions.geometry import distance, seconds, within_court, zone
from rallyloom.operators.events import ball_contacts, in_play, net_crossings, rallies, to_court
from rallyloom.params import EventParams
from rallyloom.sources.scratch import stored


def stationary_tracks(feet: DataFrame, params: EventParams = EventParams()) -> DataFrame:
    """``clip, track_id`` of long tracks whose foot points stay inside a small box."""
    spans = feet.groupBy("clip", "track_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("fx").alias("x1"), F.min("fy").alias("y1"), F.max("fx").alias("x2"), F.max("fy").alias("y2")
    )
    extent = distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    still = (F.col("n") >= params.stationary_min_frames) & (extent <= params.stationary_max_extent)
    return spans.where(still).select("clip", "track_id", "n", extent.alias("extent"))


def active_positions(feet: DataFrame, homographies: DataFrame, params: EventParams = EventParams()) -> DataFrame:
    """Court positions of tracks in bounds that are not stationary."""
    court = to_court(feet, homographies, "fx", "fy").where(within_court(F.col("x"), F.col("y"), params.bounds_margin))
    return court.join(stationary_tracks(feet, params).select("clip", "track_id"), ["clip", "track_id"], "left_anti")


def touches(contacts: DataFrame, ball_court: DataFrame, players: DataFrame) -> DataFrame:
    """Each contact with the nearest player of its frame: ``clip, frame_idx, track_id, distance_m``.

    No ball position drops the contact; no player leaves null. Ties go to the
    smaller ``ord`` (the tracker's output order), or track id where there is none.
    """
    order = F.col("ord") if "ord" in players.columns else F.col("track_id")
    p = players.select("clip", "frame_idx", "track_id", F.col("x").alias("qx"), F.col("y").alias("qy"), order.alias("_ord"))
    at = contacts.select("clip", "frame_idx").join(ball_court.select("clip", "frame_idx", "x", "y"), ["clip", "frame_idx"])
    pairs = at.join(p, ["clip", "frame_idx"], "left").withColumn("d", distance(F.col("x"), F.col("y"), F.col("qx"), F.col("qy")))
    # Nulls sort before all structs of min_by, so frames without players are kept as null.
    best = F.min_by(F.struct("track_id", "d"), F.when(F.col("track_id").isNotNull(), F.struct("d", "_ord")))
    return pairs.groupBy("clip", "frame_idx").agg(best.alias("b")).select("clip", "frame_idx", F.col("b.track_id").alias("track_id"), F.col("b.d").alias("distance_m"))


def zone_occupancy(players: DataFrame) -> DataFrame:
    """``clip, track_id, zone, n``: frames of each track in each zone."""
    return players.groupBy("clip", "track_id", zone(F.col("x"), F.col("y")).alias("zone")).agg(F.count(F.lit(1)).alias("n"))


def zone_occupancy_wide(players: DataFrame) -> DataFrame:
    """One column a zone; the list of zones is fixed, so the pivot needs no extra pass."""
    wide = players.withColumn("zone", zone(F.col("x"), F.col("y"))).groupBy("clip", "track_id").pivot("zone", [1, 2, 3, 4, 5, 6]).count()
    return wide.select("clip", "track_id", *[F.coalesce(F.col(str(z)), F.lit(0)).cast("bigint").alias(f"zone_{z}") for z in range(1, 7)])


def match_stats(ball: DataFrame, feet: DataFrame, homographies: DataFrame, clips: DataFrame, params: EventParams = EventParams()) -> DataFrame:
    """One nested document a clip: ``clip, video, fps, frame_range, rallies, touches,
    zone_occupancy, excluded_stationary_track_ids``.

    ``clips`` has ``clip, video, fps, first_frame, last_frame``. The lists of a
    document are per clip, as a rally or touch is a few rows a minute. Tables that
    several parts of the document need are stored, so that inputs are read once.
    """
    ball_court = stored(to_court(ball, homographies), "ball-court")
    feet = stored(feet, "feet")
    rally = stored(rallies(ball_court, net_crossings(ball_court, params), params), "rallies")
    players = stored(in_play(active_positions(feet, homographies, params), rally), "players")
    ball = ball_court.select("clip", "frame_idx", "cx", "cy")
    touched = touches(in_play(ball_contacts(ball, params), rally), ball_court, players)
    fps = clips.select("clip", "fps")
    r = rally.join(fps, "clip").groupBy("clip").agg(
        F.sort_array(F.collect_list(F.struct("start_frame", "end_frame", "net_crossings", seconds(F.col("start_frame"), F.col("fps")).alias("start_s"), seconds(F.col("end_frame"), F.col("fps")).alias("end_s")))).alias("rallies")
    )
    t = touched.join(fps, "clip").groupBy("clip").agg(
        F.sort_array(F.collect_list(F.struct("frame_idx", "track_id", F.bround("distance_m", 2).alias("distance_m"), seconds(F.col("frame_idx"), F.col("fps")).alias("time_s")))).alias("touches")
    )
    z = zone_occupancy(players).groupBy("clip", "track_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("zone", "n")))).alias("zones"))
    z = z.groupBy("clip").agg(F.map_from_entries(F.collect_list(F.struct(F.col("track_id").cast("string").alias("k"), F.col("zones").alias("v")))).alias("zone_occupancy"))
    s = stationary_tracks(feet, params).groupBy("clip").agg(F.sort_array(F.collect_list("track_id")).alias("excluded_stationary_track_ids"))
    doc = clips.join(r, "clip", "left").join(t, "clip", "left").join(z, "clip", "left").join(s, "clip", "left")
    return doc.select("clip", "video", "fps", F.array("first_frame", "last_frame").alias("frame_range"), "rallies", "touches", "zone_occupancy", "excluded_stationary_track_ids")
