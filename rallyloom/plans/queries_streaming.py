"""Streaming queries, drained once: their input is laid out as files, read as a stream, and the result read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyloom.functions.geometry import fixed
from rallyloom.operators import events as ev
from rallyloom.plans import adapters as ad
from rallyloom.sources.scratch import shared_place
from rallyloom.streaming import live


def _as_stream(df: DataFrame, place: str) -> DataFrame:
    df.write.parquet(f"{place}/in")
    return df.sparkSession.readStream.schema(df.schema).parquet(f"{place}/in")


def streaming_rallies(spark: SparkSession, d: str) -> DataFrame:
    court = ev.to_court(ad.ball(spark, d), ad.homographies(spark)).select("clip", "frame_idx", "x", "y")
    crossing = ev.net_crossings(court).withColumn("is_crossing", F.lit(True))
    rows = court.join(crossing, ["clip", "frame_idx"], "left").withColumn("is_crossing", F.coalesce("is_crossing", F.lit(False)))
    place = shared_place(spark, "rallies")
    return live.drain(live.rally_sessions(_as_stream(rows, place)), place, "complete")


def streaming_track(spark: SparkSession, d: str) -> DataFrame:
    place = shared_place(spark, "track")
    candidates = ad.candidates(spark, d)
    states = live.drain(live.kalman_stream(_as_stream(candidates.unionByName(live.end_markers(candidates)), place)), place)
    return states.select("clip", "frame_idx", *[fixed(F.col(c), 4).alias(c) for c in ("px", "py", "vx", "vy")], "is_contact")


def _windows(spark: SparkSession, d: str, slide: int | None) -> DataFrame:
    place = shared_place(spark, "windows")
    rows = ad.candidates(spark, d).select("clip", "frame_idx")
    return live.drain(live.window_counts(_as_stream(rows, place), 100, slide), place, "complete")


def streaming_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Ball candidates by windows of 100 frames."""
    return _windows(spark, d, None)


def streaming_sliding(spark: SparkSession, d: str) -> DataFrame:
    """The same by windows that begin every 40 frames."""
    return _windows(spark, d, 40)


QUERIES = {f.__name__: f for f in (streaming_rallies, streaming_track, streaming_tumbling, streaming_sliding)}
