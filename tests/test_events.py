"""Contacts, crossings, rallies, touches, zones and stationary tracks on small tables."""

import pytest
from pyspark.sql import functions as F

from rallyloom.functions.geometry import within_court, zone
from rallyloom.operators import events as ev
from rallyloom.operators import stats


def ball(spark, ys, clip=0):
    return spark.createDataFrame([(clip, f, 0.0, float(y)) for f, y in ys.items()], "clip bigint, frame_idx bigint, cx double, cy double")


def court(spark, points):
    return spark.createDataFrame([(0, f, float(x), float(y)) for f, (x, y) in points.items()], "clip bigint, frame_idx bigint, x double, y double")


def frames(df):
    return sorted(r.frame_idx for r in df.collect())


def parabola(*peaks):
    return {f: max(400 - (f - c) ** 2 for c in peaks) for f in range(peaks[-1] + 20)}


@pytest.mark.parametrize("ys,want", [
    (parabola(20), [20]), (parabola(10, 40), [10, 40]), ({f: 100 + f % 2 * 2 for f in range(40)}, []),
    ({f: 400 - (f - 3) ** 2 for f in range(6)}, []), ({f: 400 - max(0, abs(f - 20.5) - 0.5) ** 2 for f in range(40)}, [20]), ({}, []),
])
def test_contacts(spark, ys, want):
    assert frames(ev.ball_contacts(ball(spark, ys))) == want


@pytest.mark.parametrize("points,want", [
    ({0: (4, 8), 1: (4, 10)}, [1]), ({0: (40, 8), 1: (40, 10)}, []), ({0: (4, 8), 10: (4, 10)}, []), ({0: (4, 7), 1: (4, 8)}, []),
    ({0: (4, 8), 1: (4, 10), 2: (4, 10), 3: (4, 8)}, [1, 3]), ({0: (4, 8), 1: (4, 9), 2: (4, 10)}, []),
])
def test_crossings(spark, points, want):
    assert frames(ev.net_crossings(court(spark, points))) == want


@pytest.mark.parametrize("points,crossings,want", [
    ({f: (4, 9) for f in range(20)}, [5, 12], [(0, 19, 2)]), ({f: (4, 9) for f in range(20)}, [5], []),
    ({f: (4, 9) for f in [*range(20), *range(200, 220)]}, [5, 12, 205, 210], [(0, 19, 2), (200, 219, 2)]),
    ({f: (4, 9) if not 20 <= f < 150 else (400, 900) for f in range(170)}, [5, 12, 155, 160], [(0, 19, 2), (150, 169, 2)]),
    ({0: (4, 9), 90: (4, 9)}, [0, 90], [(0, 90, 2)]), ({0: (4, 9), 91: (4, 9)}, [0, 91], []), ({}, [], []),
])
def test_rallies(spark, points, crossings, want):
    hits = spark.createDataFrame([(0, c) for c in crossings], "clip bigint, frame_idx bigint")
    got = ev.rallies(court(spark, points), hits)
    assert sorted((r.start_frame, r.end_frame, r.net_crossings) for r in got.collect()) == want


def test_rally_frames_are_distinct(spark):
    r = spark.createDataFrame([(0, 0, 2), (0, 2, 3)], "clip bigint, start_frame bigint, end_frame bigint")
    assert frames(ev.rally_frames(r)) == [0, 1, 2, 3]


def test_touches(spark):
    contacts = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (0, 4)], "clip bigint, frame_idx bigint")
    at = court(spark, {1: (1, 1), 2: (1, 1), 4: (0, 0)})
    players = spark.createDataFrame([(0, 1, 1, 3.0, 1.0), (0, 1, 2, 1.3, 1.0), (0, 4, 9, 1.0, 0.0), (0, 4, 8, 0.0, 1.0)], "clip bigint, frame_idx bigint, track_id bigint, x double, y double")
    got = {r.frame_idx: (r.track_id, r.distance_m and round(r.distance_m, 6)) for r in stats.touches(contacts, at, players).collect()}
    assert got == {1: (2, 0.3), 2: (None, None), 4: (8, 1.0)}


ZONES = [(1, 7, 4), (4, 7, 3), (8, 7, 2), (1, 2, 5), (4, 2, 6), (8, 2, 1), (1, 10, 2), (4, 10, 3), (8, 10, 4), (1, 16, 1), (4, 16, 6), (8, 16, 5), (-5, -5, 5), (20, 30, 5), (4, 9, 3), (4, 6, 3), (4, 5.999, 6)]


def test_zones(spark):
    df = spark.createDataFrame([(float(x), float(y), z) for x, y, z in ZONES], "x double, y double, want int")
    assert df.where(zone(F.col("x"), F.col("y")) != F.col("want")).count() == 0


def test_zone_occupancy(spark):
    df = spark.createDataFrame([(0, 1, 1.0, 2.0), (0, 1, 1.0, 2.0), (0, 1, 4.0, 2.0), (0, 2, 8.0, 2.0), (0, 2, 8.0, 2.0)], "clip bigint, track_id bigint, x double, y double")
    assert {(r.track_id, r.zone, r.n) for r in stats.zone_occupancy(df).collect()} == {(1, 5, 2), (1, 6, 1), (2, 1, 2)}


def test_stationary(spark):
    rows = [(0, f, 1, 100.0 + f % 3, 50.0) for f in range(200)] + [(0, f, 2, 5.0 * f, 50.0) for f in range(200)] + [(0, f, 3, 1.0, 1.0) for f in range(50)]
    df = spark.createDataFrame(rows, "clip bigint, frame_idx bigint, track_id bigint, fx double, fy double")
    assert [r.track_id for r in stats.stationary_tracks(df).collect()] == [1]


def test_bounds_take_no_unknown_positions(spark):
    df = spark.createDataFrame([(-3.0, 21.0), (12.1, 0.0), (None, 0.0), (float("nan"), 0.0)], "x double, y double")
    assert [r[0] for r in df.select(within_court(F.col("x"), F.col("y"))).collect()] == [True, False, False, False]
