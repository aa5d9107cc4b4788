"""The registered player tracking queries over clips of more than 400 frames."""

import sys

import numpy as np
from pyspark.sql import functions as F

from rallyloom.operators.players import PlayerFold, player_tracks
from rallyloom.params import PlayerParams
from rallyloom.plans import adapters, registry

FRAMES = 900


def boxes(f):
    """Six boxes of a frame, by the formulas of FIXTURES.md."""
    feet = [(250.0 + 130 * p + (f * (p + 2)) % 200, 180.0 + 60 * p + (f * (2 * p + 1)) % 170) for p in range(1, 6)] + [(200.0 + f % 3, 300.0)]
    return np.array([(x - 30, y - 120, x + 30, y) for x, y in feet])


def test_every_frame_of_every_clip_is_tracked(spark, tmp_path):
    events = [(i, i % 4, 1.0, "click") for i in range(4 * FRAMES)]
    spark.createDataFrame(events, "event_id bigint, user_id bigint, value double, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    fold, spans = PlayerFold(PlayerParams(), adapters.FPS), {}
    kept = [f for f in range(FRAMES) if f % 400 < 300]
    for f in range(FRAMES):
        shown = f in set(kept)
        for track, _ in fold.step(f, boxes(f) if shown else np.empty((0, 4)), np.full(6 if shown else 0, 0.8)):
            n, first, _ = spans.get(track, (0, f, f))
            spans[track] = (n + 1, first, f)
    want = sorted((clip, track, *span) for clip in range(4) for track, span in spans.items())
    assert max(w[4] for w in want) == kept[-1] == FRAMES - 1
    assert adapters.player_boxes(spark, str(tmp_path)).count() == 4 * 6 * len(kept)
    rows = registry.QUERIES["player_tracks"](spark, str(tmp_path)).collect()
    assert sorted((r.clip, r.track_id, r.frames, r.first_frame, r.last_frame) for r in rows) == want
    counts = registry.QUERIES["player_track_counts"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, counts)) == [(clip, len(spans)) for clip in range(4)]


def test_work_of_a_frame_is_small():
    """Function calls a frame: some thousand when every track held arrays of its own, so a million frames took most of an hour."""
    fold, calls = PlayerFold(PlayerParams(), adapters.FPS), 0

    def count(_frame, event, _arg) -> None:
        nonlocal calls
        calls += event in ("call", "c_call")

    for f in range(FRAMES):
        found = boxes(f)
        sys.setprofile(count if f >= 400 else None)
        try:
            fold.step(f, found, np.full(6, 0.8))
        finally:
            sys.setprofile(None)
    assert calls / (FRAMES - 400) < 600


def test_frames_cut_by_batches_are_whole(spark):
    rows = [(c, f, *map(float, b), 0.8, i) for c in range(3) for f in range(40) for i, b in enumerate(boxes(f))]
    df = spark.createDataFrame(rows, "clip bigint, frame_idx bigint, x1 double, y1 double, x2 double, y2 double, confidence double, ord int")
    want, name = sorted(map(tuple, player_tracks(df, 30.0).collect())), "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(name)
    for size in ("1", "4", "7"):
        spark.conf.set(name, size)
        try:
            assert sorted(map(tuple, player_tracks(df, 30.0).collect())) == want
        finally:
            spark.conf.set(name, usual)
    assert len(want) > 3 * 40 * 4


def test_clips_do_not_share_a_task(spark):
    rows = [(c, f, *map(float, b), 0.8, i) for c in range(4) for f in range(3) for i, b in enumerate(boxes(f))]
    df = spark.createDataFrame(rows, "clip bigint, frame_idx bigint, x1 double, y1 double, x2 double, y2 double, confidence double, ord int")
    dealt = player_tracks(df, 30.0).select("clip", F.spark_partition_id().alias("task")).distinct().collect()
    assert len({r.task for r in dealt}) == len(dealt) == 4
