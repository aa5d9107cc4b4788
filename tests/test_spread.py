"""Blocks of frames against whole clips."""

import random

import pytest
from pyspark.sql import functions as F

from rallyloom.operators import spread


@pytest.mark.parametrize("gap,size", [(3, 4), (3, 64), (15, 7), (90, 512)])
def test_pieces(spark, gap, size):
    rng, rows = random.Random(gap * size), []
    for clip in range(3):
        f = rng.randrange(5)
        for _ in range(200):
            rows.append((clip, f))
            f += rng.choice((1, 1, 2, gap, gap + 1, 3 * size if rng.random() < 0.1 else 1))
    want, last = {}, {}
    for clip, f in rows:
        begun, before = last.get(clip, (f, f))
        begun = f if f - before > gap else begun
        last[clip] = begun, f
        want[clip, f] = begun
    got = spread.pieces(spark.createDataFrame(rows, "clip bigint, frame_idx bigint").repartition(5), gap, size)
    assert {(r.clip, r.frame_idx): r.piece for r in got.collect()} == want and got.columns == ["clip", "frame_idx", "piece"]


def test_guests_stay_at_home(spark):
    df = spark.range(40).select(F.lit(0).alias("clip"), F.col("id").alias("frame_idx"))
    got = spread.with_guests(df, 2, 3, 10)
    assert got.where("at_home").count() == 40
    assert {(r.frame_idx, r.block) for r in got.where("not at_home").collect()} == {(8, 1), (9, 1), (10, 0), (11, 0), (12, 0), (18, 2), (19, 2), (20, 1), (21, 1), (22, 1), (28, 3), (29, 3), (30, 2), (31, 2), (32, 2), (38, 4), (39, 4), (0, -1), (1, -1), (2, -1)}
