"""Registered queries against their SQL on the smallest tables, and the plans they make."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rallyloom.plans import registry
from rallyloom.streaming import live as streaming

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
QUICK = [
    "ball_contacts", "net_crossings", "rallies", "touches", "zone_occupancy_wide", "match_stats_summary", "linear_gap_fill", "heuristic_track", "kalman_track", "ballistic_gap_fill",
    "positives_spaced", "fp_negatives", "round2_candidates", "random_negatives", "stratified_split", "interleaved_manifest", "manifest_counts", "precision_recall",
    "best_candidate", "homography_reprojection", "verify_frames", "streaming_rallies", "streaming_tumbling", "streaming_sliding", "detections_file", "homography_files", "points_files",
    "verification_files", "manifest_file", "scan_file", "worksheet_file", "detect_union", "image_signatures", "segmentation_counts", "stats_files",
]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    result = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = lambda rows, names: sorted(repr([tuple(r)[names.index(c)] for c in sorted(names)]) for r in rows)
    assert order(df.collect(), df.columns) == order(result.fetchall(), columns)


def test_every_query_is_named_once():
    assert set(registry.ORACLES) <= set(registry.QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_streamed_track_is_the_batch_track(spark):
    batch = {tuple(r) for r in registry.QUERIES["kalman_track"](spark, DATA).collect()}
    live = {tuple(r) for r in registry.QUERIES["streaming_track"](spark, DATA).collect()}
    assert live == batch


def test_a_silent_clip_is_released_by_its_timer(spark, tmp_path):
    """Clip 0 stops at frame 10 without an end marker, clip 1 goes on: the watermark releases clip 0's last frames."""
    rows = [(0, f, 0, 100.0 + f, 50.0, 0.9) for f in range(11)] + [(1, f, 0, 300.0 + f, 80.0, 0.9) for f in range(40)]
    df = spark.createDataFrame(rows, "clip bigint, frame_idx bigint, ord int, cx double, cy double, confidence double")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    got = streaming.drain(streaming.kalman_stream(stream, lateness="5 milliseconds"), f"{tmp_path}/run").collect()
    assert sorted(r.frame_idx for r in got if r.clip == 0) == [*range(11)]
    assert sorted(r.frame_idx for r in got if r.clip == 1) == [*range(38)]  # its look-ahead may still come


def test_no_product_of_points_and_rallies(spark):
    """The range join works block by block: twice the clip makes twice the pairs, not four times."""
    from rallyloom.operators import events as ev
    from rallyloom.operators.spread import block_of

    sizes = []
    for n in (4_000, 8_000):
        points = spark.range(n).select(F.lit(0).cast("bigint").alias("clip"), F.col("id").alias("frame_idx"))
        spans = spark.range(n // 100).select(F.lit(0).cast("bigint").alias("clip"), (F.col("id") * 100).alias("start_frame"), (F.col("id") * 100 + 49).alias("end_frame"))
        found = ev.within(points, spans, "inner")
        assert found.count() == n // 2 and ev.within(points, spans, "left_semi").count() == n // 2
        touched = spans.select(F.explode(F.sequence(block_of(F.col("start_frame")), block_of(F.col("end_frame")))).alias("b"))
        sizes.append(points.join(touched, block_of(F.col("frame_idx")) == F.col("b")).count())
    assert sizes[1] <= 2.2 * sizes[0]


@pytest.mark.parametrize("name", ["rallies", "touches", "zone_occupancy", "fp_negatives"])
def test_no_nested_loops_or_python(spark, name):
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "Python" not in plan and "Arrow" not in plan
