"""Selectors, splits, labels, quality, calibration, external models and files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallyloom.functions import geometry as geo
from rallyloom.operators import calibration, curation, external, labels, quality
from rallyloom.operators.events import to_court
from rallyloom.sources import files, video


def scores(spark, values):
    return spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(values)], "clip string, frame_idx bigint, score double")


def brute_spaced(values, quota, spacing):
    chosen = []
    for i in sorted(range(len(values)), key=lambda i: (-values[i], i)):
        if len(chosen) < max(quota, 1) and all(abs(i - j) >= spacing for j in chosen):
            chosen.append(i)
    return chosen


@pytest.mark.parametrize("quota,spacing", [(3, 4), (50, 2), (0, 3)])
def test_spaced_top_k(spark, quota, spacing):
    values = [round(float(v), 1) for v in np.random.default_rng(quota).uniform(0, 3, 60)]
    got = curation.spaced_top_k(scores(spark, values), quota, spacing).orderBy("rank").collect()
    assert [r.frame_idx for r in got] == brute_spaced(values, quota, spacing)


def test_motion_scores(spark):
    df = spark.createDataFrame([("c", i, [float(v), 0.0]) for i, v in enumerate([0, 2, 2, 8])], "clip string, frame_idx bigint, signature array<double>")
    got = [r.score for r in curation.motion_scores(df).orderBy("frame_idx").collect()]
    assert got == [0.5, 1 / 3, 4 / 3, 1.5]


def test_round_robin(spark):
    df = spark.createDataFrame([("m", "a", 1), ("m", "a", 2), ("m", "a", 3), ("m", "b", 4), ("n", "b", 5), ("n", "a", 6)], "selection_reason string, clip string, ord bigint")
    assert [r.ord for r in curation.interleave(df).orderBy("position").collect()] == [1, 4, 2, 3, 6, 5]


@pytest.mark.parametrize("n,val", [(1, 1), (3, 1), (10, 2), (30, 4), (50, 8)])
def test_split_sizes_round_half_to_even(spark, n, val):
    df = spark.range(n).withColumn("g", F.lit("x"))
    assert curation.stratified_split(df, ["g"], "id").where("split = 'val'").count() == val


def test_negatives_lose_positives_after_the_quota(spark):
    hits = spark.createDataFrame([("c", f, 0, 400.0, 400.0) for f in (1, 2, 3)] + [("c", 4, 0, 40.0, 40.0)], "clip string, frame_id bigint, ord int, cx double, cy double")
    positives = spark.createDataFrame([("c", 1)], "clip string, frame_id bigint")
    assert sorted(r.frame_id for r in curation.known_false_positives(hits, 3, positives).collect()) == [2, 3]


def test_before_events(spark):
    events = spark.createDataFrame([("c", 2, 1), ("c", 9, 2)], "clip string, frame_idx bigint, rank bigint")
    existing = spark.createDataFrame([("c", 8)], "clip string, frame_idx bigint")
    assert [r.frame_idx for r in curation.before_events(events, existing, 3).orderBy("pos").collect()] == [1, 6, 4]


@pytest.mark.parametrize("total,count,want", [(100, 3, [2, 50, 98]), (100, 1, [2]), (10, 2, [1, 9])])
def test_sample_indices(spark, total, count, want):
    assert spark.range(1).select(geo.sample_indices(F.lit(total).cast("bigint"), F.lit(count)).alias("x")).first().x == want


def test_half_even_bucket(spark):
    got = spark.createDataFrame([(60.0,), (100.0,), (59.0,)], "c double").select(geo.bucket(F.col("c"))).collect()
    assert [r[0] for r in got] == [80.0, 80.0, 40.0]


def test_polygons(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.2, 0.2)], "xc double, yc double, w double, h double")
    row = labels.to_polygons(df).withColumn("line", labels.polygon_line(F.lit(0), F.col("polygon"))).first()
    assert len(row.polygon) == 16 and len(row.line.split()) == 33
    assert all(abs((p.x - 0.5) ** 2 + (p.y - 0.5) ** 2 - 0.01) < 1e-12 for p in row.polygon)


def test_label_files_hold_negatives(spark):
    lines = spark.createDataFrame([("val", "a", 1, "two"), ("val", "a", 0, "one")], "split string, stem string, line_no int, line string")
    stems = spark.createDataFrame([("val", "a"), ("val", "b")], "split string, stem string")
    assert {r.stem: r.content for r in labels.label_files(lines, stems).collect()} == {"a": "one\ntwo\n", "b": ""}


@pytest.mark.parametrize("local,conf,visible,bbox,want", [
    (0.5, None, None, None, "tier1"), (0.1, "high", True, True, "tier2_positive"), (0.1, "medium", False, None, "tier2_negative"),
    (0.1, "high", True, False, "tier3"), (0.1, "low", True, True, "tier3"), (0.1, None, None, None, "tier3"),
])
def test_tiers(spark, local, conf, visible, bbox, want):
    df = spark.createDataFrame([(local, conf, visible, bbox)], "local_conf double, confidence string, ball_visible boolean, has_bbox boolean")
    assert labels.assign_tiers(df).first().tier == want
    if want.startswith("tier2"):
        assert labels.assign_tiers(df, skip_remote=True).first().tier == "tier3"


def test_precision_recall_of_blank_cells(spark):
    df = spark.createDataFrame([("a", "3", "1", ""), ("a", "", None, "1"), ("b", "", "", "")], "k string, tp string, fp string, fn string")
    got = {r.k: r for r in quality.precision_recall(df, ["k"]).collect()}
    assert (got["a"].precision, got["a"].recall) == (0.75, 0.75) and np.isnan(got["b"].precision)


def test_homography_round_trip(spark):
    reference = calibration.reference_points(spark)
    true = np.array([[0.01, 0.001, -2.0], [0.0, 0.04, -6.0], [0.0, 0.0002, 1.0]])
    inverse = np.linalg.inv(true)
    rows = []
    for r in reference.collect():
        v = inverse @ [r.court_x, r.court_y, 1]
        rows.append((0, r.label, float(v[0] / v[2]), float(v[1] / v[2])))
    points = spark.createDataFrame([*rows, (0, "nonsense", 1.0, 1.0)], "clip bigint, label string, px double, py double")
    h = calibration.fit_homographies(points, reference)
    back = to_court(points, h, "px", "py").join(reference, "label")
    assert back.where("abs(x - court_x) > 1e-6 or abs(y - court_y) > 1e-6").count() == 0
    again = calibration.to_pixels(back.select("clip", "label", F.col("px").alias("ox"), F.col("py").alias("oy"), "x", "y"), h)
    assert again.where("abs(px - ox) > 1e-5 or abs(py - oy) > 1e-5").count() == 0
    with pytest.raises(ValueError):
        calibration.fit(np.zeros((2, 2)), np.zeros((2, 2)))


def test_backoff_waits_as_told():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise external.RateLimited(7.0 if len(calls) == 2 else None)
        return {"ok": True}

    assert external.with_backoff(call, sleep=waits.append, jitter=lambda: 0.5) == {"ok": True}
    assert waits == [2.5, 7.0, 8.5]
    with pytest.raises(KeyError):
        external.with_backoff(lambda: {}["x"], sleep=waits.append)


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_text("frame_idx,class,x1,y1,x2,y2,confidence\n3,player,1,2,3,4,0.5\n3,ball,1,2,3,4,0.9\n")
    got = files.read_detections(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.clip, r.frame_idx, r["class"]) for r in got] == [("a", 3, "player"), ("a", 3, "ball")] and got[0].ord < got[1].ord
    (tmp_path / "a.csv").write_text("frame_idx,class,x1,y1,x2,y2,confidence\n3,dog,1,2,3,4,0.5\n")
    with pytest.raises(Exception, match="unknown class"):
        files.read_detections(spark, str(tmp_path)).collect()
    (tmp_path / "c_homography.json").write_text(json.dumps([[1, 2, 3], [4, 5, 6], [7, 8, 9]]))
    row = files.read_homographies(spark, str(tmp_path)).first()
    assert (row.clip, row.h00, row.h21) == ("c", 1.0, 8.0)
    (tmp_path / "c_homography_points.json").write_text(json.dumps({"net_left": [1, 2]}))
    assert files.read_points(spark, str(tmp_path)).first().px == 1.0
    for split in ("train", "val"):
        (tmp_path / "set" / split / "labels").mkdir(parents=True)
    (tmp_path / "set/train/labels/s1.txt").write_text("0 0.5 0.5 0.1 0.1\n0 0.2 0.2 0.1 0.1\n")
    (tmp_path / "set/val/labels/s2.txt").write_text("")
    assert [(r.split, r.stem, r.line_no, r.xc) for r in files.read_labels(spark, str(tmp_path / "set")).orderBy("line_no").collect()] == [("train", "s1", 0, 0.5), ("train", "s1", 1, 0.2)]


def test_cache_key_holds_the_range(spark, tmp_path):
    make = lambda n: files.cached(spark, str(tmp_path), {"clip": "a", "limit": n}, lambda: spark.range(n))
    assert (make(3).count(), make(5).count(), make(3).count()) == (3, 5, 3)


def test_video_source(spark):
    source = video.use_decoder("fake_video", lambda clip: 10, lambda clip, a, b: ((f, bytes([f])) for f in range(a, b)))
    spark.dataSource.register(source)
    df = spark.read.format("fake_video").option("clips", "a,b").option("start", 2).option("limit", 0).option("framesPerPartition", 3).load()
    assert df.count() == 16 and df.agg(F.min("frame_idx")).first()[0] == 2


def test_one_frame_decodes_no_other(spark, tmp_path):
    def decode(clip, first, last):
        for f in range(first, last):
            (tmp_path / f"{clip}-{f}").touch()
            yield f, bytes([f])

    spark.dataSource.register(video.use_decoder("counting_video", lambda clip: 50, decode))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("counting_video").option("clips", "a,b").option("pushdown", True).load()
        row = df.where("frame_idx = 7 and clip = 'b'").collect()
        assert [(r.clip, r.frame_idx, bytes(r.content)) for r in row] == [("b", 7, b"\x07")]
        assert [p.name for p in tmp_path.iterdir()] == ["b-7"]
        assert df.where("frame_idx = 70").count() == 0 and df.where("frame_idx = 3").count() == 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_large_files_keep_their_order(spark, tmp_path):
    """A file that is cut into many tasks: boxes of a frame stay in the detector's order."""
    lines = [f"{f},player,{k}.0,2,3,4,0.5" for f in range(3000) for k in range(3)]
    (tmp_path / "a.csv").write_text("frame_idx,class,x1,y1,x2,y2,confidence\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = files.read_detections(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 4
        assert [(r.frame_idx, r.x1) for r in df.orderBy("ord").collect()] == [(f, float(k)) for f in range(3000) for k in range(3)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_frame_listing_and_box_labels(spark, tmp_path):
    from rallyloom.operators import frames

    for clip, names in (("a", ("frame_00010.jpg", "frame_00002.jpg", "other.jpg")), ("b", ("frame_00001.jpg",))):
        (tmp_path / clip).mkdir()
        for n in names:
            (tmp_path / clip / n).write_bytes(b"x")
    got = sorted((r.clip, r.frame_name, r.idx) for r in files.frame_files(spark, str(tmp_path)).collect())
    assert got == [("a", "frame_00002.jpg", 0), ("a", "frame_00010.jpg", 1), ("b", "frame_00001.jpg", 0)]
    tracks = spark.createDataFrame([(0, 1, 7, 10.9, 2.5, 30.1, 40.0, 0.5)], "clip bigint, frame_idx bigint, track_id bigint, x1 double, y1 double, x2 double, y2 double, confidence double")
    r = frames.box_labels(tracks).first()
    assert (r.x1, r.y1, r.x2, r.y2, r.label, r.label_y) == (10, 2, 30, 40, "#7", 0)


def test_datasets_need_both_splits(spark):
    rows = lambda *splits: spark.createDataFrame([(s, "x") for s in splits], "split string, stem string")
    got = labels.datasets_union({"one": rows("train", "valid"), "two": rows("train", "val", "test")})
    assert sorted((r.dataset, r.split) for r in got.collect()) == [("one", "train"), ("one", "val"), ("two", "test"), ("two", "train"), ("two", "val")]
    for bad in (rows("train"), rows("val", "test"), rows()):
        with pytest.raises(FileNotFoundError, match="bad"):
            labels.datasets_union({"one": rows("train", "val"), "bad": bad})
