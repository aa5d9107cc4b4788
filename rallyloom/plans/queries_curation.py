"""Queries of label curation, labels, quality, calibration and external models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyloom.functions import geometry as geo
from rallyloom.functions import naming
from rallyloom.functions.geometry import half_even, lit
from rallyloom.operators import calibration, curation, external, frames, labels, players, quality, tracking
from rallyloom.params import CurationParams
from rallyloom.plans import adapters as ad

POSITIVES, FALSE_POSITIVES, NEGATIVES, ROUND2 = 22, 30, 10, 35


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({c: half_even(F.col(c), digits) for c in names})


def motion_scores(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(curation.motion_scores(ad.signatures(spark, d)), 8, "score")


def change_scores(spark, d):
    return _rounded(curation.change_scores(ad.signatures(spark, d)), 8, "raw")


def _positives(spark, d):
    return curation.spaced_top_k(_rounded(curation.motion_scores(ad.signatures(spark, d)), 8, "score"), POSITIVES, CurationParams.positive_spacing)


def positives_spaced(spark, d):
    return _positives(spark, d).select("clip", "frame_idx")


def _events(spark, d, quota):
    return curation.spaced_top_k(_rounded(curation.change_scores(ad.signatures(spark, d)), 8, "raw"), quota, CurationParams.event_spacing, "raw")


def change_events_topk(spark, d):
    return _events(spark, d, CurationParams.event_top_k)


def event_probe(spark, d):
    """The top events with the names of the frame and of the one before it."""
    name = lambda c: F.format_string("frame_%05d.jpg", c)
    found = _events(spark, d, CurationParams.event_probe)
    return found.select("clip", "rank", name(F.col("frame_idx")).alias("frame_name"), name(F.greatest(F.lit(0).cast("bigint"), F.col("frame_idx") - 1)).alias("preceding"))


def fp_hotspots(spark, d):
    return curation.hotspots(ad.hits(spark, d))


def fp_negatives(spark, d):
    urgent = ad.table(spark, d, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").alias("frame_id"))
    hits = ad.hits(spark, d)
    positives = hits.select("clip", "frame_id").distinct().join(urgent, "frame_id", "left_semi").select("clip", "frame_id")
    return curation.known_false_positives(hits, FALSE_POSITIVES, positives)


def random_negatives(spark, d):
    scores = _rounded(curation.motion_scores(ad.signatures(spark, d)), 8, "score")
    return curation.random_negatives(scores, positives_spaced(spark, d), NEGATIVES)


def round2_candidates(spark, d):
    return curation.before_events(change_events_topk(spark, d), positives_spaced(spark, d), ROUND2)


def _split(spark, d, seed=42):
    return curation.stratified_split(ad.manifest(spark, d), ["clip", "selection_reason"], "frame_id", seed)


def stratified_split(spark, d):
    return _split(spark, d).select("frame_id", "clip", "selection_reason", "split")


def interleaved_manifest(spark, d):
    return curation.interleave(ad.manifest(spark, d)).select("frame_id", "clip", "selection_reason", "position")


def manifest_counts(spark, d):
    return curation.manifest_counts(_split(spark, d))


def candidate_union(spark, d):
    """Three kinds of candidates in one table, kind after kind."""
    kinds = {"motion_candidate": positives_spaced(spark, d), "pre_score_change": round2_candidates(spark, d).select("clip", "frame_idx"), "random_negative": random_negatives(spark, d).select("clip", "frame_idx")}
    parts = [df.withColumn("selection_reason", F.lit(k)).withColumn("kind_rank", F.lit(i)) for i, (k, df) in enumerate(kinds.items())]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _labelled(spark, d):
    return ad.table(spark, d, "labels").select(F.col("doc_id").alias("frame_id"))


def unlabelled(spark, d):
    return labels.unlabelled(ad.manifest(spark, d), _labelled(spark, d), "frame_id").select("frame_id", "clip")


def labelled_images(spark, d):
    return ad.manifest(spark, d).join(_labelled(spark, d), "frame_id", "left_semi").select("frame_id", "clip")


def scan_exclusion(spark, d):
    """Frames to scan: those whose flat name no training folder has."""
    used = ad.table(spark, d, "benchmark").select(naming.flat_key(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")), F.col("item_id").cast("string")).alias("key"))
    frames = ad.manifest(spark, d).withColumn("key", naming.flat_key(F.col("clip"), F.col("frame_id").cast("string")))
    return frames.join(used, "key", "left_anti").select("frame_id", "key")


def frame_names(spark, d):
    frame = naming.frame_id(F.col("clip"), F.format_string("frame_%05d.jpg", F.col("frame_id")))
    rows = ad.manifest(spark, d).select("frame_id", frame.alias("frame"))
    return rows.select("frame_id", "frame", naming.clip_of(F.col("frame")).alias("clip"), naming.name_of(F.col("frame")).alias("name"), naming.label_stem(F.col("frame")).alias("stem"), naming.label_path(F.lit("data"), F.lit("train"), F.col("frame")).alias("label_path"), naming.mime_type(F.col("frame")).alias("mime"))


def _tiers(spark, d):
    docs = ad.table(spark, d, "documents").select("doc_id", "n_chars", (F.col("n_chars") % 100 / lit(100)).alias("local_conf"))
    answers = ad.table(spark, d, "labels").select(
        "doc_id", F.when(F.col("toxic") == 1, "low").when(F.col("quality") == 1, "high").otherwise("medium").alias("confidence"), (F.col("quality") == 1).alias("ball_visible")
    )
    return labels.assign_tiers(docs.join(answers, "doc_id", "left").withColumn("has_bbox", F.col("n_chars") % 3 != 0))


def bootstrap_tiers(spark, d):
    return _tiers(spark, d).select(F.col("doc_id").alias("frame_id"), "tier")


def tier_counts(spark, d):
    return _tiers(spark, d).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


def precision_recall(spark, d):
    docs = ad.table(spark, d, "documents").select("doc_id", "lang", (F.col("n_chars") >= 500).alias("predicted"))
    sheet = docs.join(ad.table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("truth")), "doc_id", "left")
    cell = lambda c: F.when(F.col("truth").isNull(), "").otherwise(c.cast("int").cast("string"))
    p, t = F.col("predicted"), F.col("truth")
    filled = sheet.select("lang", cell(p & t).alias("tp"), cell(p & ~t).alias("fp"), cell(~p & t).alias("fn"))
    return _rounded(quality.precision_recall(filled, ["lang"]), 6, "precision", "recall")


def counts_per_frame(spark, d):
    lines = ad.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame_id"), F.when(F.col("l_returnflag") == "N", "player").otherwise("ball").alias("class"))
    frames = ad.table(spark, d, "orders").select(F.col("o_orderkey").alias("frame_id"))
    return quality.counts_per_frame(frames, lines, "frame_id")


def split_leakage(spark, d):
    """Frames that one split trains on and another validates on."""
    part = lambda seed, keep: _split(spark, d, seed).where(F.col("split") == keep).select(F.col("frame_id").alias("stem"), "split")
    return quality.split_leakage(part(42, "train").unionByName(part(7, "val")))


def best_candidate(spark, d):
    best = tracking.best_candidates(ad.boxes(spark, d).select("frame_id", "ord", "x1", "y1", "confidence"), ["frame_id"])
    return _rounded(best, 6, "x1", "y1", "confidence")


def box_geometry(spark, d):
    b = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    cx, cy = geo.box_center(*b)
    fx, fy = geo.foot_point(*b)
    corner = dict(zip(("ix1", "iy1", "ix2", "iy2"), geo.corners(cx, cy, b[2] - b[0], b[3] - b[1])))
    rows = ad.boxes(spark, d).select("frame_id", "ord", cx.alias("cx"), cy.alias("cy"), fx.alias("fx"), fy.alias("fy"), geo.bucket(cx).alias("bx"), geo.measurement_variance(F.col("confidence")).alias("var"), *[c.alias(n) for n, c in corner.items()])
    return _rounded(rows, 6, "cx", "cy", "fx", "fy", "var")


def drawn_boxes(spark, d):
    """Boxes dragged on a display of 2/3 the size, thin ones dropped."""
    scale = lit(0.5)
    box = dict(zip(("x1", "y1", "x2", "y2"), geo.drawn_box(F.col("x2"), F.col("y1"), F.col("x1"), F.col("y2"), scale)))
    wide = ad.boxes(spark, d).where((F.abs(F.col("x2") - F.col("x1")) > lit(12)) & (F.abs(F.col("y2") - F.col("y1")) > lit(12)))
    return _rounded(wide.select("frame_id", "ord", *[c.alias(n) for n, c in box.items()]), 4, "x1", "y1", "x2", "y2")


def _yolo(spark, d):
    return labels.yolo_boxes(ad.boxes(spark, d), 1280, 720)


def yolo_labels(spark, d):
    return _yolo(spark, d).select("frame_id", "ord", *[geo.fixed(F.col(c), 6).alias(c) for c in ("xc", "yc", "w", "h")])


def ellipse_polygons(spark, d):
    points = labels.to_polygons(_yolo(spark, d)).select("frame_id", "ord", F.posexplode("polygon").alias("k", "p"))
    return points.select("frame_id", "ord", "k", geo.fixed(F.col("p.x"), 6).alias("x"), geo.fixed(F.col("p.y"), 6).alias("y"))


def sample_indices(spark, d):
    total = ad.table(spark, d, "events").groupBy((F.col("user_id") % 4).alias("clip")).agg(F.count(F.lit(1)).alias("total"))
    sparse = total.select("clip", F.posexplode(geo.sample_indices(F.col("total"), F.lit(8))).alias("k", "frame_idx"))
    return sparse.select("clip", F.col("k").cast("bigint").alias("k"), "frame_idx")


def video_summary(spark, d):
    frames = ad.table(spark, d, "events").groupBy((F.col("user_id") % 4).alias("clip")).agg(F.count(F.lit(1)).alias("frames"))
    return frames.select("clip", *geo.video_summary(F.lit(1280), F.lit(720), lit(ad.FPS), F.col("frames")))


def homography_reprojection(spark, d):
    """Points placed by a known matrix: fitted, then projected back to the court and out again."""
    reference = calibration.reference_points(spark)
    homographies = ad.homographies(spark)
    placed = homographies.select("clip", F.inline(calibration.reference_array()))
    pixels = calibration.to_pixels(placed, homographies, "court_x", "court_y")
    fitted = calibration.fit_homographies(pixels.select("clip", "label", "px", "py"), reference)
    from rallyloom.operators.events import to_court

    back = to_court(pixels.select("clip", "label", "px", "py"), fitted, "px", "py")
    again = calibration.to_pixels(back.select("clip", "label", "x", "y"), fitted)
    return _rounded(again.select("clip", "label", (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y"), "px", "py"), 4, "px", "py").withColumns({c: half_even(F.abs(F.col(c)), 6) for c in ("x", "y")})


def player_tracks(spark, d):
    tracked = players.player_tracks(ad.player_boxes(spark, d), ad.FPS)
    return tracked.groupBy("clip", "track_id").agg(F.count(F.lit(1)).alias("frames"), F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"))


def player_track_counts(spark, d):
    return players.player_tracks(ad.player_boxes(spark, d), ad.FPS).groupBy("clip").agg(F.countDistinct("track_id").alias("tracks"))


def stub_detector():
    """Boxes that follow from the frame's number: for tests, in place of a network."""

    def model(row: dict) -> list[tuple]:
        n = int(row["frame_id"])
        return [("player", n % 640 + 0.25, n % 360 + 0.75, n % 640 + 50.25, n % 360 + 100.75, (n % 10) / 10), ("ball", n % 1000 + 0.5, n % 500 + 0.5, n % 1000 + 20.5, n % 500 + 20.5, (n % 7) / 8)]

    return model


def detect_frames(spark, d):
    frames = ad.manifest(spark, d).select("frame_id")
    found = external.detect(frames, "frame_id", stub_detector, "stub", 0.25)
    return found.select("frame_id", "class", "x1", "y1", "x2", "y2", "confidence")


def stub_verifier():
    def client(row: dict) -> dict:
        n = int(row["frame_id"])
        if n % 11 == 0:
            raise ValueError("no answer")
        return {"ball_visible": n % 2 == 0, "bbox": [1.0, 2.0, 3.0, 4.0] if n % 4 == 0 else None, "confidence": ("high", "medium", "low")[n % 3], "notes": ""}

    return client


def verify_frames(spark, d):
    """Remote answers of every frame, with the tier they lead to."""
    verified = external.answers(external.verify(ad.manifest(spark, d).select("frame_id"), "frame_id", stub_verifier))
    tiers = labels.assign_tiers(verified.withColumn("local_conf", lit(0)))
    return tiers.select("frame_id", "ball_visible", "confidence", "has_bbox", "error", "tier")


def frame_range(spark, d):
    return frames.frame_range(ad.ball(spark, d), 100, 200).select("clip", "frame_idx", "cx")


def sampled_frames(spark, d):
    total = ad.table(spark, d, "events").groupBy((F.col("user_id") % 4).alias("clip")).agg(F.count(F.lit(1)).alias("total"))
    return frames.sampled(ad.ball(spark, d), total, 40).select("clip", "frame_idx")


def court_lines(spark, d):
    lines = frames.court_lines(ad.homographies(spark))
    return lines.select("clip", "line", *[geo.fixed(F.col(c), 3).alias(c) for c in ("px1", "py1", "px2", "py2")])


QUERIES = {
    f.__name__: f
    for f in (
        motion_scores, change_scores, positives_spaced, change_events_topk, event_probe, fp_hotspots, fp_negatives, random_negatives, round2_candidates, stratified_split,
        interleaved_manifest, manifest_counts, candidate_union, unlabelled, labelled_images, scan_exclusion, frame_names, bootstrap_tiers, tier_counts, precision_recall,
        counts_per_frame, split_leakage, best_candidate, box_geometry, drawn_boxes, yolo_labels, ellipse_polygons, sample_indices, video_summary, homography_reprojection,
        player_tracks, player_track_counts, detect_frames, verify_frames, frame_range, sampled_frames, court_lines,
    )
}
