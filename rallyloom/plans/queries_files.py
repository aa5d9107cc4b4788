"""Files written and read back: what a query gives is what came back from the files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallyloom.functions.geometry import half_even, lit
from rallyloom.operators import external, frames, labels
from rallyloom.plans import adapters as ad
from rallyloom.plans import oracles_curation, oracles_events, queries_curation, queries_events
from rallyloom.sources import files
from rallyloom.sources.scratch import shared_place


def _there_and_back(spark: SparkSession, name: str, write: Callable[[str], None], read: Callable[[str], DataFrame]) -> DataFrame:
    place = f"{shared_place(spark, name)}/files"
    write(place)
    return read(place)


def detections_file(spark: SparkSession, d: str) -> DataFrame:
    """Boxes as CSV by clip, rounded, and the order inside each frame after reading."""
    boxes = ad.boxes(spark, d).select(
        (F.col("frame_id") % 3).cast("string").alias("clip"), F.col("frame_id").alias("frame_idx"), F.when(F.col("ord") % 2 == 0, "ball").otherwise("player").alias("class"),
        *[(F.floor(F.col(c) * 8) / lit(8)).alias(c) for c in ("x1", "y1", "x2", "y2")], "confidence",
        F.row_number().over(Window.partitionBy("frame_id").orderBy("ord", "x1", "y1", "x2", "y2", "confidence")).alias("ord"),
    )
    back = _there_and_back(spark, "detections", lambda p: files.write_detections(boxes, p), lambda p: files.read_detections(spark, p))
    place = F.row_number().over(Window.partitionBy("clip", "frame_idx").orderBy("ord")).cast("bigint")
    return back.withColumn("place", place).drop("ord")


def homography_files(spark: SparkSession, d: str) -> DataFrame:
    """A matrix a clip of the events, as JSON."""
    clips = ad.clips_of(ad.frames(spark, d)).select("clip").join(ad.homographies(spark), "clip")
    return files.homographies_of(_there_and_back(spark, "homographies", lambda p: files.write_by_clip(files.homography_json(clips), p), lambda p: files.read_by_clip(spark, p)))


def points_files(spark: SparkSession, d: str) -> DataFrame:
    """Labelled points as JSON; points clicked again replace the first."""
    rows = ad.table(spark, d, "nation").select(F.col("n_regionkey").cast("bigint").alias("clip"), F.col("n_name").alias("label"), (F.col("n_nationkey") * lit(1.5)).alias("px"), (F.col("n_nationkey") + lit(0.25)).alias("py"))
    again = rows.where("px % 2 = 0").withColumn("px", F.col("px") + lit(100))
    merged = files.points_json(files.merge_points(rows, again))
    return files.points_of(_there_and_back(spark, "points", lambda p: files.write_by_clip(merged, p), lambda p: files.read_by_clip(spark, p)))


def stats_files(spark: SparkSession, d: str) -> DataFrame:
    """Numbers out of the statistics documents' JSON."""
    texts = files.stats_json(queries_events.match_stats_doc(spark, d))
    back = _there_and_back(spark, "stats", lambda p: files.write_by_clip(texts, p), lambda p: files.read_by_clip(spark, p))
    at = lambda path: F.get_json_object("value", path)
    size = lambda path: F.coalesce(F.json_array_length(at(path)), F.lit(0)).cast("bigint")
    return back.select("clip", at("$.video").alias("video"), at("$.frame_range[1]").cast("bigint").alias("last_frame"), size("$.rallies").alias("rallies"), size("$.touches").alias("touches"))


def verification_files(spark: SparkSession, d: str) -> DataFrame:
    """Remote answers as JSON lines by path."""
    verified = external.verify(ad.manifest(spark, d).select("frame_id"), "frame_id", queries_curation.stub_verifier)
    texts = files.verification_json(verified.withColumn("path", F.format_string("frame_%05d.jpg", "frame_id")), "path")
    back = _there_and_back(spark, "verification", lambda p: files.write_json_lines(texts, p), lambda p: files.read_verification(spark, p))
    return back.select("path", "ball_visible", F.coalesce(F.size("bbox"), F.lit(0)).cast("bigint").alias("sides"), "confidence", F.col("error").isNotNull().alias("failed"))


def manifest_file(spark: SparkSession, d: str) -> DataFrame:
    """The manifest as CSV; blank cells come back null."""
    rows = queries_curation.stratified_split(spark, d).select(
        F.col("frame_id").cast("string").alias("frame_id"), F.concat(F.lit("frames/"), F.col("frame_id").cast("string"), F.lit(".jpg")).alias("image_path"), "clip",
        F.when(F.col("frame_id") % 4 > 0, F.col("frame_id") / lit(8)).alias("motion_score"), "selection_reason", "split",
    )
    return _there_and_back(spark, "manifest", lambda p: files.write_csv(rows, p), lambda p: files.read_csv(spark, p, "manifest"))


def scan_file(spark: SparkSession, d: str) -> DataFrame:
    """Hits of a scan as CSV: a low floor, and the ball's class only."""
    hits = external.detect(ad.manifest(spark, d).select("frame_id"), "frame_id", queries_curation.stub_detector, "stub", 0.0, ("ball",))
    name = F.col("frame_id").cast("string")
    rows = hits.select(name.alias("frame_id"), F.concat(F.lit("frames/"), name).alias("image_path"), "confidence", "x1", "y1", "x2", "y2")
    return _there_and_back(spark, "scan", lambda p: files.write_csv(rows, p), lambda p: files.read_csv(spark, p, "scan"))


def worksheet_file(spark: SparkSession, d: str) -> DataFrame:
    """Predicted counts of each frame with blank cells to fill in, as CSV."""
    counted = queries_curation.counts_per_frame(spark, d)
    blank = [F.lit(None).cast("string").alias(c) for c in ("player_TP", "player_FP", "player_FN", "ball_TP", "ball_FP", "ball_FN", "notes")]
    rows = counted.select(F.col("frame_id").cast("string").alias("frame_id"), F.lit("x.jpg").alias("image_path"), F.col("player_boxes").cast("string").alias("player_boxes_predicted"), F.col("ball_boxes").cast("string").alias("ball_boxes_predicted"), *blank)
    back = _there_and_back(spark, "worksheet", lambda p: files.write_csv(rows, p), lambda p: files.read_csv(spark, p, "worksheet"))
    return back.select("frame_id", F.col("player_boxes_predicted").cast("bigint").alias("players"), F.col("ball_boxes_predicted").cast("bigint").alias("balls"), (F.coalesce("player_TP", "ball_FN", "notes").isNull()).alias("blank"))


def detect_union(spark: SparkSession, d: str) -> DataFrame:
    """Persons of a general model and balls of another, in one table."""
    keys = ad.manifest(spark, d).select("frame_id")
    persons = external.detect(keys, "frame_id", general_detector, "general", 0.25, ("person",))
    balls = external.detect(keys, "frame_id", queries_curation.stub_detector, "stub", 0.25, ("ball",))
    return external.players_and_ball(persons, balls, "frame_id").select("frame_id", "class", "ord", "x1")


def general_detector():
    """Persons, a chair and a ball of the crowd."""

    def model(row: dict) -> list[tuple]:
        n = int(row["frame_id"])
        return [("person", n % 7 * 10.0, 0.0, 5.0, 5.0, 0.5), ("chair", 1.0, 1.0, 2.0, 2.0, 0.9), ("person", n % 9 * 10.0, 0.0, 5.0, 5.0, (n % 4) / 8), ("ball", 0.0, 0.0, 1.0, 1.0, 0.9)]

    return model


def image_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Signatures of images of 4 x 4 gray values, which are the 16 bytes of a text's md5."""
    image = F.struct(F.lit(4).alias("height"), F.lit(4).alias("width"), F.lit(1).alias("nChannels"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("data"))
    rows = ad.table(spark, d, "documents").select((F.col("doc_id") % 4).alias("clip"), F.col("doc_id").alias("frame_idx"), image.alias("image"))
    small = frames.signatures(rows, width=2)
    cut = frames.signatures(rows, crop=(1, 0, 3, 1))
    joined = small.join(cut.select("clip", "frame_idx", F.col("signature").alias("crop")), ["clip", "frame_idx"])
    return joined.select("clip", "frame_idx", half_even(F.col("signature")[0], 4).alias("left"), half_even(F.col("signature")[1], 4).alias("right"), F.col("crop")[0].alias("c1"), F.col("crop")[1].alias("c2"))


def segmentation_counts(spark: SparkSession, d: str) -> DataFrame:
    """Images and polygons by split of boxes turned into polygons; frames without an image are left out."""
    part = F.when(F.col("frame_id") % 5 == 0, "valid").otherwise("train")
    lines = labels.yolo_boxes(ad.boxes(spark, d), 1280, 720).select(part.alias("split"), F.col("frame_id").cast("string").alias("stem"), "xc", "yc", "w", "h")
    images = ad.table(spark, d, "orders").where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("frame_id")).select(part.alias("split"), F.col("frame_id").cast("string").alias("stem"))
    return labels.segmentation_counts(lines, images)


QUERIES = {
    f.__name__: f
    for f in (
        detections_file, homography_files, points_files, stats_files, verification_files, manifest_file, scan_file, worksheet_file, detect_union, image_signatures, segmentation_counts,
    )
}

_BYTE = "(16 * (instr('0123456789abcdef', substr(h, 2 * ({i}) + 1, 1)) - 1) + instr('0123456789abcdef', substr(h, 2 * ({i}) + 2, 1)) - 1)::DOUBLE"


def _mean(cells: list[int]) -> str:
    return "round_even((" + " + ".join(_BYTE.format(i=i) for i in cells) + f") / {len(cells)}::DOUBLE, 4)"


ORACLES = {
    "detections_file": f"""WITH {oracles_curation.BOXES} SELECT (frame_id % 3)::VARCHAR AS clip, frame_id AS frame_idx, CASE WHEN ord % 2 = 0 THEN 'ball' ELSE 'player' END AS class,
  {", ".join(f"round_even(floor({c} * 8::DOUBLE) / 8::DOUBLE, 1) AS {c}" for c in ("x1", "y1", "x2", "y2"))}, round_even(confidence, 3) AS confidence, row_number() OVER (PARTITION BY frame_id ORDER BY ord, bx.x1, bx.y1, bx.x2, bx.y2, bx.confidence) AS place FROM bx""",
    "homography_files": """SELECT DISTINCT user_id % 4 AS clip, 0.01::DOUBLE AS h00, 0::DOUBLE AS h01, -2::DOUBLE AS h02, 0::DOUBLE AS h10, 0.04::DOUBLE AS h11, -6::DOUBLE AS h12, 0::DOUBLE AS h20, 0.0002::DOUBLE AS h21, 1::DOUBLE AS h22 FROM events""",
    "points_files": """SELECT n_regionkey::BIGINT AS clip, n_name AS label, n_nationkey * 1.5::DOUBLE + CASE WHEN fmod(n_nationkey * 1.5::DOUBLE, 2::DOUBLE) = 0 THEN 100::DOUBLE ELSE 0::DOUBLE END AS px, n_nationkey + 0.25::DOUBLE AS py FROM nation""",
    "stats_files": f"""SELECT clip, video, last_frame, coalesce(rallies, 0)::BIGINT AS rallies, coalesce(touches, 0)::BIGINT AS touches FROM ({oracles_events.ORACLES["match_stats_summary"]})""",
    "verification_files": """SELECT 'frame_' || lpad(doc_id::VARCHAR, 5, '0') || '.jpg' AS path, CASE WHEN doc_id % 11 > 0 THEN doc_id % 2 = 0 END AS ball_visible, CASE WHEN doc_id % 11 > 0 AND doc_id % 4 = 0 THEN 4 ELSE 0 END::BIGINT AS sides,
  CASE WHEN doc_id % 11 > 0 THEN ['high', 'medium', 'low'][doc_id % 3 + 1] END AS confidence, doc_id % 11 = 0 AS failed FROM documents""",
    "manifest_file": f"""WITH {oracles_curation.split("sp", 42)} SELECT frame_id::VARCHAR AS frame_id, 'frames/' || frame_id || '.jpg' AS image_path, clip, CASE WHEN frame_id % 4 > 0 THEN frame_id / 8::DOUBLE END AS motion_score, selection_reason, split FROM sp""",
    "scan_file": """SELECT doc_id::VARCHAR AS frame_id, 'frames/' || doc_id AS image_path, round_even((doc_id % 7) / 8::DOUBLE, 3) AS confidence, round_even(doc_id % 1000 + 0.5::DOUBLE, 1) AS x1, round_even(doc_id % 500 + 0.5::DOUBLE, 1) AS y1,
  round_even(doc_id % 1000 + 20.5::DOUBLE, 1) AS x2, round_even(doc_id % 500 + 20.5::DOUBLE, 1) AS y2 FROM documents""",
    "worksheet_file": f"""SELECT frame_id::VARCHAR AS frame_id, player_boxes AS players, ball_boxes AS balls, true AS blank FROM ({oracles_curation.ORACLES["counts_per_frame"]})""",
    "detect_union": """SELECT doc_id AS frame_id, 'person' AS class, 0 AS ord, (doc_id % 7) * 10::DOUBLE AS x1 FROM documents
  UNION ALL SELECT doc_id, 'person', 1, (doc_id % 9) * 10::DOUBLE FROM documents WHERE (doc_id % 4) / 8::DOUBLE >= 0.25
  UNION ALL SELECT doc_id, 'ball', CASE WHEN (doc_id % 4) / 8::DOUBLE >= 0.25 THEN 2 ELSE 1 END, round_even(doc_id % 1000 + 0.5::DOUBLE, 1) FROM documents WHERE (doc_id % 7) / 8::DOUBLE >= 0.25""",
    "image_signatures": f"""SELECT clip, f AS frame_idx, {_mean([4, 5, 8, 9, 12, 13])} AS left, {_mean([6, 7, 10, 11, 14, 15])} AS right, {_BYTE.format(i=1)} AS c1, {_BYTE.format(i=2)} AS c2
  FROM (SELECT doc_id % 4 AS clip, doc_id AS f, md5(coalesce(text, '')) AS h FROM documents)""",
    "segmentation_counts": """WITH i AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'val' ELSE 'train' END AS split, o_orderkey AS k FROM orders WHERE o_orderkey % 3 > 0)
  SELECT split, count(DISTINCT k) AS images, (SELECT count(*) FROM lineitem SEMI JOIN i j ON l_orderkey = k AND j.split = i.split)::BIGINT AS polygons FROM i GROUP BY split""",
}
