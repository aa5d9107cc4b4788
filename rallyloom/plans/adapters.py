"""The driver's tables seen as the engine's: balls, feet, detections, hits, boxes, manifests.

The formulas are fixed; the SQL of ``oracles`` repeats them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallyloom.functions.geometry import lit

#: One homography for every clip, row by row.
HOMOGRAPHY = (0.01, 0.0, -2.0, 0.0, 0.04, -6.0, 0.0, 0.0002, 1.0)
FPS = 29.97


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of four clips."""
    clip = F.col("user_id") % 4
    number = F.row_number().over(Window.partitionBy(clip).orderBy("event_id")).cast("bigint") - 1
    return table(spark, sf_dir, "events").select(clip.alias("clip"), number.alias("frame_idx"), "value", "event_type")


def _cy() -> Column:
    return lit(200) + lit(12) * F.abs(F.col("frame_idx") % 60 - 30) + F.least(F.col("value"), lit(20)) / lit(10)


def ball_of(every: DataFrame) -> DataFrame:
    seen = every.where(F.col("frame_idx") % 400 < 300)
    return seen.select("clip", "frame_idx", (lit(640) + F.least(F.col("value"), lit(50))).alias("cx"), _cy().alias("cy"))


def ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_of(frames(spark, sf_dir))


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ball without some frames: short holes to fill."""
    return ball(spark, sf_dir).where(~(F.col("frame_idx") % 7).isin(3, 4))


def homographies(spark: SparkSession) -> DataFrame:
    names = [f"h{i}{j}" for i in range(3) for j in range(3)]
    return spark.range(4).select(F.col("id").alias("clip"), *[lit(v).alias(n) for n, v in zip(names, HOMOGRAPHY)])


def feet_of(every: DataFrame) -> DataFrame:
    """Foot points of six tracks in every ball frame; the sixth stands still."""
    f, p = F.col("frame_idx"), F.col("track_id")
    tracks = ball_of(every).select("clip", "frame_idx", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(6).cast("bigint"))).alias("track_id"))
    fx = F.when(p == 6, lit(200) + f % 3).otherwise(lit(250) + 130 * p + (f * (p + 2)) % 200)
    fy = F.when(p == 6, lit(300)).otherwise(lit(180) + 60 * p + (f * (2 * p + 1)) % 170)
    return tracks.select("clip", "frame_idx", "track_id", fx.alias("fx"), fy.alias("fy"))


def feet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feet_of(frames(spark, sf_dir))


def clips_of(every: DataFrame) -> DataFrame:
    spans = every.groupBy("clip").agg(F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"))
    return spans.select("clip", F.concat(F.lit("clip_"), F.col("clip").cast("string"), F.lit(".mp4")).alias("video"), lit(FPS).alias("fps"), "first_frame", "last_frame")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ball candidates with decoys: ``clip, frame_idx, ord, cx, cy, confidence``."""
    f = F.col("frame_idx")
    kept = frames(spark, sf_dir).where((f % 400 < 300) & (f % 7 != 3))
    cx = lit(640) + lit(140) * (F.floor(f / 25) % 2) + F.least(F.col("value"), lit(20)) / lit(4)
    base = kept.select("clip", "frame_idx", "event_type", cx.alias("cx"), _cy().alias("cy"), (lit(0.05) + F.least(F.col("value"), lit(90)) / lit(100)).alias("conf"))
    kind = F.col("event_type")
    one = lambda o, dx, dy, conf: F.struct(F.lit(o).alias("ord"), (F.col("cx") + lit(dx)).alias("cx"), (F.col("cy") + lit(dy)).alias("cy"), conf.alias("confidence"))
    found = F.array_compact(
        F.array(
            F.when(~((kind == "signup") & (f % 5 == 0)), one(1, 0, 0, F.col("conf"))),
            F.when(kind == "error", one(2, 500, -100, lit(0.95))),
            F.when(kind == "click", one(3, 20, 15, lit(0.3))),
            F.when(kind == "signup", one(4, -150, 0, lit(0.6))),
        )
    )
    return base.select("clip", "frame_idx", F.explode(found).alias("c")).select("clip", "frame_idx", "c.*")


def player_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes around the feet: detections of players."""
    x, y = F.col("fx"), F.col("fy")
    return feet(spark, sf_dir).select(
        "clip", "frame_idx", (x - lit(30)).alias("x1"), (y - lit(120)).alias("y1"), (x + lit(30)).alias("x2"), y.alias("y2"),
        lit(0.8).alias("confidence"), F.col("track_id").cast("int").alias("ord"),
    )


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame signatures: ``clip, frame_idx, signature``."""
    number = F.row_number().over(Window.partitionBy("clip").orderBy("vec_id")).cast("bigint") - 1
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 4).alias("clip"), "vec_id", F.col("embedding").cast("array<double>").alias("signature"))
    return rows.select("clip", number.alias("frame_idx"), "signature")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector hits of a scan: ``clip, frame_id, ord, cx, cy``."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("clip"), F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").alias("ord"),
        (F.col("l_extendedprice") % lit(1280)).alias("cx"), (lit(20) * F.col("l_quantity") % lit(720)).alias("cy"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in a 1280x720 image, several a frame."""
    x1, y1 = F.col("l_extendedprice") % lit(1200), lit(10) * F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").alias("ord"), x1.alias("x1"), y1.alias("y1"),
        (x1 + lit(10) + lit(100) * F.col("l_discount")).alias("x2"), (y1 + lit(10) + lit(100) * F.col("l_tax")).alias("y2"),
        (lit(1) - F.col("l_discount") - F.col("l_tax")).alias("confidence"),
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate manifest: ``frame_id, clip, selection_reason, ord``."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("frame_id"), F.col("source").alias("clip"), F.col("lang").alias("selection_reason"), F.col("doc_id").alias("ord"))
