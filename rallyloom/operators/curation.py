"""Choosing frames to label: motion scores, spaced top-k, hotspots, negatives, splits and their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyloom.functions.geometry import bucket, mean_abs_difference
from rallyloom.params import CurationParams


def change_scores(signatures: DataFrame) -> DataFrame:
    """``clip, frame_idx, raw``: mean absolute difference to the frame before; 0 for a clip's first."""
    w = Window.partitionBy("clip").orderBy("frame_idx")
    pairs = signatures.select("clip", "frame_idx", "signature", F.lag("signature").over(w).alias("before"))
    return pairs.select("clip", "frame_idx", mean_abs_difference(F.col("signature"), F.col("before")).alias("raw"))


def motion_scores(signatures: DataFrame) -> DataFrame:
    """``clip, frame_idx, score``: change scores, averaged over three frames (fewer at the ends)."""
    w = Window.partitionBy("clip").orderBy("frame_idx").rowsBetween(-1, 1)
    return change_scores(signatures).select("clip", "frame_idx", F.avg("raw").over(w).alias("score"))


def spaced_top_k(scores: DataFrame, quota: int, spacing: int, score: str = "score") -> DataFrame:
    """``clip, frame_idx, rank``: greedily the best frames that keep their distance.

    Equal scores go to the earlier frame; at least one frame is taken. An accepted
    frame rules out at most ``2 * spacing - 1`` frames, itself included, so the fold
    ends within the best ``quota`` times as many; only these leave their tasks, and
    its state is at most ``quota`` numbers.
    """
    place = F.row_number().over(Window.partitionBy("clip").orderBy(F.desc(score), "frame_idx"))
    scores = scores.withColumn("_place", place).where(F.col("_place") <= max(quota, 1) * max(1, 2 * spacing - 1))
    fits = lambda acc, x: (F.size(acc) < max(quota, 1)) & F.forall(acc, lambda a: F.abs(a - x["frame_idx"]) >= spacing)
    ordered = F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col("frame_idx"))))
    picked = F.aggregate("o", F.array().cast("array<bigint>"), lambda acc, x: F.when(fits(acc, x), F.concat(acc, F.array(x["frame_idx"]))).otherwise(acc))
    chosen = scores.groupBy("clip").agg(ordered.alias("o")).select("clip", F.posexplode(picked).alias("p", "frame_idx"))
    return chosen.select("clip", "frame_idx", (F.col("p") + 1).cast("bigint").alias("rank"))


def hotspots(hits: DataFrame, params: CurationParams = CurationParams()) -> DataFrame:
    """``clip, bx, by, n, frames, rank``: hits by position; rank by count, ties to the one seen first."""
    at = hits.select("clip", "frame_id", "ord", bucket(F.col("cx"), params.bucket).alias("bx"), bucket(F.col("cy"), params.bucket).alias("by"))
    counted = at.groupBy("clip", "bx", "by").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("frame_id").alias("frames"), F.min(F.struct("frame_id", "ord")).alias("first"))
    w = Window.partitionBy("clip").orderBy(F.desc("n"), "first", "bx", "by")
    return counted.select("clip", "bx", "by", "n", "frames", F.row_number().over(w).cast("bigint").alias("rank"))


def known_false_positives(hits: DataFrame, quota: int, positives: DataFrame | None = None, params: CurationParams = CurationParams()) -> DataFrame:
    """``clip, frame_id, pos``: frames of the largest hotspots first, up to the quota.

    Positives (``clip, frame_id``) leave after the quota, so there may be fewer.
    """
    at = hits.select("clip", "frame_id", bucket(F.col("cx"), params.bucket).alias("bx"), bucket(F.col("cy"), params.bucket).alias("by"))
    ranked = at.join(hotspots(hits, params).select("clip", "bx", "by", "rank"), ["clip", "bx", "by"])
    first = ranked.groupBy("clip", "frame_id").agg(F.min("rank").alias("rank"))
    pos = F.row_number().over(Window.partitionBy("clip").orderBy("rank", "frame_id"))
    chosen = first.withColumn("pos", pos).where(F.col("pos") <= quota).select("clip", "frame_id", F.col("pos").cast("bigint").alias("pos"))
    return chosen if positives is None else chosen.join(positives, ["clip", "frame_id"], "left_anti")


def seeded(seed: int, *keys: str) -> Column:
    """A reproducible order in place of a shuffle."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def random_negatives(scores: DataFrame, exclude: DataFrame, quota: int, seed: int = 42) -> DataFrame:
    """``clip, frame_idx, score``: from the calmest frames, at random.

    The pool is the calmer half of what is not excluded, or three times the quota.
    """
    left = scores.join(exclude, ["clip", "frame_idx"], "left_anti")
    place = F.row_number().over(Window.partitionBy("clip").orderBy("score", "frame_idx"))
    n = F.count(F.lit(1)).over(Window.partitionBy("clip"))
    pool = left.select("*", place.alias("place"), n.alias("n")).where(F.col("place") <= F.greatest(F.lit(3 * quota), F.floor(F.col("n") / 2)))
    order = F.row_number().over(Window.partitionBy("clip").orderBy(seeded(seed, "clip", "frame_idx")))
    return pool.withColumn("k", order).where(F.col("k") <= quota).select("clip", "frame_idx", "score")


def before_events(events: DataFrame, existing: DataFrame, quota: int, params: CurationParams = CurationParams()) -> DataFrame:
    """``clip, frame_idx, pos``: frames shortly before each event (``clip, frame_idx, rank``), best event first."""
    offsets = F.array(*[F.lit(o).cast("bigint") for o in params.event_offsets])
    at = events.select("clip", "rank", "frame_idx", F.posexplode(offsets).alias("o", "offset"))
    at = at.select("clip", (F.col("frame_idx") - F.col("offset")).alias("frame_idx"), "rank", "o").where("frame_idx >= 0").join(existing, ["clip", "frame_idx"], "left_anti")
    first = at.groupBy("clip", "frame_idx").agg(F.min(F.struct("rank", "o")).alias("k"))
    pos = F.row_number().over(Window.partitionBy("clip").orderBy("k"))
    return first.select("clip", "frame_idx", pos.cast("bigint").alias("pos")).where(F.col("pos") <= quota)


def stratified_split(rows: DataFrame, groups: list[str], key: str, seed: int = 42, fraction: float = 0.15) -> DataFrame:
    """``rows`` plus ``split``: of each group the first part, in seeded order, is ``val`` (one row at least)."""
    order = F.row_number().over(Window.partitionBy(*groups).orderBy(seeded(seed, key), key))
    n = F.count(F.lit(1)).over(Window.partitionBy(*groups))
    val = order <= F.greatest(F.lit(1), F.rint(n * F.lit(fraction)).cast("bigint"))
    return rows.withColumn("split", F.when(val, "val").otherwise("train"))


def interleave(rows: DataFrame, reason: str = "selection_reason", clip: str = "clip", order: str = "ord") -> DataFrame:
    """``rows`` plus ``position``: reasons one after the other, clips taking turns inside each.

    A row's position follows from its place in its clip and the sizes of the other
    groups, so no task sorts the whole manifest. One row's array holds a number a
    clip; reasons and clips are ordered by name.
    """
    turn = F.row_number().over(Window.partitionBy(reason, clip).orderBy(order)).cast("bigint")
    sizes = rows.groupBy(reason, clip).agg(F.count(F.lit(1)).alias("n"))
    per_reason = sizes.groupBy(reason).agg(F.sort_array(F.collect_list(F.struct(F.col(clip).alias("c"), F.col("n")))).alias("groups"), F.sum("n").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy(reason).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_reason = per_reason.select(F.col(reason).alias("_reason"), "groups", before.alias("_before"))
    joined = rows.withColumn("_turn", turn).join(per_reason, F.col(reason).eqNullSafe(F.col("_reason")))
    earlier = F.aggregate("groups", F.lit(0).cast("bigint"), lambda a, g: a + F.least(g["n"], F.col("_turn") - 1))
    same = F.aggregate("groups", F.lit(0).cast("bigint"), lambda a, g: a + ((g["c"] < F.col(clip)) & (g["n"] >= F.col("_turn"))).cast("bigint"))
    return joined.withColumn("position", F.col("_before") + earlier + same + 1).drop("_reason", "_before", "_turn", "groups")


def manifest_counts(rows: DataFrame) -> DataFrame:
    """Counts by reason, by split and by clip in one pass."""
    keys = ["selection_reason", "split", "clip"]
    counted = rows.groupingSets([[F.col(k)] for k in keys], *[F.col(k) for k in keys]).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    named = F.when(F.col("g") == 3, "selection_reason").when(F.col("g") == 5, "split").otherwise("clip")
    return counted.select(named.alias("by"), F.coalesce("selection_reason", "split", "clip").alias("key"), "n")
