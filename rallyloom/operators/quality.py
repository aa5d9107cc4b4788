"""Checks of detections by hand and of splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts_per_frame(frames: DataFrame, detections: DataFrame, key: str, classes: tuple[str, ...] = ("player", "ball")) -> DataFrame:
    """Boxes of each class in every frame, with zeros."""
    counted = detections.groupBy(key).agg(*[F.count_if(F.col("class") == c).alias(f"{c}_boxes") for c in classes])
    joined = frames.select(key).join(counted, key, "left")
    return joined.select(key, *[F.coalesce(f"{c}_boxes", F.lit(0)).cast("bigint").alias(f"{c}_boxes") for c in classes])


def _number(c: Column) -> Column:
    """A hand-filled cell: blank or unreadable is 0."""
    return F.coalesce(c.try_cast("int"), F.lit(0)).cast("bigint")


def precision_recall(worksheet: DataFrame, keys: list[str], tp: str = "tp", fp: str = "fp", fn: str = "fn") -> DataFrame:
    """``keys, tp, fp, fn, precision, recall``; a ratio without cases is not a number."""
    sums = worksheet.groupBy(*keys).agg(*[F.sum(_number(F.col(c))).alias(n) for c, n in ((tp, "tp"), (fp, "fp"), (fn, "fn"))])
    nan = F.lit(float("nan"))
    ratio = lambda other: F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col(other)).cast("double")), nan)
    return sums.withColumn("precision", ratio("fp")).withColumn("recall", ratio("fn"))


def split_leakage(rows: DataFrame, stem: str = "stem", split: str = "split") -> DataFrame:
    """Stems that are in more than one split, with the splits."""
    seen = rows.groupBy(stem).agg(F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits"), F.count(F.lit(1)).alias("n"))
    return seen.where(F.col("splits").contains(","))
