"""Detection labels, segmentation labels, and the tiers of automatic labelling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyloom.functions.geometry import ellipse_polygon, lit, normalised_box
from rallyloom.params import LabelParams


def yolo_boxes(boxes: DataFrame, width: float, height: float) -> DataFrame:
    """``boxes`` with ``xc, yc, w, h`` as fractions of the image."""
    names = ("xc", "yc", "w", "h")
    values = normalised_box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], lit(width), lit(height))
    return boxes.withColumns(dict(zip(names, values)))


def label_line(xc: Column, yc: Column, w: Column, h: Column, cls: int = 0) -> Column:
    return F.format_string(f"{cls} %.6f %.6f %.6f %.6f", xc, yc, w, h)


def polygon_line(cls: Column, polygon: Column) -> Column:
    points = F.transform(polygon, lambda p: F.format_string("%.6f %.6f", p["x"], p["y"]))
    return F.concat_ws(" ", F.concat(F.array(cls.cast("string")), points))


def to_polygons(labels: DataFrame, points: int = 16) -> DataFrame:
    return labels.withColumn("polygon", ellipse_polygon(*[F.col(c) for c in ("xc", "yc", "w", "h")], points))


def label_files(lines: DataFrame, stems: DataFrame, order: str = "line_no", line: str = "line") -> DataFrame:
    """One text a stem, lines in order with a newline after each; a stem without lines is an empty file (a negative)."""
    texts = lines.groupBy("split", "stem").agg(F.sort_array(F.collect_list(F.struct(order, line))).alias("all"))
    joined = stems.select("split", "stem").join(texts, ["split", "stem"], "left")
    whole = F.concat_ws("", F.transform("all", lambda x: F.concat(x[line], F.lit("\n"))))
    return joined.select("split", "stem", F.coalesce(whole, F.lit("")).alias("content"))


def segmentation_set(labels: DataFrame, images: DataFrame) -> DataFrame:
    """Labels that have an image, with ``valid`` named ``val``."""
    named = lambda df: df.withColumn("split", F.when(F.col("split") == "valid", "val").otherwise(F.col("split")))
    return to_polygons(named(labels).join(named(images).select("split", "stem"), ["split", "stem"], "left_semi"))


def segmentation_counts(labels: DataFrame, images: DataFrame) -> DataFrame:
    """``split, images, polygons`` of the set that ``segmentation_set`` makes; a split without labels counts 0."""
    named = images.withColumn("split", F.when(F.col("split") == "valid", "val").otherwise(F.col("split")))
    polygons = segmentation_set(labels, images).groupBy("split").agg(F.count(F.lit(1)).alias("polygons"))
    every = named.groupBy("split").agg(F.countDistinct("stem").alias("images"))
    return every.join(polygons, "split", "left").select("split", "images", F.coalesce("polygons", F.lit(0)).cast("bigint").alias("polygons"))


def unlabelled(manifest: DataFrame, labelled: DataFrame, key: str) -> DataFrame:
    """Rows that no split has a label for."""
    return manifest.join(labelled.select(key).distinct(), key, "left_anti")


def assign_tiers(rows: DataFrame, params: LabelParams = LabelParams(), skip_remote: bool = False) -> DataFrame:
    """``rows`` plus ``tier``.

    Takes ``local_conf``, and a remote answer ``confidence, ball_visible, has_bbox``
    that may be null. A confident local hit is ``tier1``; a trusted remote answer is
    ``tier2_positive`` (with a box) or ``tier2_negative``; the rest are ``tier3``.
    """
    trusted = F.coalesce(F.col("confidence").isin(*params.trusted), F.lit(False)) & F.lit(not skip_remote)
    seen, boxed = F.coalesce("ball_visible", F.lit(False)), F.coalesce("has_bbox", F.lit(False))
    tier = (
        F.when(F.col("local_conf") >= params.local_high_conf, "tier1").when(~trusted, "tier3")
        .when(seen & boxed, "tier2_positive").when(~seen, "tier2_negative").otherwise("tier3")
    )
    return rows.withColumn("tier", tier)


def datasets_union(datasets: dict[str, DataFrame]) -> DataFrame:
    """Label rows of several datasets with a ``dataset`` column; a set needs ``train`` and
    ``val`` or ``valid``, else ``FileNotFoundError``. One aggregate looks at the splits of all."""
    out = None
    if datasets:
        spaces = reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("dataset"), "split") for n, df in datasets.items()])
        found = {(r.dataset, r.split) for r in spaces.distinct().collect()}  # a few splits a dataset
        for name in datasets:
            if (name, "train") not in found or not {(name, "val"), (name, "valid")} & found:
                raise FileNotFoundError(f"dataset {name} has no train split or neither val nor valid")
    for name, df in datasets.items():
        part = df.withColumn("split", F.when(F.col("split") == "valid", "val").otherwise(F.col("split"))).withColumn("dataset", F.lit(name))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no datasets")
    return out
