"""Files of the pipeline: CSV, JSON and text in, the same out. Every reader has an explicit schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallyloom import schemas
from rallyloom.operators.events import H_COLUMNS


def _stem(path_column: str, suffix: str) -> Column:
    return F.regexp_extract(F.col(path_column), rf"([^/]+){suffix}$", 1)


def _whole_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``path, value``: one row a file. A file is one clip's or one frame's, so it fits a row."""
    return spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """``clip, frame_idx, class, x1, y1, x2, y2, confidence, ord`` of one CSV per clip, or of what ``write_detections`` wrote.

    ``ord`` grows with the line's place in its file (``line_order``), so it keeps the
    detector's order however large files are cut. Unreadable lines and unknown
    classes fail the job.
    """
    rows = spark.read.schema(schemas.DETECTIONS_CSV).option("mode", "FAILFAST").option("pathGlobFilter", "*.csv").csv(path, header=True)
    rows = rows.select("*", F.col("_metadata.file_path").alias("path"), line_order().alias("ord"))
    known = F.when(F.col("class").isin(*schemas.CLASSES), F.col("class")).otherwise(F.raise_error(F.concat(F.lit("unknown class: "), F.coalesce(F.col("class"), F.lit("null")))))
    written = F.nullif(F.regexp_extract("path", r"/clip=([^/]+)/", 1), F.lit(""))
    return rows.select(F.coalesce(written, _stem("path", r"\.csv")).alias("clip"), "frame_idx", known.alias("class"), "x1", "y1", "x2", "y2", "confidence", "ord")


def line_order() -> Column:
    """Of rows of one text or CSV file, their order: the place of the cut in the file, then the row's number in its task."""
    place = F.floor(F.col("_metadata.file_block_start") / 4096).cast("bigint")
    return F.shiftleft(place, 33) + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


def write_detections(df: DataFrame, path: str) -> None:
    """CSV by clip, boxes to one digit and confidence to three. A frame's boxes stand together, in the detector's order."""
    rounded = df.withColumns({c: F.bround(F.col(c), 1) for c in ("x1", "y1", "x2", "y2")} | {"confidence": F.bround("confidence", 3)})
    ordered = rounded.repartitionByRange("clip", "frame_idx").sortWithinPartitions("clip", "frame_idx", "ord")
    ordered.select("clip", "frame_idx", "class", "x1", "y1", "x2", "y2", "confidence").write.partitionBy("clip").option("header", True).csv(path)


def cached(spark: SparkSession, root: str, key: dict[str, object], compute: Callable[[], DataFrame]) -> DataFrame:
    """A result under a name made from everything it depends on: another range, floor or model is another entry."""
    name = "-".join(f"{k}={key[k]}" for k in sorted(key)).replace("/", "_")
    path = f"{root}/{name}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Scan, manifest and worksheet tables; blank cells are null."""
    return spark.read.schema({"scan": schemas.SCAN_CSV, "manifest": schemas.MANIFEST_CSV, "worksheet": schemas.WORKSHEET_CSV}[kind]).option("mode", "FAILFAST").csv(path, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def read_homographies(spark: SparkSession, path: str) -> DataFrame:
    """``clip, h00 .. h22`` of files ``<clip>_homography.json``."""
    return homographies_of(_whole_files(spark, path, "*_homography.json").select(_stem("path", r"_homography\.json").alias("clip"), "value"))


def homographies_of(texts: DataFrame) -> DataFrame:
    """``clip, h00 .. h22`` of rows ``clip, value``."""
    rows = texts.select("clip", F.from_json("value", schemas.HOMOGRAPHY_JSON).alias("h"))
    return rows.select("clip", *[F.col("h")[int(c[1])][int(c[2])].alias(c) for c in H_COLUMNS])


def homography_json(df: DataFrame) -> DataFrame:
    rows = F.array(*[F.array(*[F.col(f"h{i}{j}") for j in range(3)]) for i in range(3)])
    return df.select("clip", F.to_json(rows).alias("value"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """``clip, label, px, py`` of files ``<clip>_homography_points.json``."""
    return points_of(_whole_files(spark, path, "*_homography_points.json").select(_stem("path", r"_homography_points\.json").alias("clip"), "value"))


def points_json(points: DataFrame) -> DataFrame:
    """``clip, value``: the points of a clip as an object of pairs, labels in order."""
    entry = F.struct("label", F.array("px", "py").alias("p"))
    return points.groupBy("clip").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("value"))


def write_by_clip(texts: DataFrame, path: str) -> None:
    """A folder a clip, from rows ``clip, value``."""
    texts.write.partitionBy("clip").text(path)


def read_by_clip(spark: SparkSession, path: str, clip_type: str = "bigint") -> DataFrame:
    """``clip, value`` of such folders."""
    return spark.read.schema(f"value string, clip {clip_type}").text(path).select("clip", "value")


def points_of(texts: DataFrame) -> DataFrame:
    """``clip, label, px, py`` of rows ``clip, value``."""
    rows = texts.select("clip", F.explode(F.from_json("value", schemas.POINTS_JSON)).alias("label", "p"))
    return rows.select("clip", "label", F.col("p")[0].alias("px"), F.col("p")[1].alias("py"))


def merge_points(old: DataFrame, new: DataFrame) -> DataFrame:
    """Points clicked again replace those of the same label."""
    return new.unionByName(old.join(new, ["clip", "label"], "left_anti"))


def stats_json(documents: DataFrame) -> DataFrame:
    """``clip, value``: the statistics documents as JSON, empty lists where there is nothing."""
    filled = {c: F.coalesce(F.col(c), F.array().cast(dict(documents.dtypes)[c])) for c in ("rallies", "touches", "excluded_stationary_track_ids")}
    rest = [c for c in documents.columns if c != "clip"]
    return documents.withColumns(filled).select("clip", F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("value"))


def verification_json(verified: DataFrame, path: str) -> DataFrame:
    """``value``: an object a row, ``{path: answer}``, nulls kept, of remote answers with a column ``path``."""
    answer = F.struct("ball_visible", "bbox", "confidence", "notes", "error")
    return verified.select(F.to_json(F.create_map(F.col(path).cast("string"), answer), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON text a line, from a column ``value``."""
    df.select("value").write.text(path)


def read_verification(spark: SparkSession, path: str) -> DataFrame:
    """``path, ball_visible, bbox, confidence, notes, error`` of such files."""
    rows = spark.read.text(path).select(F.explode(F.from_json("value", f"map<string,{schemas.VERIFICATION_JSON}>")).alias("path", "a"))
    return rows.select("path", "a.*")


def read_labels(spark: SparkSession, path: str, images: DataFrame | None = None) -> DataFrame:
    """``split, stem, line_no, cls, xc, yc, w, h`` of ``<split>/labels/<stem>.txt``; an empty file has no rows."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), line_order().alias("ord"), F.btrim("value", F.lit(" \t\r\f\v")).alias("line")).where("line <> ''")
    parts = lines.select(F.regexp_extract("path", r"([^/]+)/labels/", 1).alias("split"), _stem("path", r"\.txt").alias("stem"), "ord", "line")
    number = F.row_number().over(Window.partitionBy("split", "stem").orderBy("ord")) - 1  # a frame's file: a few lines
    tokens = parts.withColumn("line_no", number).withColumn("t", F.split("line", r"\s+"))
    rows = tokens.select("split", "stem", "line_no", F.col("t")[0].cast("int").alias("cls"), *[F.col("t")[i + 1].cast("double").alias(c) for i, c in enumerate(("xc", "yc", "w", "h"))])
    return rows if images is None else rows.join(images.select("split", "stem"), ["split", "stem"], "left_semi")


def write_label_files(files: DataFrame, open_file: Callable[[str, str], object]) -> None:
    """One file a row of ``split, stem, content``; ``open_file`` opens it in the store that tasks share."""

    def write(rows) -> None:
        for r in rows:
            with open_file(r["split"], r["stem"]) as out:
                out.write(r["content"])

    files.select("split", "stem", "content").foreachPartition(write)


def frame_files(spark: SparkSession, path: str) -> DataFrame:
    """``clip, frame_name, idx, path`` of ``<clip>/frame_*.jpg``, numbered by name; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "frame_*.jpg").load(path).select("path")
    named = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("clip"), F.regexp_extract("path", r"([^/]+)$", 1).alias("frame_name"), "path")
    return named.withColumn("idx", F.row_number().over(Window.partitionBy("clip").orderBy("frame_name")).cast("bigint") - 1)
