"""Helpers shared by the corpus operators: scratch tables and text constants."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a session
    on one machine makes a temporary folder and remembers it; any other is an error,
    as executors would not see each other's folders.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("rallyloom.scratch.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="rallyloom-")
        spark.conf.set("rallyloom.scratch.dir", named)
    return named.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when the driver's JVM ends."""
    context = spark.sparkContext
    folder = f"{scratch_dir(spark)}/rallyloom-{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return folder


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it again.

    This cuts the lineage: a lost executor costs at most the tasks after this
    table, and what was stored (ids included) is the same for every reader.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._scratch_path = path  # for discard()
    for made in _recorders:
        made.append(stored)
    return stored


_recorders: list[list[DataFrame]] = []


@contextmanager
def recording() -> Iterator[list[DataFrame]]:
    """The tables that are stored meanwhile, so that whoever stores a result can remove them."""
    made: list[DataFrame] = []
    _recorders.append(made)
    try:
        yield made
    finally:
        _recorders[:] = [x for x in _recorders if x is not made]


def discard(*tables: DataFrame | None) -> None:
    """Remove tables of ``materialise`` that nothing reads any more (what was made of them is stored itself)."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            context = df.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def reads(df: DataFrame, tables: list[DataFrame]) -> bool:
    """Whether ``df`` is made of one of these stored tables."""
    paths = [t._scratch_path for t in tables]
    return any(p.split(":", 1)[-1].lstrip("/") in f for f in df.inputFiles() for p in paths)


def named(column: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def of_row(column: str) -> Column:
    """A column of the rows of a ``keyed`` table; only what is asked for is read."""
    return F.col("row").getField(column)


def keyed(df: DataFrame, tag: str) -> DataFrame:
    """``key, row``, stored: ``row`` holds all columns of ``df`` (``of_row``),
    ``key`` tells apart rows that are equal in every column, so verdicts hold for rows
    and not for ids, which may be null or repeat. No name of ``df`` can clash."""
    row = F.struct(*[named(c) for c in df.columns]) if df.columns else F.struct(F.lit(0).alias("none"))
    return materialise(df.select(row.alias("row")).withColumn("key", F.monotonically_increasing_id()), tag)


#: Bits of a filter that spares rows a shuffle: 512 parts of 4 KiB, 2 MiB at any size of the input.
FILTER_BITS, PART_BITS = 1 << 24, 1 << 15


def _spot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def filter_parts(keys: DataFrame, key: Column) -> DataFrame:
    """``part, bits``: a bitmap of the hashes of ``key``, in at most 512 rows."""
    spots = keys.select((_spot(key) + 1).alias("p"))  # these functions count from 1
    part, bit = F.call_function("bitmap_bucket_number", F.col("p")), F.call_function("bitmap_bit_position", F.col("p"))
    return spots.groupBy(part.alias("part")).agg(F.call_function("bitmap_construct_agg", bit).alias("bits"))


def test_bit(bitmap: Column, position: Column) -> Column:
    """One bit of a binary column; bytes and bits count from the low end."""
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, F.pmod(position, F.lit(8)).cast("int")) == 1


def possibly(df: DataFrame, key: Column, parts: DataFrame, found: bool = True) -> DataFrame:
    """The rows of ``df`` whose key may be among those of ``parts`` (or, not ``found``, surely is not).

    The parts have a proven bound of 2 MiB and are broadcast. Where they are full,
    all rows are possible ones, and the join that follows decides alone.
    """
    spot = _spot(key)
    small = F.broadcast(parts.select(F.col("part").alias("_filter_part"), F.col("bits").alias("_filter_bits")))
    joined = df.join(small, (F.floor(spot / PART_BITS) + 1).cast("bigint") == F.col("_filter_part"), "left")
    hit = F.col("_filter_bits").isNotNull() & test_bit(F.col("_filter_bits"), F.pmod(spot, F.lit(PART_BITS)))
    return joined.where(hit if found else ~hit).drop("_filter_part", "_filter_bits")


def without(stored: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of a ``keyed`` table whose ``key`` is not in ``dropped`` (a stored table of keys).

    Rows that the filter clears stay where they are; only the others are joined.
    """
    parts = materialise(filter_parts(dropped, F.col("key")), "filter")
    clear = possibly(stored, F.col("key"), parts, found=False)
    asked = possibly(stored, F.col("key"), parts).join(dropped, "key", "left_anti")
    return clear.unionByName(asked)


def words_of(text: Column) -> Column:
    """Words of a text as an array column; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def text_bytes(df: DataFrame, text: str) -> int:
    """UTF-8 bytes of all texts: one aggregate over the text column."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()["b"])
