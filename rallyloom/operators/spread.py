"""Windows over a clip's frames without a clip in one task.

A clip is cut into blocks of frames. A window that looks at most so many frames
back and ahead gets these from the neighbouring blocks as guests, so it is dealt by
(clip, block) and a long clip spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frames of a block: many times what a window looks at, few enough that clips spread.
BLOCK_FRAMES = 512


def block_of(frame: Column, size: int = BLOCK_FRAMES) -> Column:
    return F.floor(frame / size).cast("bigint")


def with_guests(df: DataFrame, back: int, ahead: int, size: int = BLOCK_FRAMES) -> DataFrame:
    """``df`` plus ``block``: every row in its own block, and in those whose rows look at
    it from at most ``back`` frames later or ``ahead`` frames earlier. ``at_home`` tells
    a row from its guest copies."""
    f = F.col("frame_idx")
    spread = df.withColumn("block", F.explode(F.sequence(block_of(f - ahead, size), block_of(f + back, size))))
    return spread.withColumn("at_home", F.col("block") == block_of(f, size))


def in_block() -> Window:
    return Window.partitionBy("clip", "block").orderBy("frame_idx")


def pieces(df: DataFrame, max_gap: int, size: int = BLOCK_FRAMES) -> DataFrame:
    """``df`` (one row a frame) plus ``piece``: the first frame of the run that a row belongs
    to, where runs are cut at holes of more than ``max_gap`` frames.

    A row that begins a run is told by its block and the guests in it. Which run goes
    on at the start of a block follows from the last begin of the blocks before it,
    one row a block.
    """
    back = F.col("frame_idx") - F.lag("frame_idx").over(in_block())
    begins = F.when(back.isNull() | (back > max_gap), F.col("frame_idx"))
    marked = with_guests(df, max_gap, 0, max(size, max_gap + 1)).withColumn("_begin", begins).where("at_home")
    here = F.max("_begin").over(in_block().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = marked.withColumn("_here", here)
    last = marked.groupBy("clip", "block").agg(F.max("_begin").alias("_last"))
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy("clip").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    carried = last.select("clip", "block", before.alias("_before"))
    joined = marked.join(carried, ["clip", "block"])
    return joined.withColumn("piece", F.coalesce("_here", "_before")).drop("block", "at_home", "_begin", "_here", "_before")
