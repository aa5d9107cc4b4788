"""Exact dedup by distributed most-significant-digit radix partitioning.

A level looks at the next digit of every open document: a block of successive
bytes of its normalised text. Digits grow from level to level, so depth is
logarithmic in the longest text. Rows of a group that share the digit form a new
group; counting groups is a map-side combined aggregate, so a group with a third
of all rows is one partial row per task. A row leaves when its group has one row
or its text has ended (then all rows of its group are equal: they agree in every
byte and ended together; no digest is compared).

The first level works on a narrow stored table without texts. Of the texts, only
those are dealt out whose first digit another row may share; each later level
carries bytes with open rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyloom.llm.common import SPACES, discard, filter_parts, keyed, materialise, named, of_row, possibly, without

#: Bytes of the first digit and how much wider each next one is.
FIRST_DIGIT, WIDER = 48, 24


def _groups(rows: DataFrame, keys: list[str], width: int, level: int) -> DataFrame:
    """Groups of two or more rows of this level, with a stored id; ``ended``: the digit is shorter than its block."""
    best = F.min(F.struct((-F.col("n_cp")).alias("n"), F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("d"), F.col("key").alias("k")))
    return materialise(
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("size"), best.alias("best"))
        .where(F.col("size") > 1)
        .select(
            *keys, "size", F.col("best.d").alias("best_id"), F.col("best.k").alias("best_key"),
            (F.octet_length("head") < width).alias("ended"), F.monotonically_increasing_id().alias("next_gid"),
        ),
        f"radix-groups-{level}",
    )


def _split(rows: DataFrame, groups: DataFrame, keys: list[str], level: int) -> DataFrame:
    """Rows with their group of this level; bytes stay only with rows that go on.

    A hot digit is a skewed side against one row of the other: adaptive execution
    splits it. The join is a sort-merge join at every size, never a broadcast, so
    what it moves follows the input from the smallest on.
    """
    alone = F.col("size").isNull()
    done = alone | F.col("ended")
    rest = [F.when(~done, F.col("rest")).alias("rest")] if "rest" in rows.columns else []
    out = rows.join(groups.hint("merge"), keys, "left").select(
        "key", "doc_id", "n_cp", "text_sha256",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.when(alone, F.col("key")).otherwise(F.col("best_key")).alias("keep_key"),
        F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
        done.alias("done"), F.col("next_gid").alias("gid"), *rest,
    )
    return materialise(out, f"radix-rows-{level}")


def _verdicts(base: DataFrame, first: int, wider: int) -> DataFrame:
    """``key, doc_id, keep_id, keep_key, group_size, text_sha256`` from rows of ``key, doc_id, text``.

    Keys need to be the same in every read of ``base`` only if the caller looks rows
    up by them: a row is told apart by the key it has in a stored table here.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    norm = F.encode(F.translate(text, SPACES, ""), "utf-8")
    base = base.select("key", "doc_id", F.length(text).cast("bigint").alias("n_cp"), norm.alias("norm"))
    base = base.select("key", "doc_id", "n_cp", F.sha2("norm", 256).alias("text_sha256"), F.substring("norm", 1, first).alias("head"), "norm")
    rows = materialise(base.drop("norm"), "radix-heads")
    groups = _groups(rows, ["head"], first, 0)
    split = _split(rows, groups, ["head"], 0)
    finished, level, width = [split.where("done")], 0, first
    opened = groups.where(~F.col("ended")).select("head", F.col("next_gid").alias("gid"))
    if not opened.isEmpty():
        # Texts whose digit no open group has stay where they are, but for the filter's errors.
        parts = materialise(filter_parts(opened, F.col("head")), "radix-filter")
        texts = possibly(base, F.col("head"), parts).withColumn("rest", F.expr(f"substring(norm, {first + 1})")).drop("norm")
        rows = texts.join(opened.hint("merge"), "head").drop("head")
        while True:
            width, level, keys = width * wider, level + 1, ["gid", "head"]
            cut = rows.select(
                "key", "doc_id", "n_cp", "text_sha256", "gid",
                F.substring("rest", 1, width).alias("head"), F.expr(f"substring(rest, {width + 1})").alias("rest"),
            )
            here = materialise(cut, f"radix-open-{level}") if level == 1 else cut
            last, groups = groups, _groups(here, keys, width, level)
            before, split = split, _split(here, groups, keys, level)
            finished.append(split.where("done"))
            discard(last, *([here] if level == 1 else []))
            if groups.where(~F.col("ended")).isEmpty():
                break
            rows = split.where(~F.col("done"))
    out = finished[0]
    for more in finished[1:]:
        out = out.drop("rest").unionByName(more.drop("rest"))
    return out.select("key", "doc_id", "keep_id", "keep_key", "group_size", "text_sha256")


def exact_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", first: int = FIRST_DIGIT, wider: int = WIDER) -> DataFrame:
    """One row per row of ``df``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical without ASCII white space; null counts as
    empty, and all empty texts are one group. Of equal texts the row with most
    code points stays, then the smallest id (null ids last). A repeated row is a
    copy of itself: it counts in ``group_size`` and, having the same id, carries the
    same verdict here; ``drop_duplicates`` returns one of them. Other columns of
    ``df`` are not looked at, whatever their names.
    """
    base = df.select(F.monotonically_increasing_id().alias("key"), named(doc_id).cast("bigint").alias("doc_id"), named(text).alias("text"))
    found = _verdicts(base, first, wider)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with their columns: exactly one of each group of
    equal texts, also where ids are null or repeat (of equal rows any one)."""
    stored = keyed(df, "exact-input")
    found = _verdicts(stored.select("key", of_row(doc_id).cast("bigint").alias("doc_id"), of_row(text).alias("text")), FIRST_DIGIT, WIDER)
    dropped = materialise(found.where("key <> keep_key").select("key"), "exact-dropped")
    return without(stored.select("key", "row"), dropped).select("row.*")
