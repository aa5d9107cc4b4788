"""Mixing sources to target weights by entropy balancing.

Wanted are document rates 0 <= r <= most that meet each source's token target and
stay as close as possible, in relative entropy over documents, to taking every
document once. The optimum is exponentially tilted: r = min(most, exp(l * size)),
with one multiplier l a source, which solves the convex dual, a separate problem in
one variable for every source: the tokens that the rates give must be the target.

Newton steps find all multipliers at once. Rates depend on source and size only, so
documents are counted by these once; a step is an aggregate of gradient and
curvature over that table by source. It is taken on the logarithm of the tokens,
where tilted sums are nearly straight, and halves a bracket where it would leave
it. The steps end when every source meets its target to ``tolerance``.

Rates are then rounded into copies, size by size from the longest down, carrying
the remainder to the next shorter size, so a source ends within about half its
shortest document of its target. Which documents of equal size get the one copy
more is decided by a hash of the id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyloom.llm.common import WORD, discard, keyed, materialise, named, of_row


@dataclass(frozen=True)
class MixParams:
    #: Weights of the sources in code-point order, repeating.
    weights: tuple[int, ...] = (5, 2, 1)
    #: No source gives, and no document is taken, more than this many times its size.
    most: int = 3
    #: Newton stops when the tokens of every source are this close to its target, relatively.
    tolerance: float = 1e-12
    newton_steps: int = 100
    #: Rows of one source and size that are ranked in one task, about.
    rank_rows: int = 10_000


def _ranked_sources(by_source: DataFrame) -> DataFrame:
    """``by_source`` plus ``rank`` from 0 in code-point order, null last: ranges of sources
    are ranked in tasks of their own, after the counts of the ranges before them."""
    order = [F.col("source").isNull(), F.col("source")]
    dealt = materialise(by_source.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "mix-ranges")
    # One row a range.
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(before, F.lit(0)).alias("start"))
    rank = F.col("start") + F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    return dealt.join(starts, "range").withColumn("rank", rank).drop("range", "start")


def source_targets(sized: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """``source, source_size, target`` from rows of ``source, size``.

    Sources share the sum of all sizes by weight. Where a target would exceed
    ``most`` times its source's size it stops there, and the excess is reshared by
    weight among the others until none is above. Each round is one aggregate over
    the table of sources; only three numbers reach the driver.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in params.weights]), (F.col("rank") % len(params.weights) + 1).cast("int"))
    sources = materialise(_ranked_sources(by_source).select("source", "source_size", weight.cast("bigint").alias("weight")), "mix-sources")
    cap = F.col("source_size") * params.most
    share = None
    while True:
        above = F.lit(False) if share is None else F.col("weight") * F.lit(share) > cap
        row = sources.agg(
            F.sum("source_size").alias("total"), F.sum(F.when(above, cap)).alias("stopped"),
            F.sum(F.when(~above, F.col("weight"))).alias("open"),
        ).first()
        if not row["open"]:
            break
        new = (float(row["total"]) - float(row["stopped"] or 0)) / float(row["open"])
        if share is not None and new <= share:
            break
        share = new
    target = F.least(F.col("weight") * F.lit(float(share or 0.0)), cap.cast("double"))
    return sources.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _by_source(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` with the row of ``b`` of their source; null is a source."""
    other = b.withColumnRenamed("source", "_source")
    return a.join(other, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def newton_rates(targets: DataFrame, cells: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """``targets`` plus ``multiplier``, stored, from rows of ``source, size, n`` (documents of that source and size).

    A source whose target is what its documents can give at most has no finite
    multiplier; it gets infinity, and one with nothing to take minus infinity.
    """
    most, z = float(params.most), F.col("size").cast("double")
    cells = cells.where("size > 0")
    lengths = cells.groupBy("source").agg(F.min("size").cast("double").alias("least"))
    lengths = lengths.withColumnRenamed("source", "_source")
    at = targets.join(lengths, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    share = F.try_divide("target", "source_size")
    full, none = F.col("target") >= F.col("source_size") * params.most, F.col("least").isNull() | (F.col("target") <= 0)
    inf = F.lit(float("inf"))
    # Brackets: at log(share) / least all rates are at most share, at log(most) / least all are at their bound.
    state = at.select(
        "source", "source_size", "target", F.when(none, -inf).when(full, inf).otherwise(F.lit(0.0)).alias("multiplier"),
        F.when((share > 0) & (share < 1), F.log(share) / F.col("least")).otherwise(F.lit(0.0)).alias("low"),
        F.when(share > 1, F.log(F.lit(most)) / F.col("least")).otherwise(F.lit(0.0)).alias("high"),
        (none | full).alias("done"),
    )
    state = materialise(state, "mix-newton")
    for _ in range(params.newton_steps):
        if state.where(~F.col("done")).isEmpty():
            break
        open_cells = _by_source(cells, state.where(~F.col("done")).select("source", "multiplier"))
        tilted = F.exp(F.col("multiplier") * z)
        words = F.col("n") * z
        sums = open_cells.groupBy("source").agg(
            F.sum(words * F.least(tilted, F.lit(most))).alias("tokens"), F.sum(F.when(tilted < most, words * z * tilted).otherwise(F.lit(0.0))).alias("curvature")
        )
        sums = sums.withColumnRenamed("source", "_source")
        joined = state.join(sums, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
        gap = F.col("tokens") - F.col("target")
        low = F.when(gap < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("multiplier")).otherwise(F.col("high"))
        newton = F.col("multiplier") + F.log(F.try_divide("target", "tokens")) * F.try_divide("tokens", "curvature")
        inside = F.col("curvature").isNotNull() & (F.col("curvature") > 0) & (newton > low) & (newton < high)
        following = F.when(inside, newton).otherwise((low + high) / 2)
        met = (F.abs(gap) <= F.col("target") * params.tolerance) | (following == F.col("multiplier"))
        done = F.col("done") | met
        last, state = state, materialise(
            joined.select(
                "source", "source_size", "target", F.when(done, F.col("multiplier")).otherwise(following).alias("multiplier"),
                F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"), F.when(F.col("done"), F.col("high")).otherwise(high).alias("high"), done.alias("done"),
            ),
            "mix-newton",
        )
        discard(last)
    return state.select("source", "source_size", "target", "multiplier")


def _rate(params: MixParams):
    """min(most, exp(multiplier * size)); 12 digits, so that Newton's last one never decides a whole copy."""
    tilted = F.least(F.exp(F.col("multiplier") * F.col("size")), F.lit(float(params.most)))
    return F.when(F.col("size") > 0, F.round(tilted, 12)).otherwise(F.lit(0.0))


def _round_source(table: pa.Table, most: int) -> pa.Table:
    """Copies that the ``n`` documents of each size of one source get together.

    A fold over the distinct sizes, the longest first (their number is bounded by
    the longest document, not by the number of documents), whose state is the words
    still owed. It rounds to the nearest copy, but never leaves more to the shorter
    sizes than they can take, or less than nothing, where that can be helped.
    """
    table = table.sort_by("size")
    size, n, rate = (table.column(c).to_numpy() for c in ("size", "n", "rate"))
    want, can = rate * (n * size), (most * n * size).astype(np.float64)
    low = np.cumsum(want) - want  # of the shorter sizes
    high = np.cumsum(can) - can - low
    total, owed = np.zeros(len(size), np.int64), 0.0
    for i in range(len(size) - 1, -1, -1):
        due = owed + want[i]
        copies = np.floor(due / size[i] + 0.5)
        copies = min(max(copies, np.ceil((due - high[i]) / size[i])), max(np.floor((due + low[i]) / size[i]), 0))
        total[i] = min(max(copies, 0), most * n[i])
        owed = due - total[i] * size[i]
    return pa.table({"source": table.column("source"), "size": pa.array(size, pa.int64()), "total": pa.array(total, pa.int64())})


def _group_copies(cells: DataFrame, rates: DataFrame, params: MixParams) -> DataFrame:
    """``source, size, total`` of every source and size above 0."""
    most = params.most
    rated = _by_source(cells.where("size > 0"), rates.select("source", "multiplier")).select("source", "size", "n", _rate(params).alias("rate"))
    return rated.groupBy("source").applyInArrow(lambda t: _round_source(t, most), "source string, size bigint, total bigint")


def _mix(base: DataFrame, params: MixParams) -> DataFrame:
    """``key, doc_id, size, source_size, target, copies, rate`` from rows of ``key, doc_id, source, text``."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("bigint")
    docs = materialise(base.select("key", "doc_id", "source", size.alias("size")), "mix-sizes")
    cells = materialise(docs.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    rates = newton_rates(source_targets(docs, params), cells, params)
    totals = materialise(_group_copies(cells, rates, params), "mix-totals")
    # Documents of one source and size are ranked by md5 inside salts, which are ranges
    # of the same order: a row's place is the rows of earlier salts and its rank in its own.
    salts = max(1, docs.count() // params.rank_rows)
    digest = F.md5(F.col("doc_id").cast("string"))
    lead = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    salt = F.coalesce(F.floor(lead * F.lit(salts) / F.lit(float(1 << 32))), F.lit(salts)).cast("bigint")  # null ids come last
    salted = docs.withColumn("salt", salt)
    keys = ["source", "size", "salt"]
    upto = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row a salt of a cell: their number is rows / rank_rows above the number of cells.
    places = salted.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")).withColumn("upto", F.sum("m").over(upto))
    null_safe = lambda a, b, on: [a[k].eqNullSafe(b[f"_{k}"]) for k in on]
    renamed = lambda x, on: x.select(*[F.col(k).alias(f"_{k}") for k in on], *[c for c in x.columns if c not in on])
    known = renamed(_by_source(cells, rates), ["source", "size"])
    given = renamed(totals.withColumnRenamed("total", "_total"), ["source", "size"])
    given = known.join(given.select(F.col("_source").alias("_s"), F.col("_size").alias("_z"), "_total"), [F.col("_source").eqNullSafe(F.col("_s")), F.col("_size") == F.col("_z")], "left")
    places = places.join(given, null_safe(places, given, ["source", "size"])).withColumn("total", F.coalesce("_total", F.lit(0)))
    places = places.withColumn("base", F.floor(F.col("total") / F.col("n"))).withColumn("extra", F.col("total") - F.col("base") * F.col("n"))
    places = renamed(places.select(*keys, "base", "extra", (F.col("upto") - F.col("m")).alias("earlier"), "source_size", "target", _rate(params).alias("rate")), keys)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(digest.asc_nulls_last(), "doc_id", "key"))
    ranked = salted.withColumn("rank", rank)
    ranked = ranked.join(places, null_safe(ranked, places, keys))
    copies = (F.col("base") + (F.col("earlier") + F.col("rank") <= F.col("extra")).cast("bigint")).cast("bigint")
    return ranked.select("key", "doc_id", "size", "source_size", "target", copies.alias("copies"), "rate")


def mix_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", params: MixParams = MixParams()) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies, rate`` for every row.

    A null source is a source of its own, the last one. Null and blank texts have
    size 0 and are never taken; repeated rows count each, and stand next to each
    other in the order that extra copies follow. Other columns of ``df`` are not
    looked at.
    """
    base = df.select(
        F.monotonically_increasing_id().alias("key"), named(doc_id).cast("bigint").alias("doc_id"), named(source).cast("string").alias("source"), named(text).alias("text")
    )
    return _mix(base, params).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def take_mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", params: MixParams = MixParams()) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes that row, with their columns."""
    stored = keyed(df, "mix-input")
    base = stored.select("key", of_row(doc_id).cast("bigint").alias("doc_id"), of_row(source).cast("string").alias("source"), of_row(text).alias("text"))
    copies = _mix(base, params).where("copies > 0").select("key", "copies")
    taken = stored.select("key", "row").join(copies, "key")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
