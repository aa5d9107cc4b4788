"""Quality rules with host-level verdicts (DataFrame functions only).

Every document gets its rule counts from array functions on its own row, so no
text is shuffled. Failures are then summed by host (map-side combined, so a host
with a third of all rows is one partial row per task), each host's failure rate
is shrunk towards an empirical beta prior, and the verdicts are joined back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyloom.llm.common import SPACE_CLASS, materialise, named, words_of


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: A host is rejected when its shrunk failure rate exceeds this.
    max_host_rate: float = 0.5
    #: Bounds of the prior's strength, in documents.
    min_strength: float = 2.0
    max_strength: float = 1000.0
    #: Rejected hosts that may be broadcast (a few MB of names), and the salts of rows where there are more.
    max_broadcast_hosts: int = 50_000
    salts: int = 64


def _with_cover(df: DataFrame) -> DataFrame:
    """Add ``n_repeat_words`` to rows of ``words, n_words``: words inside 3-word windows that the text holds twice or more.

    Windows are compared by 64-bit hash first. Only in texts that hold a hash twice
    are the windows of such hashes made as strings (words hold no space, so joining
    by one is injective) and sorted; neighbours in that order that are equal are the
    repeated ones, and gaps between their positions give the number of words covered.
    """
    at = lambda i: F.get("words", i)
    starts = F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), F.col("n_words").cast("int") - 3)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("hashes", F.transform(starts, lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2))))
    twice = F.size(F.array_distinct("hashes")) < F.size("hashes")
    df = df.withColumn("by_hash", F.when(twice, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.withColumn("likely", _repeated("by_hash", "h"))
    window = lambda i: F.concat_ws(" ", at(i), at(i + 1), at(i + 2))
    df = df.withColumn("by_text", F.when(F.size("likely") > 0, F.sort_array(F.transform("likely", lambda i: F.struct(window(i).alias("t"), i.alias("i"))))))
    df = df.withColumn("repeated", _repeated("by_text", "t")).withColumn("n_repeat_words", _covered("repeated"))
    return df.drop("hashes", "by_hash", "likely", "by_text", "repeated")


def _repeated(array: str, field: str) -> Column:
    """Sorted positions ``i`` of the elements of a sorted array of structs that equal a neighbour in ``field``."""
    same = lambda j, k: F.coalesce(F.get(array, j)[field] == F.get(array, k)[field], F.lit(False))
    found = F.filter(F.sequence(F.lit(0), F.size(array) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
    return F.when(F.size(array) > 0, F.sort_array(F.transform(found, lambda j: F.get(array, j)["i"])))


def _covered(at: str) -> Column:
    """Words that 3-word windows at these positions cover."""
    gap = lambda k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), F.get(at, k) - F.get(at, k - 1)))
    count = F.aggregate(F.sequence(F.lit(0), F.size(at) - 1), F.lit(0).cast("bigint"), lambda acc, k: acc + gap(k).cast("bigint"))
    return F.when(F.size(at) > 0, count).otherwise(F.lit(0).cast("bigint"))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def rule_counts(df: DataFrame, text: str = "text", params: QualityParams = QualityParams()) -> DataFrame:
    """``df`` plus ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``
    (columns of ``df`` of these names are replaced, all others kept)."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    others = [c for c in df.columns if c not in COUNTS]
    inner = df.select(F.struct(F.lit(0).alias("_".join(others)), *[named(c) for c in others]).alias("row"), named(text).alias("text"))
    inner = inner.withColumn("words", words_of(F.col("text"))).withColumn("n_words", F.size("words").cast("bigint"))
    inner = inner.withColumn("word_chars", F.length(F.regexp_replace(whole, SPACE_CLASS + "+", "")).cast("bigint"))
    inner = inner.withColumn("n_symbols", F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("bigint"))
    inner = inner.withColumn("lines", F.filter(F.split(whole, "\n", -1), has_word))
    inner = inner.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"))
    inner = _with_cover(inner)
    failed: Column = (F.col("n_words") < params.min_words) | (100 * F.col("n_repeat_words") > params.max_repeat_percent * F.col("n_words"))
    return inner.select(*[F.col("row").getField(c).alias(c) for c in others], *COUNTS[:-1], failed.alias("base_failed"))


def beta_prior(docs: float, failed: float, squares: float, hosts: int, params: QualityParams) -> tuple[float, float]:
    """Mean and strength. ``squares``: sum over hosts of failed ** 2 / docs."""
    if not docs:
        return 0.0, params.max_strength
    mean = failed / docs
    # Variance of the rates between hosts, less what binomial noise adds to it.
    between = squares / docs - mean * mean - mean * (1 - mean) * hosts / docs
    strength = mean * (1 - mean) / between - 1 if between > 1e-12 else params.max_strength
    return mean, min(max(strength, params.min_strength), params.max_strength)


def host_verdicts(counted: DataFrame, host: str = "source", params: QualityParams = QualityParams()) -> DataFrame:
    """One row per host: ``host, host_docs, host_failed, host_rate, host_ok``.

    The prior is a beta distribution fitted by moments to the hosts' rates: its
    mean is the pooled rate, its strength the binomial variance over the variance
    between hosts, bounded by the parameters. A host's rate is its posterior mean.
    """
    hosts = (
        counted.where(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("host"))
        .agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("bigint")).alias("host_failed"))
    )
    n, f = F.col("host_docs").cast("double"), F.col("host_failed").cast("double")
    # One row of four sums; they become constants of the plan.
    sums = hosts.agg(F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(f * f / n).alias("ff"), F.count(F.lit(1)).alias("h")).first()
    mean, strength = beta_prior(sums["n"] or 0.0, sums["f"] or 0.0, sums["ff"] or 0.0, sums["h"], params)
    rate = (f + mean * strength) / (n + strength)
    return hosts.withColumn("host_rate", rate).select(
        "host", "host_docs", "host_failed", "host_rate", (F.col("host_rate") <= params.max_host_rate).alias("host_ok")
    )


def judge_documents(df: DataFrame, text: str = "text", host: str = "source", params: QualityParams = QualityParams()) -> DataFrame:
    """Rule counts, host rate and ``kept`` for every row of ``df`` (all its columns but the text).

    Null and blank texts have no words and fail; rows without a host get no host
    verdict; repeated rows are judged alike; columns of ``df`` that carry one of
    the result names are replaced, all others are kept. The counts are stored once
    (without texts), so texts are read once.
    """
    results = {*COUNTS, "host_docs", "host_failed", "host_rate", "host_ok", "kept"}
    others = [c for c in df.columns if c != text and c not in results]
    inner = df.select(F.struct(F.lit(0).alias("_".join(others)), *[named(c) for c in others]).alias("row"), named(host).alias("host_"), named(text).alias("text"))
    counted = materialise(rule_counts(inner, "text", params).drop("text"), "quality")
    verdicts = host_verdicts(counted, "host_", params)
    joined = counted.join(verdicts, F.col("host_") == F.col("host"), "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("host_ok"), F.lit(True))
    return joined.select(*[F.col("row").getField(c).alias(c) for c in others], *COUNTS, "host_docs", "host_failed", "host_rate", "host_ok", kept.alias("kept"))


def keep_good(df: DataFrame, text: str = "text", host: str = "source", params: QualityParams = QualityParams()) -> DataFrame:
    """The rows of ``df`` that pass, with their columns, whatever their names.

    Counts stay beside the rows in one stored table; hosts are summed from its narrow
    columns. Rejected hosts are a stored table, too: up to ``max_broadcast_hosts`` of
    them are broadcast, so no text moves; more are joined with their rows dealt over
    salts, so that a host's rows never meet in one task.
    """
    row = F.struct(*[named(c) for c in df.columns])
    inner = df.select(row.alias("row"), named(text).alias("text"), named(host).alias("host_"))
    counted = rule_counts(inner, "text", params).select("row", "host_", "base_failed", F.pmod(F.xxhash64("row"), F.lit(params.salts)).alias("salt"))
    stored = materialise(counted, "quality-rows")
    bad = materialise(host_verdicts(stored, "host_", params).where(~F.col("host_ok")).select("host"), "quality-bad-hosts")
    good = stored.where(~F.col("base_failed"))
    if bad.count() <= params.max_broadcast_hosts:
        found = good.join(F.broadcast(bad), good["host_"] == bad["host"], "left_anti")
    else:
        salted = bad.select("host", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(params.salts - 1).cast("bigint"))).alias("salt_"))
        found = good.join(salted, (good["host_"] == salted["host"]) & (good["salt"] == salted["salt_"]), "left_anti")
    return found.select("row.*")
