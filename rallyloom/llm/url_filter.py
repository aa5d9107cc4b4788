"""URL filters: prefix rules, and exact list membership by a cascade of Bloom filters.

The cascade holds a list of domain names within the corpus's complete universe of
names: every host and every domain above it. Level 1 encodes the listed names; level
2 encodes the unlisted names that level 1 wrongly passes; level 3 the listed names
that level 2 wrongly passes; and so on until a level passes nothing wrongly. A name
of the universe is listed exactly if the number of levels it passes before it fails
is odd. So membership is a few bit tests on each row; no rows are joined or shuffled,
and a host with a third of all pages is like any other.

Only the distinct names are shuffled, to meet the list (a table of any size) and to
find each level's false positives. A long list is split by name hash into cascades
of bounded size. Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyloom.llm.common import materialise, named, test_bit

#: (verdict, host, path) as in production.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


@dataclass(frozen=True)
class CascadeParams:
    bits_per_key: int = 12
    hashes: int = 6
    #: A level of more bytes is split into cascades by ranges of name hashes. Up to
    #: ``max_cascades`` are put into the plan (5.6 million listed names each); above
    #: that, membership is an ordinary join with the listed names.
    max_filter_bytes: int = 8 << 20
    max_cascades: int = 16


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and where ``://`` is missing."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct of the longest rule that fits (``rule``, ``verdict``), or null. Longest is by the characters of host and path together."""
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    made = lambda v, h, p: F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))
    return F.coalesce(*[F.when(fits(h, p), made(v, h, p)) for v, h, p in ranked])


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * 64 + i)), F.lit(bits)) for i in range(hashes)]


def names_of(host: Column) -> Column:
    """The host and every domain above it, as an array."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


@dataclass(frozen=True)
class Level:
    bits: int
    bitmap: bytes


class Cascade:
    """Levels of Bloom filters; ``contains`` is exact for keys of the universe."""

    def __init__(self, levels: list[Level], params: CascadeParams):
        self.levels, self.params = levels, params

    def passes(self, key: Column, level: int) -> Column:
        one = self.levels[level]
        bitmap = F.unhex(F.lit(one.bitmap.hex()))
        return reduce(lambda a, b: a & b, [test_bit(bitmap, p) for p in _positions(key, level, one.bits, self.params.hashes)])

    def contains(self, key: Column) -> Column:
        """Level by level: a key that fails level i is listed if i is even, counting from 0 as not listed."""
        answer: Column = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            answer = F.when(self.passes(key, level), answer).otherwise(F.lit(level % 2 == 1))
        return answer


def _build_level(keys: DataFrame, count: int, level: int, params: CascadeParams) -> Level:
    """A filter over the ``key`` column. Bits are set by a map-side combined aggregate
    over bitmap parts of 4 KiB; the driver gets ``bits_per_key`` bits a key, which
    the caller has bounded."""
    bits = max(64, math.ceil(count * params.bits_per_key / 8) * 8)
    spots = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits, params.hashes))).alias("p"))
    number = F.col("p") + 1  # these functions count from 1
    part, bit = F.call_function("bitmap_bucket_number", number), F.call_function("bitmap_bit_position", number)
    rows = spots.groupBy(part.alias("part")).agg(F.call_function("bitmap_construct_agg", bit).alias("bitmap"))
    whole = bytearray((bits // 32768 + 2) * 4096)
    for row in rows.toLocalIterator():
        # Bucket n holds the positions from (n - 1) * 32768 on.
        start = (row["part"] - 1) * 4096
        whole[start : start + 4096] = row["bitmap"]
    return Level(bits, bytes(whole[: bits // 8]))


def build_cascade(universe: DataFrame, params: CascadeParams = CascadeParams()) -> Cascade:
    """From a stored table of ``key, listed`` (distinct keys). Each level is over what the level before got wrong."""
    levels: list[Level] = []
    todo = universe
    while True:
        encode = len(levels) % 2 == 0  # even levels encode listed keys, odd ones unlisted keys
        count = todo.where(F.col("listed") == encode).count()
        if not count and levels:
            return Cascade(levels, params)
        levels.append(_build_level(todo.where(F.col("listed") == encode), count, len(levels), params))
        passed = Cascade(levels, params).passes(F.col("key"), len(levels) - 1)
        # The next level must undo the wrong passes, among all keys that came this far.
        todo = materialise(todo.where(passed), "cascade")


def membership(universe: DataFrame, params: CascadeParams = CascadeParams()) -> Callable[[Column], Column] | None:
    """A test of listed keys for any key of the universe (rows ``key, listed``, distinct keys), by
    as many cascades as the list needs; None if these were more than ``max_cascades``."""
    universe = materialise(universe.select("key", "listed"), "universe")
    parts = max(1, math.ceil(universe.where("listed").count() * params.bits_per_key / 8 / params.max_filter_bytes))
    if parts > params.max_cascades:
        return None
    part = lambda key: F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts))
    if parts == 1:
        return build_cascade(universe, params).contains
    cascades = [build_cascade(universe.where(part(F.col("key")) == i), params) for i in range(parts)]
    return lambda key: reduce(lambda rest, i: F.when(part(key) == i, cascades[i].contains(key)).otherwise(rest), range(parts), F.lit(False))


def filter_pages(df: DataFrame, blocklist: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, params: CascadeParams = CascadeParams()) -> DataFrame:
    """``page_id, host, path, rule, verdict, listed`` for every row.

    ``blocklist`` has a column ``key`` of domain names (repeats and nulls do not
    matter); a host is ``listed`` if the list has it or a domain above it. Rules come
    first; where none fits, a listed host is blocked. Null and malformed URLs have an
    empty host, which is looked up like any other name; repeated rows are judged
    alike, ids may be null; other columns are not looked at.
    """
    host, path = split_url(F.col("url"))
    pages = df.select(named(page_id).cast("bigint").alias("page_id"), named(url).alias("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    names = pages.select("host").distinct().select(F.explode(names_of(F.col("host"))).alias("key")).distinct()
    keys = blocklist.select(F.col("key").alias("listed_key")).where("listed_key is not null").distinct()
    universe = names.join(keys, F.col("key") == F.col("listed_key"), "left").select("key", F.col("listed_key").isNotNull().alias("listed"))
    contains = membership(universe, params)
    if contains:
        pages = pages.withColumn("listed", F.exists(names_of(F.col("host")), contains))
    else:
        hosts = pages.select("host").distinct().select(F.col("host").alias("listed_host"), F.explode(names_of(F.col("host"))).alias("key"))
        hosts = hosts.join(keys, F.col("key") == F.col("listed_key"), "left_semi").select("listed_host").distinct()
        pages = pages.join(hosts, F.col("host") == F.col("listed_host"), "left").withColumn("listed", F.col("listed_host").isNotNull())
    pages = pages.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return pages.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "listed")
