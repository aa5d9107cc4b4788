"""MinHash near-dedup with bottom-k sketches of one hash function.

1. A text's set is its distinct word shingles, as 64-bit hashes; its sketch is the
   ``k`` smallest. Texts with equal sets are one class from here on.
2. Inverted lists of retained values generate candidates. Two sets that are
   similar enough share many retained values, so each class is listed only under
   its rarest ones (prefix filter); what every text holds lists nobody.
3. Lists with the same smallest member, the pivot, are one group, cut into blocks of
   bounded members and shingles. A block's sketches and the pivot's meet in one
   task. Pairs with few shared values are ruled out all at once; the k smallest
   values of the union of two sketches then estimate their similarity, and a member
   is kept if it has a likely partner. No pair is emitted.
4. The kept members' full sets, made from their texts, meet in the same way; exact
   Jaccard decides, and a task emits only a spanning forest of its links.
5. In a group of more than one block, members that are exactly linked with the
   pivot, directly or through their block, are one component already. Only the
   others still meet the members of other blocks, by steps 3 and 4 again. So a large
   group of near copies costs work in proportion to its members.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyloom.llm.common import discard, filter_parts, keyed, materialise, named, of_row, possibly, without
from rallyloom.llm.components import connected_components
from rallyloom.llm.windows import window_hashes, word_ids

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Standard deviations by which a similar pair's shared values may fall below their mean.
MARGIN = 5.5
#: Members and shingles of a block, about; a task compares two blocks at most.
BLOCK, BLOCK_SHINGLES = 512, 1 << 21
#: Shares into which the members of a large group are dealt where they meet its row.
SALTS = 64



def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a text of fewer words is one shingle."""
    ids = word_ids(text.translate(_LOWER).split())
    if not len(ids):
        return np.empty(0, np.uint64)
    if len(ids) < width:
        return window_hashes(ids, len(ids)) ^ np.uint64(len(ids))
    return np.unique(window_hashes(ids, width))


def least_shared(threshold: float, k: int) -> int:
    """Retained values that two sets at the threshold share, all but surely."""
    return max(1, math.floor(k * threshold - MARGIN * math.sqrt(k * threshold * (1 - threshold))))


def _sketches(width: int, k: int):
    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            sizes, digests, sketches = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                values = shingle_set(text.as_py() or b"", width)
                digest = hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None
                sizes.append(len(values))
                digests.append(digest)
                # Copies inside a task send their sketch once.
                sketches.append(None if digest is None or digest in seen else values[:k].tobytes())
                if len(seen) < 1_000_000:
                    seen.add(digest)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())],
                ["key", "doc_id", "text_hash", "n_shingles", "digest", "sketch"],
            )

    return run


def _packed_texts(width: int):
    """Texts whose shingles are those of their class, compressed."""

    def run(batches):
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            gids, texts = [], []
            for gid, digest, text in zip(batch.column("gid").to_pylist(), batch.column("digest").to_pylist(), batch.column("text").cast(pa.binary())):
                value = text.as_py()
                if hashlib.blake2b(shingle_set(value, width).tobytes(), digest_size=16).digest() == digest:
                    gids.append(gid)
                    texts.append(compress(value))
            yield pa.RecordBatch.from_arrays([pa.array(gids, pa.int64()), pa.array(texts, pa.binary())], ["gid", "packed"])

    return run


def _values(batches):
    for batch in batches:
        sketches = [np.frombuffer(x, np.int64) for x in batch.column("sketch").to_pylist()]
        gids = np.repeat(batch.column("gid").to_numpy(), [len(x) for x in sketches])
        yield pa.RecordBatch.from_arrays([pa.array(gids, pa.int64()), pa.array(np.concatenate(sketches) if sketches else [], pa.int64())], ["gid", "value"])


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets, from products of incidence matrices."""
    m = len(sets)
    if m == 2:
        out = np.zeros((2, 2), np.int64)
        out[0, 1] = out[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
        return out
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((m, m), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [first, first + 4096])
        part = np.zeros((m, 4096), np.float32)
        part[owner[a:b], column[a:b] - first] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _runs(batches):
    """Lists of record batches, one list for each run of equal ``pivot, i, j``."""
    held, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("pivot", "i", "j")], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            key = tuple(keys[a].tolist())
            if key != held and parts:
                yield held, parts
                parts = []
            held = key
            parts.append(batch.slice(a, b - a))
    if parts:
        yield held, parts


def _list(parts: list[pa.RecordBatch], column: str) -> list:
    return [x for p in parts for x in p.column(column).to_pylist()]


def _near_size(n: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum.outer(n, n) >= percent * np.maximum.outer(n, n)


def _union_shared(x: np.ndarray, y: np.ndarray, k: int) -> int:
    """Values that both sketches hold among the k smallest of their union."""
    both = np.union1d(x, y)[:k]
    return int(np.isin(np.intersect1d(x, y, assume_unique=True), both, assume_unique=True).sum())


def _likely(percent: int, k: int):
    """Members of each group whose similarity with another member is estimated as high enough."""
    t = percent / 100
    low, whole = least_shared(t, k), math.floor(k * t)

    def run(batches):
        for (pivot, _, _), parts in _runs(batches):
            gid, n = np.array(_list(parts, "gid")), np.array(_list(parts, "n"))
            gid, first = np.unique(gid, return_index=True)  # the pivot may be a member of the block, too
            n = n[first]
            found = _list(parts, "sketch")
            sketches = [np.frombuffer(found[i], np.uint64) for i in first]
            shared = _overlaps(sketches)
            # A set whose partners' sketches are whole too shares at least t of itself.
            must = np.where(n <= whole, -(-n * percent // 100), low)
            fits = (shared >= np.maximum.outer(must, must)) & _near_size(n, percent)
            np.fill_diagonal(fits, False)
            keep = np.zeros(len(gid), bool)
            for a in np.flatnonzero(fits.any(1)):
                for b in np.flatnonzero(fits[a]) if not keep[a] else ():
                    # Small unions are known whole; else the estimate is from k values.
                    size = min(k, n[a] + n[b] - shared[a, b]) if max(n[a], n[b]) <= k else k
                    enough = low if size == k else -(-size * percent // 100)
                    if _union_shared(sketches[a], sketches[b], k) >= enough:
                        keep[a] = keep[b] = True
                        break
            yield pa.RecordBatch.from_arrays([pa.array([pivot] * int(keep.sum()), pa.int64()), pa.array(gid[keep], pa.int64())], ["pivot", "gid"])

    return run


def _linked(width: int, percent: int):
    """Components of the exact links inside each task's members, as stars: ``pivot, a, b``."""

    def run(batches):
        expand = zstandard.ZstdDecompressor().decompress
        for (pivot, _, _), parts in _runs(batches):
            packed = dict(zip(_list(parts, "gid"), _list(parts, "packed")))
            gid = sorted(packed)
            sets = [shingle_set(expand(packed[x]), width) for x in gid]
            del packed
            n, shared = np.array([len(x) for x in sets]), _overlaps(sets)
            links = np.argwhere(np.triu(100 * shared >= percent * (np.add.outer(n, n) - shared), 1))
            parent = [*range(len(gid))]

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            for x, y in links.tolist():
                parent[root(x)] = root(y)
            # A component becomes a star: around the pivot where it is a member, else around its smallest.
            centre = {root(i): x for i, x in reversed([*enumerate(gid)])}
            if pivot in gid:
                centre[root(gid.index(pivot))] = pivot
            star = [(centre[root(i)], x) for i, x in enumerate(gid) if centre[root(i)] != x]
            yield pa.RecordBatch.from_arrays(
                [pa.array([pivot] * len(star), pa.int64()), pa.array([a for a, _ in star], pa.int64()), pa.array([b for _, b in star], pa.int64())], ["pivot", "a", "b"]
            )

    return run


def _blocks(name: str) -> Column:
    return F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias(name)


def _large(members: DataFrame) -> DataFrame:
    """``pivot, blocks`` of the groups of more than one block, stored."""
    return materialise(members.groupBy("pivot").agg(_blocks("blocks")).where("blocks > 1"), "near-large")


def _by_pivot(members: DataFrame, groups: DataFrame, how: str = "inner") -> DataFrame:
    """``members`` with the columns of ``groups`` (a row a pivot, large groups only). A group's
    members are dealt over salts, so that a hot pivot is in many tasks."""
    salted = groups.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    salt = F.pmod(F.xxhash64("gid", F.lit(1)), F.lit(SALTS))
    return members.withColumn("salt", salt).join(salted.hint("merge"), ["pivot", "salt"], how).drop("salt")


def _own(blocks: str) -> Column:
    return F.pmod(F.xxhash64("gid"), F.col(blocks))


def _upto(n: str) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)


def _within_blocks(members: DataFrame, large: DataFrame) -> DataFrame:
    """``pivot, i, j, gid, n``: every member in its own block, and the pivot in every block."""
    dealt = _by_pivot(members, large, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)).cast("bigint"))
    own = dealt.select("pivot", _own("blocks").alias("i"), _own("blocks").alias("j"), "gid", "n")
    pivots = large.select("pivot", F.explode(_upto("blocks")).alias("i"))
    every = members.where("gid = pivot").join(pivots.hint("merge"), "pivot").select("pivot", "i", F.col("i").alias("j"), "gid", "n")
    return own.unionByName(every)


def _across_blocks(members: DataFrame, large: DataFrame, linked: DataFrame) -> DataFrame:
    """``pivot, i, j, gid, n``: members that are not linked with the pivot, in blocks i of
    their own, with every block j of their group. A pair of linked members need not meet."""
    inside = _by_pivot(members, large)
    apart = materialise(inside.where("gid <> pivot").join(linked.hint("merge"), ["pivot", "gid"], "left_anti"), "near-apart")
    few = materialise(apart.groupBy("pivot").agg(_blocks("rows")), "near-apart-sizes")
    a = _by_pivot(apart, few).select("pivot", _own("rows").alias("i"), F.explode(_upto("blocks")).alias("j"), "gid", "n")
    both = large.join(few, "pivot")
    b = _by_pivot(members, both).select("pivot", F.explode(_upto("rows")).alias("i"), _own("blocks").alias("j"), "gid", "n")
    return a.unionByName(b).distinct()


def _together(dealt: DataFrame) -> DataFrame:
    return dealt.repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j", "gid")


def _lists(classes: DataFrame, percent: int, k: int) -> DataFrame:
    """``value, gid``: classes under the rarest retained values they must share with a similar one."""
    t = percent / 100
    postings = classes.select("gid", "sketch").mapInArrow(_values, "gid bigint, value bigint")
    held = postings.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = postings.join(held.hint("merge"), "value")
    ranked = shared.groupBy("gid").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("by_df"))
    must = F.when(F.col("n") <= math.floor(k * t), F.ceil(F.col("n") * F.lit(percent) / 100)).otherwise(F.lit(least_shared(t, k)))
    sized = ranked.join(classes.select("gid", "n").hint("merge"), "gid").withColumn("prefix", (F.size("by_df") - must + 1).cast("int"))
    rare = sized.where("prefix > 0").select("gid", "n", F.explode(F.slice("by_df", F.lit(1), F.col("prefix"))).alias("x"))
    return materialise(rare.select(F.col("x.value").alias("value"), "gid", "n"), "near-lists")


def _texts_of(base: DataFrame, classes: DataFrame, gids: DataFrame, width: int) -> DataFrame:
    """``gid, packed``, stored: a compressed text of each class.

    Texts are found by a hash of the text, and those that surely are not wanted stay
    where they are (a filter of fixed size). Of copies one goes on; its shingles are
    compared with the class, so that a hash that two texts share does no harm.
    """
    wanted = materialise(classes.select("gid", "digest", "text_hash").join(gids.hint("merge"), "gid", "left_semi"), "near-wanted")
    parts = materialise(filter_parts(wanted, F.col("text_hash")), "near-filter")
    possible = possibly(base.select("text_hash", "text"), F.col("text_hash"), parts)
    found = possible.join(wanted.hint("merge"), "text_hash").dropDuplicates(["gid", "text"])
    texts = found.select("gid", "digest", "text").mapInArrow(_packed_texts(width), "gid bigint, packed binary")
    return materialise(texts.dropDuplicates(["gid"]), "near-texts")


def _links(base: DataFrame, classes: DataFrame, dealt: DataFrame, width: int, percent: int, k: int) -> DataFrame:
    """``pivot, a, b``, stored: the components (stars, per task) of the exact links among members that meet in ``dealt``."""
    dealt = materialise(dealt, "near-dealt")
    sketches = _together(dealt.drop("n").join(classes.select("gid", "n", "sketch").hint("merge"), "gid"))
    likely = materialise(sketches.mapInArrow(_likely(percent, k), "pivot bigint, gid bigint").distinct(), "near-likely")
    texts = _texts_of(base, classes, likely.select("gid").distinct(), width)
    chosen = dealt.select("pivot", "i", "j", "gid").join(likely.hint("merge"), ["pivot", "gid"])
    whole = _together(chosen.join(texts.hint("merge"), "gid"))
    found = materialise(whole.mapInArrow(_linked(width, percent), "pivot bigint, a bigint, b bigint").distinct(), "near-links")
    discard(dealt, likely, texts)
    return found


def _components(base: DataFrame, width: int, percent: int, k: int) -> DataFrame:
    """``key, doc_id, n_shingles, component_id, first_key`` from rows of ``key, doc_id, text``; the keys are stored ones."""
    base = base.select("key", "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    rows = materialise(base.mapInArrow(_sketches(width, k), "key bigint, doc_id bigint, text_hash bigint, n_shingles bigint, digest binary, sketch binary"), "near-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    classes = materialise(
        rows.where("n_shingles > 0").groupBy("digest")
        .agg(first.alias("first"), F.first("n_shingles").alias("n"), F.first("text_hash").alias("text_hash"), F.first("sketch", ignorenulls=True).alias("sketch"))
        .withColumn("gid", F.monotonically_increasing_id()),
        "near-classes",
    )
    lists = _lists(classes, percent, k)
    pivots = lists.groupBy("value").agg(F.min("gid").alias("pivot"), F.count(F.lit(1)).alias("members")).where("members > 1").select("value", "pivot")
    members = materialise(lists.join(pivots.hint("merge"), "value").select("pivot", "gid", "n").distinct(), "near-members")
    large = _large(members)
    links = _links(base, classes, _within_blocks(members, large), width, percent, k)
    if not large.isEmpty():
        linked = links.where(F.col("a") == F.col("pivot")).select("pivot", F.col("b").alias("gid"))
        more = _links(base, classes, _across_blocks(members, large, linked), width, percent, k)
        links = links.unionByName(more)
    roots = connected_components(links.select("a", "b").distinct()).select(F.col("node").alias("gid"), "root")
    found = classes.select("gid", "digest", "first").join(roots.hint("merge"), "gid", "left").withColumn("root", F.coalesce("root", "gid"))
    found = materialise(found, "near-named")
    firsts = found.groupBy("root").agg(F.min("first").alias("first"))
    by_digest = found.select("root", "digest").join(firsts.hint("merge"), "root").select("digest", "first")
    discard(lists, members)
    blank = F.col("n_shingles") == 0
    return (
        rows.select("key", "doc_id", "n_shingles", "digest").join(by_digest.hint("merge"), "digest", "left")
        .select(
            "key", "doc_id", "n_shingles", F.when(blank, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
            F.when(blank, F.col("key")).otherwise(F.col("first.key")).alias("first_key"),
        )
    )


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, k: int = 64) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Rows are linked when 100 * intersection >= percent * union of their shingle
    sets; ``component_id`` is the smallest id reachable, ``kept`` whether it is the
    row's own. Texts without words link with nothing. Repeated rows are copies of
    themselves and, having one id, carry one verdict; null ids are never smallest
    unless a component has no other. Other columns of ``df`` are not looked at.
    A pair at the threshold is missed with a probability of about 1e-7 (the chance
    that its sketches share too few values).
    """
    base = df.select(F.monotonically_increasing_id().alias("key"), named(doc_id).cast("bigint").alias("doc_id"), named(text).alias("text"))
    found = _components(base, width, percent, k)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, k: int = 64) -> DataFrame:
    """The rows of ``df`` that stay, with their columns: exactly one of each component
    (the smallest id; of rows with one id any one), and every row without words."""
    stored = keyed(df, "near-input")
    found = _components(stored.select("key", of_row(doc_id).cast("bigint").alias("doc_id"), of_row(text).alias("text")), width, percent, k)
    dropped = materialise(found.where("key <> first_key").select("key"), "near-dropped")
    return without(stored.select("key", "row"), dropped).select("row.*")
