"""The radix exchange under op4, op5 and op9: rows follow the input, levels and buckets change no result."""

import random

import numpy as np
import pytest

from rallyloom.llm import blocks, lm_scores
from rallyloom.llm.substring_dedup import _Windows


def texts(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60)), "x") for i in range(n)]


def test_rows_follow_the_input(spark):
    """Twice the documents make twice the rows, at one level and at more."""
    for fanout, level in ((64, 1), (4, 2)):
        found = []
        for n in (150, 300):
            df = spark.createDataFrame(texts(n), "doc_id bigint, text string, m string")
            _, asks, levels, cut = blocks.asks_of(df, _Windows(5, False), "doc_id", "text", 8_000, fanout)
            assert levels >= level and cut <= fanout
            found.append(asks.count() / cut)
        assert found[1] <= 2.2 * found[0]


def test_levels():
    assert blocks.levels_of(1, 512) == (1, 1) and blocks.levels_of(512, 512) == (1, 512)
    levels, cut = blocks.levels_of(12_500_000, 512)
    assert levels == 3 and cut <= 512 and cut**levels >= 12_500_000


def test_numbers_survive():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 64, 1000, np.uint64))
    for x in (keys, keys[:0], keys[-1:], np.array([0, 2**64 - 1], np.uint64)):
        assert (blocks.unpack_sorted(blocks.pack_sorted(x)) == x).all() and len(blocks.unpack_sorted(blocks.pack_sorted(x))) == len(x)
        assert (blocks.unpack_numbers(blocks.pack_numbers(x)) == x).all()
    assert blocks.cuts_of(keys, range(4), 4)[0] == 0 and blocks.cuts_of(keys, range(4), 4)[-1] == len(keys)


@pytest.mark.parametrize("block,fanout", [(200, 512), (50, 512), (50, 3)])
def test_scores_do_not_depend_on_the_number_of_buckets(spark, block, fanout):
    """Far more buckets than distinct words."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(30))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    one = {r.doc_id: r for r in lm_scores.score_documents(df).collect()}
    for r in lm_scores.score_documents(df, block_bytes=block, fanout=fanout).collect():
        assert abs(r.log_prob - one[r.doc_id].log_prob) < 1e-9 and r.n_backoff == one[r.doc_id].n_backoff


def test_equal_rows_are_packed_once(spark):
    """A third of all rows are one row: their block holds it once, results hold them all."""
    rows = texts(40) + [(None, "the same words again", "y")] * 20
    df = spark.createDataFrame(rows, "doc_id bigint, text string, m string").coalesce(1)
    packed, _, _, _ = blocks.asks_of(df, _Windows(3, False), "doc_id", "text", 1000, 512)
    assert packed.count() <= 41
    assert lm_scores.score_documents(df, block_bytes=1000).where("doc_id is null").count() == 20
