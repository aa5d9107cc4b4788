"""A corpus pipeline over ``documents``: every stage works on what the one before kept.

A stage takes ``(spark, docs, sf_dir)`` and returns rows; ``run`` writes them as
Parquet and gives them, read again, to the next. All but the last stage return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rallyloom.llm.bpe import encode_documents
from rallyloom.llm.common import discard, materialise, reads, recording
from rallyloom.llm.exact_dedup import drop_duplicates
from rallyloom.llm.mixing import take_mix
from rallyloom.llm.near_dedup import drop_near_duplicates
from rallyloom.llm.quality_rules import keep_good
from rallyloom.llm.queries import tokenizer_path


#: By input: stored tables of the stage before.
_left: dict[str, list[DataFrame]] = {}


def _stage(operator: Callable[[DataFrame], DataFrame], docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the stage before has stored goes first, if ``docs`` are a table made of its rows;
    if they are its rows themselves, it goes when this operator, which stores its input, is done."""
    before = _left.pop(sf_dir, [])
    later = before if reads(docs, before) else []
    discard(*(() if later else before))
    with recording() as made:
        out = operator(docs)
    discard(*later)
    _left[sf_dir] = made
    return out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and whose host passes."""
    return _stage(keep_good, docs, sf_dir)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return _stage(drop_duplicates, docs, sf_dir)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five words, 0.8)."""
    return _stage(drop_near_duplicates, docs, sf_dir)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return _stage(take_mix, docs, sf_dir)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of what they decode to."""
    return encode_documents(docs, tokenizer_path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("near dedup", near),
    ("source mixing", mix),
    ("bpe encoding", encode),
]

#: SQL can't express the encoding; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    discard(*_left.pop(sf_dir, ()))
    return STAGES[-1][1](spark, docs, sf_dir)
