"""Substring dedup: word windows that occur more than once in the corpus are removed.

Rabin-Karp hashes of every window are counted through the block exchange: a block
sends each distinct window hash once with its count, a bucket sums them, and the
block looks its windows up. Repeated windows merge into maximal intervals of words.
Judgement is on the input, so no copy is spared for being the first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rallyloom.llm.blocks import BLOCK_BYTES, FANOUT, HashCounts, exchange
from rallyloom.llm.windows import BlockWords, counted

#: A count above this says no more than this.
MANY = 2


class _Windows(HashCounts):
    def __init__(self, width: int, with_text: bool):
        self.width, self.with_text = width, with_text

    def tables(self, docs):
        keys, _, counts = counted(BlockWords(docs).windows(self.width)[1])
        return [(keys, np.minimum(counts, MANY))]

    def _sums(self, asked, kind):
        keys, counts = super()._sums(asked, kind)
        return keys, np.minimum(counts, MANY)

    def finish(self, docs, cells, of, answers):
        block = BlockWords(docs, keep=True)
        starts, hashes = block.windows(self.width)
        _, back, _ = counted(hashes)
        often = self.totals(answers)[0] >= MANY
        edges = np.zeros(len(block.ids) + 1, np.int64)  # windows do not cross documents, so neither do intervals
        begin = starts[often[back]] if len(back) else starts
        np.add.at(edges, begin, 1)
        np.add.at(edges, begin + self.width, -1)
        covered = np.cumsum(edges)[:-1] > 0
        rows: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "spans": []}
        texts = []
        for i, (a, b) in enumerate(zip(block.starts[:-1].tolist(), block.starts[1:].tolist())):
            own, cut = block.words[i], covered[a:b]
            ends = np.flatnonzero(np.diff(np.concatenate([[0], cut.view(np.int8), [0]]))).reshape(-1, 2).tolist()
            kept, last = [], 0
            for x, y in ends:
                kept += own[last:x]
                last = y
            whole = b" ".join(kept + own[last:])
            rows["n_words"].append(b - a)
            rows["n_removed"].append(int(cut.sum()))
            rows["kept_sha256"].append(hashlib.sha256(whole).hexdigest())
            rows["spans"].append([{"start": x, "end": y} for x, y in ends])
            if self.with_text:
                texts.append(whole)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = {"doc_id": pa.array(block.docs, pa.int64()), "n_words": pa.array(rows["n_words"], pa.int64()), "n_removed": pa.array(rows["n_removed"], pa.int64()), "kept_sha256": pa.array(rows["kept_sha256"], pa.string()), "spans": pa.array(rows["spans"], span)}
        if self.with_text:
            columns["kept_text"] = pa.array([x.decode() for x in texts], pa.string())
        return pa.table(columns)


def remove_repeats(df: DataFrame, width: int = 35, doc_id: str = "doc_id", text: str = "text", with_text: bool = False, block_bytes: int = BLOCK_BYTES, fanout: int = FANOUT) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, spans`` (and ``kept_text``) for every row.

    ``spans`` are the removed word intervals [start, end). Null and blank texts and
    texts under ``width`` words lose nothing; a repeated row repeats its windows;
    ids may be null; other columns are not looked at. Windows are compared by 64-bit
    hashes: n windows are expected to hold n*n / 2**65 pairs that only look equal.
    """
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"
    return exchange(df, _Windows(width, with_text), schema + (", kept_text string" if with_text else ""), doc_id, text, block_bytes, fanout)
