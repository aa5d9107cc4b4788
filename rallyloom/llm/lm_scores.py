"""Stupid-backoff language-model scores, each document against the rest of the corpus.

N-gram count tables are partitioned by n-gram hash: a block of documents sends its
distinct n-grams with their counts, a bucket of the table sums them over all
blocks, and the sums are joined back to the block's n-grams, scored and summed per
document. A document's own counts are taken off first, so a text cannot vouch for
itself and n-grams of its own back off.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyloom.llm.blocks import BLOCK_BYTES, FANOUT, HashCounts, exchange
from rallyloom.llm.common import named
from rallyloom.llm.windows import BlockWords, counted

#: Fixed value: what a score is multiplied by for each step down to a shorter n-gram.
BACKOFF = 0.4

class _Grams(HashCounts):
    def __init__(self, order: int, backoff: float, total: int):
        self.kinds, self.backoff, self.total = order, backoff, total

    def tables(self, docs):
        block = BlockWords(docs)
        return [counted(block.windows(k)[1])[::2] for k in range(1, self.kinds + 1)]

    def _elsewhere(self, block: BlockWords, k: int, sums: np.ndarray) -> np.ndarray:
        """Of each word, how often other documents hold the k-gram that ends with it; 0 where none does."""
        first, hashes = block.windows(k)
        keys, back, _ = counted(hashes)
        _, mine, own = counted(block.owner[first] * max(1, len(keys)) + back)
        out = np.zeros(len(block.ids), np.int64)
        out[first + k - 1] = sums[back] - own[mine]
        return out

    def finish(self, docs, cells, of, answers):
        block = BlockWords(docs)
        n = len(block.ids)
        rest = np.repeat(self.total - block.lengths, block.lengths)
        score, used = np.empty(0), np.ones(n, np.int64)
        shorter = None
        for k, sums in enumerate(self.totals(answers), 1):
            found = self._elsewhere(block, k, sums)
            if k == 1:
                score = np.where(found > 0, found, 0.5) / (rest + 0.5)
            else:
                whole = block.place >= k - 1
                # c(context): the shorter gram that ends one word earlier. A text's last
                # word is no context, but it is taken off with the text's own counts.
                context = np.roll(shorter, 1)
                seen = whole & (found > 0)
                score = np.where(seen, found / np.maximum(context, 1), np.where(whole, self.backoff * score, score))
                used[seen] = k
            shorter = found
        backed = used < np.minimum(block.place + 1, self.kinds)
        per_doc = lambda x: np.bincount(block.owner, x, len(block.docs)) if n else np.zeros(len(block.docs))
        log_prob = per_doc(np.log(score))
        mean = pa.array(log_prob / np.maximum(block.lengths, 1), pa.float64(), mask=block.lengths == 0)
        return pa.table(
            {
                "doc_id": pa.array(block.docs, pa.int64()), "n_words": pa.array(block.lengths, pa.int64()),
                "n_backoff": pa.array(np.rint(per_doc(backed)).astype(np.int64)), "log_prob": pa.array(log_prob, pa.float64()), "mean_log_prob": mean,
            }
        )


def corpus_words(df: DataFrame, text: str = "text") -> int:
    """Words of all texts."""

    def run(batches):
        for batch in batches:
            n = sum(len(t.split()) for t in batch.column("text").cast(pa.binary()).to_pylist() if t)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return int(df.select(named(text).alias("text")).mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"])


def score_documents(df: DataFrame, order: int = 3, backoff: float = BACKOFF, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, fanout: int = FANOUT) -> DataFrame:
    """``doc_id, n_words, n_backoff, log_prob, mean_log_prob`` for every row.

    S(w | context) is c(context w) / c(context) if that n-gram occurs in other
    rows, else ``backoff`` times the score with a context one word shorter; words
    that no other row holds get half a count. Contexts do not cross documents.
    ``n_backoff`` counts words scored with a shorter n-gram than their place allows.
    Logarithms are natural. Null and blank texts have no words, log_prob 0 and a
    null mean; repeated rows count as different documents; ids may be null; other
    columns are not looked at.
    """
    schema = "doc_id bigint, n_words bigint, n_backoff bigint, log_prob double, mean_log_prob double"
    return exchange(df, _Grams(order, backoff, corpus_words(df, text)), schema, doc_id, text, block_bytes, fanout)
