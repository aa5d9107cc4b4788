"""Token counts by prefix dynamic programming.

No token of the vocabulary spans white space, so the token count of a prefix that
ends between two words is the count at the previous word end plus the count of
one word: C[j] = C[j-1] + n(word j). A prefix that ends inside a word adds the
count of that part of the word, P[word][k], the number of tokens of its first k
code points, which ``prefix_bpe`` gets byte by byte from the counts of shorter parts.
Both tables together hold the exact count at every prefix: budgets and truncations
are look-ups in them, and no part of a text is encoded for one. ``prefix_counts``
stores them in one column.

Each distinct word is given to the library once per worker; afterwards texts
cost one dictionary look-up a word. Nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyloom.llm.common import named
from rallyloom.llm.prefix_bpe import Merges, prefix_counts_of_word

#: Words a worker remembers before it starts afresh.
REMEMBERED = 1_500_000


@cache
def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class PrefixTable:
    """Exact token counts of the prefixes of texts, for one vocabulary."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.merges = Merges(path)
        self.words: dict[bytes, int] = {}
        self.parts: dict[bytes, np.ndarray] = {}
        self.held = 0

    def _learn(self, words: list[bytes]) -> None:
        fresh = [w for w in set(words) if w not in self.words]
        if len(self.words) + len(fresh) > REMEMBERED:
            self.words.clear()
            fresh = list(set(words))
        for i in range(0, len(fresh), 20_000):
            some = fresh[i : i + 20_000]
            found = self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
            self.words.update(zip(some, map(len, found)))

    def word_counts(self, words: list[bytes]) -> list[int]:
        try:
            return [*map(self.words.__getitem__, words)]
        except KeyError:
            self._learn(words)
            return [*map(self.words.__getitem__, words)]

    def inside(self, word: bytes) -> np.ndarray:
        """P[word]: token counts of its first 0, 1, 2, ... code points."""
        found = self.parts.get(word)
        if found is None:
            text = word.decode()
            found = np.array(prefix_counts_of_word(self.merges, text), np.int32)
            if found[-1] != self.word_counts([word])[0]:
                found = self._by_library(text)
            if self.held + len(found) > REMEMBERED:
                self.parts.clear()
                self.held = 0
            self.parts[word] = found
            self.held += len(found)
        return found

    def _by_library(self, word: str) -> np.ndarray:
        """For words with characters that the library's Unicode tables hold otherwise:
        every prefix encoded, a megabyte of them at a time."""
        out, step = [0], max(1, (1 << 20) // len(word))
        for a in range(1, len(word) + 1, step):
            some = [word[:k] for k in range(a, min(a + step, len(word) + 1))]
            out += map(len, self.tokenizer.encode_batch_fast(some, add_special_tokens=False))
        return np.array(out, np.int32)

    def ends(self, text: bytes) -> tuple[list[bytes], list[int]]:
        """Words, and C: the token count at the end of each."""
        words = text.split()
        return words, [*accumulate(self.word_counts(words))]

    def every_prefix(self, text: bytes) -> np.ndarray:
        """Token count at every prefix, by code points: len(text) + 1 numbers."""
        out, done, at = [np.zeros(1, np.int32)], 0, 0
        for w in text.split():
            start = text.index(w, at)
            inside = self.inside(w)
            out += [np.full(start - at, done, np.int32), inside[1:] + np.int32(done)]
            done, at = done + int(inside[-1]), start + len(w)
        out.append(np.full(len(text) - at, done, np.int32))
        return np.concatenate(out)

    def fits(self, text: bytes, words: list[bytes], counts: list[int], limit: int) -> int:
        """Code points of the longest prefix with at most ``limit`` tokens."""
        if not counts or counts[-1] <= limit:
            return len(text.decode())
        j = bisect_right(counts, limit)  # the first word end over the limit
        at = 0
        for w in words[:j]:
            at = text.index(w, at) + len(w)
        start = text.index(words[j], at)
        left = limit - (counts[j - 1] if j else 0)
        # Counts inside a word can fall again (merges); the longest part that fits counts.
        return len(text[:start].decode()) + int(np.flatnonzero(self.inside(words[j]) <= left)[-1])


@cache
def prefix_table(path: str) -> PrefixTable:
    return PrefixTable(path)


def count_tokens(df: DataFrame, tokenizer: str, limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, fit_chars`` for every row.

    ``tokenizer`` is the path of a tokenizers file of the kind of ``prefix_bpe``, whose
    pre-tokeniser drops white space. ``n_tokens`` is the last entry of the text's
    prefix counts, ``fit_chars`` the last prefix, in code points, whose entry is
    within the limit. Null counts as empty (no tokens); ids may be null or repeat, rows
    stand alone; other columns are not looked at.
    """

    def run(batches):
        table = prefix_table(tokenizer)
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            totals, fits = [], []
            for t in texts:
                words, counts = table.ends(t)
                totals.append(counts[-1] if counts else 0)
                fits.append(table.fits(t, words, counts, limit))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(totals, pa.int64()), pa.array([n > limit for n in totals], pa.bool_()), pa.array(fits, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    base = df.select(named(doc_id).cast("bigint").alias("doc_id"), named(text).alias("text"))
    return base.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint")


def prefix_counts(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, counts``: the exact token count of every prefix, by code points from 0 to the whole text.

    Stored once, it answers every later budget question by ``tokens_at`` and
    ``longest_fit``, without the text or the tokenizer.
    """

    def run(batches):
        table = prefix_table(tokenizer)
        for batch in batches:
            every = [table.every_prefix(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(every, pa.list_(pa.int32()))], ["doc_id", "counts"])

    base = df.select(named(doc_id).cast("bigint").alias("doc_id"), named(text).alias("text"))
    return base.mapInArrow(run, "doc_id bigint, counts array<int>")


def tokens_at(counts: Column, chars: Column | int) -> Column:
    """Tokens of the first ``chars`` code points; null beyond the text."""
    return F.get(counts, F.lit(chars) if isinstance(chars, int) else chars)


def longest_fit(counts: Column, limit: int) -> Column:
    """Code points of the longest prefix with at most ``limit`` tokens."""
    back = F.transform(F.reverse(counts), lambda n: n <= limit)
    return F.size(counts).cast("bigint") - F.array_position(back, F.lit(True))
