"""BPE encoding and decoding through a distinct-piece table.

Texts are split where the tokenizer surely splits too: before ASCII white space
that follows a character which is no white space. Each distinct piece meets its
copies in one bucket of the block exchange and is encoded there once; ids are
joined back to the positions of the piece in every text. Decoding joins ids with
the vocabulary's pieces (one row an id, so its size is the vocabulary's) and puts
the bytes together in order: ``decode_ids`` as a Spark join of exploded ids, and
inside a block, where a row an id would cost more than the corpus, as one look-up of
all ids of a text in the table of pieces.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyloom.llm.blocks import BLOCK_BYTES, FANOUT, Dictionary, exchange
from rallyloom.llm.common import keyed, of_row
from rallyloom.llm.prefix_bpe import byte_letters

#: Characters that some library calls white space and that are no ASCII white space.
_ODD = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
_PIECE = re.compile(r"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
_CAREFUL = re.compile(r"(?<=[^\s\x1c-\x1f\x85\xa0\u180e\u200b\ufeff])(?=[\t-\r ])")


def split_pieces(text: str) -> list[str]:
    """Pieces whose encodings, joined, are the encoding of the text."""
    return _CAREFUL.split(text) if _ODD.search(text) else _PIECE.findall(text)


@cache
def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@cache
def vocabulary_pieces(path: str) -> list[bytes]:
    """Bytes of every id."""
    tokenizer = load_tokenizer(path)
    byte_of = {letter: b for b, letter in byte_letters().items()}
    special = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    pieces = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        pieces[i] = special[i].encode() if i in special else bytes(byte_of[c] for c in token)
    return pieces


def _packed(values: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, values), np.uint32, len(values)).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(struct.pack("<I", len(values)) + sizes + b"".join(values))


def _unpacked(payload: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    (n,) = struct.unpack_from("<I", raw)
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64) + 4 + 4 * n
    starts = np.append(4 + 4 * n, ends[:-1]) if n else ends
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


class _Pieces(Dictionary):
    """Distinct pieces of a block; answers are their ids."""

    def __init__(self, path: str, with_ids: bool):
        self.path, self.with_ids = path, with_ids

    @staticmethod
    def _cut(pieces: set[bytes], cells: range, of: int) -> list[list[bytes]]:
        dealt: list[list[bytes]] = [[] for _ in cells]
        for piece in pieces:
            dealt[(xxhash.xxh3_64_intdigest(piece) * of >> 64) - cells.start].append(piece)
        return [sorted(x) for x in dealt]

    def _distinct(self, texts: list[str], cells: range, of: int) -> list[list[bytes]]:
        found: set[str] = set()
        for t in texts:
            found.update(split_pieces(t))
        return self._cut(set(map(str.encode, found)), cells, of)

    def ask(self, docs, cells, of):
        return [_packed(x) if x else b"" for x in self._distinct([t.decode() for _, t in docs], cells, of)]

    def merge(self, payloads, cells, of):
        return [_packed(x) if x else b"" for x in self._cut(set().union(*map(_unpacked, payloads)), cells, of)]

    def answer(self, payloads):
        asked = [_unpacked(p) for p in payloads]
        pieces = list(set().union(*asked))
        known: dict[bytes, bytes] = {}
        library = load_tokenizer(self.path)
        for i in range(0, len(pieces), 20_000):
            some = pieces[i : i + 20_000]
            for piece, found in zip(some, library.encode_batch_fast([x.decode() for x in some], add_special_tokens=False)):
                known[piece] = np.array(found.ids, "<u4").tobytes()
        return [_packed([known[x] for x in one]) for one in asked]

    def relay(self, payloads, merged, answers):
        known = {p: a for m, x in zip(merged, answers) if m for p, a in zip(_unpacked(m), _unpacked(x))}
        return [_packed([known[x] for x in _unpacked(p)]) for p in payloads]

    def finish(self, docs, cells, of, answers):
        rows = [(d, t.decode()) for d, t in docs]
        ids_of: dict[str, bytes] = {}
        for cell, pieces in zip(cells, self._distinct([t for _, t in rows], cells, of)):
            if pieces:
                ids_of.update(zip((p.decode() for p in pieces), _unpacked(answers[cell])))
        vocabulary = pa.array(vocabulary_pieces(self.path), pa.large_binary())
        columns: dict[str, list] = {"n": [], "ids": [], "text": [], "list": []}
        for _, t in rows:
            encoded = b"".join(map(ids_of.__getitem__, split_pieces(t)))
            ids = np.frombuffer(encoded, "<u4")
            columns["n"].append(len(ids))
            columns["ids"].append(hashlib.sha256(encoded).hexdigest())
            columns["text"].append(hashlib.sha256(_decoded(ids, vocabulary)).hexdigest())
            if self.with_ids:
                columns["list"].append(ids.astype(np.int32))
        out = {"doc_id": pa.array([d for d, _ in rows], pa.int64()), "n_tokens": pa.array(columns["n"], pa.int64()), "ids_sha256": pa.array(columns["ids"], pa.string()), "decoded_sha256": pa.array(columns["text"], pa.string())}
        if self.with_ids:
            out["ids"] = pa.array(columns["list"], pa.list_(pa.int32()))
        return pa.table(out)


def _decoded(ids: np.ndarray, vocabulary: pa.Array) -> bytes:
    """UTF-8 of the text of ids: their pieces, looked up all at once, lie one after the other in one buffer."""
    if not len(ids):
        return b""
    pieces = vocabulary.take(pa.array(ids))
    ends = np.frombuffer(pieces.buffers()[1], np.int64)
    raw = pieces.buffers()[2].to_pybytes()[ends[pieces.offset] : ends[pieces.offset + len(pieces)]]
    return raw.decode("utf-8", "replace").encode()


def encode_documents(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False, block_bytes: int = BLOCK_BYTES, fanout: int = FANOUT) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``) for every row.

    ``tokenizer`` is the path of a byte-level BPE file for the tokenizers library.
    Null counts as empty and has no tokens; ids may be null or repeat; other columns
    are not looked at; strings of special tokens inside a text are special tokens,
    as is the library's default.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return exchange(df, _Pieces(tokenizer, with_ids), schema, doc_id, text, block_bytes, fanout)


def vocabulary_table(spark: SparkSession, path: str) -> DataFrame:
    """``id, piece``: a row for every id of the vocabulary."""
    return spark.createDataFrame(pa.table({"id": pa.array(range(len(vocabulary_pieces(path))), pa.int32()), "piece": pa.array(vocabulary_pieces(path), pa.binary())}))


def decode_ids(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, text`` from rows of ids, by a join of every id with its piece.

    The vocabulary (its size is the tokenizer's, so it may be broadcast) meets the
    ids where they are; a row's pieces are put in order by position. Null ids and
    empty lists give an empty text; repeated rows stay apart.
    """
    stored = keyed(df, "decode").select("key", of_row(doc_id).cast("bigint").alias("doc_id"), of_row(ids).alias("ids"))
    tokens = stored.select("key", F.posexplode("ids").alias("at", "id"))
    pieces = tokens.join(F.broadcast(vocabulary_table(df.sparkSession, tokenizer)), "id")
    whole = pieces.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", F.hex("piece").alias("piece")))).alias("pieces"))
    raw = F.unhex(F.array_join(F.transform("pieces", lambda x: x["piece"]), ""))
    # Bytes that are no UTF-8 become replacement characters, as the library decodes them.
    texts = whole.select("key", F.make_valid_utf8(raw.cast("string")).alias("text"))
    return stored.join(texts, "key", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
