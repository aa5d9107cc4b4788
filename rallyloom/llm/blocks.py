"""A distributed dictionary over blocks of documents.

Many corpus questions need, for every word, window or n-gram of a text, one fact
about the whole corpus. One row a question would move the corpus several times.
Here documents are dealt into blocks by a hash; a block sends each of its distinct
keys once (``ask``), keys meet in buckets, which are ranges of key hashes
(``answer``), and the answers come back to the block (``finish``).

Blocks and buckets both grow in number, not in size, with the corpus. So that the
payloads do not grow with blocks times buckets, keys go to their bucket by radix
exchange: a task cuts its keys into at most ``FANOUT`` ranges and sends the ranges
that are not empty; the ranges of a group of ``FANOUT`` blocks are merged, cut
again, and so on, and answers return the same way. Each of the levels, as many as
the logarithm of the number of blocks to the base ``FANOUT`` (one to 4 GB of text,
two to 2 TB, three to 1 PB), makes at most ``FANOUT`` rows a block: rows follow the
input.

A block's keys are a sorted function of the rows in it, so a block that is made
again after a lost executor asks the same questions in the same order. A key that
fills a third of the corpus is asked at most once a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyloom.llm.common import named, text_bytes

#: UTF-8 bytes of text in a block, on average.
BLOCK_BYTES = 8 << 20
#: Text that a packing task gathers before it sends what it has to the blocks.
PACK_BYTES = 16 << 20
#: Ranges into which a task cuts its keys, at most.
FANOUT = 512

Docs = Iterator[tuple[int | None, bytes]]
SHAPE = "m bigint, cell bigint, payload binary"


class Dictionary:
    """What an operator asks. Payloads are bytes; an empty one is not sent.

    ``cells`` are equal ranges of 64-bit key hashes: cell c of n begins at c * 2**64 // n.
    """

    def ask(self, docs: Docs, cells: range, of: int) -> list[bytes]:
        """A payload of sorted distinct keys for each of ``cells``."""
        raise NotImplementedError

    def merge(self, payloads: list[bytes], cells: range, of: int) -> list[bytes]:
        """One payload a cell for the keys of several blocks."""
        raise NotImplementedError

    def answer(self, payloads: list[bytes]) -> list[bytes]:
        """All there is of a bucket: an answer for each payload, in the order of its keys."""
        raise NotImplementedError

    def relay(self, payloads: list[bytes], merged: list[bytes], answers: list[bytes]) -> list[bytes]:
        """Answers for the payloads, from the answers to what ``merge`` made of them."""
        raise NotImplementedError

    def finish(self, docs: Docs, cells: range, of: int, answers: dict[int, bytes]) -> pa.Table:
        """Result rows of a block; ``answers`` has the cells that ``ask`` sent something to."""
        raise NotImplementedError


def _pack(batches):
    """Rows of a block, packed; equal rows are packed once, with their number."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.large_binary()), ("n", pa.int64())])
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))

    def flush(rows: dict[int, dict]):
        out = []
        for block, held in rows.items():
            sink = pa.BufferOutputStream()
            ids, texts = zip(*held)
            with pa.ipc.new_stream(sink, schema, options=options) as writer:
                writer.write_batch(pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.large_binary()), pa.array(held.values(), pa.int64())], schema=schema))
            out.append((block, sink.getvalue().to_pybytes()))
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([p for _, p in out], pa.binary())], ["block", "packed"])

    rows: dict[int, dict] = {}
    size = 0
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for doc, block, text in zip(batch.column("doc_id").to_pylist(), batch.column("block").to_pylist(), texts):
            value = text.as_py() or b""
            held = rows.setdefault(block, {})
            if (doc, value) not in held:
                size += len(value)
            held[doc, value] = held.get((doc, value), 0) + 1
            if size >= PACK_BYTES:
                yield flush(rows)
                rows, size = {}, 0
    if rows:
        yield flush(rows)


def _unpack(table: pa.Table) -> Docs:
    for packed in table.column("packed"):
        with pa.ipc.open_stream(packed.as_buffer()) as reader:
            for batch in reader:
                for doc, text, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                    value = text.as_py()
                    for _ in range(n):
                        yield doc, value


def _payloads(table: pa.Table) -> list[bytes]:
    return [x.as_py() for x in table.column("payload")]


def _rows(m: list[int], cells: list[int], payloads: list[bytes]) -> pa.Table:
    kept = [i for i, p in enumerate(payloads) if p]
    pick = lambda x: [x[i] for i in kept]
    return pa.table({"m": pa.array(pick(m), pa.int64()), "cell": pa.array(pick(cells), pa.int64()), "payload": pa.array(pick(payloads), pa.binary())})


def levels_of(blocks: int, fanout: int) -> tuple[int, int]:
    """Levels of the radix exchange, and the ranges that a task cuts its keys into at each."""
    levels = 1
    while fanout**levels < blocks:
        levels += 1
    cut = max(1, math.ceil(blocks ** (1 / levels) - 1e-9))
    return levels, cut


def _resolve(asks: DataFrame, words: Dictionary, cut: int, level: int, levels: int) -> DataFrame:
    """Answers ``m, cell, payload`` to asks of that shape: cells of ``cut ** level``, members m of a cell's parent."""
    of = cut ** (level + 1)

    def answered(table: pa.Table) -> pa.Table:
        return table.set_column(table.schema.get_field_index("payload"), "payload", pa.array(words.answer(_payloads(table)), pa.binary()))

    def finer(cell: int) -> range:
        return range(cell * cut, (cell + 1) * cut)

    def merged(key, table):
        cells = finer(key[0].as_py())
        return _rows([key[1].as_py()] * cut, [*cells], words.merge(_payloads(table.sort_by("m")), cells, of))

    def relayed(key, table, answers):
        table, cells = table.select(["m", "cell", "payload"]).sort_by("m"), finer(key[0].as_py())
        payloads = _payloads(table)
        found = dict(zip(answers.column("cell").to_pylist(), _payloads(answers)))
        back = words.relay(payloads, words.merge(payloads, cells, of), [found.get(c, b"") for c in cells])
        return table.set_column(table.schema.get_field_index("payload"), "payload", pa.array(back, pa.binary()))

    if level == levels:
        return asks.groupBy("cell").applyInArrow(answered, SHAPE)
    grouped = asks.select("m", "cell", "payload", F.floor(F.col("m") / cut).cast("bigint").alias("g")).groupBy("cell", "g")
    following = _resolve(grouped.applyInArrow(merged, SHAPE), words, cut, level + 1, levels)
    # A finer ask's member is the group that made it, its cell's parent the cell of the group.
    back = following.select("m", "cell", "payload", F.floor(F.col("cell") / cut).cast("bigint").alias("parent")).groupBy("parent", "m")
    return grouped.cogroup(back).applyInArrow(relayed, SHAPE)


def asks_of(df: DataFrame, words: Dictionary, doc_id: str, text: str, block_bytes: int, fanout: int) -> tuple[DataFrame, DataFrame, int, int]:
    """Packed blocks, their asks at the first level, levels, and the ranges of a cut."""
    base = df.select(named(doc_id).cast("bigint").alias("doc_id"), F.coalesce(named(text), F.lit("")).alias("text"))
    blocks = max(1, math.ceil(text_bytes(base, "text") / block_bytes))
    levels, cut = levels_of(blocks, fanout)
    # By id and text: null or repeated ids spread over blocks, as do copies with ids of their own.
    dealt = base.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("bigint"))
    packed = dealt.mapInArrow(_pack, "block bigint, packed binary")

    def asked(key, table):
        return _rows([key[0].as_py()] * cut, [*range(cut)], words.ask(_unpack(table), range(cut), cut))

    return packed, packed.groupBy("block").applyInArrow(asked, SHAPE), levels, cut


def exchange(df: DataFrame, words: Dictionary, out_schema: str, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Result rows of ``words.finish`` for all rows of ``df``."""
    packed, asks, levels, cut = asks_of(df, words, doc_id, text, block_bytes, fanout)
    answers = _resolve(asks, words, cut, 1, levels)

    def finished(left: pa.Table, right: pa.Table) -> pa.Table:
        found = dict(zip(right.column("cell").to_pylist(), _payloads(right)))
        return words.finish(_unpack(left), range(cut), cut, found)

    return packed.groupBy("block").cogroup(answers.groupBy("m")).applyInArrow(finished, out_schema)


def cuts_of(sorted_hashes: np.ndarray, cells: range, of: int) -> list[int]:
    """Where the part of each cell begins in sorted hashes, and where the last ends."""
    edges = [(c << 64) // of for c in (*cells, cells.stop)]
    inner = np.searchsorted(sorted_hashes, np.array(edges[:-1], np.uint64))
    last = len(sorted_hashes) if edges[-1] >> 64 else np.searchsorted(sorted_hashes, np.uint64(edges[-1]))
    return [*inner.tolist(), int(last)]


def _narrow(values: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest needs: a byte for that, then the bytes."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    raw = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + raw.tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, : raw[0]] = np.frombuffer(raw, np.uint8, n * raw[0], 1).reshape(n, raw[0])
    return out.view("<u8").reshape(n)


def pack_numbers(values: np.ndarray) -> bytes:
    """Small numbers, mostly equal ones."""
    return len(values).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(_narrow(values))


def unpack_numbers(raw: bytes) -> np.ndarray:
    return _wide(zstandard.ZstdDecompressor().decompress(raw[4:]), int.from_bytes(raw[:4], "little"))


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted distinct hashes, as the gaps between them. Low bytes of gaps are noise and stay
    as they are; the highest bytes are mostly small and are compressed."""
    if not len(keys):
        return b""
    gaps = np.diff(keys, prepend=np.uint64(0))
    gaps[0] = 0  # the first hash is stored whole
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(gaps, "<u8").view(np.uint8).reshape(-1, 8)
    low, high = planes[:, : width - 1].tobytes(), zstandard.ZstdCompressor(level=1).compress(planes[:, width - 1].tobytes())
    return len(keys).to_bytes(4, "little") + bytes([width]) + int(keys[0]).to_bytes(8, "little") + low + high


def unpack_sorted(raw: bytes) -> np.ndarray:
    if not raw:
        return np.empty(0, np.uint64)
    n, width = int.from_bytes(raw[:4], "little"), raw[4]
    planes = np.zeros((n, 8), np.uint8)
    at = 13 + n * (width - 1)
    planes[:, : width - 1] = np.frombuffer(raw, np.uint8, n * (width - 1), 13).reshape(n, width - 1)
    planes[:, width - 1] = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[at:]), np.uint8)
    gaps = planes.view("<u8").reshape(n)
    gaps[0] = int.from_bytes(raw[5:13], "little")
    return np.cumsum(gaps, dtype=np.uint64)


def joined(parts: list[bytes]) -> bytes:
    """Several payloads as one."""
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def parted(raw: bytes) -> list[bytes]:
    at, out = 0, []
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 4], "little")
        out.append(raw[at + 4 : at + 4 + n])
        at += 4 + n
    return out


class HashCounts(Dictionary):
    """How often hashed keys occur in all blocks. An operator says what a block's keys are.

    A payload holds, for each of ``kinds`` tables, sorted hashes and their counts.
    """

    kinds = 1

    def tables(self, docs: Docs) -> list[tuple[np.ndarray, np.ndarray]]:
        """Sorted distinct hashes and counts, by kind."""
        raise NotImplementedError

    def ask(self, docs: Docs, cells: range, of: int) -> list[bytes]:
        return self._cut(self.tables(docs), cells, of)

    @staticmethod
    def _cut(tables: list[tuple[np.ndarray, np.ndarray]], cells: range, of: int) -> list[bytes]:
        cuts = [cuts_of(keys, cells, of) for keys, _ in tables]
        out = []
        for i in range(len(cells)):
            parts = [p for (keys, counts), c in zip(tables, cuts) for p in (pack_sorted(keys[c[i] : c[i + 1]]), pack_numbers(counts[c[i] : c[i + 1]]))]
            out.append(joined(parts) if any(c[i] < c[i + 1] for c in cuts) else b"")
        return out

    @staticmethod
    def _read(payload: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
        parts = parted(payload)
        return [(unpack_sorted(k), unpack_numbers(c)) for k, c in zip(parts[::2], parts[1::2])]

    def _sums(self, asked: list[list[tuple[np.ndarray, np.ndarray]]], kind: int) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.concatenate([a[kind][0] for a in asked]), np.concatenate([a[kind][1] for a in asked])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
        return keys[first], np.add.reduceat(counts[order], np.flatnonzero(first)) if len(keys) else counts

    def merge(self, payloads: list[bytes], cells: range, of: int) -> list[bytes]:
        asked = [self._read(p) for p in payloads]
        return self._cut([self._sums(asked, k) for k in range(self.kinds)], cells, of)

    def _reply(self, asked: list[list[tuple[np.ndarray, np.ndarray]]], tables: list[tuple[np.ndarray, np.ndarray]]) -> list[bytes]:
        return [joined([pack_numbers(sums[np.searchsorted(keys, a[k][0])]) for k, (keys, sums) in enumerate(tables)]) for a in asked]

    def answer(self, payloads: list[bytes]) -> list[bytes]:
        asked = [self._read(p) for p in payloads]
        return self._reply(asked, [self._sums(asked, k) for k in range(self.kinds)])

    def relay(self, payloads: list[bytes], merged: list[bytes], answers: list[bytes]) -> list[bytes]:
        pairs = [(self._read(m), [unpack_numbers(x) for x in parted(a)]) for m, a in zip(merged, answers) if m]
        tables = [(np.concatenate([m[k][0] for m, _ in pairs]), np.concatenate([a[k] for _, a in pairs])) for k in range(self.kinds)]
        return self._reply([self._read(p) for p in payloads], tables)

    def totals(self, answers: dict[int, bytes]) -> list[np.ndarray]:
        """The answers of all cells, by kind, in the order of the block's keys."""
        found = [[unpack_numbers(x) for x in parted(answers[c])] for c in sorted(answers)]
        return [np.concatenate([f[k] for f in found]).astype(np.int64) if found else np.empty(0, np.int64) for k in range(self.kinds)]
