"""Blocks of whole texts in NumPy, and the question-and-answer exchange between blocks and hash shards.

A block is a run of rows of one scan partition, closed once its texts reach a number of bytes. A block sends each
shard the sorted distinct keys that fall to it, packed into one binary row; the shard joins them with those of all
other blocks and answers in the same order, so an answer needs no keys. Blocks are named by scan partition and
position, and rows of a scan come in a fixed order, so a later pass over the same scan finds the same blocks; each
carries a digest of its rows, and a mismatch is an error.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut

BLOCK_BYTES = 4 << 20
with contextlib.suppress(OSError, AttributeError):  # large arrays go back to the system when freed, so idle workers stay small
    ctypes.CDLL(None).mallopt(-3, 1 << 18)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@dataclass
class Block:
    no: int
    ids: pa.Array
    data: np.ndarray  # uint8, followed by 64 zero bytes
    offsets: np.ndarray  # int64, one more than rows

    @property
    def size(self) -> int:
        return int(self.offsets[-1])

    def pack(self) -> bytes:
        """The rows, to be read by unpack()."""
        sink = pa.BufferOutputStream()
        text = pa.Array.from_buffers(pa.large_binary(), len(self.ids), [None, pa.py_buffer(self.offsets), pa.py_buffer(self.data[: self.size])])
        batch = pa.record_batch([self.ids, text], names=["doc_id", "text"])
        with pa.ipc.new_stream(sink, batch.schema) as writer:
            writer.write_batch(batch)
        return squeeze(sink.getvalue(), 3)


def _block(no: int, ids: list[pa.Array], texts: list[pa.Array]) -> Block:
    lengths = np.concatenate([np.diff(_offsets(t)) for t in texts])
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    data = np.zeros(int(offsets[-1]) + 64, np.uint8)
    at = 0
    for t in texts:
        o = _offsets(t)
        part = np.frombuffer(t.buffers()[2], np.uint8)[o[0] : o[-1]] if t.buffers()[2] is not None else np.zeros(0, np.uint8)
        data[at : at + len(part)] = part
        at += len(part)
    return Block(no, pa.concat_arrays(ids), data, offsets)


def _offsets(text: pa.Array) -> np.ndarray:
    return np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)


def unpack(no: int, blob: bytes) -> Block:
    batch = next(iter(pa.ipc.open_stream(spread(blob))))
    return _block(no, [batch.column(0)], [batch.column(1)])


def read_blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK_BYTES) -> Iterator[Block]:
    """batches of (doc_id, text as binary); a null text is an empty one."""
    first, ids, texts, held = TaskContext.get().partitionId() << 24, [], [], 0
    for batch in batches:
        text = batch.column(1).cast(pa.large_binary()).fill_null(b"")
        ends, at = np.cumsum(np.diff(_offsets(text))), 0
        while at < len(text):
            before = int(ends[at - 1]) if at else 0
            upto = min(int(np.searchsorted(ends, before + size - held)) + 1, len(text))  # the row that fills the block is its last
            ids.append(batch.column(0).slice(at, upto - at))
            texts.append(text.slice(at, upto - at))
            held, at = held + int(ends[upto - 1]) - before, upto
            if held >= size:
                block = _block(first, ids, texts)
                first, ids, texts, held = first + 1, [], [], 0
                yield block
                del block
                pa.default_memory_pool().release_unused()
    if ids:
        yield _block(first, ids, texts)


def steady(docs: DataFrame) -> DataFrame:
    """docs, written first unless it is a plain scan of files: its partitions then hold the same rows in each pass."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    todo, plain = [plan], plan.deterministic()
    while todo and plain:
        node = todo.pop()
        plain = node.nodeName() in ("Project", "Filter", "LogicalRelation") or node.nodeName().startswith("Relation")
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return docs if plain else cut(docs, "steady")


def scan(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"))


def squeeze(data, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def spread(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def key_bits(shards: int) -> int:
    """Bits of a key beside its shard's number; shard and key tell almost all of a 64-bit hash apart once there are 65,536 shards."""
    return min(48, 64 - (shards - 1).bit_length())


def place(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shard in the high bits, key in the low key_bits(shards)."""
    bits = key_bits(shards)
    return (((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)) << np.uint64(bits)) | (hashes & np.uint64((1 << bits) - 1))


def cuts(placed: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard begins in sorted placed keys."""
    return np.append(np.searchsorted(placed, np.arange(shards, dtype=np.uint64) << np.uint64(key_bits(shards))), len(placed))


def pack_keys(placed: np.ndarray, shards: int) -> bytes:
    """Sorted keys of one shard as their differences, byte by byte: the high bytes are mostly zero and shrink to nothing."""
    steps = np.diff(placed & np.uint64((1 << key_bits(shards)) - 1), prepend=np.uint64(0))
    return squeeze(np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes())


def unpack_keys(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(spread(blob), np.uint8).reshape(6, -1)
    full = np.zeros((planes.shape[1], 8), np.uint8)
    full[:, :6] = planes.T
    return np.cumsum(full.view("<u8").ravel(), dtype=np.uint64)


def numbers(values: np.ndarray) -> bytes:
    return squeeze(np.ascontiguousarray(values).tobytes())


def packed_blocks(docs: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """(block, shard = -1, keys = the packed rows, extra): the blocks themselves, for a later pass."""

    def run(batches):
        for b in read_blocks(batches, size):
            yield pa.record_batch([[b.no], [-1], [b.pack()], [b""]], schema=QUESTION)

    return scan(docs).mapInArrow(run, QUESTION_DDL)


QUESTION = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("keys", pa.binary()), ("extra", pa.binary())])
QUESTION_DDL = "block long, shard int, keys binary, extra binary"


def questions(b: Block, placed: np.ndarray, shards: int, extra) -> pa.RecordBatch:
    """Sorted distinct placed keys as a row a shard; extra(from, to) packs what goes with them."""
    at = cuts(placed, shards)
    rows = [(s, pack_keys(placed[at[s] : at[s + 1]], shards), extra(at[s], at[s + 1])) for s in np.flatnonzero(np.diff(at)).tolist()]
    return pa.record_batch([pa.array([b.no] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], schema=QUESTION)
