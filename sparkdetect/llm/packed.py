"""Packed chunks of documents, and questions about hashes that chunks ask each other.

Operators that look at every position of the corpus would shuffle a row for each. Here documents are
packed into chunks of several MB, written once. A chunk asks about its distinct hashes in packed, sorted
runs, one for each bucket of the hash range; a bucket answers each run with a byte for each hash, in the
same order, so that neither positions nor hashes travel back. A hash that is in every document costs one
entry for each chunk, and there are never more rows than hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, sliced

#: Bytes of text in a chunk and in a part of it, each beyond a single longer document.
CHUNK, PART = 8 << 20, 1 << 20
#: Entries that a bucket holds, about, and buckets in a task.
BUCKET, TOGETHER = 1 << 20, 4


def squeeze(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


SCHEMA = "chunk long, ids binary, nulls binary, ends binary, firsts binary, data array<binary>, n_bytes long, n_words long"
ARROW = pa.schema([("chunk", pa.int64()), ("ids", pa.binary()), ("nulls", pa.binary()), ("ends", pa.binary()), ("firsts", pa.binary()), ("data", pa.list_(pa.binary())), ("n_bytes", pa.int64()), ("n_words", pa.int64())])


def chunks(docs: DataFrame, size: int = CHUNK, part: int = PART) -> DataFrame:
    """(chunk, ids, nulls, ends, firsts, data, n_bytes, n_words): documents as they come, in rows of ``size`` bytes of text.

    Inside a chunk documents are in order of doc_id, nulls last, then text, and ``data`` holds them in parts of whole
    documents. Null texts are empty.
    """

    def row(docs: list[tuple[int | None, bytes]], k: int) -> pa.RecordBatch:
        docs.sort(key=lambda d: (d[0] is None, d[0] or 0, d[1]))
        firsts, total = [0], 0
        for i, (_, t) in enumerate(docs):
            if i > firsts[-1] and total + len(t) > part:
                firsts.append(i)
                total = 0
            total += len(t)
        data = [squeeze(b"".join(t for _, t in docs[s:e]), 3) for s, e in zip(firsts, [*firsts[1:], len(docs)], strict=True)]
        ends = np.cumsum([len(t) for _, t in docs]).astype(np.int64)
        whole = {
            "chunk": TaskContext.get().partitionId() << 32 | k, "ids": np.array([d[0] or 0 for d in docs], np.int64).tobytes(), "nulls": np.array([d[0] is None for d in docs], np.uint8).tobytes(),
            "ends": ends.tobytes(), "firsts": np.array(firsts, np.int64).tobytes(), "data": data, "n_bytes": int(ends[-1]), "n_words": sum(len(t.split()) for _, t in docs),
        }
        return pa.RecordBatch.from_pylist([whole], schema=ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, k = [], 0, 0
        for b in sliced(batches, "text"):
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                raw = t.as_py().encode() if t.is_valid else b""
                if held and total + len(raw) > size:
                    yield row(held, k)
                    held, total, k = [], 0, k + 1
                held.append((i, raw))
                total += len(raw)
        if held:
            yield row(held, k)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def by_chunk(table: DataFrame, answers: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, n: int) -> DataFrame:
    """``run`` gets each of ``n`` chunks, already dealt, with its answers."""
    return table.groupBy("chunk").cogroup(dealt(answers, "chunk", n).groupBy("chunk")).applyInArrow(run, schema)


@dataclass
class Chunk:
    """A chunk's documents: ids, whether an id is null, where texts start and end, and the parts with their first documents."""

    chunk: int
    ids: np.ndarray
    nulls: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    firsts: list[int]
    packed: list[bytes]

    @classmethod
    def of(cls, row: dict) -> Chunk:
        ends = np.frombuffer(row["ends"], np.int64)
        firsts = np.frombuffer(row["firsts"], np.int64).tolist()
        return cls(row["chunk"], np.frombuffer(row["ids"], np.int64), np.frombuffer(row["nulls"], np.uint8) > 0, np.concatenate([[0], ends[:-1]]), ends, firsts, row["data"])

    def parts(self) -> Iterator[tuple[int, int, int, bytes]]:
        """(first document, past the last, place of the first byte, bytes) of each part."""
        for first, past, data in zip(self.firsts, [*self.firsts[1:], len(self.ends)], self.packed, strict=True):
            yield first, past, int(self.starts[first]), unsqueeze(data)


_FIELDS = ("chunk", "ids", "nulls", "ends", "firsts", "data")


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for b in batches:
        for i in range(b.num_rows):
            yield Chunk.of({n: b.column(n)[i].as_py() for n in _FIELDS})


def pack(values: np.ndarray) -> bytes:
    """Sorted whole numbers as differences, byte planes apart, so that the high zeros vanish."""
    step = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def bits_for(entries: int) -> int:
    """Bits of a hash with which a given hash meets one of ``entries`` others by chance once in some 4,000 times."""
    return min(64, max(40, math.ceil(math.log2(max(entries, 2))) + 12))


def buckets_for(entries: int) -> int:
    return max(1, -(-entries // BUCKET))


ASKED = "bucket int, chunk long, keys binary, notes binary"
ASKED_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("notes", pa.binary())])
ANSWERED = "chunk long, bucket int, answer binary"


def questions(chunk: int, keys: np.ndarray, notes: list[np.ndarray], bits: int, buckets: int) -> Iterator[dict]:
    """Rows that ask about ``keys`` (sorted, distinct, below 2**bits), each with its notes, by bucket."""
    bounds = np.array([(b << bits) // buckets for b in range(1, buckets)], np.uint64)
    cuts = [0, *np.searchsorted(keys, bounds), len(keys)]
    for b, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if e > s:
            yield {"bucket": b, "chunk": chunk, "keys": squeeze(pack(keys[s:e])), "notes": squeeze(b"".join(np.ascontiguousarray(n[s:e]).tobytes() for n in notes))}


def asked(table: DataFrame, ask: Callable[[Chunk], Iterator[dict]]) -> DataFrame:
    """The questions of all chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in opened(batches):
            if rows := list(ask(c)):
                yield pa.RecordBatch.from_pylist(rows, schema=ASKED_ARROW)

    return table.mapInArrow(run, ASKED)


def dealt(rows: DataFrame, key: str, groups: int, together: int = TOGETHER) -> DataFrame:
    """``rows`` by ``key`` in so many partitions that one has about ``together`` of all groups, however large the input."""
    return rows.repartition(max(partitions(rows.sparkSession), -(-groups // together)), key)


def answered(questions: DataFrame, answer: Callable[[list[int], list[np.ndarray], list[bytes]], list[np.ndarray]], buckets: int) -> DataFrame:
    """``answer`` gets a bucket's chunks, keys and notes, and returns a byte for each key of each chunk."""
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("answer", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk").to_pylist()
        keys = [unpack(unsqueeze(k)) for k in table.column("keys").to_pylist()]
        out = answer(chunk, keys, [unsqueeze(n.as_py()) for n in table.column("notes")])
        return pa.table([pa.array(chunk, pa.int64()), table.column("bucket").combine_chunks(), pa.array([squeeze(a.astype(np.uint8).tobytes()) for a in out], pa.binary())], schema=schema)

    return dealt(questions, "bucket", buckets).groupBy("bucket").applyInArrow(run, ANSWERED)


def replies(answers: pa.Table) -> np.ndarray:
    """A chunk's answers in the order of its keys."""
    got = sorted(zip(answers.column("bucket").to_pylist(), answers.column("answer").to_pylist(), strict=True))
    return np.frombuffer(b"".join(unsqueeze(a) for _, a in got), np.uint8)


def chunk_of(row: pa.Table) -> Chunk:
    return Chunk.of(row.select(list(_FIELDS)).slice(0, 1).to_pylist()[0])


def counted(keys: list[np.ndarray], notes: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's distinct keys, sorted; how many chunks have each; the OR and the sum of its notes' bytes."""
    flat, note = np.concatenate(keys), np.frombuffer(b"".join(notes), np.uint8)
    order = np.argsort(flat, kind="stable")
    flat, note = flat[order], note[order]
    at = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    return flat[at], np.diff(np.append(at, len(flat))), np.bitwise_or.reduceat(note, at), np.add.reduceat(note.astype(np.int64), at)
