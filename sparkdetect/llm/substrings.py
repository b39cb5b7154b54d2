"""Repeated runs of words: fixed blocks as anchors, rolling probes, maximal exact repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packed
from .common import byte_table, documents, prefix_hash, rolling_hash, span_hash, stored, words
from .packed import Chunk

WINDOW = 20
#: A window of WINDOW words holds a whole block, wherever blocks start.
BLOCK = (WINDOW + 1) // 2


def _split(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of ``data`` that do not run over the documents' ends."""
    start, end = words(data)
    if not len(start):
        return start, end
    cut = np.unique(ends[:-1])
    at = np.searchsorted(start, cut, "right") - 1
    inside = (at >= 0) & (start[at] < cut) & (cut < end[at])
    return np.sort(np.concatenate([start, cut[inside]])), np.sort(np.concatenate([end, cut[inside]]))


class Words:
    """A chunk's words: place in the bytes, document, and number in it; with a seed also hashes of runs of words."""

    def __init__(self, c: Chunk, seed: int | None = None):
        starts, ends, hashed = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        table = None if seed is None else byte_table(seed)
        for first, past, begin, raw in c.parts():
            data = np.frombuffer(raw, np.uint8)
            start, end = _split(data, c.ends[first:past] - begin)
            starts.append(start + begin)
            ends.append(end + begin)
            if table is not None:
                hashed.append(span_hash(prefix_hash(data, table), start, end))
        self.start, self.end = np.concatenate(starts), np.concatenate(ends)
        self.doc = np.searchsorted(c.ends, self.start, "right")
        self.count = np.bincount(self.doc, minlength=len(c.ends))
        self.first = np.cumsum(self.count) - self.count
        self.prefix = None if seed is None else prefix_hash(np.concatenate(hashed), None)

    def rolling(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and position of each run of ``width`` words inside one document."""
        hashed = rolling_hash(self.prefix, width)
        at = np.flatnonzero(self.doc[: len(hashed)] == self.doc[width - 1 :]) if len(hashed) else np.zeros(0, int)
        return hashed[at], at


def _distinct(hashed: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, which of them each hash has, and how often each occurs."""
    return np.unique(hashed >> np.uint64(shift), return_inverse=True, return_counts=True)


def _ask_blocks(c: Chunk, bits: int, buckets: int) -> Iterator[dict]:
    """Every run of BLOCK words asks; note 1: it is a block of the index, note 2: it occurs twice in the chunk."""
    w = Words(c, 0)
    hashed, at = w.rolling(BLOCK)
    keys, which, count = _distinct(hashed, 64 - bits)
    note = np.where(count > 1, 2, 0).astype(np.uint8)
    note[which[(at - w.first[w.doc[at]]) % BLOCK == 0]] |= 1
    return packed.questions(c.chunk, keys, [note], bits, buckets)


def _answer_blocks(chunk: list[int], keys: list[np.ndarray], notes: list[bytes]) -> list[np.ndarray]:
    """2: the run is elsewhere too; and 1: one of its places is a block of the index."""
    known, chunks, note, _ = packed.counted(keys, notes)
    said = np.where((chunks > 1) | (note & 2 > 0), 2 | note & 1, 0)
    return [said[np.searchsorted(known, k)] for k in keys]


def _candidates(w: Words, said: np.ndarray, bits: int) -> np.ndarray:
    """Windows to which a hit extends: a run that is a block elsewhere, and on both sides runs of BLOCK words that are elsewhere too."""
    hashed, at = w.rolling(BLOCK)
    _, which, _ = _distinct(hashed, 64 - bits)
    again, hit = np.zeros((2, len(w.doc) + 1), np.int64)
    again[at + 1], hit[at + 1] = said[which] >> 1, said[which] & 1
    again, hit = np.cumsum(again), np.cumsum(hit)
    _, start = w.rolling(WINDOW)
    runs = WINDOW - BLOCK + 1
    return start[(again[start + runs] - again[start] == runs) & (hit[start + runs] > hit[start])]


def _windows(w: Words, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of the windows at ``start``, which each has, and the first window of each."""
    hashed = rolling_hash(w.prefix, WINDOW)[start] if len(start) else np.zeros(0, np.uint64)
    keys, first, which = np.unique(hashed, return_index=True, return_inverse=True)
    return keys, which, first


#: Where a window's first place in a chunk is: no id, id, a hash of the text (which say what is earlier, then the chunk), and its number.
ORDER = np.dtype([("null", "u1"), ("id", "<i8"), ("text", "<u4"), ("at", "<u4")])


def _order_of(c: Chunk, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    out, digest = np.zeros(len(doc), ORDER), np.zeros(len(c.ends), np.uint32)
    wanted = set(np.unique(doc).tolist())
    for first, past, begin, raw in c.parts():
        for d in wanted.intersection(range(first, past)):
            digest[d] = int.from_bytes(hashlib.md5(raw[c.starts[d] - begin : c.ends[d] - begin]).digest()[:4], "big")
    out["null"], out["id"], out["text"], out["at"] = c.nulls[doc], c.ids[doc], digest[doc], at
    return out


LED = np.dtype([("chunk", "<i8"), ("at", "<u4")])


def _firsts(table: pa.Table) -> pa.Table:
    """For each key of each chunk the chunk and window of its first place."""
    chunk = table.column("chunk").to_pylist()
    keys = [packed.unpack(packed.unsqueeze(k)) for k in table.column("keys").to_pylist()]
    size = [len(k) for k in keys]
    flat, own = np.concatenate(keys), np.repeat(np.array(chunk, np.int64), size)
    order = np.frombuffer(b"".join(packed.unsqueeze(n) for n in table.column("notes").to_pylist()), ORDER)
    by = np.lexsort((own, order["text"], order["id"], order["null"], flat))
    new = np.concatenate([[True], flat[by][1:] != flat[by][:-1]])
    leader = by[np.flatnonzero(new)[np.cumsum(new) - 1]]
    out = np.zeros(len(flat), LED)
    out["chunk"][by], out["at"][by] = own[leader], order["at"][leader]
    parts = [packed.squeeze(a["chunk"].tobytes() + a["at"].tobytes()) for a in np.split(out, np.cumsum(size)[:-1])]
    return pa.table([pa.array(chunk, pa.int64()), table.column("bucket").combine_chunks(), pa.array(parts, pa.binary())], names=["chunk", "bucket", "answer"])


def _leaders(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    got = [packed.unsqueeze(a) for _, a in sorted(zip(answers.column("bucket").to_pylist(), answers.column("answer").to_pylist(), strict=True))]
    n = [len(a) // 12 for a in got]
    return np.frombuffer(b"".join(a[: 8 * k] for a, k in zip(got, n, strict=True)), "<i8"), np.frombuffer(b"".join(a[8 * k :] for a, k in zip(got, n, strict=True)), "<u4").astype(np.int64)


#: Maximal exact repeats: ``n`` words from word ``at`` of a chunk are those from word ``of_at`` of chunk ``of``.
REPEATS = "chunk long, at long, n long, of long, of_at long"
_REPEATS = pa.schema([(x.split()[0], pa.int64()) for x in REPEATS.split(", ")])


def _repeats(c: Chunk, w: Words, start: np.ndarray, chunk: np.ndarray, at: np.ndarray) -> pa.Table:
    """Windows at ``start`` that follow each other, as do their first places, make one repeat."""
    later = (chunk != c.chunk) | (at != start)
    start, chunk, at = start[later], chunk[later], at[later]
    # a part of a repeat has few bytes, so that spans of very long ones stay small; both documents are the same all along, as windows do not cross them
    new = np.flatnonzero(np.concatenate([[True], (np.diff(start) != 1) | (np.diff(at) != 1) | (np.diff(chunk) != 0) | (np.diff(w.start[start] >> 20) > 0)])) if len(start) else start
    n = np.diff(np.append(new, len(start))) + WINDOW - 1
    return pa.table([np.full(len(new), c.chunk), start[new], n, chunk[new], at[new]], schema=_REPEATS)


def _spans(c: Chunk, w: Words, at: list[int], n: list[int]) -> Iterator[bytes]:
    """``n`` words from word ``at`` on, joined by a space; ``at`` ascends."""
    k, parts = 0, c.parts()
    first, past, begin, raw = next(parts)
    for a, m in zip(at, n, strict=True):
        while w.doc[a] >= past:
            first, past, begin, raw = next(parts)
        yield b" ".join([raw[s:e] for s, e in zip((w.start[a : a + m] - begin).tolist(), (w.end[a : a + m] - begin).tolist(), strict=True)])


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in one of the runs."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:n]) > 0


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, wrong boolean"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string()), ("wrong", pa.bool_())])


def _cut(c: Chunk, found: pa.Table, texts: bool) -> Iterator[dict]:
    """A chunk's documents without the repeats whose words are those of their first places; ``wrong`` if some are not."""
    w = Words(c)
    found = found.sort_by("at")
    at, n, wrong = found.column("at").to_numpy(), found.column("n").to_numpy(), False
    for mine, first in zip(_spans(c, w, at.tolist(), n.tolist()), found.column("span"), strict=True):
        wrong |= first.as_py() != mine
    gone = covered(at, n, len(w.doc))
    for first, past, begin, raw in c.parts():
        for d in range(first, past):
            s = slice(w.first[d], w.first[d] + w.count[d])
            stay = np.flatnonzero(~gone[s]) + w.first[d]
            text = b" ".join([raw[a:b] for a, b in zip((w.start[stay] - begin).tolist(), (w.end[stay] - begin).tolist(), strict=True)])
            yield {"doc_id": None if c.nulls[d] else int(c.ids[d]), "n_words": int(w.count[d]), "n_removed": int(gone[s].sum()), "kept_sha256": hashlib.sha256(text).hexdigest(), "kept": text.decode("utf-8", "replace") if texts else None, "wrong": wrong}


def without_repeats(docs: DataFrame, texts: bool = True, chunk_bytes: int = packed.CHUNK, bits: int = 64) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for each row of ``docs`` (doc_id, text).

    Words are runs without space, tab, line feed to carriage return. A word goes if a window of 20 words that covers it
    has its words at an earlier place too: in a document of smaller doc_id, or earlier in the same. Null
    ids come last; rows of one id are ordered by a hash of their text, and equal rows one after the other.
    Null and empty texts have no words. ``texts=False`` leaves ``kept`` null. Other columns than doc_id and text are left aside.

    Blocks of 10 words at fixed places in every document are the index, and all runs of 10 words probe it.
    A hit extends to both sides while the next runs are elsewhere too; the windows so found, a small part of all, ask for
    their first place by ``bits`` of a hash of their words. Windows that follow each other, as their first places do, are one
    maximal repeat, and its words are compared with those at its first place. Should a hash ever bring different
    words together, the windows ask again by other hashes.
    """
    table = stored(packed.chunks(docs, chunk_bytes))
    total, n_chunks = table.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.count("*")).first()
    few, buckets = packed.bits_for(total), packed.buckets_for(total)
    second = max(1, buckets // 4)
    rows = packed.dealt(table, "chunk", n_chunks)
    hits = stored(packed.answered(packed.asked(table, lambda c: _ask_blocks(c, few, buckets)), _answer_blocks, buckets))

    def both(answers: DataFrame, run, schema: str) -> DataFrame:
        return rows.groupBy("chunk").cogroup(packed.dealt(answers, "chunk", n_chunks).groupBy("chunk")).applyInArrow(run, schema)

    def found(row: pa.Table, answers: pa.Table, seed: int) -> tuple[Chunk, Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        c = packed.chunk_of(row)
        w = Words(c, 0)
        start = _candidates(w, packed.replies(answers), few)
        w = Words(c, seed) if seed else w
        keys, which, first = _windows(w, start)
        return c, w, start, keys, which, first

    def attempt(seed: int) -> DataFrame:
        shift = np.uint64(64 - bits) if seed == 0 else np.uint64(0)

        def narrowed(keys: np.ndarray, which: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            short, of = np.unique(keys >> shift, return_inverse=True)
            low = np.full(len(short), np.iinfo(np.int64).max)
            np.minimum.at(low, of, first)
            return short, of[which], low

        def ask(row: pa.Table, answers: pa.Table) -> pa.Table:
            if not (row.num_rows and answers.num_rows):
                return packed.ASKED_ARROW.empty_table()
            c, w, start, *found_keys = found(row, answers, seed)
            keys, _, first = narrowed(*found_keys)
            notes = [_order_of(c, w.doc[start[first]], start[first])]
            return pa.Table.from_pylist(list(packed.questions(c.chunk, keys, notes, 64 - int(shift), second)), schema=packed.ASKED_ARROW)

        firsts = stored(packed.dealt(both(hits, ask, packed.ASKED), "bucket", second).groupBy("bucket").applyInArrow(_firsts, packed.ANSWERED))

        def repeats(row: pa.Table, answers: pa.Table) -> pa.Table:
            kind = answers.column("kind").to_numpy() if answers.num_rows else np.zeros(0, int)
            if not (row.num_rows and (kind == 1).any()):
                return _REPEATS.empty_table()
            c, w, start, *found_keys = found(row, answers.filter(pa.array(kind == 0)), seed)
            _, which, _ = narrowed(*found_keys)
            chunk, at = _leaders(answers.filter(pa.array(kind == 1)))
            return _repeats(c, w, start, chunk[which], at[which])

        said = hits.withColumn("kind", F.lit(0)).union(firsts.withColumn("kind", F.lit(1)))
        asked = stored(both(said, repeats, REPEATS))

        def span(row: pa.Table, wanted: pa.Table) -> pa.Table:
            if not (row.num_rows and wanted.num_rows):
                return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())], names=["of", "of_at", "n", "span"])
            c = packed.chunk_of(row)
            wanted = wanted.sort_by("of_at")
            got = list(_spans(c, Words(c), wanted.column("of_at").to_pylist(), wanted.column("n").to_pylist()))
            return pa.table([wanted.column("of"), wanted.column("of_at"), wanted.column("n"), pa.array(got, pa.binary())], names=["of", "of_at", "n", "span"])

        # a passage that many chunks repeat is read once
        wanted = packed.dealt(asked.select("of", "of_at", "n").distinct(), "of", n_chunks)
        spans = rows.groupBy("chunk").cogroup(wanted.groupBy("of")).applyInArrow(span, "of long, of_at long, n long, span binary")
        compared = asked.join(spans, ["of", "of_at", "n"]).select("chunk", "at", "n", "span")

        def cut(row: pa.Table, found: pa.Table) -> pa.Table:
            return pa.Table.from_pylist(list(_cut(packed.chunk_of(row), found, texts)) if row.num_rows else [], schema=_RESULT)

        return stored(both(compared, cut, RESULT))

    seed = 0
    while not (out := attempt(seed)).where("wrong").isEmpty():
        seed += 1
    return out.drop("wrong")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by their words; see ``without_repeats``."""
    return without_repeats(documents(spark, sf_dir), texts=False).drop("kept")
