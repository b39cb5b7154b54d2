"""Columns of media bytes: types by signature and structure, embedded media, and texts stored as samples."""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, extended, sliced

BLOCK, FILL, RATE = 576, b"\xff", 8000
#: Fixed signatures: bytes, offset of the medium's start before them, kind.
SIGNATURES = (
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"), (b"\xff\xd8\xff", 0, "image/jpeg"), (b"GIF87a", 0, "image/gif"), (b"GIF89a", 0, "image/gif"), (b"BM", 0, "image/bmp"),
    (b"RIFF", 0, "riff"), (b"OggS", 0, "audio/ogg"), (b"%PDF-", 0, "application/pdf"), (b"PK\x03\x04", 0, "application/zip"), (b"\x1f\x8b\x08", 0, "application/gzip"), (b"ftyp", 4, "video/mp4"),
)
_RIFF = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}


def _png(d: bytes, at: int) -> int:
    i, first = at + 8, True
    while i + 12 <= len(d):
        n = int.from_bytes(d[i : i + 4], "big")
        kind, end = d[i + 4 : i + 8], i + 12 + n
        if end > len(d) or first and kind != b"IHDR" or zlib.crc32(d[i + 4 : end - 4]) != int.from_bytes(d[end - 4 : end], "big"):
            return 0
        if kind == b"IEND":
            return end - at
        i, first = end, False
    return 0


def _jpeg(d: bytes, at: int) -> int:
    i = at + 2
    while i + 4 <= len(d) and d[i] == 0xFF:
        kind = d[i + 1]
        n = int.from_bytes(d[i + 2 : i + 4], "big")
        if n < 2 or kind in (0x00, 0xFF, 0xD8, 0xD9):
            return 0
        i += 2 + n
        if kind == 0xDA:
            # scan data: a marker other than a stuffed zero or a restart ends it
            while (i := d.find(b"\xff", i)) >= 0 and i + 1 < len(d):
                if d[i + 1] == 0xD9:
                    return i + 2 - at
                if d[i + 1] != 0 and not 0xD0 <= d[i + 1] <= 0xD7:
                    break
                i += 2
            if i < 0:
                return 0
    return 0


def _walked(step: Callable[[int], tuple[int | None, int]], i: int, known: dict[int, int]) -> int:
    """What a walk from ``i`` comes to; ``step`` gives the next place, or none and the result. All places passed are known afterwards."""
    path = []
    while (result := known.get(i)) is None:
        path.append(i)
        then, result = step(i)
        if then is None:
            break
        i = then
    known.update(dict.fromkeys(path, result))
    return result


def _gif(d: bytes, at: int, walks: dict) -> int:
    if at + 13 > len(d):
        return 0
    blocks, parts = walks.setdefault("blocks", {}), walks.setdefault("parts", {})
    over = lambda i: _walked(lambda i: (i + d[i] + 1, 0) if i < len(d) and d[i] else (None, i + 1), i, blocks)

    def part(i: int) -> tuple[int | None, int]:
        if i < len(d) and d[i] == 0x3B:
            return None, i + 1
        if i < len(d) and d[i] == 0x21:
            return over(i + 2), 0
        if i + 10 <= len(d) and d[i] == 0x2C:
            return over(i + 11 + (3 << (d[i + 9] & 7) + 1 if d[i + 9] & 0x80 else 0)), 0
        return None, 0

    end = _walked(part, at + 13 + (3 << (d[at + 10] & 7) + 1 if d[at + 10] & 0x80 else 0), parts)
    return end and end - at


def _bmp(d: bytes, at: int) -> int:
    if at + 26 > len(d):
        return 0
    n, zero, start, head = struct.unpack_from("<IIII", d, at + 2)
    return n if zero == 0 and head in (12, 40, 52, 56, 108, 124) and 14 + head <= start <= n <= len(d) - at else 0


def _riff(d: bytes, at: int) -> int:
    n = 8 + int.from_bytes(d[at + 4 : at + 8], "little")
    if d[at + 8 : at + 12] not in _RIFF or n > len(d) - at:
        return 0
    i = at + 12
    while i + 8 <= at + n:
        size = int.from_bytes(d[i + 4 : i + 8], "little")
        i += 8 + size + size % 2
    return n if i == at + n else 0


def _ogg(d: bytes, at: int, walks: dict) -> int:
    def page(i: int) -> tuple[int | None, int]:
        if d[i : i + 4] != b"OggS" or i + 27 > len(d) or d[i + 4] != 0:
            return None, 0
        count = d[i + 26]
        end = i + 27 + count + sum(d[i + 27 : i + 27 + count])
        if end > len(d):
            return None, 0
        return (None, end) if d[i + 5] & 4 else (end, 0)

    end = _walked(page, at, walks)
    return end and end - at


class Trailers:
    """Where the marks that end a medium, or stand before its end, lie in some bytes, by one pass of an automaton."""

    def __init__(self, places: dict[bytes, list[int]]):
        self.places, self.archives, self.zeros = places, None, None

    def zero(self, d: bytes, at: int) -> int:
        """The first zero byte from ``at`` on, -1 if there is none."""
        if self.zeros is None:
            self.zeros = np.flatnonzero(np.frombuffer(d, np.uint8) == 0)
        i = int(np.searchsorted(self.zeros, at))
        return int(self.zeros[i]) if i < len(self.zeros) else -1

    def next(self, mark: bytes, at: int) -> int:
        """The first place of ``mark`` from ``at`` on, -1 if there is none."""
        own = self.places.get(mark, [])
        i = bisect_left(own, at)
        return own[i] if i < len(own) else -1


def _pdf(d: bytes, at: int, marks: Trailers) -> int:
    end = marks.next(b"%%EOF", at)
    start = marks.next(b"startxref", at)
    return end + 5 - at if end > 0 and 0 < start and start + 9 <= end and d[at + 5 : at + 6].isdigit() else 0


def _zip(d: bytes, at: int, marks: Trailers) -> int:
    """Each end record says where its archive starts, so an archive's end is one of those that say ``at``."""
    if marks.archives is None:
        marks.archives = {}
        for end in marks.places.get(b"PK\x05\x06", []):
            if end + 22 <= len(d):
                size, start = struct.unpack_from("<II", d, end + 12)
                n = end + 22 + int.from_bytes(d[end + 20 : end + 22], "little")
                if n <= len(d):
                    marks.archives.setdefault(end - size - start, n)
    return marks.archives.get(at, at) - at


def _gzip(d: bytes, at: int, marks: Trailers) -> int:
    flags = d[at + 3] if at + 10 <= len(d) else 0xFF
    if flags & 0xE0:
        return 0  # too short, or reserved flags
    i = at + 10 + (2 + int.from_bytes(d[at + 10 : at + 12], "little") if flags & 4 else 0)
    for flag in (8, 16):  # a name and a comment, each up to a zero byte
        if flags & flag:
            i = marks.zero(d, i) + 1
            if not i:
                return 0
    worker, check, size = zlib.decompressobj(-15), 0, 0
    i += 2 * bool(flags & 2)
    try:
        while i < len(d) and not worker.eof:
            out = worker.decompress(d[i : i + (1 << 14)])
            check, size, i = zlib.crc32(out, check), size + len(out), i + (1 << 14)
    except zlib.error:
        return 0
    end = min(i, len(d)) - len(worker.unused_data)
    return end + 8 - at if worker.eof and d[end : end + 8] == struct.pack("<II", check, size & 0xFFFFFFFF) else 0


def _mp4(d: bytes, at: int, walks: dict) -> int:
    def box(i: int) -> tuple[int | None, int]:
        n = int.from_bytes(d[i : i + 4], "big") if i + 8 <= len(d) else 0
        return (i + n, 0) if n >= 8 and i + n <= len(d) and d[i + 4 : i + 8].isalnum() else (None, i)

    end = _walked(box, at, walks)
    return end - at if end > at and end > at + int.from_bytes(d[at : at + 4], "big") else 0


#: Formats that are walked part by part.
_WALKS = ("image/gif", "audio/ogg", "video/mp4")
_CHECKS: dict[str, Callable[..., int]] = {
    "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "riff": _riff, "audio/ogg": _ogg, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip, "video/mp4": _mp4,
}


_ENDS = (b"%%EOF", b"startxref", b"PK\x05\x06")
_WITH_ENDS = ("application/pdf", "application/zip", "application/gzip")


def _automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for magic, before, kind in SIGNATURES:
        auto.add_word(magic.decode("latin-1"), (len(magic) + before, kind))
    for mark in _ENDS:
        auto.add_word(mark.decode("latin-1"), (len(mark), mark))
    auto.make_automaton()
    return auto


_AUTO: list[ahocorasick.Automaton] = []


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, length) of every medium in ``data`` whose structure holds, by start; those inside others included.

    Magic bytes alone do not count: a validator for the format must find its parts and end. The automaton finds the
    marks of ends in the same pass as the magic bytes, so that no validator searches for its own. A validator that walks
    along a medium's parts takes up the walk of an earlier one where they meet, so the time grows with the data.
    """
    if not _AUTO:
        _AUTO.append(_automaton())
    starts, places = [], {}
    for end, (n, what) in _AUTO[0].iter(data.decode("latin-1")):
        if isinstance(what, bytes):
            places.setdefault(what, []).append(end + 1 - n)
        elif end + 1 - n >= 0:
            starts.append((end + 1 - n, what))
    found, marks, walks = [], Trailers(places), {}
    for start, kind in reversed(starts):  # from the last, so that walks are known where they lead
        if kind in _WITH_ENDS:
            length = _CHECKS[kind](data, start, marks)
        elif kind in _WALKS:
            length = _CHECKS[kind](data, start, walks.setdefault(kind, {}))
        else:
            length = _CHECKS[kind](data, start)
        if length:
            found.append((_RIFF[data[start + 8 : start + 12]] if kind == "riff" else kind, start, length))
    return sorted(found, key=lambda f: (f[1], -f[2], f[0]))


def _sniffed(batches: Iterator[pa.RecordBatch], media: str = "media", declared: str = "declared") -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
    for b in batches:
        detected, corrected, inner = [], [], []
        for data, said in zip(b.column(media), b.column(declared).to_pylist(), strict=True):
            found = sniff(data.as_py() or b"")
            top = next((k for k, start, _ in found if start == 0), said)
            detected.append(top)
            corrected.append(top != said)
            inner.append([{"kind": k, "start": s, "length": n} for k, s, n in found if s])
        arrays = [pa.array(detected, pa.string()), pa.array(corrected, pa.bool_()), pa.array(inner, kind)]
        yield pa.RecordBatch.from_arrays([*b.columns, *arrays], names=[*b.schema.names, "detected", "corrected", "embedded"])


def sniffed(rows: DataFrame, media: str = "media", declared: str = "declared") -> DataFrame:
    """Add detected, corrected and embedded to ``rows`` of media bytes with a declared type.

    detected: the kind of a valid medium that starts at byte 0, else the declared type; corrected: does it
    differ from the declared type; embedded: kind, start, length of valid media further in. Null media
    keep their declared type and hold nothing. Columns of these names are replaced.
    """
    rows = rows.drop("detected", "corrected", "embedded")
    return rows.mapInArrow(lambda batches: _sniffed(sliced(batches, media), media, declared), extended(rows, detected="string", corrected="boolean", embedded="array<struct<kind:string,start:bigint,length:bigint>>"))


def padded(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, the payload: those bytes and bytes 255 up to a positive multiple of 576)."""
    raw = (text or "").encode()
    return len(raw), raw + FILL * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """One channel of 8-bit samples."""
    odd = len(samples) % 2
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * odd
    return b"RIFF" + struct.pack("<I", len(body)) + body


def samples(media: bytes) -> bytes:
    """The samples of a wave file; raises if there are none."""
    i = 12
    while i + 8 <= len(media):
        n = int.from_bytes(media[i + 4 : i + 8], "little")
        if media[i : i + 4] == b"data":
            return media[i + 8 : i + 8 + n]
        i += 8 + n + n % 2
    raise ValueError("no samples")


_STORED = "doc_id long, n_bytes long, media binary, declared string"


def _stored(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [padded(t) for t in b.column(text).to_pylist()]
        arrays = [b.column("doc_id"), pa.array([n for n, _ in rows], pa.int64()), pa.array([wav(p) for _, p in rows], pa.binary()), pa.array(["application/octet-stream"] * len(rows), pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "media", "declared"])


def stored_as_samples(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media and declared: each whole text as a wave file whose type is declared as unknown bytes. A null text is stored as an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(lambda batches: _stored(sliced(batches, text), text), _STORED)


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in _FEATURES.split(", ")]

    def one(n: int, media: bytes, kind: str, inner: list[dict]) -> tuple:
        if kind != "audio/wav":
            raise ValueError(f"stored media were found to be {kind}")
        back = samples(media)
        x = np.frombuffer(back, np.uint8)
        turns = int(np.count_nonzero(np.diff((x >= 128).view(np.int8))))
        feature = f"{kind};mean={int(x.sum(dtype=np.int64) * 1000 // len(x))};turns={turns};embedded={'+'.join(e['kind'] for e in inner)}"
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature

    for b in batches:
        got = [one(n.as_py(), m.as_py(), k.as_py(), e.as_py()) for n, m, k, e in zip(b.column("n_bytes"), b.column("media"), b.column("detected"), b.column("embedded"), strict=True)]
        arrays = [b.column("doc_id"), *(pa.array([g[i] for g in got], pa.string() if i in (2, 5, 6) else pa.int64()) for i in range(7))]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def features(rows: DataFrame) -> DataFrame:
    """The samples of sniffed media (doc_id, n_bytes, media, detected, embedded), read back, with digests and a feature.

    feature: the type found, the samples' mean and the number of sign changes around 128, and the embedded kinds.
    """
    return rows.select("doc_id", "n_bytes", "media", "detected", "embedded").mapInArrow(lambda batches: _featured(sliced(batches, "media")), _FEATURES)


def text_features(docs: DataFrame) -> DataFrame:
    """``features(sniffed(stored_as_samples(docs)))`` in one pass, a few MB of text at a time, so that stored media never leave the task."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: _featured(_sniffed(_stored(sliced(batches, "text")))), _FEATURES)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, each stored as a medium and read back; null texts count as empty."""
    return text_features(documents(spark, sf_dir))
