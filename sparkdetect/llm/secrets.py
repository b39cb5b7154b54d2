"""Secrets in texts and in what is encoded in them."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, extended, sliced

KINDS = ("assign", "access", "hex")
#: Fixed patterns: kind, pattern, group that is measured, its least length.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # as AKIA[A-Z0-9]+ of 20 characters or more
_HEX = re.compile(r"[0-9a-f]{24,}")  # as [0-9a-f]+ of 24 or more
_NAMES = re.compile(r"passw|secret|token|api_?key")
#: Parts that may hold another layer: runs without blanks and quotes, and what is escaped in them.
_RUN = re.compile(r"[^\s\"'<>]+")
_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
#: A run of base64 characters, also one that goes on over line ends; and what may stand before a blob within a run.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)*(?:[\x20\t]*\r?\n[\x20\t]*(?==))?={0,2}")
_BEFORE = re.compile(r"[+/_-]")
_URLSAFE = str.maketrans("-_", "+/")
#: In bytes: what ends a run of base64 characters and lines; the same table; what is no part of a blob; what may stand before one.
_ENDS = re.compile(rb"[^A-Za-z0-9+/_=\-\s]|[^\s][\x20\t]+(?=[^\s])")
_URLSAFE_BYTES, _BETWEEN = bytes.maketrans(b"-_", b"+/"), b"= \t\r\n\x0b\x0c"
#: Control characters and bytes that are no UTF-8 (as surrogates); ASCII as UTF-16; the shortest secret, "token=" and six characters.
_BREAKS = re.compile("([\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\udc80-\\udcff]+)")
_UTF16_LE, _UTF16_BE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\0){12,}"), re.compile(rb"(?:\0[\t\n\r\x20-\x7e]){12,}")
_LEAST = 12
#: Bytes of an unpacked stream that are looked at together; what the next look sees again; first bytes by which a stream that holds itself is known.
STEP, AGAIN, MARK = 4 << 20, 256, 64
_HEX_VALUE = np.full(256, 255, np.uint8)
_HEX_VALUE[np.frombuffer(b"0123456789abcdefABCDEF", np.uint8)] = [*range(16), *range(10, 16)]

Span = tuple[str, int, int]
#: A decoded text and, for each of its characters, where its source starts and ends.
Layer = tuple[str, np.ndarray, np.ndarray]


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) in code points; leftmost and without overlap for each kind; by start, then kind as listed."""
    found = []
    if _NAMES.search(text.lower()):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return _sorted(found)


def _sorted(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _sizes(text: str) -> np.ndarray:
    """Bytes of each character in UTF-8."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)


def _stretches(data: bytes) -> Iterator[Layer]:
    """The printable stretches of ``data`` with the byte at which each character starts and ends: UTF-8, and UTF-16 of ASCII.

    What is no UTF-8 or a control character ends a stretch, and no pattern crosses one. Stretches under ``_LEAST``
    characters hold neither a secret nor a layer with one.
    """
    at, text = 0, data.decode("utf-8", "surrogateescape")
    for part in _BREAKS.split(text):  # breaks are kept, at odd places; each of their characters is one byte
        n = len(part) if part.isascii() else len(part.encode("utf-8", "surrogateescape"))
        if len(part) >= _LEAST and not _BREAKS.match(part):
            ends = at + np.cumsum(_sizes(part))
            yield part, np.concatenate([[at], ends[:-1]]), ends
        at += n
    for pattern, first in ((_UTF16_LE, 0), (_UTF16_BE, 1)):
        for m in pattern.finditer(data):
            low = np.arange(m.start(), m.end(), 2)
            yield m[0][first::2].decode("ascii"), low, low + 2


def _through(layers: Iterable[Layer], starts: np.ndarray, ends: np.ndarray) -> Iterator[Layer]:
    """``layers`` of a text whose characters have their source at starts to ends."""
    for text, low, high in layers:
        yield text, starts[low], ends[high - 1]


def _percent(part: str, at: int) -> Iterator[Layer]:
    raw = np.frombuffer(part.encode("utf-8", "surrogatepass") + b"  ", np.uint8)
    char = np.repeat(np.arange(len(part)), _sizes(part)) + at
    high, low = _HEX_VALUE[raw[1:-1]], _HEX_VALUE[raw[2:]]
    hit = (raw[:-2] == 0x25) & (high < 16) & (low < 16)
    value = np.where(hit, high * 16 + low, raw[:-2]).astype(np.uint8)
    stay = ~hit
    stay[1:] &= ~hit[:-1]
    stay[2:] &= ~hit[:-2]
    stay |= hit
    return _through(_stretches(value[stay].tobytes()), char[stay], (char + np.where(hit, 3, 1))[stay])


def _escaped(part: str, at: int) -> Layer:
    out, low, high, last = [], [], [], 0
    for m in _ESCAPE.finditer(part):
        code = int(m[1] or m[2] or m[4], 16) if m[3] is None else int(m[3])
        if code > 0x10FFFF or 0xD800 <= code < 0xE000:
            continue
        out += [part[last : m.start()], chr(code)]
        low += [np.arange(last, m.start()), [m.start()]]
        high += [np.arange(last + 1, m.start() + 1), [m.end()]]
        last = m.end()
    out.append(part[last:])
    low.append(np.arange(last, len(part)))
    high.append(np.arange(last + 1, len(part) + 1))
    return "".join(out), at + np.concatenate(low).astype(np.int64), at + np.concatenate(high).astype(np.int64)


def _is_packed(head: bytes) -> bool:
    """Does a zlib or gzip stream start so?"""
    return head[:2] == b"\x1f\x8b" or head[:1] == b"\x78" and len(head) > 2 and int.from_bytes(head[:2], "big") % 31 == 0


class _Sieve:
    """Kinds of secrets in bytes that come piece by piece, and in what is encoded or packed in them.

    It holds a few MB, whatever comes: what is held is looked at up to the last byte that ends a run. A run that goes on
    beyond that is looked at as it comes, and is decoded on and on besides.
    """

    def __init__(self, kinds: set[str]):
        self.kinds, self.held, self.tail, self.run = kinds, b"", b"", None

    def feed(self, data: bytes) -> None:
        if len(self.kinds) == len(KINDS):
            return
        self.held += data
        while len(self.held) > 2 * STEP:
            window = self.held[: 2 * STEP]
            self._look(window, self._last_end(window) or 2 * STEP)

    def _look(self, window: bytes, cut: int) -> None:
        part, self.held = window[:cut], self.held[cut:]
        for text, _, _ in _stretches(self.tail + part):
            self.kinds.update(k for k, _, _ in all_spans(text))
        self.tail = part[-AGAIN:]
        first = _ENDS.search(part)
        if self.run:
            # an end of more than one byte begins with the run's last
            self.run.feed(part[: first.start() + (first.end() - first.start() > 1)] if first else part)
            if first:
                self.run.close()
                self.run = None
        if not first and not self.run:
            self.run = _Run(self.kinds)
            self.run.feed(part)

    @staticmethod
    def _last_end(window: bytes) -> int:
        for at in range(len(window), 0, -4096):
            ends = [m.end() for m in _ENDS.finditer(window, max(0, at - 4096), min(len(window), at + AGAIN))]
            if ends:
                return ends[-1]
        return 0

    def close(self) -> None:
        if self.held and len(self.kinds) < len(KINDS):
            self._look(self.held, len(self.held))
        if self.run:
            self.run.close()


class _Run:
    """A run of base64 characters that comes piece by piece, read from each of its first four; streams in it are unpacked to their ends."""

    def __init__(self, kinds: set[str]):
        self.kinds, self.count, self.starts = kinds, 0, [0]
        self.rest, self.base = [b""] * 4, [0, 1, 2, 3]  # what is not decoded yet, and the number of its first character
        self.sieves, self.packed = [_Sieve(kinds) for _ in range(4)], [[] for _ in range(4)]

    def feed(self, piece: bytes) -> None:
        raw = np.frombuffer(piece, np.uint8)
        inside = ~np.isin(raw, np.frombuffer(_BETWEEN, np.uint8))
        number = self.count + np.cumsum(inside)  # of characters up to and with each byte
        begins = np.isin(raw, np.frombuffer(b"+/_-\n", np.uint8))
        self.starts += number[begins].tolist()
        body = piece.translate(_URLSAFE_BYTES, _BETWEEN)
        first, self.count = self.count, self.count + len(body)
        left = []
        for phase in range(4):
            have = self.rest[phase] + body[max(0, self.base[phase] - first) :] if not self.rest[phase] else self.rest[phase] + body
            n = len(have) // 4 * 4
            self._decoded(phase, base64.b64decode(have[:n]), left)
            self.rest[phase] = have[n:]
            self.base[phase] += n
        self.starts = sorted({s for s in left if s >= self.count - 8})

    def _decoded(self, phase: int, data: bytes, left: list[int]) -> None:
        for p in self.packed[phase]:
            p.feed(data)
        for s in dict.fromkeys(self.starts):
            j = (s - self.base[phase]) // 4 * 3
            if (s - phase) % 4 or j < 0:
                continue
            if j + 3 > len(data):
                left.append(s)
            elif _is_packed(data[j : j + 3]):
                self.packed[phase].append(_Packed(self.kinds))
                self.packed[phase][-1].feed(data[j:])
        self.packed[phase] = [p for p in self.packed[phase] if p.goes_on()]
        self.sieves[phase].feed(data)

    def close(self) -> None:
        for phase in range(4):
            rest = self.rest[phase]
            if len(rest) > 1:
                self._decoded(phase, base64.b64decode(rest + b"=" * (-len(rest) % 4)), [])
            for p in self.packed[phase]:
                p.close()
            self.sieves[phase].close()


class _Packed:
    """A zlib or gzip stream that comes piece by piece, and the streams that it holds at its start, however deep, up to where they end or break.

    A stream that begins as one that holds it does is taken for that one and is not unpacked again.
    """

    def __init__(self, kinds: set[str]):
        self.kinds, self.levels = kinds, []
        self._deeper()

    def _deeper(self) -> None:
        self.levels.append({"worker": zlib.decompressobj(47), "sieve": _Sieve(self.kinds), "mark": b"", "head": b"", "dead": False})

    def goes_on(self) -> bool:
        if self.levels[0]["dead"] or self.levels[0]["worker"].eof:
            self.close()
            return False
        return True

    def feed(self, data: bytes) -> None:
        todo = [(0, data)]
        while todo:
            i, data = todo.pop()
            own = self.levels[i]
            if own["dead"] or own["worker"].eof:
                continue
            if len(own["mark"]) < MARK:
                own["mark"] += data[: MARK - len(own["mark"])]
                if len(own["mark"]) == MARK and any(own["mark"] == above["mark"] for above in self.levels[:i]):
                    own["dead"] = True
                    continue
            try:
                out = own["worker"].decompress(data, STEP)
            except zlib.error:
                own["dead"] = True
                continue
            if own["worker"].unconsumed_tail:
                todo.append((i, own["worker"].unconsumed_tail))
            if not out:
                continue
            own["sieve"].feed(out)
            if own["head"] is not None:
                own["head"] += out
                if len(own["head"]) > 2:
                    out, own["head"] = own["head"], None
                    if _is_packed(out):
                        self._deeper()
                        todo.append((i + 1, out))
            elif i + 1 < len(self.levels):
                todo.append((i + 1, out))

    def close(self) -> None:
        for own in self.levels:
            own["sieve"].close()
            own["sieve"] = _Sieve(self.kinds)


class _Found(str):
    """Instead of a layer: the kind of a secret that was found in one whose characters have no places."""


def _base64(part: str, at: int) -> Iterator[Layer]:
    """What a run of base64 characters holds, read from each of its first four characters on.

    So whatever stands before a blob in the run, one of the four reads it in step; what is rubbish before a blob, or after
    it, ends at a break or does no harm. A compressed layer is sought at the start of the run and of its lines and after
    each separator; its characters have the whole blob as their source.
    """
    lines, places = [], []
    for m in re.finditer(r"[^\s=]+", part):
        lines.append(lines[-1] + len(places[-1]) if lines else 0)
        places.append(np.arange(at + m.start(), at + m.end()))
    where = np.concatenate(places)
    body = "".join(part[p[0] - at : p[-1] + 1 - at] for p in places)
    starts = sorted({*lines, *(m.end() for m in _BEFORE.finditer(body))})
    body, end = body.translate(_URLSAFE), at + len(part)
    for phase in range(4):
        n = len(body) - phase
        if n < 16:
            break
        raw = body[phase : len(body) - (n % 4 == 1)]
        data = base64.b64decode(raw + "=" * (-len(raw) % 4))
        for s in starts:
            if s % 4 == phase and _is_packed(data[(j := (s - phase) // 4 * 3) : j + 3]):
                stream = _Packed(set())
                stream.feed(data[j:])
                stream.close()
                for kind in sorted(stream.kinds):
                    yield _Found(kind), where[s : s + 1], np.array([end])
        byte = np.arange(len(data))
        yield from _through(_stretches(data), where[phase + byte * 4 // 3], where[np.minimum(phase + (byte * 8 + 7) // 6, len(where) - 1)] + 1)


def _layers(text: str) -> Iterator[Layer]:
    """What the parts of ``text`` hold one layer down, with positions in ``text``."""
    percent, escape = "%" in text, "\\" in text or "&#" in text
    if percent or escape:
        for m in _RUN.finditer(text):
            if percent and _PERCENT.search(m[0]):
                yield from _percent(m[0], m.start())
            if escape and _ESCAPE.search(m[0]):
                yield _escaped(m[0], m.start())
    for m in _BASE64.finditer(text):
        yield from _base64(m[0], m.start())


def all_spans(text: str, base: list[Span] | None = None) -> list[Span]:
    """The base spans and those found in nested layers, as spans of ``text``.

    A worklist holds decoded layers; each is scanned with the base patterns and unwrapped further
    until nothing new appears. A layer is taken up once for each place it comes from, so a text that
    decodes to itself ends. A span found in a layer covers the characters that the layer's span came from.
    """
    found = set(base_spans(text) if base is None else base)
    seen, work = {(0, len(text), _name(text))}, [_layers(text)]
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
            continue
        inner, low, high = layer
        if isinstance(inner, _Found):
            found.add((str(inner), int(low[0]), int(high[-1])))
            continue
        if not inner or (key := (int(low[0]), int(high[-1]), _name(inner))) in seen:
            continue
        seen.add(key)
        found.update((kind, int(low[a]), int(high[a:b].max())) for kind, a, b in base_spans(inner))
        work.append(_through(_layers(inner), low, high))
    return _sorted(list(found))


def _name(text: str) -> bytes | str:
    return text if len(text) < 64 else hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """``text`` with each maximal covered run replaced by ``mark``."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, text: str = "text", redact: bool = False) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, base_sha256 and spans; with ``redact`` the text without its secrets instead.

    A null text counts as empty (and stays null when redacting). Columns of these names are replaced,
    others pass through. Each row is scanned alone, a few MB of text at a time: no shuffle, and a lost task is done again.
    Empty texts have no spans. Time grows with the length of a text and of all that is packed in it, which may be a
    thousand times as long; of unpacked bytes a few MB are held at a time.
    """
    if redact:
        schema = docs.schema
    else:
        names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
        docs = docs.drop(*names)
        schema = extended(docs, n_assign="long", n_access="long", n_hex="long", base_sha256="string", spans="string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, text):
            at = b.schema.get_field_index(text)
            texts = b.column(at).to_pylist()
            if redact:
                new = [None if t is None else redacted(t, all_spans(t)) for t in texts]
                yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))
                continue
            cols: list[list] = [[], [], [], [], []]
            for t in texts:
                base = base_spans(t or "")
                kinds = [k for k, *_ in base]
                row = (*(kinds.count(k) for k in KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(all_spans(t or "", base)))
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            arrays = [pa.array(c, pa.int64() if i < 3 else pa.string()) for i, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], names=[*b.schema.names, *names])

    return docs.mapInArrow(run, schema)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: secrets by kind, a digest of the base spans, and all spans."""
    return scan(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
