"""Repeated strings of 100 bytes, by sorted suffix runs that are merged without comparing known prefixes again."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packed
from .common import documents, prefix_hash, rolling_hash, stored
from .packed import Chunk

WIDTH = 100
#: Strings of WIDTH bytes that hold a given place of an anchor: their keep flags fill one long.
SPREAD = 64
#: Bytes of an anchor. Every string of WIDTH bytes holds SPREAD runs of so many bytes; the one of least hash is its anchor.
GRAM = WIDTH - SPREAD + 1
#: Places of an anchor from which on its strings must show that they repeat, before they are sent.
HOT = 1000
#: Suffixes that a range has, about; chunks whose runs are merged at once; ranges that have a bound of their own at most.
MERGED, FAN, BOUNDS = 1 << 15, 1024, 4096
#: Bytes of text in a chunk. Copies of a text seldom meet in one chunk, however large; in small ones a task holds less.
CHUNK = 2 << 20
#: Anchors whose text is looked at for the bounds of the ranges, about: a sample by their hash.
SAMPLED = 1 << 16
#: Bytes that are hashed at a time.
PIECE = 1 << 18
_PLACE = np.uint64((1 << 28) - 1)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    full = np.full(-(-len(values) // width) * width, _ALL, np.uint64)
    full[: len(values)] = values
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _pieces(c: Chunk) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(place, bytes, starts, documents): pieces that overlap, with the strings of WIDTH bytes in one document that start in each."""
    for _, _, begin, raw in c.parts():
        data = np.frombuffer(raw, np.uint8)
        for s in range(0, len(data), PIECE):
            piece = data[s : s + PIECE + WIDTH - 1]
            start = np.arange(min(PIECE, len(data) - s))
            doc = np.searchsorted(c.ends, start + (begin + s), "right")
            whole = np.flatnonzero(c.ends[doc] - start - (begin + s) >= WIDTH)
            if len(whole):
                yield begin + s, piece, whole, doc[whole]


@dataclass
class Anchors:
    """A chunk's anchors: place, first and last string that has it, document, hash, and where each piece's anchors start."""

    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    cuts: list[int]


def anchors(c: Chunk) -> Anchors:
    found: list[list[np.ndarray]] = [[], [], [], [], []]
    cuts = [0]
    for begin, data, start, doc in _pieces(c):
        grams = rolling_hash(prefix_hash(data), GRAM)
        # the least hash, then the first place; places grow along the text, so equal strings agree on their anchor
        least = _least((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), SPREAD)
        anchor = (least[start] & _PLACE).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
        last = np.append(new[1:], len(start)) - 1
        for out, x in zip(found, (anchor[new] + begin, start[new] + begin, start[last] + begin, doc[new], grams[anchor[new]]), strict=True):
            out.append(x)
        cuts.append(cuts[-1] + len(new))
    empty = np.zeros(0, np.int64)
    return Anchors(*(np.concatenate(x) if x else empty.astype(np.uint64) if k == 4 else empty for k, x in enumerate(found)), cuts)


def _ask_anchors(c: Chunk, bits: int, buckets: int, rate: float) -> Iterator[dict]:
    """Bucket -1 takes the text of sampled anchors, all places of an anchor or none."""
    a = anchors(c)
    keys, first, count = np.unique(a.hash >> np.uint64(64 - bits), return_index=True, return_counts=True)
    yield from packed.questions(c.chunk, keys, [np.minimum(count, 255).astype(np.uint8)], bits, buckets)
    # the lower bits are as good as random, while keys and places of least hashes lean towards 0
    low = (a.hash[first] & np.uint64(0xFFFFFFF)).astype(float) / (1 << 28) < rate
    if low.any():
        at, count = a.at[first[low]], np.minimum(count[low], 255).astype(np.uint8)
        raw = b"".join(p for *_, p in c.parts())
        yield {"bucket": -1, "chunk": c.chunk, "keys": b"".join(raw[i : i + GRAM] for i in at.tolist()), "notes": count.tobytes()}


def _answer_anchors(keys: list[np.ndarray], notes: list[bytes], hot: int) -> list[np.ndarray]:
    """0: once in all; 1: repeated; 2: at ``hot`` places or more."""
    known, _, _, places = packed.counted(keys, notes)
    said = np.where(places >= hot, 2, (places > 1).astype(int))
    return [said[np.searchsorted(known, k)] for k in keys]


def _said(a: Anchors, answers: np.ndarray, bits: int) -> np.ndarray:
    _, which = np.unique(a.hash >> np.uint64(64 - bits), return_inverse=True)
    return answers[which] if len(which) else np.zeros(0, np.uint8)


def _hot(c: Chunk, a: Anchors, said: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings whose anchor is hot: the anchor's number and the string's hash; anchor by anchor, from low to high."""
    numbers, hashed = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for (begin, data, _, _), s, e in zip(_pieces(c), a.cuts, a.cuts[1:], strict=False):
        of = s + np.flatnonzero(said[s:e] == 2)
        if len(of):
            size = a.high[of] - a.low[of] + 1
            nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            numbers.append(np.repeat(of, size))
            hashed.append(rolling_hash(prefix_hash(data), WIDTH)[np.repeat(a.low[of] - begin, size) + nth] >> np.uint64(64 - bits))
    return np.concatenate(numbers), np.concatenate(hashed)


def _answer_twice(keys: list[np.ndarray], notes: list[bytes]) -> list[np.ndarray]:
    known, _, _, places = packed.counted(keys, notes)
    return [(places > 1)[np.searchsorted(known, k)] for k in keys]


@dataclass
class Suffixes:
    """Suffixes at anchors: the text from the anchor on (``right``), what stands before it backwards (``left``), both with their lengths, and the place.

    Lefts and rights are rows of bytes, zeros past their ends. The place is: no id, id, a hash of the text, chunk, anchor.
    """

    right: np.ndarray
    right_n: np.ndarray
    left: np.ndarray
    left_n: np.ndarray
    null: np.ndarray
    id: np.ndarray
    text: np.ndarray
    chunk: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return len(self.at)

    def take(self, i: np.ndarray) -> Suffixes:
        return Suffixes(*(getattr(self, f.name)[i] for f in fields(self)))

    def rank(self) -> np.ndarray:
        """Numbers in the order of places."""
        out = np.empty(len(self), np.int64)
        out[np.lexsort((self.at, self.chunk, self.text, self.id, self.null))] = np.arange(len(self))
        return out

    @staticmethod
    def joined(parts: list[Suffixes]) -> Suffixes:
        return Suffixes(*(np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(Suffixes)))


def _strings(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as values that numpy compares; those of equal value differ in their lengths alone."""
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


def _shared(rows: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The length that each row shares with the one before."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differs = np.concatenate([rows[1:] != rows[:-1], np.ones((len(rows) - 1, 1), bool)], 1).argmax(1)
        out[1:] = np.minimum(differs, np.minimum(n[1:], n[:-1]))
    return out


def _ragged(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> bytes:
    """The bytes of each row from low to high, one row after the other."""
    place = np.arange(rows.shape[1])
    return rows[(place >= low[:, None]) & (place < high[:, None])].tobytes()


def text_hash(raw: bytes) -> int:
    return int.from_bytes(hashlib.md5(raw).digest()[:4], "big")


def suffixes(c: Chunk, a: Anchors, low: np.ndarray, high: np.ndarray, of: np.ndarray) -> Suffixes:
    """Those that hold the strings from low to high, with anchor ``of``."""
    left = np.zeros((len(of), SPREAD - 1), np.uint8)
    right = np.zeros((len(of), WIDTH), np.uint8)
    at = a.at[of]
    left_n, right_n = (at - low).astype(np.uint8), (high + WIDTH - at).astype(np.uint8)
    digest = np.zeros(len(c.ends), np.uint32)
    cut = np.searchsorted(at, [int(c.starts[f]) for f in c.firsts] + [int(c.ends[-1]) + 1]) if len(c.ends) else []
    for (first, past, begin, raw), s, e in zip(c.parts(), cut, cut[1:], strict=False):
        for d in np.unique(a.doc[of[s:e]]).tolist():
            digest[d] = text_hash(raw[c.starts[d] - begin : c.ends[d] - begin])
        # zeros on both sides, so that a row of fixed length can be taken at each place
        data = np.zeros(len(raw) + WIDTH + SPREAD, np.uint8)
        data[SPREAD : SPREAD + len(raw)] = np.frombuffer(raw, np.uint8)
        here = at[s:e] - begin + SPREAD
        right[s:e] = np.lib.stride_tricks.sliding_window_view(data, WIDTH)[here]
        left[s:e] = np.lib.stride_tricks.sliding_window_view(data, SPREAD - 1)[here - (SPREAD - 1)][:, ::-1]
    right[np.arange(WIDTH) >= right_n[:, None]] = 0
    left[np.arange(SPREAD - 1) >= left_n[:, None]] = 0
    doc = a.doc[of]
    return Suffixes(right, right_n, left, left_n, c.nulls[doc].astype(np.uint8), c.ids[doc], digest[doc], np.full(len(of), c.chunk, np.int64), at)


def _in_order(s: Suffixes) -> np.ndarray:
    """By suffix, what stands before it, and place."""
    return np.lexsort((s.rank(), s.left_n, _strings(s.left), s.right_n, _strings(s.right)))


def _copies(s: Suffixes) -> np.ndarray:
    """Which of sorted ``s`` equal the one before: all of their strings stand at an earlier place."""
    same = np.zeros(len(s), bool)
    same[1:] = (s.right_n[1:] == s.right_n[:-1]) & (s.left_n[1:] == s.left_n[:-1]) & (s.right[1:] == s.right[:-1]).all(1) & (s.left[1:] == s.left[:-1]).all(1)
    return same


_PLACES = (("null", "u1"), ("id", "<i8"), ("text", "<u4"), ("chunk", "<i8"), ("at", "<i8"))


def write_run(s: Suffixes) -> bytes:
    """Sorted suffixes, front-coded: the length shared with the suffix before, and the rest."""
    shared = _shared(s.right, s.right_n.astype(np.int64))
    head = [len(s).to_bytes(4, "little"), shared.astype(np.uint8).tobytes(), s.right_n.tobytes(), s.left_n.tobytes(), *(getattr(s, n).astype(t).tobytes() for n, t in _PLACES)]
    return packed.squeeze(b"".join([*head, _ragged(s.right, shared, s.right_n.astype(np.int64)), _ragged(s.left, np.zeros(len(s), np.int64), s.left_n.astype(np.int64))]), 3)


@dataclass
class Run:
    """A run as written: suffixes, the length each shares with the one before, lefts with their lengths, and places."""

    suffixes: list[bytes]
    shared: list[int]
    left: np.ndarray
    left_n: np.ndarray
    places: dict[str, np.ndarray]


def read_run(data: bytes) -> Run:
    raw = packed.unsqueeze(data)
    n, at = int.from_bytes(raw[:4], "little"), 4
    columns = []
    for kind in ("u1", "u1", "u1", *(t for _, t in _PLACES)):
        columns.append(np.frombuffer(raw, kind, n, at))
        at += columns[-1].nbytes
    shared, right_n, left_n, *places = columns
    last, out = b"", []
    for s, m in zip(shared.tolist(), right_n.tolist(), strict=True):
        last = last[:s] + raw[at : at + m - s]
        at += m - s
        out.append(last)
    left = np.zeros((n, SPREAD - 1), np.uint8)
    left[np.arange(SPREAD - 1) < left_n[:, None]] = np.frombuffer(raw, np.uint8, offset=at)
    return Run(out, shared.tolist(), left, left_n, {name: x for (name, _), x in zip(_PLACES, places, strict=True)})


def shared_length(a: bytes, b: bytes, known: int) -> int:
    """The length of the common prefix, of which ``known`` bytes need no look."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


def merged(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, index, length shared with the suffix before) of all suffixes in order; a run is its suffixes and their shared lengths.

    A loser tree. Each run's next suffix knows how much it shares with the last one put out. Of two, the
    one that shares more comes first, without a look at the bytes; if they share the same, bytes are compared
    from there on, and the loser keeps what it shares with the winner. So no byte of a known prefix is seen twice.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[bytes | None] = [texts[0] if texts else None for texts, _ in runs] + [None] * (k - len(runs))
    known, index, tree = [0] * k, [0] * k, [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        n = shared_length(x, y, known[a])
        if x[n:] < y[n:] or x[n:] == y[n:] and a < b:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, tree[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    top = build(1) if k > 1 else 0
    while heads[top] is not None:
        yield top, index[top], known[top]
        index[top] += 1
        texts, shared = runs[top]
        if index[top] < len(texts):
            known[top], heads[top] = shared[index[top]], texts[index[top]]
        else:
            heads[top] = None
        node = (top + k) // 2
        while node:
            top, tree[node] = play(top, tree[node])
            node //= 2


def merge(runs: list[Run]) -> tuple[Suffixes, np.ndarray]:
    """All suffixes in order, and the length that each shares with the one before."""
    order = list(merged([(r.suffixes, r.shared) for r in runs]))
    which, index, shared = (np.array(x, np.int64) for x in zip(*order, strict=True)) if order else [np.zeros(0, np.int64)] * 3
    begin = np.cumsum([0, *(len(r.suffixes) for r in runs)])[which] + index
    texts = [runs[r].suffixes[i] for r, i, _ in order]
    right_n = np.array([len(t) for t in texts], np.uint8)
    right = np.zeros((len(texts), WIDTH), np.uint8)
    right[np.arange(WIDTH) < right_n[:, None]] = np.frombuffer(b"".join(texts), np.uint8)
    left, left_n = (np.concatenate([getattr(r, n) for r in runs])[begin] for n in ("left", "left_n"))
    return Suffixes(right, right_n, left, left_n, *(np.concatenate([r.places[n] for r in runs])[begin] for n, _ in _PLACES)), shared


def repeated(s: Suffixes, shared: np.ndarray) -> np.ndarray:
    """For each of sorted ``s`` the strings that stand at an earlier place too, as bits from the first string on.

    A string is d bytes before the anchor and WIDTH - d from it on. Suffixes next to each other that share WIDTH - d
    or more are one class on the right; of an anchor's lefts in order, those that share d are one on the left.
    Strings of both classes alike are equal, and all but the first place are repeats.
    """
    out = np.zeros(len(s), np.uint64)
    anchor = np.cumsum(shared < GRAM)
    alone = np.bincount(anchor, minlength=1)[anchor] < 2
    use = np.flatnonzero(~alone)
    if not len(use):
        return out
    # an anchor that is alone separates nothing that shares its GRAM bytes, so the shared lengths of the others stay
    s, shared, anchor, rank = s.take(use), shared[use], anchor[use], s.rank()[use]
    left_n, right_n = s.left_n.astype(np.int64), s.right_n.astype(np.int64)
    by = np.lexsort((left_n, _strings(s.left), anchor))
    before = _shared(s.left[by], left_n[by])
    other = np.concatenate([[True], anchor[by][1:] != anchor[by][:-1]])
    n, ranked = len(use) + 1, np.argsort(rank)
    mask, class_left = np.zeros(len(use), np.uint64), np.empty(len(use), np.int64)
    for d in range(SPREAD):
        has = ranked[(left_n[ranked] >= d) & (right_n[ranked] >= WIDTH - d)]
        if not len(has):
            continue
        class_left[by] = np.cumsum(other | (before < d))
        key = np.cumsum(shared < WIDTH - d)[has] * n + class_left[has]
        _, first = np.unique(key, return_index=True)
        later = np.ones(len(has), bool)
        later[first] = False
        has = has[later]
        mask[has] |= np.uint64(1) << (left_n[has] - d).astype(np.uint64)
    out[use] = mask
    return out


#: Groups in which answers pass through merges.
ANSWERS = 4096
#: kind 0: a run for the next merge; kind 1: a chunk's strings that are repeats.
MOVED = "kind int, bucket int, chunk long, data binary"
MOVED_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("data", pa.binary())])


def _answers(s: Suffixes, mask: np.ndarray) -> Iterator[dict]:
    """By chunk: first strings and bits. Their buckets are below 0, apart from those of runs."""
    use = np.flatnonzero(mask)
    use = use[np.argsort(s.chunk[use], kind="stable")]
    cuts = np.flatnonzero(np.diff(s.chunk[use], prepend=-1, append=-1)) if len(use) else []
    for a, b in zip(cuts, cuts[1:], strict=False):
        i = use[a:b]
        yield {"kind": 1, "bucket": -1 - int(s.chunk[i[0]]) % ANSWERS, "chunk": int(s.chunk[i[0]]), "data": packed.squeeze((s.at[i] - s.left_n[i]).astype("<i8").tobytes() + mask[i].tobytes())}


def _whole(s: Suffixes) -> np.ndarray:
    """Bits of all strings."""
    n = s.left_n.astype(np.uint64) + s.right_n.astype(np.uint64) - np.uint64(WIDTH) + np.uint64(1)
    return _ALL >> (np.uint64(SPREAD) - n)


def _moved(rows: Iterator[dict]) -> pa.Table:
    return pa.Table.from_pylist(list(rows), schema=MOVED_ARROW)


def _without_copies(s: Suffixes) -> tuple[Suffixes, list[dict]]:
    """Sorted ``s`` with one suffix of equal ones, and answers for the rest."""
    copies = _copies(s)
    gone = s.take(np.flatnonzero(copies))
    return s.take(np.flatnonzero(~copies)), list(_answers(gone, _whole(gone)))


def _runs(s: Suffixes, chunk: int, bounds: list[bytes], deep: int) -> Iterator[dict]:
    """A run for each range of suffixes; beyond ``BOUNDS`` ranges a range is dealt into ``deep`` by the anchor."""
    heads = s.right[:, :GRAM]
    cut = np.searchsorted(np.array(bounds, f"S{GRAM}"), _strings(heads), "right") if bounds else np.zeros(len(s), np.int64)
    if deep > 1:
        with np.errstate(over="ignore"):
            cut = cut * deep + (heads.astype(np.uint64) * np.arange(1, 2 * GRAM, 2, dtype=np.uint64) ** np.uint64(7)).sum(1).astype(np.int64) % deep
    by = np.argsort(cut, kind="stable")
    edge = [0, *(np.flatnonzero(np.diff(cut[by])) + 1).tolist(), len(by)]
    for a, b in zip(edge, edge[1:], strict=False):
        if b > a:
            yield {"kind": 0, "bucket": int(cut[by[a]]), "chunk": chunk, "data": write_run(s.take(by[a:b]))}


def _candidates(c: Chunk, answers: pa.Table, bits: int, wide: int) -> Suffixes:
    """A chunk's suffixes after the answers of kind 0 (anchors) and 1 (strings of hot anchors), sorted."""
    kind = answers.column("kind").to_numpy()
    a = anchors(c)
    said = _said(a, packed.replies(answers.filter(pa.array(kind == 0))), bits)
    of = np.flatnonzero(said == 1)
    low, high = a.low[of], a.high[of]
    if (said == 2).any():
        number, hashed = _hot(c, a, said, wide)
        twice = packed.replies(answers.filter(pa.array(kind == 1)))[np.unique(hashed, return_inverse=True)[1]] > 0
        new = np.concatenate([[True], number[1:] != number[:-1]])
        start = a.low[number] + np.arange(len(number)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        number, start = number[twice], start[twice]
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(start) > 1) | (np.diff(number) > 0)])) if len(start) else np.zeros(0, np.int64)
        end = start[np.append(cut[1:], len(start)) - 1] if len(start) else start
        of, low, high = np.concatenate([of, number[cut]]), np.concatenate([low, start[cut]]), np.concatenate([high, end])
        by = np.lexsort((low, a.at[of]))
        of, low, high = of[by], low[by], high[by]
    s = suffixes(c, a, low, high, of)
    return s.take(_in_order(s))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _cut(c: Chunk, found: list[bytes], texts: bool) -> Iterator[dict]:
    """A chunk's documents without what the answers say."""
    repeats = np.zeros(int(c.ends[-1]) + 1 if len(c.ends) else 1, np.uint8)
    for data in found:
        raw = packed.unsqueeze(data)
        low, mask = np.frombuffer(raw, "<i8", len(raw) // 16), np.frombuffer(raw, "<u8", offset=len(raw) // 2)
        for j in range(SPREAD):
            repeats[low[(mask >> np.uint64(j)) & np.uint64(1) > 0] + j] = 1
    for first, past, begin, raw in c.parts():
        data = np.frombuffer(raw, np.uint8)
        upto = np.cumsum(np.concatenate([np.zeros(WIDTH, np.uint8), repeats[begin : begin + len(data)]]), dtype=np.int32)
        lost = upto[WIDTH:] > upto[:-WIDTH]
        for d in range(first, past):
            own = slice(int(c.starts[d]) - begin, int(c.ends[d]) - begin)
            left, gone = data[own][~lost[own]].tobytes(), lost[own]
            spans = int(gone[:1].sum() + np.count_nonzero(gone[1:] & ~gone[:-1]))
            yield {"doc_id": None if c.nulls[d] else int(c.ids[d]), "n_bytes": len(gone), "n_removed": int(gone.sum()), "n_spans": spans, "kept_sha256": hashlib.sha256(left).hexdigest(), "kept": left if texts else None}


def _bounds(heads: DataFrame, rate: float) -> tuple[list[bytes], int]:
    """Bounds between ranges with about ``MERGED`` suffixes each, from the sampled anchors that repeat; and into how many a range is dealt beyond ``BOUNDS``."""

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, notes in zip(b.column("keys").to_pylist(), b.column("notes").to_pylist(), strict=True):
                head = [keys[i : i + GRAM] for i in range(0, len(keys), GRAM)]
                yield pa.RecordBatch.from_arrays([pa.array(head, pa.binary()), pa.array(np.frombuffer(notes, np.uint8).astype(np.int64))], names=["head", "n"])

    # bounded by the sample: a row for each distinct anchor in it
    got = heads.mapInArrow(single, "head binary, n long").groupBy("head").agg(F.sum("n").alias("n"), F.count("*").alias("chunks")).where("n > 1").collect()
    got = sorted((bytes(r["head"]), r["chunks"]) for r in got)
    upto = np.cumsum([n for _, n in got]) / max(rate, 1e-9)
    ranges = int(-(-(upto[-1] if len(upto) else 0) // MERGED)) or 1
    cuts = min(ranges, BOUNDS)
    at = {bisect_right(upto.tolist(), upto[-1] * k / cuts) for k in range(1, cuts)} if len(upto) else set()
    return sorted({got[i][0] for i in at if i < len(got)}), -(-ranges // cuts)


def without_repeats(docs: DataFrame, texts: bool = True, chunk_bytes: int = CHUNK, hot: int = HOT, fan: int = FAN) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row of ``docs`` (doc_id, text).

    A byte of a text's UTF-8 goes if a string of 100 bytes that covers it stands at an earlier place too: in a
    document of smaller doc_id, or earlier in the same. Null ids come last; rows of one id are ordered by a
    hash of their text, and equal rows one after the other. Null texts are empty. Strings do not cross
    documents. ``texts=False`` leaves ``kept`` null. Other columns than doc_id and text are left aside.

    Sorting all suffixes would move a hundred times the corpus. Of every string of 100 bytes one anchor of 37 is
    kept, the one of least hash, and equal strings have equal anchors. Anchors that no other place shares
    drop out by their hash, which never drops a repeat. The suffixes at the others are sorted in each chunk and
    go out as front-coded runs, one for each range of the global order; loser trees merge a range's runs, and the
    lengths that neighbours share, of suffixes and of what stands before them, say which strings are equal.
    Equal suffixes are one in a run, and runs of many chunks are merged ``fan`` at a time. Anchors at
    ``hot`` places or more (a line that many documents share) send only strings that are found twice by their
    hash, so what differs around such a line doesn't meet in one task.
    """
    table = stored(packed.chunks(docs, chunk_bytes))
    total, n_chunks = table.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count("*")).first()
    expected = total * 2 // (SPREAD + 1)
    bits, wide, buckets = packed.bits_for(expected), packed.bits_for(total), packed.buckets_for(expected)
    rate, runs_left = min(1.0, SAMPLED / max(expected, 1)), n_chunks
    rows = packed.dealt(table, "chunk", n_chunks)
    asked = stored(packed.asked(table, lambda c: _ask_anchors(c, bits, buckets, rate)))
    bounds, deep = _bounds(asked.where("bucket < 0").select("keys", "notes"), rate)
    zero = stored(packed.answered(asked.where("bucket >= 0"), lambda _, keys, notes: _answer_anchors(keys, notes, hot), buckets).withColumn("kind", F.lit(0)))

    def ask_hot(row: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[dict] = []
        if row.num_rows and answers.num_rows:
            c = packed.chunk_of(row)
            a = anchors(c)
            _, hashed = _hot(c, a, _said(a, packed.replies(answers), bits), wide)
            keys, count = np.unique(hashed, return_counts=True)
            out = list(packed.questions(c.chunk, keys, [np.minimum(count, 255).astype(np.uint8)], wide, buckets))
        return pa.Table.from_pylist(out, schema=packed.ASKED_ARROW)

    first = zero.union(stored(packed.answered(packed.by_chunk(rows, zero, ask_hot, packed.ASKED, n_chunks), lambda _, keys, notes: _answer_twice(keys, notes), buckets).withColumn("kind", F.lit(1))))

    def send(row: pa.Table, answers: pa.Table) -> pa.Table:
        if not (row.num_rows and answers.num_rows):
            return _moved(iter(()))
        c = packed.chunk_of(row)
        s, said = _without_copies(_candidates(c, answers, bits, wide))
        return _moved([*said, *_runs(s, c.chunk, bounds, deep)])

    moved = packed.by_chunk(rows, first, send, MOVED, n_chunks)
    ranges = (len(bounds) + 1) * deep

    # answers pass through the merges beside the runs, in groups of their own
    def halfway(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py():
            return table.select(MOVED_ARROW.names)
        s, _ = merge([read_run(d) for d in table.column("data").to_pylist()])
        s, said = _without_copies(s.take(_in_order(s)))
        return _moved([*said, {"kind": 0, "bucket": table.column("bucket")[0].as_py(), "chunk": min(table.column("chunk").to_pylist()), "data": write_run(s)}])

    def last(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py():
            return table.select(MOVED_ARROW.names)
        s, shared = merge([read_run(d) for d in table.column("data").to_pylist()])
        return _moved(_answers(s, repeated(s, shared)))

    while runs_left > fan:
        runs_left = -(-runs_left // fan)
        sent = moved.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(runs_left))).repartition(max(1, -(-ranges * runs_left // packed.TOGETHER)), "bucket", "part")
        moved = sent.groupBy("bucket", "part").applyInArrow(halfway, MOVED)
    ended = packed.dealt(moved, "bucket", ranges, 1).groupBy("bucket").applyInArrow(last, MOVED)

    def cut(row: pa.Table, answers: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(list(_cut(packed.chunk_of(row), answers.column("data").to_pylist(), texts)) if row.num_rows else [], schema=_RESULT)

    return packed.by_chunk(rows, ended.select("chunk", "data"), cut, RESULT, n_chunks)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by their bytes, nothing kept back; see ``without_repeats``."""
    return without_repeats(documents(spark, sf_dir), texts=False).drop("kept")
