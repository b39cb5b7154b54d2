"""SentencePiece models: encoding in a single pass over an Aho-Corasick automaton, and decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from importlib.util import find_spec
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, extended, sliced

#: The mark that stands for a space in pieces.
MARK = "▁"
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Segments whose ids and pairs of pieces whose fit a task keeps, and the longest of the segments in characters.
_KEPT, _KEPT_LENGTH = 300_000, 48
#: Fixed values of the model's format: kinds of models, and types of pieces.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def default_model() -> str:
    """The public 32k model, where it is installed."""
    return str(Path(find_spec("public_tokenizers").submodule_search_locations[0]) / "piece_bpe_32k.model")


def read_model(path: str) -> bytes:
    return Path(path).read_bytes()


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a message in the protobuf format."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, data[at : at + size]
        at += size


class Pieces:
    """A model's pieces; ``encode`` returns the ids that the model's own library gives.

    Characters are normalised as the model says. The automaton reports the pieces that end at each position, longest
    first, by its output links, and each tries to improve what is known there. For a unigram model that is
    the best sum of scores. For a model of merges it is the last piece of the prefix up to there: exactly one
    piece goes with the last piece of the prefix before it, in that merging the two texts together gives the two pieces again,
    and the pieces of a text are the right ones if and only if all neighbours go together.

    A character that is no piece may stand alone, at a score below all pieces, and is written as its bytes, or as the
    unknown piece where the model has none for bytes. Where pieces hold marks only at their start a text falls apart
    before each run of marks, and common segments are solved once. Of equal sums the piece that starts first stays (the library
    rounds its sums, so there it may be another).
    """

    def __init__(self, model: bytes):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        message = list(_fields(model))
        trainer, normal = (dict(_fields(b"".join(v for k, v in message if k == n))) for n in (2, 3))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("neither a unigram model nor one of merges")
        #: Only a mark in front and marks for spaces?
        self.plain = not normal.get(2) and normal.get(3, 1) == 1 and normal.get(4, 1) == 0 and normal.get(5, 1) == 1
        self.prefixed = normal.get(3, 1) == 1
        self.bytes: dict[int, int] = {}
        self.surface: list[bytes] = []
        self.auto, self.score, self.ids, self.unknown = ahocorasick.Automaton(), {}, {}, 0
        for i, raw in enumerate(v for k, v in message if k == 1):
            piece = dict(_fields(raw))
            text, kind = piece[1].decode(), piece.get(3, NORMAL)
            self.surface.append(text.replace(MARK, " ").encode() if kind in (NORMAL, UNUSED) else b"")
            if kind == BYTE:
                self.bytes[int(text[3:5], 16)] = i
                self.surface[-1] = bytes([int(text[3:5], 16)])
            elif kind == NORMAL:
                self.score[text], self.ids[text] = float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]), i
                self.auto.add_word(text, (len(text), text))
            elif kind == UNKNOWN:
                self.unknown, self.surface[-1] = i, " ⁇ ".encode()
            elif kind != CONTROL:
                raise ValueError("a model with pieces that the user set")
        self.auto.make_automaton()
        self.apart = all(MARK not in p.lstrip(MARK) for p in self.ids)
        self.other = min(self.score.values(), default=0.0) - 10
        self.known: dict[str, np.ndarray] = {}
        self.fits: dict[tuple[str, str], bool] = {}

    def _go_together(self, a: str, b: str) -> bool:
        """Does merging ``a + b`` from its characters on end with the two? Of all neighbours the best merge is next, then the first."""
        key = (a, b)
        if (known := self.fits.get(key)) is None:
            parts = list(a + b)
            while len(parts) > 2:
                ranked = [(-self.score[p], i) for i, p in enumerate(map(str.__add__, parts, parts[1:])) if p in self.score]
                if not ranked:
                    break
                i = min(ranked)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            known = parts == [a, b] and a + b not in self.score
            if len(self.fits) >= _KEPT:
                self.fits.clear()
            self.fits[key] = known
        return known

    def _by_merges(self, s: str) -> list[str]:
        """The last piece of each prefix of ``s``, for a model of merges."""
        last, fits, go = [""] * (len(s) + 1), self.fits, self._go_together
        for end, (n, piece) in self.auto.iter(s):
            end += 1
            if last[end]:
                continue
            before = end - n
            if before:
                # all that ends before is known; where nothing does, a character stands alone
                left = last[before] or s[before - 1]
                if (fit := fits.get((left, piece))) is None:
                    fit = go(left, piece)
                if not fit:
                    continue
            last[end] = piece
        return last

    def _by_scores(self, s: str) -> list[str]:
        """The last piece of the best sum of each prefix of ``s``, for a unigram model."""
        best: list[float] = [0.0] + [-np.inf] * len(s)
        last = [""] * (len(s) + 1)
        at, score = 0, self.score

        def alone(upto: int) -> None:
            """Characters that are no piece, up to there."""
            nonlocal at
            while at < upto:
                at += 1
                if s[at - 1] not in score and (total := best[at - 1] + self.other) > best[at]:
                    best[at], last[at] = total, s[at - 1]

        for end, (n, piece) in self.auto.iter(s):
            alone(end)
            end += 1
            if (total := best[end - n] + score[piece]) > best[end]:
                best[end], last[end] = total, piece
        alone(len(s))
        return last

    def single_pass(self, s: str) -> list[int]:
        """Ids of normalised ``s``."""
        last = self._by_merges(s) if self.kind == BPE else self._by_scores(s)
        out: list[int] = []
        at, lone, ids = len(s), False, self.ids
        while at:
            piece = last[at] or s[at - 1]
            at -= len(piece)
            known = ids.get(piece)
            if known is not None:
                out.append(known)
            elif self.bytes:
                out.extend(self.bytes[b] for b in reversed(piece.encode()))
            elif not (lone and self.kind == UNIGRAM):
                out.append(self.unknown)  # neighbours that are unknown to a unigram model are one
            lone = known is None
        return out[::-1]

    def _solved(self, segment: str) -> np.ndarray:
        if (out := self.known.get(segment)) is None:
            out = np.array(self.single_pass(segment), np.int32)
            if len(segment) <= _KEPT_LENGTH:
                if len(self.known) >= _KEPT:
                    self.known.clear()
                self.known[segment] = out
        return out

    def encode(self, text: str) -> np.ndarray:
        s = self.sp.normalize(text) if not self.plain else MARK + text.replace(" ", MARK) if text else ""
        segments = _SEGMENT.findall(s) if self.apart else [s]
        return np.concatenate([np.zeros(0, np.int32), *map(self._solved, segments)])

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids); null texts have none. Words between single spaces are looked up once for all texts."""
        texts = pc.fill_null(texts, "")
        if not (self.plain and self.apart):
            got = [self.encode(t) for t in texts.to_pylist()]
            return np.array([len(g) for g in got], np.int64), np.concatenate([np.zeros(0, np.int32), *got])
        words = pc.split_pattern(texts, " ")
        flat = pc.list_flatten(words)
        count = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        # marks elsewhere than at a word's start would belong to another segment; such texts are taken one by one
        odd = pc.or_(pc.equal(pc.binary_length(flat), 0), pc.match_substring(flat, MARK)).to_numpy(zero_copy_only=False)
        own = np.repeat(np.arange(len(texts)), count)
        alone = np.unique(own[odd])
        coded = flat.filter(pa.array(~np.isin(own, alone))).dictionary_encode()
        solved = [self._solved(MARK + w) for w in coded.dictionary.to_pylist()] + [self.encode(texts[i].as_py()) for i in alone.tolist()]
        which = np.empty(len(own), np.int64)
        plain = ~np.isin(own, alone)
        which[plain] = coded.indices.to_numpy()
        keep = plain | np.concatenate([[True], own[1:] != own[:-1]])[: len(own)]
        which[keep & ~plain] = len(coded.dictionary) + np.arange(len(alone))
        which, own = which[keep], own[keep]
        size = np.array([len(x) for x in solved], np.int64)
        begin, n = np.cumsum(size) - size, size[which]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[which], n)
        return np.bincount(own, n, len(texts)).astype(np.int64), np.concatenate([np.zeros(0, np.int32), *solved])[place]

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; control pieces are empty, the space of the mark in front goes, broken bytes become U+FFFD."""
        surface = self.surface
        out = b"".join([surface[i] for i in ids]).decode("utf-8", "replace")
        return out[1:] if self.prefixed and out[:1] == " " else out


@lru_cache(2)
def _pieces(model: bytes) -> Pieces:
    return Pieces(model)


def encode(docs: DataFrame, model: bytes, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add ``out``, the ids of each whole text; empty for a null or empty text. Columns of the new names are replaced.

    With ``decoded`` the ids are decoded again in the same pass, into a column of that name. Each row is
    encoded alone, a few MB of text at a time; the model (under a MB, read once by the driver) goes to tasks as a broadcast.
    """
    docs = docs.drop(out, *([decoded] if decoded else []))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(sent.value)
        for b in sliced(batches, text):
            count, ids = pieces.encode_all(b.column(b.schema.get_field_index(text)))
            ends = np.cumsum([0, *count])
            columns = [*b.columns, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))]
            if decoded:
                columns.append(pa.array([pieces.decode(ids[s:e].tolist()) for s, e in zip(ends, ends[1:], strict=False)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, out, *([decoded] if decoded else [])])

    return docs.mapInArrow(run, extended(docs, **{out: "array<int>"} | ({decoded: "string"} if decoded else {})))


def decode(rows: DataFrame, model: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``, the text of the ids; empty for null or no ids. A column of that name is replaced."""
    rows = rows.drop(out)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(sent.value)
        for b in batches:
            column = b.column(b.schema.get_field_index(ids))
            # a row at a time: a list of all numbers of a batch would take ten times their bytes
            texts = [pieces.decode(row.values.to_numpy(zero_copy_only=False).tolist() if row.is_valid else []) for row in column]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])

    return rows.mapInArrow(run, extended(rows, **{out: "string"}))


def op9_sentencepiece(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """All documents: ids, their number and hash, the decoded text's digest, and whether it is the text again (a mark in the text comes back as a space, so such texts do not)."""
    model = read_model(path or default_model())
    rows = encode(documents(spark, sf_dir).select("doc_id", "text"), model, decoded="decoded")
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.xxhash64("ids").alias("ids_hash"), F.sha2("decoded", 256).alias("decoded_sha256"), same.alias("round_trip"))
