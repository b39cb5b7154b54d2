"""Fill-in-middle: texts cut at line boundaries into prefix, middle and suffix, in an order that is marked."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, extended, sliced

SENTINELS = ("<P>", "<S>", "<M>")
#: Offsets that share a container, and the bytes of a bitmap over them.
SPAN, BITMAP_BYTES = 1 << 16, 1 << 13


class Boundaries:
    """A set of offsets: containers of 2**16 values each, as sorted array, bitmap or runs, whichever is smallest.

    ``upto`` has the number of offsets before each container, so the k-th offset is found by a search for its container
    and a select inside it.
    """

    def __init__(self, offsets: np.ndarray):
        """``offsets``: distinct, ascending."""
        high = offsets // SPAN
        first = np.flatnonzero(np.diff(high, prepend=-1))
        self.upto = np.append(first, len(offsets))
        self.base = high[first] * SPAN
        self.parts = [self._packed((offsets[s:e] - b).astype(np.uint16)) for s, e, b in zip(first, self.upto[1:], self.base, strict=True)]

    @staticmethod
    def _packed(low: np.ndarray) -> tuple:
        starts = np.flatnonzero(np.diff(low.astype(np.int32), prepend=-2) != 1)
        size = {"array": 2 * len(low), "bitmap": BITMAP_BYTES, "runs": 4 * len(starts)}
        kind = min(size, key=size.get)
        if kind == "array":
            return kind, low
        if kind == "runs":
            return kind, low[starts], starts
        bits = np.zeros(SPAN, np.uint8)
        bits[low] = 1
        words = np.packbits(bits, bitorder="little").view("<u8")
        return kind, words, np.cumsum(np.bitwise_count(words), dtype=np.int64)

    def __len__(self) -> int:
        return int(self.upto[-1])

    def select(self, k: int) -> int:
        """The k-th offset, from 0."""
        i = int(np.searchsorted(self.upto, k, "right")) - 1
        return int(self.base[i]) + self._select(self.parts[i], k - int(self.upto[i]))

    @staticmethod
    def _select(part: tuple, k: int) -> int:
        kind, values, *counts = part
        if kind == "array":
            return int(values[k])
        if kind == "runs":
            i = int(np.searchsorted(counts[0], k, "right")) - 1
            return int(values[i]) + k - int(counts[0][i])
        i = int(np.searchsorted(counts[0], k, "right"))
        left, word = k - (int(counts[0][i - 1]) if i else 0), int(values[i])
        for _ in range(left):
            word &= word - 1
        return 64 * i + (word & -word).bit_length() - 1


def boundaries(text: str) -> Boundaries:
    """Where lines start, and the end of the text, in code points."""
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") == 10) + 1
    return Boundaries(np.unique(np.concatenate([[0], ends, [len(text)]])))


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four 32-bit numbers that depend on the seed and the id alone."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[8 * i : 8 * i + 8], 16) for i in range(4))


def transformed(text: str, numbers: tuple[int, int, int, int], rate: int, spm_rate: int, marks: tuple[str, str, str] = SENTINELS) -> tuple[int, str, int | None, int | None, str]:
    """(lines, form, code points of prefix and of middle, output) of one text."""
    h1, h2, h3, h4 = numbers
    ends = boundaries(text)
    n = len(ends) - 1
    if not text or any(m in text for m in marks) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((ends.select(h1 % (n + 1)), ends.select(h2 % (n + 1))))
    prefix, middle, suffix, (p, s, m) = text[:a], text[a:b], text[b:], marks
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def restored(output: str, form: str, marks: tuple[str, str, str] = SENTINELS) -> str:
    """The text that ``transformed`` was given, from its output and form. Marks are unambiguous, as only texts without them are cut."""
    p, s, m = marks
    if form == "plain":
        return output
    first, second = (p, s) if form == "psm" else (s, p)
    one, _, rest = output[len(first) :].partition(second)
    two, _, middle = rest.partition(m)
    return one + middle + two if form == "psm" else two + middle + one


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, text: str = "text", marks: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Add n (lines), form (plain, psm, spm), prefix_chars, middle_chars and output to ``docs``, a row for each row.

    ``rate`` and ``spm_rate`` are percentages; cuts depend on the seed and doc_id, so rows that share an id and a text
    come out equal. A null text counts as empty, a null doc_id as an empty number. Empty texts, texts that hold a mark
    and those that are not drawn stay plain, with null lengths. Other columns pass through; columns of these names are
    replaced.
    """
    docs = docs.drop("n", "form", "prefix_chars", "middle_chars", "output")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, text):
            made = [transformed(t or "", draws(seed, i), rate, spm_rate, marks) for i, t in zip(b.column("doc_id").to_pylist(), b.column(text).to_pylist(), strict=True)]
            n, form, before, inside, output = zip(*made, strict=True)
            arrays = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(inside, pa.int64()), pa.array(output, pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], names=[*b.schema.names, "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.mapInArrow(run, extended(docs, n="bigint", form="string", prefix_chars="bigint", middle_chars="bigint", output="string"))


def with_digests(rows: DataFrame, marks: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Add output_sha256 and restored_sha256, of the text rebuilt from output and form alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in sliced(batches, "output"):
            pairs = list(zip(b.column("output").to_pylist(), b.column("form").to_pylist(), strict=True))
            arrays = [pa.array([sha(o) for o, _ in pairs], pa.string()), pa.array([sha(restored(o, f, marks)) for o, f in pairs], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], names=[*b.schema.names, "output_sha256", "restored_sha256"])

    return rows.mapInArrow(run, extended(rows, output_sha256="string", restored_sha256="string"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, cut and put together again; outputs as digests."""
    rows = fill_in_middle(documents(spark, sf_dir).select("doc_id", "text"))
    return with_digests(rows.drop("text")).drop("output")


ORACLE = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), drawn AS (
  SELECT *, len(units)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS u, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS v,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT *, array_to_string(units[1:least(u, v)], '') AS p, array_to_string(units[least(u, v) + 1:greatest(u, v)], '') AS m,
         array_to_string(units[greatest(u, v) + 1:], '') AS s
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
