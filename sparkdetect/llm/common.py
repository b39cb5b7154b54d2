"""What the operators of this subpackage share: the shared folder, stored tables and word hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.tables import shared_dir, stored  # noqa: F401


def extended(df: DataFrame, **columns: str) -> T.StructType:
    """The schema of ``df`` with further columns of the given types."""
    more = [T.StructField(name, T._parse_datatype_string(kind)) for name, kind in columns.items()]
    return T.StructType([*df.schema.fields, *more])


def sliced(batches: Iterator[pa.RecordBatch], column: str, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """``batches`` cut into runs of rows with about ``size`` bytes in ``column``, a row at least, so that what Python makes of them stays small."""
    for b in batches:
        lengths = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths, dtype=np.int64) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if e > s:
                yield b.slice(s, e - s)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: An odd multiplier for polynomial hashes modulo 2**64.
_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)
_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(n: int, base: int = _P) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; kept and grown by doubling."""
    have = _powers.get((base, 0))
    if have is None or len(have) <= n:
        size = max(1 << 12, 1 << int(n + 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        _powers[(base, 0)] = have
    return have[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(seed: int = 0) -> np.ndarray:
    """A value for each byte; other seeds give other hashes."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed))


_BYTES = byte_table()


def prefix_hash(data: np.ndarray, table: np.ndarray | None = _BYTES) -> np.ndarray:
    """Sums of value[i] * P**i over prefixes, one longer than ``data``."""
    values = data if table is None else table[data]
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values * powers(len(data))[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] that do not depend on where the span lies."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), _INVERSE)[start] + (end - start).astype(np.uint64))


def rolling_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all spans of ``width`` values, by start."""
    n = len(prefix) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((prefix[width:] - prefix[:n]) * powers(len(prefix), _INVERSE)[:n] + np.uint64(width))


#: Bytes that separate words: space and tab to carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 ``data``: maximal runs without ASCII white space."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
