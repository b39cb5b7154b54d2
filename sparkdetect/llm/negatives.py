"""Hard negatives: of other labels the rows next below each positive, by codes of one bit and exact scores."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, stored

#: Codes of a vector, each of what the ones before leave over; bits of a rotated query's component.
CODES, QUERY_BITS = 4, 6
#: Rows that a task holds at most while queries pass by, and the pairs that it estimates at once.
BLOCK_ROWS, PAIRS = 1 << 19, 1 << 20
#: Rows for each anchor, about: decides into how many blocks rows and anchors are cut.
ROWS_PER_ANCHOR = 50
#: Components are taken to lie within this, so that scores of up to 2,048 of them fit 64 bits.
MOST = 1 << 26


@lru_cache(2)
def rotation(dims: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(12).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def bits(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    n, d = signs.shape
    wide = np.zeros((n, -(-d // 64) * 64), np.uint8)
    wide[:, :d] = signs
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")


def encoded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, alignments, rest) of rotated vectors.

    The first code has the signs of the vector's components; as a vector of length 1 it is aligned with the vector by
    their inner product, which is stored. What that leaves over is at right angles to the code and is coded in turn.
    ``rest``: the length of what all codes leave over.
    """
    left, d = vectors @ rotation(vectors.shape[1]), vectors.shape[1]
    codes, along = [], []
    for _ in range(CODES):
        up = left >= 0
        code = np.where(up, 1.0, -1.0) / math.sqrt(d)
        a = np.einsum("ij,ij->i", left, code)
        codes.append(bits(up))
        along.append(a)
        left = left - a[:, None] * code
    return np.stack(codes, 1), np.stack(along, 1), np.linalg.norm(left, axis=1)


class Block:
    """Rows with their codes; answers which of them may score within given bounds."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, ints: np.ndarray, codes: np.ndarray, along: np.ndarray, rest: np.ndarray):
        order = np.argsort(labels, kind="stable")
        self.ids, self.labels, self.ints, self.codes, self.along, self.rest = (x[order] for x in (ids, labels, ints, codes, along, rest))
        self.ones = np.bitwise_count(self.codes).sum(2, dtype=np.float64)
        self.length = np.linalg.norm(self.ints.astype(np.float64), axis=1)
        self.most = float(np.abs(self.ints).max(initial=0))

    def intervals(self, queries: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """(estimates, half widths) of the scores of ``queries`` with ``rows``; every score lies within.

        The query is rotated and rounded to a few bits for each component, and estimated by popcounts of its bit planes
        with the codes. By Cauchy and Schwarz the query's part along the rest is at most the product of their lengths,
        and the rounding's at most its length times the coded part's.
        """
        d = queries.shape[1]
        turned = queries @ rotation(d)
        low = turned.min(1, keepdims=True)
        step = np.maximum((turned.max(1, keepdims=True) - low) / ((1 << QUERY_BITS) - 1), 1e-12)
        levels = np.rint((turned - low) / step).astype(np.int64)
        rounded = low + step * levels
        error, total = np.linalg.norm(turned - rounded, axis=1), rounded.sum(1)
        codes, along, ones = self.codes[rows], self.along[rows], self.ones[rows]
        estimate = np.zeros((len(queries), len(along)))
        planes = [bits(levels >> p & 1 != 0) for p in range(QUERY_BITS)]
        for k in range(CODES):
            counted = np.zeros(estimate.shape, np.int32)
            for p, plane in enumerate(planes):
                for w in range(codes.shape[2]):
                    counted += np.bitwise_count(plane[:, w, None] & codes[None, :, k, w]).astype(np.int32) << p
            inner = (2 * (low * ones[None, :, k] + step * counted) - total[:, None]) / math.sqrt(d)
            estimate += along[None, :, k] * inner
        length = np.linalg.norm(queries, axis=1)
        half = length[:, None] * self.rest[None, rows] + error[:, None] * (self.length + self.rest)[None, rows]
        return estimate, half * (1 + 1e-9) + 1e-9 * length[:, None] * self.length[None, rows] + 1e-6

    def scores(self, query: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact inner products of whole numbers."""
        own = self.ints[at]
        if self.most * float(np.abs(query).max(initial=0)) * max(1, len(query)) < 1 << 53:
            return (own.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
        return own @ query

    def best(self, at: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
        """Places in ``at`` of the n highest scores, ties by smaller id."""
        if len(at) > n:
            least = np.partition(scores, len(scores) - n)[len(scores) - n]
            keep = np.flatnonzero(scores >= least)
        else:
            keep = np.arange(len(at))
        return keep[np.lexsort((self.ids[at[keep]], -scores[keep]))[:n]]

    def batches(self, n: int, rows: int) -> Iterator[slice]:
        size = max(1, PAIRS // max(1, rows))
        yield from (slice(i, i + size) for i in range(0, n, size))

    def same_label(self, ids: np.ndarray, labels: np.ndarray, ints: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
        """(query, row's id, score) of the n best other rows of each query's label."""
        for label in np.unique(labels):
            rows = slice(*np.searchsorted(self.labels, [label, label + 1]).tolist())
            mine = np.flatnonzero(labels == label)
            for part in self.batches(len(mine), rows.stop - rows.start) if rows.stop > rows.start else ():
                some = mine[part]
                estimate, half = self.intervals(ints[some].astype(np.float64), rows)
                other = ids[some, None] != self.ids[None, rows]
                lower, upper = np.where(other, estimate - half, -np.inf), np.where(other, estimate + half, -np.inf)
                k = lower.shape[1] - n
                bound = np.partition(lower, k, axis=1)[:, k] if k >= 0 else np.full(len(some), -np.inf)
                for i, q in enumerate(some):
                    at = np.flatnonzero((upper[i] >= bound[i]) & other[i]) + rows.start
                    scores = self.scores(ints[q], at)
                    yield from ((int(q), int(self.ids[at[j]]), int(scores[j])) for j in self.best(at, scores, n))

    def other_labels(self, labels: np.ndarray, ints: np.ndarray, windows: list[list[tuple[int, int]]], n: int) -> Iterator[tuple[int, int, int, int]]:
        """(query, window, row's id, score) of the n best rows of other labels whose score lies in each of the query's windows, ends included."""
        rows = slice(0, len(self.ids))
        for part in self.batches(len(labels), len(self.ids)):
            estimate, half = self.intervals(ints[part].astype(np.float64), rows)
            for i, q in enumerate(range(part.start, part.start + len(estimate))):
                other, lower, upper = self.labels != labels[q], estimate[i] - half[i], estimate[i] + half[i]
                may = np.zeros(len(other), bool)
                for least, most in windows[q]:
                    sure = lower[other & (lower >= least) & (upper <= most)]
                    if len(sure) >= n:
                        least = max(least, np.partition(sure, len(sure) - n)[len(sure) - n])
                    may |= (upper >= least) & (lower <= most)
                at = np.flatnonzero(may & other)
                scores = self.scores(ints[q], at)
                for k, (least, most) in enumerate(windows[q]):
                    inside = np.flatnonzero((scores >= least) & (scores <= most))
                    yield from ((q, k, int(self.ids[at[j]]), int(scores[j])) for j in inside[self.best(at[inside], scores[inside], n)])


#: Stands for a null id among whole numbers: the largest, so that it comes last.
_NO_ID = (1 << 63) - 1
_CODED = "node string, vec_id bigint, label bigint, ints binary, codes binary, along binary, rest double"


def whole_numbers(rows: DataFrame, vector: str, factor: int) -> DataFrame:
    """vec_id, label and ints of the rows that have a label and a vector without null or non-finite components."""
    x = F.col(vector).cast("array<double>")
    whole = F.col("label").isNotNull() & F.col(vector).isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))
    limit = lambda v: F.greatest(F.least(F.floor(factor * F.greatest(F.least(v, F.lit(1e9)), F.lit(-1e9))), F.lit(MOST)), F.lit(-MOST)).cast("int")
    return rows.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(x, limit).alias("ints"))


def coded(rows: DataFrame, dims: int) -> DataFrame:
    """Rows with codes, alignments and rests; shorter vectors are filled up with zeros. ``node`` stands for id, label and vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for s in range(0, big.num_rows, 4096):
                b = big.slice(s, 4096)
                column = b.column("ints")
                lengths = np.diff(column.offsets.to_numpy())
                ints = np.zeros((b.num_rows, dims), np.int32)
                ints[np.arange(dims)[None, :] < lengths[:, None]] = column.flatten().to_numpy()
                codes, along, rest = encoded(ints.astype(np.float64))
                raw = lambda a: pa.array([row.tobytes() for row in a], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("node"), b.column("vec_id"), b.column("label"), raw(ints), raw(codes), raw(along), pa.array(rest, pa.float64())], names=["node", "vec_id", "label", "ints", "codes", "along", "rest"])

    node = F.md5(F.to_json(F.struct("vec_id", "label", "ints")))
    return rows.select(node.alias("node"), "vec_id", "label", "ints").mapInArrow(run, _CODED)


def _matrix(column: pa.Array, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _cells(rows: DataFrame, queries: DataFrame, n_rows: int) -> DataFrame:
    """Each row with each query in one cell of a grid, a cell's rows before its queries.

    Rows go to ``groups`` places and queries to ``blocks``; for a given number of tasks this moves least.
    """
    tasks = partitions(rows.sparkSession)
    blocks = max(-(-n_rows // BLOCK_ROWS), min(tasks, round(math.sqrt(tasks * ROWS_PER_ANCHOR))), 1)
    groups = max(1, round(tasks / blocks))
    number = F.monotonically_increasing_id()
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = rows.select((number % blocks).cast("int").alias("block"), every(groups).alias("group"), F.lit(0).alias("kind"), *[F.col(c) for c in rows.columns])
    asked = queries.select(every(blocks).alias("block"), (number % groups).cast("int").alias("group"), F.lit(1).alias("kind"), *[F.col(c) for c in queries.columns])
    return held.unionByName(asked, allowMissingColumns=True).repartition(blocks * groups, "block", "group").sortWithinPartitions("block", "group", "kind")


def _searched(cells: DataFrame, dims: int, ask, schema: str) -> DataFrame:
    """``ask(block, queries)`` gives the columns of the answers; a block is whole before its first query comes, queries come a few thousand at a time."""
    words = -(-dims // 64)

    def block(parts: list[pa.RecordBatch]) -> Block:
        t = pa.Table.from_batches(parts).combine_chunks()
        col = lambda name: t.column(name).combine_chunks()
        return Block(_ids(col("vec_id")), col("label").to_numpy(), _matrix(col("ints"), "<i4", dims), _matrix(col("codes"), "<u8", CODES, words), _matrix(col("along"), "<f8", CODES), col("rest").to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts, own = None, [], None
        for b in batches:
            key = np.stack([b.column(c).to_numpy() for c in ("block", "group", "kind")], 1)
            cuts = [0, *(np.flatnonzero((np.diff(key, axis=0) != 0).any(1)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if e == s:
                    continue
                if tuple(key[s, :2]) != cell:
                    cell, parts, own = tuple(key[s, :2]), [], None
                if key[s, 2] == 0:
                    parts.append(b.slice(s, e - s).select(["vec_id", "label", "ints", "codes", "along", "rest"]))
                elif parts or own:
                    own = own or block(parts)
                    parts = []
                    yield ask(own, b.slice(s, e - s))

    return cells.mapInArrow(run, schema)


def hard_negatives(rows: DataFrame, anchor: Column, vector: str = "embedding", factor: int = 256, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows where ``anchor`` holds.

    Components become floor(``factor`` * x); a score is the inner product of those whole numbers. An anchor's positives
    are its best ``positives`` rows of the same label and another vec_id; for each positive come the best ``negatives``
    rows of other labels whose score is from ``least`` to ``most`` hundredths of the positive's. Higher scores come
    first, ties by smaller vec_id, null ids last.

    Rows with a null label or vector, or with a null or non-finite component, take no part; an empty vector scores 0;
    vectors of unequal length are filled up with zeros; components beyond 2**26 count as that. Rows that share a vec_id
    are never each other's positives, else each counts for itself; anchors equal in all are one anchor. Without anchors
    or rows the result is empty. Other columns are ignored.

    Rows are held in blocks, and all anchors pass by each block, so work is anchors times rows; what comes out of a
    block is a few rows for each anchor. No row is skipped but by an interval that shows it is not among the best.
    """
    whole = whole_numbers(rows, vector, factor)
    n_rows, dims = whole.agg(F.count("*"), F.coalesce(F.max(F.size("ints")), F.lit(0))).first()
    dims = max(1, dims)
    held = stored(coded(whole, dims))
    anchors = held.where(anchor).dropDuplicates(["node"]).select("node", "vec_id", "label", "ints")

    def same(block: Block, b: pa.RecordBatch) -> pa.RecordBatch:
        got = list(block.same_label(_ids(b.column("vec_id")), b.column("label").to_numpy(), _matrix(b.column("ints"), "<i4", dims).astype(np.int64), positives))
        q, other, score = zip(*got, strict=True) if got else ((), (), ())
        return _answers(b, q, ["node"], other_id=other, score=score)

    def others(block: Block, b: pa.RecordBatch) -> pa.RecordBatch:
        near = b.column("near").to_pylist()
        windows = [[(-(-least * p["score"] // 100), most * p["score"] // 100) for p in some] for some in near]
        got = list(block.other_labels(b.column("label").to_numpy(), _matrix(b.column("ints"), "<i4", dims).astype(np.int64), windows, negatives))
        q, k, other, score = zip(*got, strict=True) if got else ((), (), (), ())
        picked = [near[i][j] for i, j in zip(q, k, strict=True)]
        return _answers(b, q, ["node", "vec_id"], other_id=other, score=score, place=[p["place"] for p in picked], positive_id=[p["other_id"] for p in picked], positive_score=[p["score"] for p in picked])

    found = _searched(_cells(held, anchors, n_rows), dims, same, "node string, other_id bigint, score bigint")
    by = Window.partitionBy("node").orderBy(F.col("score").desc(), F.col("other_id").asc_nulls_last())
    near = found.withColumn("place", F.row_number().over(by)).where(F.col("place") <= positives).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("place", "other_id", "score"))).alias("near"))
    asked = stored(anchors.join(near, "node"))
    found = _searched(_cells(held, asked, n_rows), dims, others, "node string, vec_id bigint, other_id bigint, score bigint, place int, positive_id bigint, positive_score bigint")
    by = Window.partitionBy("node", "place").orderBy(F.col("score").desc(), F.col("other_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= negatives)
    return best.select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _answers(b: pa.RecordBatch, q: tuple, keep: list[str], **columns) -> pa.RecordBatch:
    """The queries' own columns beside what was found for them."""
    at = pa.array(q, pa.int64())
    ids = {"other_id", "positive_id"}
    values = [pa.array([None if v == _NO_ID else v for v in c] if n in ids else c, pa.int32() if n == "place" else pa.int64()) for n, c in columns.items()]
    return pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in keep), *values], names=[*keep, *columns])


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings; anchors are the rows whose vec_id is divisible by 50. Where it is divisible by 7 the label is the next one, modulo 10."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q, row_number() OVER () AS r
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.r, a.vec_id AS anchor_id, o.vec_id AS other_id, a.label = o.label AS same, list_dot_product(a.q, o.q)::BIGINT AS score
  FROM whole a JOIN whole o ON a.vec_id % 50 = 0 AND a.r <> o.r
), positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.other_id AS positive_id, row_number() OVER w::INT AS rank, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.r = n.r AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.r, p.other_id ORDER BY n.score DESC, n.other_id)
QUALIFY row_number() OVER w <= 3
"""
