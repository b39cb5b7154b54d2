"""Contiguous shards of nearly equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, partitions, stored


def shard_by_bytes(rows: DataFrame, shards: int, size: str = "size", order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add ``shard`` and ``slot`` to ``rows``: contiguous runs in ``order``, cut at equal targets of ``size``.

    The rows are range partitioned, each partition is summed, the sums of the partitions give every
    partition its offset, and a running sum inside the partition gives each row its global offset. A row
    belongs to the shard in which the middle of its bytes falls; ``slot`` counts from 0 inside a shard.
    Nulls in ``order`` come last. Rows that agree in all of ``order`` take any order among themselves. An
    empty table gives an empty table; sizes must be positive. Other columns pass through.
    """
    n = partitions(rows.sparkSession)
    keys = [F.col(c).asc_nulls_last() for c in order]
    # the last key splits runs of equal rows, so that no range holds them all
    dealt = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(n, *keys, F.col("_at"))
    dealt = stored(dealt.withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy("_part").agg(F.sum(size).alias("_bytes"), F.count("*").alias("_rows"))
    # a row for each partition: the one window below without a key sees no more than that
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(Window.partitionBy()).alias("_all"),
    )
    inside = Window.partitionBy("_part").orderBy(*keys, "_at")
    placed = (
        dealt.withColumn("_sum", F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_rank", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_part")
        .withColumn("_middle", 2 * (F.col("_bytes_before") + F.col("_sum")) - F.col(size))
        .withColumn("shard", F.least(F.expr(f"_middle * {shards} div (2 * _all)"), F.lit(shards - 1)).cast("int"))
        .withColumn("_global", F.col("_rows_before") + F.col("_rank"))
    )
    placed = stored(placed.drop("_at", "_bytes_before", "_rows_before", "_all", "_sum", "_rank", "_middle", "_part"))
    first = placed.groupBy("shard").agg(F.min("_global").alias("_first"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("_global") - F.col("_first")).drop("_global", "_first")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (bytes of the text and 1; a null text has none) and text_crc32 (0 for a null text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))


def op1_sharding(spark: SparkSession, sf_dir: str, shards: int = 8) -> DataFrame:
    """All documents in shards 0 to 7 by bytes, contiguous in (doc_id, size, text_crc32)."""
    rows = shard_by_bytes(sized(documents(spark, sf_dir)), shards, order=("doc_id", "size", "text_crc32"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: DuckDB has no crc32: the table of the reflected polynomial and a fold over the bytes stand for it.
ORACLE = """
WITH RECURSIVE steps(n, c, k) AS (
  SELECT n, n::BIGINT, 0 FROM range(256) t(n)
  UNION ALL
  SELECT n, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (SELECT list(c ORDER BY n) AS t FROM steps WHERE k = 8
), texts AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents
), sums AS (
  SELECT text, xor(4294967295, list_reduce(
      [4294967295] || [('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::BIGINT FOR i IN range(strlen(text))],
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS text_crc32
  FROM texts, crc
), sized AS (
  SELECT doc_id, (strlen(s.text) + 1)::BIGINT AS size, text_crc32 FROM documents d JOIN sums s ON coalesce(d.text, '') = s.text
), placed AS (
  SELECT *, row_number() OVER w AS g, sum(size) OVER w AS upto, sum(size) OVER () AS total
  FROM sized WINDOW w AS (ORDER BY doc_id NULLS LAST, size, text_crc32 ROWS UNBOUNDED PRECEDING)
), cut AS (SELECT *, least((2 * upto - size) * 8 // (2 * total), 7)::INT AS shard FROM placed)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard, (g - min(g) OVER (PARTITION BY shard))::BIGINT AS slot,
       NULL::INT AS grown_shard
FROM cut
"""
