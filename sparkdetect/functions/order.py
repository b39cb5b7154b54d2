"""Places and predecessors in the order of a key's rows, also where one key has very many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

#: Rows of one key that are still sorted in one task.
HOT_ROWS = 1 << 20


def _is_hot(df: DataFrame, keys: list[str]) -> bool:
    return bool(df.groupBy(*keys).count().where(F.col("count") > HOT_ROWS).limit(1).count())


def _ranges(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Stored in ranges of keys and order, with the range's number as ``_part``; so a key lies in ranges that follow each other."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str, total: str | None = None) -> DataFrame:
    """Add the place of each row among its key's, from 1, and with ``total`` their number.

    Where a key has more than ``HOT_ROWS`` rows all are dealt by ranges of key and order: each range numbers its own rows
    and a table with a row for each range and key tells how many came before. Rows that agree in key and order take any
    order among themselves.
    """
    if not _is_hot(df, keys):
        own = Window.partitionBy(*keys)
        out = df.withColumn(name, F.row_number().over(own.orderBy(*order)).cast("long"))
        return out.withColumn(total, F.count("*").over(own)) if total else out
    dealt = _ranges(df, keys, order)
    at, along, whole = ["_part", *keys], Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    counts = dealt.groupBy(*at).agg(F.count("*").alias("_n"))
    before = counts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(at)], F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_all"))
    rows = dealt.withColumn("_own", F.row_number().over(Window.partitionBy(*at).orderBy(*order)))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(at)]
    out = rows.join(before, same, "left").withColumn(name, F.col("_before") + F.col("_own"))
    out = out.withColumn(total, F.col("_all")) if total else out
    return out.select(*[c for c in df.columns if c not in (name, total)], name, *([total] if total else []))


def with_previous(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str]) -> DataFrame:
    """Add, under the names of ``columns``, values of the row before in the order of the row's key; null for the first.

    Where a key has more than ``HOT_ROWS`` rows all are dealt by ranges, and what the last row of each range has is
    carried over to the next.
    """
    if not _is_hot(df, keys):
        own = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({new: F.lag(c).over(own) for new, c in columns.items()})
    dealt = _ranges(df, keys, [F.col(c) for c in order])
    at, along = ["_part", *keys], Window.partitionBy(*keys).orderBy("_part")
    own = Window.partitionBy(*at).orderBy(*order)
    last = dealt.groupBy(*at).agg(F.max_by(F.struct(*columns.values()), F.struct(*order)).alias("_last"))
    carried = last.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(at)], F.lag("_last").over(along).alias("_carried"))
    rows = dealt.withColumns({f"_own_{c}": F.lag(c).over(own) for c in columns.values()}).withColumn("_first", F.row_number().over(own) == 1)
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(at)]
    out = rows.join(carried, same, "left").withColumns({new: F.when(F.col("_first"), F.col(f"_carried.{c}")).otherwise(F.col(f"_own_{c}")) for new, c in columns.items()})
    return out.select(*[c for c in df.columns if c not in columns], *columns)
