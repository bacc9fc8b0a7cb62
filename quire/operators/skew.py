"""Joins and numbering on keys of which a few hold much of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import written

#: A key is hot from this share of all rows on, so that there are at most 1 / HOT hot keys, whatever the size: their list may be broadcast.
HOT = 1 / 200
SALTS = 64


def hot_keys(counts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Of counts (keys, n), at most 200 rows: the keys that hold HOT of all rows or more."""
    total = counts.agg(F.sum(n).alias("t")).first()["t"] or 0
    return counts.filter(F.col(n) >= F.lit(max(1.0, total * HOT))).select(*keys)


def join_unique(rows: DataFrame, unique: DataFrame, keys: list[str], counts: DataFrame, n: str, salts: int = SALTS, by: list[str] | None = None) -> DataFrame:
    """rows joined (inner) with unique, which has each key once. Rows of hot keys are dealt over `salts` tasks, to each of which the one matching row
    goes; all others join as they are. counts: rows for each key, as keys and n; by: columns that tell rows of one key apart, by default all. Null keys match nothing."""
    hot = F.broadcast(hot_keys(counts, keys, n).withColumn("_hot", F.lit(True)))  # at most 200 rows
    deal = F.when(F.col("_hot"), F.pmod(F.xxhash64(*[F.col(c) for c in by or rows.columns]), F.lit(salts)).cast("int")).otherwise(0)
    left = rows.join(hot, keys, "left").withColumn("_salt", deal).drop("_hot")
    spread = F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    right = unique.join(hot, keys, "left").withColumn("_salt", spread).drop("_hot")
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def numbered(df: DataFrame, by: list[str], order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """df with _no, the row's place (from 1) within its key in an order that leaves no ties, _total, the rows of the key, and _part; and the parts (by, _part, _n, _before, _total) themselves.

    The rows are ranged over keys and order together, so that a key with a third of all rows lies in a third of the parts; a place is that within the part plus the rows of the key in the parts
    before, of which there are few. Null keys are a key. The ranged rows are written, as another sampling would range them otherwise."""
    ranged = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    placed = written(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    starts = placed.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    parts = Window.partitionBy(*by).orderBy("_part")
    before = F.coalesce(F.sum("_n").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("*", before.alias("_before"), F.sum("_n").over(Window.partitionBy(*by)).alias("_total"))
    right = starts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_by_part"), "_first", "_before", "_total")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], F.col("_part") == F.col("_by_part"))
    joined = placed.join(right, same)
    return joined.select(*df.columns, "_part", (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias("_no"), "_total"), starts
