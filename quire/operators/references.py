"""References to records that do not exist: missing, deleted, or there only later."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.skew import join_unique
from quire.session import written


def parents(df: DataFrame, name: str, key: str, available: str, removed: str) -> DataFrame:
    """The keys of a table in long form. Repeated rows are one record, available from the earliest of their times."""
    return df.filter(F.col(key).isNotNull()).select(
        F.lit(name).alias("target"), F.col(key).cast("bigint").alias("ref"), F.lit(1).alias("there"), F.col(removed).isNotNull().cast("int").alias("gone"),
        F.col(available).alias("since"), F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("timestamp").alias("needed"),
    )


def children(df: DataFrame, name: str, target: str, ref: str, key: str = "id", at: str = "loaded_at") -> DataFrame:
    """The references of a table in long form, one row for each record: of repeated rows, the one loaded first. Null references are none."""
    first = F.min(F.struct(F.col(at).isNull().alias("late"), F.col(at).alias("at"), F.col(ref).cast("bigint").alias("ref")))
    one = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("bigint").alias("id")).agg(first.alias("r"))
    return one.select(F.lit(name).alias("table_name"), "id", F.lit(target).alias("target"), F.col("r.ref").alias("ref"), F.col("r.at").alias("loaded_at")).filter("ref IS NOT NULL")


def failing_references(child_tables: list[DataFrame], parent_tables: list[DataFrame]) -> DataFrame:
    """(table_name, id, kind, loaded_at) of the records whose reference fails: `missing`, no record has that key; else `deleted`; else `late`, the
    target became available after the record was loaded (a null time is never late).

    Keys of both sides are grouped in one long table; only the keys that fail, each once, meet the records again, where hot keys are dealt over many tasks."""
    kids = reduce(DataFrame.unionByName, child_tables)
    long = [*parent_tables, kids.select("target", "ref", F.lit(0).alias("there"), F.lit(0).alias("gone"), F.lit(None).cast("timestamp").alias("since"), F.lit(1).cast("bigint").alias("n"), F.col("loaded_at").alias("needed"))]
    keys = (
        reduce(DataFrame.unionByName, long)
        .groupBy("target", "ref")
        .agg(F.max("there").alias("there"), F.max("gone").alias("gone"), F.min("since").alias("since"), F.sum("n").alias("n"), F.min("needed").alias("needed"))
        .filter("n > 0")
    )
    keys = written(keys)  # used for the hot keys and for the join
    bad = keys.filter("there = 0 OR gone = 1 OR since > needed").select("target", "ref", "there", "gone", "since")
    kind = F.when(F.col("there") == 0, "missing").when(F.col("gone") == 1, "deleted").when(F.col("since") > F.col("loaded_at"), "late")
    met = join_unique(kids, bad, ["target", "ref"], keys.select("target", "ref", "n"), "n")
    return met.select("table_name", "id", kind.alias("kind"), "loaded_at").filter("kind IS NOT NULL")


def failing_by_period(found: DataFrame) -> DataFrame:
    """(table_name, month, kind, records): counts by month of loaded_at (`unknown` where it is null)."""
    month = F.coalesce(F.date_format("loaded_at", "yyyy-MM"), F.lit("unknown"))
    return found.groupBy("table_name", month.alias("month"), "kind").agg(F.count(F.lit(1)).alias("records"))
