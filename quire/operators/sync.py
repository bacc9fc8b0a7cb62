"""Differences between what is on disk and what is indexed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import written

KEY = ["corpus", "filepath"]


def snapshot_diff(indexed: DataFrame, disk: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """(change, corpus, filepath, file_hash, from_corpus, from_path) between two tables (corpus, filepath, file_hash, unique corpus and filepath).

    `added`, `removed`, `modified`, `unchanged`; an added file whose hash a removed one had is `moved` (same corpus) or `cross_moved`. Moves pair one to one, by the order of corpus and path within a
    hash. failures (corpus, filepath, file_hash): content that could not be read before and has not changed is `known_failure`."""
    i = indexed.select(*KEY, F.col("file_hash").alias("old_hash"), F.lit(True).alias("was"))
    d = disk.select(*KEY, F.col("file_hash").alias("new_hash"), F.lit(True).alias("is"))
    j = i.join(d, KEY, "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "unchanged").otherwise("modified")
    j = j.withColumn("change", change)
    if failures is not None:
        f = failures.select(*KEY, F.col("file_hash").alias("new_hash"), F.lit(True).alias("failed")).dropDuplicates([*KEY, "new_hash"])
        j = j.join(f, [*KEY, "new_hash"], "left").withColumn("change", F.when(F.col("failed") & F.col("change").isin("added", "modified"), "known_failure").otherwise(F.col("change"))).drop("failed")
    j = written(j)  # read by the branches below
    none = F.lit(None).cast("string")
    same = j.filter("change NOT IN ('added', 'removed')").select("change", *KEY, F.coalesce("new_hash", "old_hash").alias("file_hash"), none.alias("from_corpus"), none.alias("from_path"))
    # what was neither added nor removed takes no part in what follows
    ends = j.filter("change IN ('added', 'removed')").select("change", *KEY, F.coalesce("new_hash", "old_hash").alias("file_hash"))

    def paired(df: DataFrame, by: list[str]) -> DataFrame:
        """Rows (change, ...) with `no`, their number among those of the same hash and change; one of each change with the same number is a pair."""
        return df.withColumn("no", F.row_number().over(Window.partitionBy("change", *by).orderBy(*KEY)))

    def matched(df: DataFrame, by: list[str], move: str) -> tuple[DataFrame, DataFrame]:
        """Moves, and the rows that are in none: one shuffle by hash and number, no join."""
        known = paired(df.filter("file_hash IS NOT NULL"), by)
        place = F.struct(*KEY)
        both = known.groupBy(*by, "no").agg(F.max(F.when(F.col("change") == "removed", place)).alias("old"), F.max(F.when(F.col("change") == "added", place)).alias("new"))
        pairs = both.filter("old IS NOT NULL AND new IS NOT NULL").select(F.lit(move).alias("change"), "new.corpus", "new.filepath", "file_hash", F.col("old.corpus").alias("from_corpus"), F.col("old.filepath").alias("from_path"))
        single = both.filter("old IS NULL OR new IS NULL").select(F.when(F.col("new").isNull(), "removed").otherwise("added").alias("change"), F.coalesce("new", "old").alias("k"), "file_hash")
        return pairs, single.select("change", "k.corpus", "k.filepath", "file_hash")

    near, rest = matched(ends, ["file_hash", "corpus"], "moved")
    far, left = matched(rest, ["file_hash"], "cross_moved")
    left = left.unionByName(ends.filter("file_hash IS NULL")).select("change", *KEY, "file_hash", none.alias("from_corpus"), none.alias("from_path"))
    return same.unionByName(near).unionByName(far).unionByName(left)


def quick_diff(indexed: DataFrame, disk: DataFrame) -> DataFrame:
    """(change, corpus, filepath) by size alone (file_size), without hashes."""
    j = indexed.select(*KEY, F.col("file_size").alias("a"), F.lit(True).alias("was")).join(disk.select(*KEY, F.col("file_size").alias("b"), F.lit(True).alias("is")), KEY, "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("a").eqNullSafe(F.col("b")), "unchanged").otherwise("modified")
    return j.select(change.alias("change"), *KEY)


def confirmed_removals(removed: DataFrame, roots: DataFrame, excluded: str) -> DataFrame:
    """removed (corpus, filepath) that may go: their path is excluded by a rule (a regular expression), or every root of the corpus (corpus, root_path, readable) can be read."""
    state = roots.groupBy("corpus").agg(F.every("readable").alias("all_read"))
    return removed.join(state, "corpus", "left").filter(F.col("filepath").rlike(excluded) | F.coalesce("all_read", F.lit(False))).select(*KEY)


def freshness(indexed: DataFrame, disk: DataFrame, most_bytes: int = 2 << 20) -> DataFrame:
    """(corpus, filepath, verdict): GONE, NEW, STALE or ok. Equal size and an unchanged time are trusted; beyond that small files are compared by hash, large ones by size."""
    i = indexed.select(*KEY, F.col("file_size").alias("s1"), F.col("file_hash").alias("h1"), F.col("indexed_at").alias("at"))
    d = disk.select(*KEY, F.col("file_size").alias("s2"), F.col("file_hash").alias("h2"), F.col("modified_at").alias("m"))
    j = i.withColumn("was", F.lit(True)).join(d.withColumn("is", F.lit(True)), KEY, "full_outer")
    trusted = F.col("s1").eqNullSafe(F.col("s2")) & (F.col("m") < F.col("at") - F.expr("INTERVAL 1 SECOND"))
    differs = F.when(F.col("s2") <= most_bytes, ~F.col("h1").eqNullSafe(F.col("h2"))).otherwise(~F.col("s1").eqNullSafe(F.col("s2")))
    verdict = F.when(F.col("is").isNull(), "GONE").when(F.col("was").isNull(), "NEW").when(trusted, "ok").when(differs, "STALE").otherwise("ok")
    return j.select(*KEY, verdict.alias("verdict"))
