"""A stored inverted index: postings with positions in files sorted by term, and statistics; built once for a state of a table, read by the few terms of a query.

    <index>/postings  (term, key, positions, len), ranged and sorted by term: a query reads the row groups of its terms
    <index>/stats     (n, avg): how many rows there are and how many terms they have on average

Terms are folded and stemmed. Positions count through all columns, with a gap between two, so that a phrase never reaches from one into the next.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import folded_word, phrases, porter_stem
from quire.session import shared_dir, spread
from quire.sources.tables import one_record

K1, B = 1.2, 0.75
#: Positions between two columns.
GAP = 1000
_TERM = re.compile(r"[^\W_]+")


class _Stems(dict):
    """Folded words and their stems; forgotten when there are many, so that a worker's memory stays bounded."""

    def __init__(self, stemmed: bool) -> None:
        super().__init__()
        self.stemmed = stemmed

    def __missing__(self, word: str) -> str:
        if len(self) > 300_000:
            self.clear()
        w = folded_word(word)
        s = self[word] = porter_stem(w) if self.stemmed else w
        return s


def _postings(columns: list[str], stemmed: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stem = _Stems(stemmed)
        for b in batches:
            for at in range(0, len(b), 500):  # postings of a few rows at a time
                some = b.iloc[at : at + 500]
                keys, terms, places, lengths = [], [], [], []
                for row in zip(some["key"], *[some[c] for c in columns], strict=True):
                    held: dict[str, list[int]] = {}
                    place = n = 0
                    for text in row[1:]:
                        for w in map(stem.__getitem__, _TERM.findall(text.lower())) if text else ():
                            held.setdefault(w, []).append(place)
                            place += 1
                            n += 1
                        place += GAP
                    held = held or {"": []}  # a row without terms counts too
                    keys += [row[0]] * len(held)
                    terms += list(held)
                    places += list(held.values())
                    lengths += [n] * len(held)
                yield pd.DataFrame({"term": terms, "key": keys, "positions": places, "len": pd.Series(lengths, dtype="int32")})

    return run


def build(docs: DataFrame, key: str, columns: list[str], path: str, stemmed: bool = True, partitions: int | None = None, at: str | None = None) -> None:
    """Writes the index of docs. Rows with a null key are left out; of repeated keys the row with the earliest `at` counts, or else the smallest. Null columns count as empty."""
    names = [f"c{i}" for i in range(len(columns))]
    shaped = docs.select(F.col(key).alias("key"), *[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)], (F.col(at) if at else F.lit(None).cast("timestamp")).alias("_loaded"))
    one = one_record(spread(shaped), "key", *names, at="_loaded")
    made = one.mapInPandas(_postings(names, stemmed), f"term string, key {dict(docs.dtypes)[key]}, positions array<int>, len int")
    ranged = made.repartitionByRange(*([partitions] if partitions else []), "term", "key").sortWithinPartitions("term", "key")
    # small row groups: a query reads those of its terms alone
    ranged.write.mode("overwrite").option("parquet.block.size", 4 << 20).parquet(f"{path}/postings")
    post = docs.sparkSession.read.parquet(f"{path}/postings")
    per_row = post.groupBy("key").agg(F.max("len").alias("len"))
    per_row.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg")).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def of(docs: DataFrame, key: str, columns: list[str], stemmed: bool = True, at: str | None = None) -> str:
    """The path of docs' index, which is built in the shared folder unless there is one for these columns and exactly these files (names, sizes, times of change). Rows that come from no file are indexed anew each time."""
    spark = docs.sparkSession
    jvm = spark._jvm
    files = []
    for name in docs.inputFiles():
        p = jvm.org.apache.hadoop.fs.Path(name)
        s = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
        files.append((name, s.getLen(), s.getModificationTime()))
    token = hashlib.md5(repr((sorted(files), key, columns, stemmed, at)).encode()).hexdigest() if files else uuid.uuid4().hex
    root = shared_dir(spark)
    mark = f"{root}/quire-index-{token}"
    fs = jvm.org.apache.hadoop.fs.Path(mark).getFileSystem(spark._jsc.hadoopConfiguration())
    final = jvm.org.apache.hadoop.fs.Path(mark)
    if not fs.exists(final):
        aside = f"{root}/quire-index-new-{uuid.uuid4().hex}"
        build(docs, key, columns, aside, stemmed, at=at)
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(aside), final) and not fs.exists(final):  # another session may have been first
            raise OSError(f"cannot place {mark}")
    return mark


def bm25(spark: SparkSession, path: str, query: str, stemmed: bool = True) -> DataFrame:
    """(key, score) of the rows that hold a word of the query, by the index. A word with punctuation inside is a phrase of its parts; one that is repeated counts twice; one held by more than half of
    the rows weighs next to nothing. A query without words finds nothing."""
    asked = [tuple(porter_stem(w) if stemmed else w for w in p) for p in phrases(query)]
    wanted = sorted(set(asked))
    names = sorted({w for p in wanted for w in p})
    hits = spark.read.parquet(f"{path}/postings").filter(F.col("term").isin(names))
    if not wanted:
        return hits.select("key", F.lit(0.0).alias("score")).filter(F.lit(False))
    by_row = hits.groupBy("key").agg(F.first("len").alias("len"), *[F.first(F.when(F.col("term") == w, F.col("positions")), ignorenulls=True).alias(f"p{i}") for i, w in enumerate(names)])
    place = {w: f"p{i}" for i, w in enumerate(names)}

    def held(p: tuple[str, ...]) -> Column:
        """How often a phrase stands in a row; occurrences may overlap only where words differ, as in a scan from the left."""
        moved = lambda w, k: F.transform(F.col(place[w]), lambda x: x - k)
        n = F.size(place[p[0]]) if len(p) == 1 else F.size(reduce(F.array_intersect, [moved(w, k) for k, w in enumerate(p)]))
        return F.greatest(F.coalesce(n, F.lit(0)), F.lit(0))

    counted = by_row.select("key", "len", *[held(p).alias(f"tf_{i}") for i, p in enumerate(wanted)])
    found = counted.filter(reduce(Column.__or__, [F.col(f"tf_{i}") > 0 for i in range(len(wanted))]))
    df = found.agg(*[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(wanted))]).first()
    s = spark.read.parquet(f"{path}/stats").first()
    score = F.lit(0.0)
    for i, p in enumerate(wanted):
        n = df[f"df_{i}"] or 0
        idf = F.log(F.lit((s["n"] - n + 0.5) / (n + 0.5)))
        tf = F.col(f"tf_{i}")
        score = score + asked.count(p) * F.when(idf > 0, idf).otherwise(1e-6) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / (s["avg"] or 1.0)))
    return found.select("key", score.alias("score"))


def search(docs: DataFrame, key: str, columns: list[str], query: str, keep: list[str] | None = None, where: Column | None = None, at: str | None = None, stemmed: bool = True, most: int | None = None) -> DataFrame:
    """(key, keep..., score) of the rows of docs that hold a word of the query: bm25 over the table's index, joined with the columns that are kept. Statistics are those of all rows, also where `where`
    limits the results. Only hits are joined, and only the kept columns are read; without `where`, of the best `most` hits alone."""
    found = bm25(docs.sparkSession, of(docs, key, columns, stemmed, at), query, stemmed).withColumnRenamed("key", key)
    if most is not None and where is None:
        found = found.orderBy(F.desc("score"), key).limit(most)
    if not keep and where is None:
        return found
    own = docs.select("*") if where is not None else docs.select(key, *(keep or []), *([at] if at else []))
    if most is not None and where is None:
        own = own.join(F.broadcast(found.select(key)), key, "left_semi")  # `most` rows
    wanted = keep or []
    own = one_record(own, key, *wanted, at=at) if at else own.select(key, *wanted).dropDuplicates([key])
    j = found.join(own, key)
    return (j if where is None else j.filter(where)).select(key, *wanted, "score")
